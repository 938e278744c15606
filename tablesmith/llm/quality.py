"""Quality rules with host verdicts, in built-in functions only.

Documents are measured one by one. The shares of documents that break a rule are then taken by
host; a beta prior fitted to all hosts by moments pulls the rate of a small host towards the
average; hosts whose shrunk rate is too high lose all their documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.functions.binding import let
from tablesmith.llm.common import BLANKS, keep, text_of

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("too_short", "repetitive", "symbol_heavy", "odd_words", "line_copies")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS[1:], " " * (len(BLANKS) - 1)), " "), "")


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are sorted by hash with their places, so copies are neighbours; the places of copies
    in order then cover three words each, less what the next one covers too.
    """

    def covered(places: Column) -> Column:
        step = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def copies(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def window(w: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))

    def count(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: window(w, i))
        return F.when(F.size(w) >= 3, let(F.sort_array(windows), lambda s: let(copies(s), covered))).otherwise(F.lit(0).cast("long"))

    return F.struct(F.size(words).cast("long").alias("n_words"), count(words).alias("n_repeat_words"))


def measure(docs: DataFrame, text_col: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all unless named) plus MEASURES and ``n_lines`` (lines with a word), which replace columns of these names."""
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), F.size(F.array_distinct(x)).cast("long").alias("own")))
    others = [c for c in (docs.columns if carry is None else carry) if c not in (*MEASURES, "n_lines")]
    with_structs = docs.select(F.struct(*others).alias("row"), let(_words(text_of(text_col)), _repeated).alias("w"), lined.alias("l"), text.alias("t"))
    return with_structs.select(
        *[F.col("row")[c].alias(c) for c in others],
        F.col("w.n_words"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.col("l.all") - F.col("l.own")).alias("n_dup_lines"),
        F.col("w.n_repeat_words"),
        F.col("l.all").alias("n_lines"),
    )


def rule_failures() -> dict[str, Column]:
    """Each rule as a condition over the measures, true where it is broken.

    Integer arithmetic only, so every engine decides alike.
    """
    return {
        "too_short": F.col("n_words") < 50,
        "repetitive": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbol_heavy": 100 * F.col("n_symbols") > 20 * F.col("word_chars"),
        "odd_words": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        "line_copies": 100 * F.col("n_dup_lines") > 50 * F.col("n_lines"),
    }


def host_verdicts(measured: DataFrame, host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row per host: documents, failures by rule, prior ``alpha`` and ``beta``, ``shrunk_rate``, ``rejected``.

    The prior takes mean and variance of the hosts' failure rates, each host counted once. When
    they vary less than chance allows (or there is one host) the prior counts as ``n_docs`` of an
    average host, all at the mean. Documents without a host have no verdict.
    """
    broken = rule_failures()
    failed = F.array_max(F.array(*[c.cast("int") for c in broken.values()]))
    hosts = (
        measured.where(F.col(host_col).isNotNull())
        .groupBy(F.col(host_col).alias("host"))
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.sum(failed).alias("n_failed"),
            *[F.sum(c.cast("int")).alias(f"n_{name}") for name, c in broken.items()],
        )
    )
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg("n_docs").alias("size")).first()
    mean, var, size = prior["mean"] or 0.0, prior["var"] or 0.0, prior["size"] or 0.0
    weight = mean * (1 - mean) / var - 1 if var > 0 else 0.0
    weight = weight if weight > 0 else size
    alpha, beta = mean * weight, (1 - mean) * weight
    shrunk = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    return hosts.select(
        "*", F.lit(alpha).alias("alpha"), F.lit(beta).alias("beta"), shrunk.alias("shrunk_rate"), (shrunk > max_rate).alias("rejected")
    )


def quality_rules(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", max_rate: float = 0.5, carry: Sequence[str] | None = None
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all unless named; the host is always one) plus the measures, ``base_failed``, ``host_rejected`` and ``kept``.

    A null or empty text has no words and fails; a null host has no verdict, so its documents
    stand or fall alone. Repeated rows each count. Columns of the added names are replaced.
    """
    # measured once and written: the aggregate and the join both read the few small columns
    added = (*MEASURES, "n_lines", "base_failed", "host_rejected", "kept")
    columns = [c for c in (docs.columns if carry is None else dict.fromkeys([*carry, host_col])) if c not in added]
    measured = keep(measure(docs, text_col, columns), "measures")
    broken = rule_failures()
    # written too: hosts are few, so Spark knows whether they can be broadcast, and else can split a hot host
    rejected = keep(host_verdicts(measured, host_col, max_rate).where("rejected").select(F.col("host").alias(host_col), F.lit(True).alias("host_rejected")), "hosts")
    base = broken["too_short"] | broken["repetitive"]
    judged = measured.join(rejected, host_col, "left").withColumn("base_failed", base)
    judged = judged.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False)))
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
