"""Hard negatives by exact inner products in a residue number system.

Vectors become integers. Their products are taken modulo several primes below 512 by float32 matrix
products, which are exact as long as 256 components are summed at once: residues lie within 255 of
zero, and 256 * 255**2 is below 2**24. The primes are as many as the longest vector needs, and Chinese
remaindering (in mixed radix) gives back the signed 64-bit scores.

All rows meet all anchors in blocks: anchors are dealt into groups and rows into others, each pair of
groups is one matrix product in one task, and only the few best of a block for each anchor, or for
each anchor and positive, leave it. Windows then select among the blocks' best.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablesmith.session import scratch_tables, stored

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LEAST, MOST = 50, 95  # percent of the positive's score
ANCHOR_GROUP = 1_024
ROW_GROUP = 2_048
MAX_SCORE = 1 << 55  # products with percentages stay within 64 bits
CHUNK = 256  # components summed at once

# The primes below 512, the largest first, as many as 64-bit scores can need.
PRIMES = tuple(p for p in range(511, 400, -1) if all(p % d for d in range(2, 23)))


def moduli(bound: int) -> tuple[int, ...]:
    """The fewest of ``PRIMES`` whose product tells all numbers from ``-bound`` to ``bound`` apart."""
    out, product = [], 1
    for p in PRIMES:
        out.append(p)
        product *= p
        if product > 2 * bound:
            return tuple(out)
    raise ValueError("more than 64 bits")


def residues(values: np.ndarray, prime: int) -> np.ndarray:
    """Values modulo ``prime`` nearest to zero, as float32."""
    r = values % prime
    return np.where(r > prime // 2, r - prime, r).astype(np.float32)


def products(left: np.ndarray, right: np.ndarray, bound: int) -> np.ndarray:
    """The exact inner products of the rows of two int64 matrices, each at most ``bound`` in size."""
    value = np.zeros((len(left), len(right)), np.int64)
    base = 1
    for p in moduli(bound):
        a, b = residues(left, p), residues(right, p)
        total = np.zeros(value.shape, np.int64)
        for k in range(0, left.shape[1], CHUNK):
            total += (a[:, k : k + CHUNK] @ b[:, k : k + CHUNK].T).astype(np.int64)
        # the next digit: what is missing to the remainder modulo p, in [-p/2, p/2]
        digit = (total - value) % p * pow(base, -1, p) % p
        digit[digit > p // 2] -= p
        value += base * digit
        base *= p
    return value


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Rows of equal length; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    row = np.repeat(np.arange(len(vectors)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = vectors.flatten().to_numpy()
    return out


def _blocks(anchors: DataFrame, rows: DataFrame, pick: Callable, schema: str, width: int, bound: int, groups: tuple[int, int]) -> DataFrame:
    """What ``pick(anchors, rows, scores)`` returns for each pair of groups; rows come in order of their ids."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return of_kind.empty_table()
        order = [("late", "ascending"), ("vec_id", "ascending"), ("row", "ascending")]
        right = right.take(pc.sort_indices(right.select(["late", "vec_id", "row"]), order))
        scores = products(*(_matrix(t.column("v").combine_chunks(), width) for t in (left, right)), bound)
        return pick(left, right, scores)

    of_kind = to_arrow_schema(T.StructType.fromDDL(schema))
    many, few = groups
    left = anchors.withColumn("rg", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    right = rows.withColumn("ag", F.explode(F.sequence(F.lit(0), F.lit(few - 1))))
    return left.groupBy("ag", "rg").cogroup(right.groupBy("ag", "rg")).applyInArrow(work, schema)


def _int(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _best_positives(count: int) -> Callable:
    def pick(left: pa.Table, right: pa.Table, scores: np.ndarray) -> pa.Table:
        anchor, label, own = (_int(left, c) for c in ("row", "label", "vec_id"))
        other, labels = _int(right, "row"), _int(right, "label")
        out = []
        for i in range(len(anchor)):
            at = np.flatnonzero((labels == label[i]) & (other != anchor[i]))
            out.append(at[np.argsort(-scores[i, at], kind="stable")[:count]])
        of, at = np.repeat(np.arange(len(out)), [len(x) for x in out]), np.concatenate([np.zeros(0, np.int64), *out])
        cols = {"row": anchor[of], "anchor_id": own[of], "positive": other[at], "late": _int(right, "late")[at]}
        return pa.table({**cols, "positive_id": right.column("vec_id").take(pa.array(at)), "positive_score": scores[of, at]})

    return pick


def _best_negatives(count: int, least: int, most: int) -> Callable:
    def pick(left: pa.Table, right: pa.Table, scores: np.ndarray) -> pa.Table:
        label, labels = _int(left, "label"), _int(right, "label")
        pairs, places, values = [], [], []
        for i, wanted in enumerate(left.column("positives").combine_chunks()):
            at = np.flatnonzero(labels != label[i])
            s = scores[i, at]
            order = np.argsort(-s, kind="stable")
            falling = -s[order]
            for p in wanted:
                score = p["positive_score"].as_py()
                # from the first at most ``most`` percent to the last of at least ``least`` percent
                high, low = most * score // 100, -(-least * score // 100)
                a, b = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
                for j in order[a : min(b, a + count)]:
                    pairs.append((i, p["positive"].as_py(), p["positive_id"].as_py(), score))
                    places.append(at[j])
                    values.append(s[j])
        of, positive, positive_id, score = zip(*pairs) if pairs else ((), (), (), ())
        take = pa.array(np.array(places, np.int64))
        return pa.table({
            "row": left.column("row").take(pa.array(of, pa.int64())), "anchor_id": left.column("vec_id").take(pa.array(of, pa.int64())),
            "positive": pa.array(positive, pa.int64()), "positive_id": pa.array(positive_id, pa.int64()), "positive_score": pa.array(score, pa.int64()),
            "negative_id": right.column("vec_id").take(take), "negative": right.column("row").take(take), "late": right.column("late").take(take),
            "negative_score": pa.array(np.array(values, np.int64)),
        })

    return pick


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``label``, ``v``: whole components ``floor(scale * x)`` of the rows that take part."""
    usable = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    x = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.when(usable, x).alias("x"))
    rows = rows.where(F.col("x").isNotNull()).where(F.forall("x", finite))
    return rows.select("vec_id", "label", F.transform("x", lambda x: F.floor(scale * x)).alias("v"))


def flipped(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Labels moved on by one (of ``labels``) where the id is divisible by ``every``: noise with a known answer."""
    moved = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    return rows.withColumn("label", F.when(moved, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def hard_negatives(
    rows: DataFrame, anchors_where: str = "vec_id % 50 = 0", positives: int = POSITIVES, negatives: int = NEGATIVES,
    least: int = LEAST, most: int = MOST, anchor_group: int = ANCHOR_GROUP, row_group: int = ROW_GROUP,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``rows`` has ``vec_id``, ``label`` and whole components ``v`` (see ``integer_vectors``); extra columns
    are not looked at. A score is the integer inner product with the anchor. An anchor's positives are
    its first ``positives`` other rows of the same label, and each has the first ``negatives`` rows of
    other labels whose score lies from ``least`` to ``most`` percent of its own (none if that is
    negative). Higher scores come first, ties by lesser id, null ids last. Repeated rows are rows of
    their own, each an anchor, positive or negative like any other. A shorter vector counts as if zeros
    followed, an empty one scores zero; an empty table gives no rows. Scores of 2**55 or more raise.
    """
    spark = rows.sparkSession
    with scratch_tables(spark) as keep:
        size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        table = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("vec_id").isNull().cast("int").alias("late"), F.col("label").cast("long").alias("label"), "v")
        table = keep(table, "vectors")
        n, heads, width, longest = table.agg(F.count(F.lit(1)), F.count_if(F.expr(anchors_where)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.max(size)).first()
        nothing = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        if not heads:
            return spark.createDataFrame([], nothing)
        bound = int(longest * 1.000001) + 1  # no score exceeds the square of the longest vector
        if bound >= MAX_SCORE:
            raise ValueError("scores may reach 2**55: scale the vectors by less")
        groups = (-(-n // row_group), -(-heads // anchor_group))
        deal = lambda count, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(count)).cast("int")
        dealt = table.withColumn("rg", deal(groups[0], 1))
        anchors = keep(table.where(anchors_where).withColumn("ag", deal(groups[1], 2)).select("ag", "row", "vec_id", "label", "v"), "anchors")

        kind = "row long, anchor_id long, positive long, late int, positive_id long, positive_score long"
        first = _blocks(anchors, dealt, _best_positives(positives), kind, width, bound, groups)
        order = Window.partitionBy("row").orderBy(F.desc("positive_score"), "late", "positive_id", "positive")
        first = first.withColumn("at", F.row_number().over(order)).where(F.col("at") <= positives)
        of = first.groupBy("row").agg(F.collect_list(F.struct("positive", "positive_id", "positive_score")).alias("positives"))
        ready = keep(anchors.join(of, "row"), "ready-anchors")

        kind = "row long, anchor_id long, positive long, positive_id long, positive_score long, negative_id long, negative long, late int, negative_score long"
        best = _blocks(ready, dealt, _best_negatives(negatives, least, most), kind, width, bound, groups)
        order = Window.partitionBy("row", "positive").orderBy(F.desc("negative_score"), "late", "negative_id", "negative")
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        return stored(best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
