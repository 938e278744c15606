"""Value repairs. Each returns struct(new, method, confidence, reason); a null method means
nothing to record, and then ``new`` is the value as it came in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablesmith.functions import dates, patterns, text
from tablesmith.functions.binding import let

Repair = Callable[[Column], Column]


def outcome(new: Column, method: Column | str, confidence: Column | float, reason: Column | str) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        new.alias("new"),
        as_col(method).cast("string").alias("method"),
        as_col(confidence).cast("double").alias("confidence"),
        as_col(reason).cast("string").alias("reason"),
    )


def unchanged(value: Column) -> Column:
    return outcome(value, F.lit(None), F.lit(None), F.lit(None))


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.try_element_at(table, key)


def sentinel(v: Column) -> Column:
    return F.when(
        text.is_sentinel(v),
        outcome(
            F.lit(None).cast("string"),
            "sentinel_detection",
            1.0,
            F.concat(F.lit("Value '"), v, F.lit("' stands for a missing value.")),
        ),
    ).otherwise(unchanged(v))


def tidy_text(v: Column, new: Column) -> Column:
    """``new`` is the tidied value (it takes an Arrow call, which cannot sit inside a lambda)."""
    note = "White space, Unicode form and invisible characters."
    return F.when(new != v, outcome(new, "text_normalization", 0.99, note)).otherwise(unchanged(v))


def name_case(v: Column) -> Column:
    def judge(s: Column) -> Column:
        skip = s.rlike("^[0-9]+$") | (F.length(s) <= 1)
        raised = text.capitalise_after(F.lower(s), r"\s\-'")
        return let(
            raised,
            lambda new: F.when(
                ~skip & (new != s), outcome(new, "name_standardization", 0.95, "Name written in title case.")
            ).otherwise(unchanged(v)),
        )

    return let(text.strip(v), judge)


def category(mapping: dict[str, str], label: str) -> Repair:
    def repair(v: Column) -> Column:
        def judge(pair: Column) -> Column:
            s, new = pair.getField("s"), pair.getField("new")
            reason = F.concat(F.lit("Category '"), v, F.lit("' written as '"), new, F.lit(f"' ({label})."))
            return F.when(new != s, outcome(new, "category_mapping", 0.98, reason)).otherwise(unchanged(v))

        return let(
            text.strip(v),
            lambda s: let(F.struct(s.alias("s"), _lookup(mapping, F.lower(s)).alias("new")), judge),
        )

    return repair


def email(v: Column) -> Column:
    def mended(joined: Column) -> Column:
        """One ``@`` (further ones become dots) and a dotted domain."""

        def join(parts: Column) -> Column:
            tail = F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 1), ".")
            address = let(
                tail,
                lambda t: F.concat(
                    F.get(parts, F.lit(0)), F.lit("@"), t,
                    F.when(F.contains(t, F.lit(".")), F.lit("")).otherwise(F.lit(".com")),
                ),
            )
            return F.when(F.size(parts) > 1, address).otherwise(joined)

        return let(F.split(joined, "@", -1), join)

    flagged = outcome(
        v, "invalid_email_flag", 0.0, F.concat(F.lit("Email '"), v, F.lit("' is invalid and has no safe repair."))
    )

    def judge(s: Column) -> Column:
        def mend(fixed: Column) -> Column:
            reason = F.concat(F.lit("Repaired '"), s, F.lit("' to '"), fixed, F.lit("'."))
            usable = fixed.rlike(patterns.EMAIL) & (fixed != s)
            return F.when(usable, outcome(fixed, "email_repair", 0.85, reason)).otherwise(flagged)

        repaired = let(let(F.replace(s, F.lit(" "), F.lit("")), mended), mend)
        fine = s.isNull() | (F.length(s) == 0) | s.rlike(patterns.EMAIL)
        return F.when(fine, unchanged(v)).otherwise(repaired)

    return let(text.strip(v), judge)


def date_text(v: Column) -> Column:
    def judge(pair: Column) -> Column:
        s, new = pair.getField("s"), pair.getField("new")
        reason = F.concat(F.lit("Read '"), s, F.lit("' as '"), new, F.lit("'."))
        return F.when(new != s, outcome(new, "date_standardization", 0.98, reason)).otherwise(unchanged(v))

    def read(s: Column) -> Column:
        return let(F.struct(s.alias("s"), F.date_format(dates.parse_date(s), "yyyy-MM-dd").alias("new")), judge)

    return let(text.strip(v), read)


def date_value(v: Column) -> Column:
    """A date or timestamp column: the time of day is dropped, every value is recorded."""
    new = F.date_trunc("day", v)
    return F.when(v.isNotNull(), outcome(new, "date_standardization", 0.99, "")).otherwise(unchanged(v))


def _phone_form(digits: Column) -> Column:
    size = F.length(digits)

    def cut(start: Column | int, length: int | Column) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return digits.substr(as_col(start), as_col(length))

    dash = F.lit("-")
    return (
        F.when(
            size > 10,
            F.concat(F.lit("+"), cut(1, size - 10), dash, cut(size - 9, 3), dash, cut(size - 6, 3), dash, cut(size - 3, 4)),
        )
        .when(size == 10, F.concat(cut(1, 3), dash, cut(4, 3), dash, cut(7, 4)))
        .when(size == 7, F.concat(cut(1, 3), dash, cut(4, 4)))
        .otherwise(digits)
    )


def phone(v: Column) -> Column:
    flagged = outcome(v, "invalid_phone_flag", 0.0, F.concat(F.lit("Phone '"), v, F.lit("' is invalid.")))

    def judge(s: Column) -> Column:
        def form(digits: Column) -> Column:
            def written(new: Column) -> Column:
                reason = F.concat(F.lit("Wrote '"), s, F.lit("' as '"), new, F.lit("'."))
                return F.when(new != s, outcome(new, "phone_standardization", 0.92, reason)).otherwise(unchanged(v))

            return F.when(F.length(digits) < 7, flagged).otherwise(let(_phone_form(digits), written))

        kept = F.regexp_replace(F.regexp_replace(s, r"[^\d+]", ""), r"^\+", "")
        return F.when(s.isNull() | (F.length(s) == 0), unchanged(v)).otherwise(let(kept, form))

    return let(text.strip(v), judge)


def address(v: Column) -> Column:
    def word(w: Column) -> Column:
        def choose(seen: Column) -> Column:
            letters, street, stem = (seen.getField(k) for k in ("letters", "street", "stem"))
            tail = w.substr(F.length(stem) + 1, F.length(w))
            return (
                F.when(street.isNotNull() & (F.lower(stem) == letters), F.concat(street, tail))
                .when(street.isNotNull(), w)
                .when(letters.isin(patterns.STATE_CODES), F.upper(letters))
                .otherwise(w)
            )

        stem = F.regexp_replace(w, "[,.;]+$", "")
        return let(
            F.lower(F.regexp_replace(w, "[^a-zA-Z]", "")),
            lambda k: let(
                F.struct(k.alias("letters"), _lookup(patterns.STREETS, k).alias("street"), stem.alias("stem")), choose
            ),
        )

    def judge(pair: Column) -> Column:
        s, new = pair.getField("s"), pair.getField("new")
        reason = F.concat(F.lit("Wrote '"), s, F.lit("' as '"), new, F.lit("'."))
        changed = (F.length(s) > 0) & (new != s)
        return F.when(changed, outcome(new, "address_standardization", 0.90, reason)).otherwise(unchanged(v))

    def rewrite(s: Column) -> Column:
        words = F.transform(F.split(text.collapse_space(s), " ", -1), word)
        new = text.capitalise_after(F.array_join(words, " "), r"\s#")
        return let(F.struct(s.alias("s"), new.alias("new")), judge)

    return let(text.strip(v), rewrite)


def url(v: Column) -> Column:
    def judge(s: Column) -> Column:
        has_protocol = s.startswith("http://") | s.startswith("https://") | s.startswith("ftp://")
        new, reason = F.concat(F.lit("https://"), s), F.concat(F.lit("Added https:// to '"), s, F.lit("'."))
        dotted = F.contains(s, F.lit(".")) & ~F.contains(s, F.lit(" "))
        return (
            F.when(has_protocol | (F.length(s) == 0), unchanged(v))
            .when(s.startswith("www."), outcome(new, "url_standardization", 0.95, reason))
            .when(dotted, outcome(new, "url_standardization", 0.90, reason))
            .otherwise(unchanged(v))
        )

    return let(text.strip(v), judge)
