"""Span columns: finding, filtering, resolving and replacing half-open character ranges, all in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PRIORITY

SPAN = "struct<start:int,end:int,entity_type:string,score:double,source:string,value:string>"
SPANS = f"array<{SPAN}>"


def let(value: Column, body) -> Column:
    """body(value); value is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def span(start: Column, end: Column, entity: Column | str, score: Column | float, source: Column | str, value: Column | None = None) -> Column:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), col(entity).alias("entity_type"), col(score).cast("double").alias("score"), col(source).alias("source"),
        (value if value is not None else F.lit(None)).cast("string").alias("value"),
    )


def no_spans() -> Column:
    return F.array().cast(SPANS)


def matches(text: Column, pattern: str | Column) -> Column:
    """All matches of a pattern (that can't match nothing; a column: another one for each row) as
    array<struct<start,end,value>>.

    The pieces between matches and the matches alternate, so places are running sums of their lengths. Texts without a
    match cost one search.
    """
    p = pattern if isinstance(pattern, Column) else F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    gaps = F.transform(F.split(text, p, F.lit(-1)), F.length)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def places(g: Column, m: Column) -> Column:
        step = lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["value"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))).alias("out"),
        )
        pairs = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: F.struct(a.alias("gap"), b.alias("value")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    return F.when(F.rlike(text, p), let(gaps, lambda g: let(found, lambda m: places(g, m)))).otherwise(empty)


def given(text: Column, condition, body) -> Column:
    """body(text) for texts that meet a condition, else no spans; both the text and the condition are computed once."""
    return F.when(condition(text), body(text)).otherwise(no_spans())


def find_spans(text: Column, pattern: str, entity: str, score: float, source: str) -> Column:
    """Matches of a pattern as spans."""
    return F.transform(matches(text, pattern), lambda m: span(m["start"], m["end"], entity, score, source))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def rank(entity: Column) -> Column:
    """Place in the order of preference; unknown types come last."""
    at = F.array_position(F.array(*map(F.lit, PRIORITY)), entity).cast("int")
    return F.when(at > 0, at).otherwise(F.lit(10_000))


def resolve_overlaps(spans: Column) -> Column:
    """Longest first, then by type, score and place: a span stays if it overlaps none that stays. In order of start."""
    def resolved(spans: Column) -> Column:
        keyed = F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("k1"), rank(s["entity_type"]).alias("k2"), (-s["score"]).alias("k3"), s["start"].alias("k4"), s.alias("s")))
        keep = F.aggregate(
            F.array_sort(keyed), no_spans(),
            lambda kept, x: F.when(F.exists(kept, lambda k: overlaps(k, x["s"])), kept).otherwise(F.concat(kept, F.array(x["s"]))),
        )
        return F.when(F.size(spans) < 2, spans).otherwise(F.array_sort(keep))

    return let(spans, resolved)


def value_of(text: Column, s: Column) -> Column:
    return F.substring(text, s["start"] + 1, s["end"] - s["start"])


def splice(text: Column, replacements: Column) -> Column:
    """text with ranges replaced. replacements: array<struct<start,end,fake>>, in order and not overlapping."""
    end = F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit("").alias("fake"))
    step = lambda acc, r: F.struct(r["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, r["start"] - acc["at"]), r["fake"])).alias("out"))
    parts = F.aggregate(F.concat(replacements, F.array(end)), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(replacements) == 0, text).otherwise(F.array_join(parts, ""))


def last_words(text: Column, n: int = 5) -> Column:
    """The last n words of a text, lower-cased and parted by blanks."""
    found = F.regexp_extract_all(F.lower(F.right(text, F.lit(200))), F.lit(r"(?U)[\w][\w.]*"), F.lit(0))
    return let(found, lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.lit(n)), " "))
