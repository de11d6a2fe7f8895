"""Scores of predicted spans against gold ones: tokens, entities, boxes and leaks, as mergeable aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.spans import matches
from ..functions.text import mask, squeezed, tokens
from ..staging import numbered, saved
from .docpass import candidates, pattern_of

TOKEN = r"(?U)\w+(?:[.'’@-]\w+)*|[^\w\s]"


def token_labels(units: DataFrame, gold: str = "entities", predicted: str = "spans") -> DataFrame:
    """A row for each token: unit columns, start, end, token, g and p: types of the first gold and the first predicted
    span that overlaps it, and where that gold span begins."""
    keys = [c for c in ("doc_id", "unit_id") if c in units.columns]
    rows = units.select(*keys, F.col(gold).alias("_g"), F.col(predicted).alias("_p"), F.explode(matches(F.col("text"), TOKEN)).alias("t"))
    hit = lambda spans: F.get(F.filter(spans, lambda s: (s["start"] < F.col("t.end")) & (F.col("t.start") < s["end"])), F.lit(0))
    rows = rows.withColumn("_g", hit(F.col("_g"))).withColumn("_p", hit(F.col("_p")))
    return rows.select(*keys, F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.col("t.value").alias("token"), F.col("_g.type").alias("g"), F.col("_p.entity_type").alias("p"), F.col("_g.start").alias("gold_start"))


def _counts(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    return [F.count_if(x).alias(k) for k, x in (("tp", tp), ("fp", fp), ("fn", fn), ("tn", tn))]


def with_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy to four places; null where undefined, F1 0 where precision or recall is 0."""
    ratio = lambda a, b: F.try_divide(a.cast("double"), b)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(p.isNotNull() & r.isNotNull(), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))
    four = lambda x: F.round(x, 4)
    return counts.withColumns({"precision": four(p), "recall": four(r), "f1": four(f1), "accuracy": four(ratio(tp + tn, tp + fp + fn + tn))})


def token_confusion(labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts whatever the type: a token is a hit if it is in a gold and in a predicted span."""
    g, p = F.col("g").isNotNull(), F.col("p").isNotNull()
    return with_rates(labels.groupBy(*(by or [])).agg(*_counts(g & p, ~g & p, g & ~p, ~g & ~p)))


def type_confusion(labels: DataFrame) -> DataFrame:
    """Counts by type; a mismatch is a miss of the gold type and a false hit of the predicted one."""
    rows = labels.select("g", "p", F.explode(F.filter(F.array_distinct(F.array("g", "p")), lambda x: x.isNotNull())).alias("entity_type"))
    t = F.col("entity_type")
    g, p = F.coalesce(F.col("g") == t, F.lit(False)), F.coalesce(F.col("p") == t, F.lit(False))
    return with_rates(rows.groupBy("entity_type").agg(*_counts(g & p, ~g & p, g & ~p, F.lit(False))))


def entity_status(labels: DataFrame) -> DataFrame:
    """A row for each gold span: type and status, full, partial or missed, by its covered tokens."""
    keys = [c for c in ("doc_id", "unit_id") if c in labels.columns]
    rows = labels.where(F.col("g").isNotNull()).groupBy(*keys, "gold_start", F.col("g").alias("entity_type")).agg(F.count("*").alias("n"), F.count_if(F.col("p").isNotNull()).alias("covered"))
    return rows.select(*keys, "gold_start", "entity_type", F.when(F.col("covered") == F.col("n"), "full").when(F.col("covered") > 0, "partial").otherwise("missed").alias("status"))


def status_totals(status: DataFrame) -> DataFrame:
    """Counts of each status by type, and for all types (ALL)."""
    counts = [F.count_if(F.col("status") == x).alias(x) for x in ("full", "partial", "missed")]
    rows = status.rollup("entity_type").agg(F.grouping("entity_type").alias("_all"), *counts, F.count("*").alias("total"))
    return rows.withColumn("entity_type", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("entity_type"))).drop("_all")


def errors(labels: DataFrame, kind: str) -> DataFrame:
    """False hits ('fp') or misses ('fn') with their number, masked, the most frequent first."""
    cond = F.col("g").isNull() & F.col("p").isNotNull() if kind == "fp" else F.col("g").isNotNull() & F.col("p").isNull()
    label = F.col("p") if kind == "fp" else F.col("g")
    rows = labels.where(cond).groupBy(label.alias("entity_type"), mask(F.col("token")).alias("masked")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "entity_type", "masked")


#: Rows that a task numbers.
RANGE_ROWS = 1_000_000


def _occurrences(rows: DataFrame, order: str) -> DataFrame:
    """rows (with sha1) with _n, the number of the row among those of its digest; empty and boilerplate texts may be many."""
    rows = saved(rows, "digests")
    return numbered(rows, ["sha1"], [order], max(1, -(-rows.count() // RANGE_ROWS)), "by-digest").withColumnRenamed("at", "_n").drop("of")


def match_by_hash(gold: DataFrame, units: DataFrame, columns: list[str]) -> DataFrame:
    """Gold units joined to units of equal text digest; equal texts are used up in order. Unmatched gold keeps nulls."""
    left = gold.withColumn("sha1", F.coalesce("sha1", F.sha1("text")) if "text" in gold.columns else F.col("sha1"))
    names = left.columns
    left, without = left.where("sha1 is not null"), left.where("sha1 is null").withColumn("_n", F.lit(None).cast("bigint"))
    right = units.withColumn("sha1", F.sha1("text")).where("sha1 is not null").select("sha1", F.col("unit_id").alias("_order"), *columns)
    left = _occurrences(left, "gold_id").select(*names, "_n").unionByName(without)
    return left.join(_occurrences(right, "_order").drop("_order"), ["sha1", "_n"], "left").drop("_n")


def match_by_index(gold: DataFrame, units: DataFrame) -> DataFrame:
    """Gold units joined to units by their index; a unit whose text has another digest ends the run."""
    rows = gold.join(units.withColumn("_sha1", F.sha1("text")), "unit_id", "left")
    wrong = ~F.coalesce(F.col("_sha1") == F.col("sha1"), F.lit(False))
    message = F.concat(F.lit("gold unit doesn't match the text at index "), F.col("unit_id").cast("string"))
    return rows.withColumn("text", F.when(wrong, F.raise_error(message)).otherwise(F.col("text"))).drop("_sha1")


def leaks(gold: DataFrame, redacted: DataFrame) -> DataFrame:
    """Gold values that can still be read in redacted texts: entity_type, checked, leaked.

    gold: doc_id, entity_type, value; redacted: doc_id, text. Values of under four characters and those of generic,
    company or state words only aren't checked; each value of a document once. Values meet the documents that have their
    first piece, as sets of pieces, and then these documents' texts, once.
    """
    generic = F.array(*map(F.lit, sorted(C.GENERIC | C.ORG_WORDS | {w for s in C.STATES for w in s.split()} | {"india", "of", "and", "&"})))
    value = squeezed(F.col("value"))
    wanted = gold.select("doc_id", "entity_type", F.lower(value).alias("key")).where(F.length("key") >= 4)
    wanted = wanted.where(~F.forall(tokens(F.col("key")), lambda t: F.array_contains(generic, F.rtrim(t, F.lit("."))))).dropDuplicates(["doc_id", "key"])
    hold = candidates(redacted, wanted.select("doc_id", "key"), ["doc_id"], [])
    read = lambda k: F.rlike(F.col("text"), F.concat(F.lit("(?iuU)"), pattern_of(k["key"])))
    found = redacted.select("doc_id", "text").join(hold, "doc_id").select("doc_id", F.explode(F.filter("_keys", read)).alias("k")).select("doc_id", "k.key").distinct().withColumn("_hit", F.lit(1))
    rows = wanted.join(found, ["doc_id", "key"], "left")
    return rows.groupBy("entity_type").agg(F.count("*").alias("checked"), F.count("_hit").alias("leaked"))


def box_scores(coverage: DataFrame) -> DataFrame:
    """coverage: pii, covered (share of a gold box that is painted). Boxes hidden (0.9 or more) and wrongly hidden (0.5)."""
    return coverage.agg(
        F.count_if("pii").alias("pii_boxes"), F.count_if(F.col("pii") & (F.col("covered") >= 0.9)).alias("pii_hidden"),
        F.count_if(~F.col("pii")).alias("other_boxes"), F.count_if(~F.col("pii") & (F.col("covered") >= 0.5)).alias("other_hidden"),
    )


__all__ = ["token_labels", "token_confusion", "type_confusion", "entity_status", "status_totals", "errors", "match_by_hash", "match_by_index", "leaks", "box_scores", "with_rates"]
