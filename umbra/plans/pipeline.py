"""From units to redacted units and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import docpass, recognizers, replace
from ..staging import saved


@dataclass
class Detections:
    units: DataFrame
    known: DataFrame

    def by_type(self) -> DataFrame:
        return counts(self.units, "entity_type")

    def by_source(self) -> DataFrame:
        return counts(self.units, "source")


def counts(units: DataFrame, column: str) -> DataFrame:
    return units.select(F.explode("spans").alias("s")).groupBy(F.col(f"s.{column}").alias(column)).agg(F.count("*").alias("n"))


def as_units(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plain documents as units, one for each line that isn't blank, in order; all lines of a document are one container."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.filter(F.split(text_col, "\n"), lambda x: F.btrim(x) != "").alias("lines"))
    rows = rows.select("doc_id", F.posexplode("lines").alias("unit_id", "text"))
    return rows.select("doc_id", "unit_id", "text", F.array().cast("array<string>").alias("context"), F.lit("body").alias("container_id"))


def detect(units: DataFrame, config: C.RunConfig | None = None, stage=saved, **options) -> Detections:
    """Spans of all units, after the passes over their documents."""
    found = stage(recognizers.detect(units, config, **options), "detected")
    return Detections(*docpass.run(found, stage))


def redact(units: DataFrame, config: C.RunConfig | None = None, stage=saved, **options) -> tuple[DataFrame, Detections, DataFrame]:
    """Redacted units, the detections and the replacements."""
    config = config or C.RunConfig()
    found = detect(units, config, stage, **options)
    found.units = stage(found.units, "spans")
    spans = stage(replace.spans_of(found.units, config), "values")
    made = stage(replace.replacements(spans, config, stage), "replacements")
    return replace.redact(found.units, config, replace.faked(spans, config, made)), found, made


def report(redacted: DataFrame, config: C.RunConfig | None = None) -> DataFrame:
    """One row: units, units_with_pii, counts by type and by source, unique values. Never an original value."""
    config = config or C.RunConfig()
    spans = replace.spans_of(redacted, config)
    figure = lambda kind, key, n: [F.lit(kind).alias("kind"), key.cast("string").alias("key"), n.cast("long").alias("n")]
    none = F.lit(None)
    rows = redacted.agg(*figure("units", none, F.count("*"))).union(redacted.agg(*figure("units_with_pii", none, F.count_if(F.size("spans") > 0))))
    for column in ("entity_type", "source"):
        rows = rows.union(spans.groupBy(column).agg(F.count("*").alias("n")).select(*figure(column, F.col(column), F.col("n"))))
    rows = rows.union(spans.where("entity_type <> 'URL'").agg(*figure("unique", none, F.count_distinct("scope_id", "entity_type", "key"))))
    # A few dozen rows, gathered to one.
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("n")))
    many = lambda kind: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n")))))
    return rows.agg(
        one("units").alias("units"), one("units_with_pii").alias("units_with_pii"), many("entity_type").alias("by_entity_type"), many("source").alias("by_source"),
        one("unique").alias("unique_values_replaced"),
    )
