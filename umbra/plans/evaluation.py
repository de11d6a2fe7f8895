"""How well detection does on labelled units and images: counts, rates, statuses, errors, leaks, and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import images, scoring
from ..sources import sinks
from ..staging import saved


@dataclass
class Scores:
    """Small tables of one labelled set."""

    tokens: DataFrame
    types: DataFrame
    entities: DataFrame
    false_hits: DataFrame
    misses: DataFrame


def score(units: DataFrame, stage=saved) -> Scores:
    """units: text, entities (gold) and spans (predicted)."""
    labels = stage(scoring.token_labels(units), "labels")
    return Scores(
        scoring.token_confusion(labels), scoring.type_confusion(labels).orderBy("entity_type"), scoring.status_totals(scoring.entity_status(labels)).orderBy("entity_type"),
        scoring.errors(labels, "fp"), scoring.errors(labels, "fn"),
    )


def by_index(detected: DataFrame, gold: DataFrame) -> DataFrame:
    """Detected units of one document with the gold entities of their index; a text that differs ends the run."""
    return scoring.match_by_index(gold, detected.select("unit_id", "text", "spans"))


def by_hash(detected: DataFrame, gold: DataFrame) -> DataFrame:
    """Detected units with the gold entities of an equal text; a gold unit without one ends the run."""
    rows = scoring.match_by_hash(gold, detected, ["unit_id", "spans"])
    return rows.withColumn("spans", F.when(F.col("unit_id").isNull(), F.raise_error(F.lit("a gold unit has no text like it"))).otherwise(F.col("spans")))


def leaks(gold_units: DataFrame, redacted: DataFrame) -> DataFrame:
    """Gold values that can be read in the redacted texts of the same document."""
    values = gold_units.select("doc_id", "text", F.explode("entities").alias("e"))
    values = values.select("doc_id", F.col("e.type").alias("entity_type"), F.coalesce("e.text", F.substring(F.col("text"), F.col("e.start") + 1, F.col("e.end") - F.col("e.start"))).alias("value"))
    return scoring.leaks(values, redacted.select("doc_id", F.col("redacted").alias("text")))


def image_scores(raw: DataFrame, boxes: DataFrame, gold_boxes: DataFrame) -> DataFrame:
    """How many personal boxes painting hides, and how many others."""
    return scoring.box_scores(images.coverage(images.paint(raw, boxes), gold_boxes))


def markdown(sets: dict[str, Scores], leaked: DataFrame | None = None, boxes: DataFrame | None = None) -> str:
    """The figures of all sets as Markdown."""
    out = []
    for name, s in sets.items():
        out.append(f"## {name}")
        for title, df in (("Tokens, whatever the type", s.tokens), ("By type", s.types), ("Entities", s.entities), ("False hits (masked)", s.false_hits), ("Misses (masked)", s.misses)):
            out += [f"### {title}", sinks.markdown(df, 50)]
    if leaked is not None:
        out += ["## Leaks", sinks.markdown(leaked)]
    if boxes is not None:
        out += ["## Image boxes", sinks.markdown(boxes)]
    return "\n\n".join(out) + "\n"
