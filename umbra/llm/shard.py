"""Sharding by proportional stratified interleaving.

Rows are shuffled within each source by a seeded digest of their id; a row's fractional rank is (rank - 1/2) / rows
of its source. Sorted by fractional rank, all sources advance in proportion, so cutting the sorted rows into
consecutive runs whose counts differ by one at most gives shards that all match the mixture. Law: ``rows``.

Scale: no window holds a source or all rows. Ranks are taken in two steps (see ``common.numbered``): rows are dealt by
ranges of (source, digest, ...), sampled so that ranges are alike whatever the sources' sizes; the ranges are counted, a
running sum over these counts gives each range's first rank, and rows are numbered within a range. The same again for
ranges of (fraction, source, digest, ...). So a source with a third of all rows is numbered by many tasks, and so are
many sources whose rows share a fraction. Texts are dropped before the first shuffle.

Defined cases: a null text has size 8 and checksum 0; a null id is shuffled as the text "null"; rows of a null source
are a source of their own; repeated rows are equal to each other, so which is which doesn't matter; equal texts (groups)
are not kept together, the law is about counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, pieces, saved

RUN = 4_000


def interleave(docs: DataFrame, shards: int, *, seed: int = 42, id_col="doc_id", text_col="text", source_col="source", run: int = RUN) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes + 8), text_crc32, fraction, shard (0 to shards - 1), slot (gapless from 0)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    doc = F.col(f"`{id_col}`")
    rows = docs.select(
        doc.alias("doc_id"), F.col(f"`{source_col}`").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("n")).alias("stratum"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("null"))).cast("binary")).alias("digest"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = saved(rows, "narrow")
    total = rows.count()
    parts = pieces(total, max(run, math.isqrt(total)))
    order = ["digest", "doc_id", "size", "text_crc32"]
    ranked = numbered(rows, ["stratum"], order, parts, "by-source")
    ranked = ranked.withColumn("fraction", (F.col("at") - F.lit(0.5)) / F.col("of")).drop("at", "of")
    placed = numbered(saved(ranked, "ranked"), [], ["fraction", "stratum", *order], parts, "by-fraction")
    placed = placed.withColumn("position", F.col("at") - 1).withColumn("shard", F.expr(f"cast((position * {shards}) div {max(1, total)} as int)"))
    slot = F.expr(f"position - ((cast(shard as long) * {total} + {shards - 1}) div {shards})")
    return placed.select("doc_id", "source", "size", "text_crc32", "fraction", "shard", slot.alias("slot"))
