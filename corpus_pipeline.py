"""A corpus pipeline of the operators in umbra.llm: quality, near duplicates, repeated passages, contamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet in the
cluster's shared folder and reads it again as the next stage's docs, so a lost executor never costs more than a stage.
All stages but the last return the columns of documents; the last returns doc_id, n_tokens, ids and decoded text checks.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import bytebpe, common, decontaminate, neardup, quality, substring

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: No SQL can express a trained classifier, so the whole is tested against a brute-force version.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose id and text are among the kept (doc_id, text_hash); a null id counts as an id."""
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("kept_hash"))
    return docs.join(kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")), same, "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    scored = quality.classify(docs, _table(spark, sf_dir, "labels"), threshold=0.3)
    return _only(docs, scored.where("predicted = 1"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest id. Documents without words all stay; of rows
    that share id and text one stays."""
    found = neardup.near_duplicates(docs)
    out = _only(docs, found.where("first"))
    # Rows are meant to be unique; texts are dealt by id only where some aren't.
    repeated = found.groupBy("doc_id", "text_hash").count().where("count > 1").take(1)
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words that repeat a passage of 13 words or more of a document with a smaller id.

    A document that loses nothing keeps its text as it is; in others the words left are joined by one blank.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = substring.remove_repeats(docs, carry=others, same_if_untouched=True)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), **{c: F.col(f"row.`{c}`") for c in others}}
    if "n_chars" in others:
        made["n_chars"] = F.when(F.col("n_removed") == 0, made["n_chars"]).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType))
    return out.select(*(made[c].alias(c) for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    found = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return _only(docs, found.where(~F.col("contaminated")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), and digests of the ids and of the decoded bytes."""
    vocabulary = public_tokenizers.path(VOCABULARY)
    encoded = bytebpe.encode(docs, vocabulary, public_tokenizers.PATTERN)
    decoded = bytebpe.decode(encoded, vocabulary, public_tokenizers.PATTERN)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Only the last stage's table stays in the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = len(common.WRITTEN)
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
        # What a stage wrote on its way isn't needed any more, nor is the stage before; its own result is written last.
        common.dropped(spark, max(0, before - (name != STAGES[0][0])), len(common.WRITTEN) - 1)
    return docs
