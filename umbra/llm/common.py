"""What the operators share beside the library's staging: input narrowing, sizes, and workers' memory."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import WRITTEN, dealt, dropped, numbered, saved, scratch, shared_dir

__all__ = ["NULL_ID", "WRITTEN", "dealt", "dropped", "lean", "lean_after", "narrow", "numbered", "pieces", "saved", "scratch", "shared_dir", "text_bytes", "text_hash"]

#: What a null id counts as in orders: before every other id.
NULL_ID = -(1 << 63)


def narrow(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text): other columns, whatever their names, don't reach an operator."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def text_hash() -> Column:
    """Tells rows apart that share an id but not the text; null is empty."""
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def text_bytes(df: DataFrame, text: Column | str = "text") -> int:
    """UTF-8 bytes of a text column, summed on the executors."""
    return df.select(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long")).first()[0]


def pieces(total_bytes: int, piece_bytes: int, least: int = 1) -> int:
    """How many pieces of about piece_bytes a total makes."""
    return max(least, -(-total_bytes // piece_bytes))


def lean() -> None:
    """Lets a Python worker give freed memory back: Arrow takes it from malloc, and malloc returns what it can."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean_after(run):
    """An iterator function whose worker gives its memory back at the end, when the function's own variables are gone."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        lean()

    return whole
