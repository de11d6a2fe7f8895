"""What the two operators that remove repeated passages share: chunks of documents, compressed blobs, ranges.

A document belongs to a chunk, by a hash of its id and text, of about ``bucket_bytes`` of text. Chunks ask about windows
(one compact blob for each range of fingerprints), ranges answer, and in the end each chunk applies what it learnt to its
documents. A question is asked once a chunk however often its window occurs there, so a passage that a third of all
documents share makes one entry a chunk, not one a document. All steps are plain lineage over the input table, with one
shuffle of the documents that all steps reuse: a lost task is run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from . import anchors as A
from .common import NULL_ID, lean, lean_after

BUCKET_BYTES = 8 << 20
#: Bucket the row goes to, what it is (a kind, or the bucket that it comes from), content.
ROW = "bucket int, kind int, payload binary"
_NAMES = ["bucket", "kind", "payload"]


# ---- blobs


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte planes first, compressed."""
    out = [np.array([len(arrays), len(arrays[0])], "<u4").tobytes()]
    for a in arrays:
        out.append(bytes([a.dtype.itemsize]))
        out.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    _, n = np.frombuffer(data, "<u4", 2)
    at, out = 8, []
    for kind in kinds:
        size = data[at]
        planes = np.frombuffer(data, np.uint8, size * n, at + 1).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += 1 + size * int(n)
    return out


def gathered(table: pa.Table, kind: int, kinds: list[str]) -> list[np.ndarray]:
    """All blobs of one kind in a bucket, joined."""
    found = [unpack(p, kinds) for k, p in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True) if k == kind]
    if not found:
        return [np.zeros(0, x) for x in kinds]
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def origins(table: pa.Table, kinds: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """All blobs of a bucket, joined, and for each row the kind (the bucket of origin) of its blob."""
    found = [unpack(p, kinds) for p in table.column("payload").to_pylist()]
    if not found:
        return np.zeros(0, np.int32), [np.zeros(0, x) for x in kinds]
    return np.repeat(np.array(table.column("kind").to_pylist(), np.int32), [len(x[0]) for x in found]), [np.concatenate(x) for x in zip(*found, strict=True)]


def rows(found: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.binary())], names=_NAMES)


def split(buckets: np.ndarray, kind: int, arrays: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """One blob for each bucket that occurs."""
    if not len(buckets):
        return []
    order = np.argsort(buckets, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(buckets[order]) != 0, True])
    return [(int(buckets[order[a]]), kind, pack(*(x[order[a:b]] for x in arrays))) for a, b in zip(at[:-1], at[1:], strict=True)]


def by_print(prints: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of fingerprints, mixed anew: those of a cover are chosen for being small."""
    prints = A.mixed(prints ^ np.uint64(A.MULTIPLIER))
    return ((prints >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def by_document(ids: np.ndarray, salts: np.ndarray, buckets: int) -> np.ndarray:
    """Different texts of one id are dealt apart."""
    return by_print(A.mixed(ids.view(np.uint64)) + salts, buckets)


# ---- documents


def salt(text: bytes) -> int:
    """Tells rows apart that share an id but not the text."""
    return xxhash.xxh32_intdigest(text)


def documents(batch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids (null: the least), salts and texts (null: empty) of (doc_id, text, ...) rows."""
    ids = batch.column(0).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(0).combine_chunks().cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
    return ids, np.array([salt(x) for x in texts], np.uint32), texts


def packed_documents(docs: DataFrame, buckets: int) -> DataFrame:
    """The rows in compressed blobs by document bucket."""

    @lean_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            bucket = by_document(ids, np.array([salt(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()], np.uint32), buckets)
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0, True])
            lean()
            for a, b in zip(at[:-1], at[1:], strict=True):
                part = batch.take(pa.array(order[a:b]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue())
                yield pa.RecordBatch.from_arrays([pa.array([bucket[order[a]]], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "payload"])

    return docs.mapInArrow(run, "bucket int, payload binary")


def unpacked_documents(table: pa.Table) -> list[pa.Table]:
    return [pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(x)).read_all() for x in table.column("payload").to_pylist()]


def leaner(run):
    """A function of one table or two, whose worker gives its memory back before and after each call."""

    def one(table: pa.Table) -> pa.Table:
        lean()
        out = run(table)
        lean()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        out = run(left, right)
        lean()
        return out

    return one if run.__code__.co_argcount == 1 else two


def dealt_by(df: DataFrame, buckets: int):
    """Grouped by bucket, each bucket a task of its own."""
    return df.repartitionById(buckets, "bucket").groupBy("bucket")


# ---- sorted rows


def heads(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = False
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
    return out


def first_rows(new: np.ndarray) -> np.ndarray:
    """For each row, the row that heads its group."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


# ---- ranges of symbols


RANGE = ["<i8", "<u4", "<u4", "<u4"]


def ranges(kind: int, buckets: int, ids, salts, start, end) -> list[tuple[int, int, bytes]]:
    """Blobs of ranges by chunk, those of a document that overlap joined."""
    if not len(ids):
        return []
    order = np.lexsort((start, salts, ids))
    ids, salts, start, end = ids[order], salts[order], start[order], end[order]
    new = heads(ids, salts)
    # Within a document, the furthest end so far: documents are spread on one axis so that a running maximum serves.
    lift = (np.cumsum(new) - 1).astype(np.int64) << 33
    reach = np.maximum.accumulate(lift + end)
    cut = np.r_[True, (lift + start)[1:] > reach[:-1]]
    last = np.r_[np.flatnonzero(cut)[1:] - 1, len(cut) - 1]
    ids, salts, start, end = ids[cut], salts[cut], start[cut], (reach[last] - lift[last]).astype(np.uint32)
    return split(by_document(ids, salts, buckets), kind, [ids, salts, start, end])


def by_text(ids, salts, start, end) -> dict[tuple[int, int], list[list[int]]]:
    """The ranges of each document, joined, in order."""
    order = np.lexsort((start, salts, ids))
    new = np.flatnonzero(np.r_[heads(ids[order], salts[order]), True]) if len(ids) else np.zeros(0, int)
    by = {}
    for a, b in zip(new[:-1], new[1:], strict=True):
        spans: list[list[int]] = []
        for s, e in zip(start[order[a:b]].tolist(), end[order[a:b]].tolist(), strict=True):
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(e, spans[-1][1])
            else:
                spans.append([s, e])
        by[int(ids[order[a]]), int(salts[order[a]])] = spans
    return by


def finished(left: pa.Table, by: dict, finish, schema: pa.Schema) -> pa.Table:
    """finish(text, spans) for each document of a chunk, between its id and what it carries."""
    made = []
    for part in unpacked_documents(left):
        found = [finish(text, by.get((int(i), int(s)), [])) for i, s, text in zip(*documents(part), strict=True)]
        columns = [pa.array([x[k] for x in found], schema.field(k + 1).type) for k in range(len(found[0]))]
        made.append(pa.table([part.column(0), *columns, *part.columns[2:]], names=schema.names))
    return pa.concat_tables(made) if made else schema.empty_table()


def shape(docs: DataFrame, result: str, kinds: list[pa.DataType]) -> tuple[str, pa.Schema]:
    """DDL and Arrow schema of doc_id, the result's columns and the carried ones."""
    names = ["doc_id", *(x.split()[0] for x in result.split(", ")), *docs.columns[2:]]
    carried = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[2:]]
    arrow = pa.schema([(n, pa.null()) for n in names])
    for k, kind in enumerate(kinds):
        arrow = arrow.set(k + 1, pa.field(names[k + 1], kind))
    return ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", result, *carried]), arrow
