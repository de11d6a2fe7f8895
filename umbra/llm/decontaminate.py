"""Benchmark decontamination: Wu-Manber multi-pattern search whose symbols are words.

The patterns are all windows of ``window`` consecutive words of the benchmark items (an item
of fewer words, but not none, is one pattern). Patterns of like length share a searcher. Each
searcher has a shift table from blocks of words to the distance that is safe to skip, buckets
from the last block of a pattern to the patterns that end so, and a direct comparison of all words.

Scale: documents are never shuffled; they are read once and searched where they are read. The benchmark is cut into
pieces of PIECE windows and written to the shared folder in blocks of about ``block_bytes`` of text; it never goes to the
driver. One Python node gathers up to GATHERED bytes of documents, then searches them for one block after another: a task
holds these documents and the tables of one block (about 100 bytes a byte), however large the benchmark. With one block
its tables are made once a worker; with more, once a block and 32 MB of documents (half a second beside two to search
them). No state outlives a row, so a lost executor costs only its tasks.

Defined cases: a null or empty text (of a document or an item) has no words: nothing is hit.
Repeated rows and equal ids give one output row for each input row. An empty benchmark hits
nothing; an empty document table gives an empty result. Items that share an id count once; a null
item id is the empty string. Extra columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_after, narrow, pieces, saved, scratch, text_bytes, text_hash

WINDOW = 13
BLOCK_BYTES = 1 << 20
#: Windows of a piece of an item, and bytes of documents that a task holds while it goes through the blocks.
PIECE = 4096
GATHERED = 32 << 20
#: Patterns of lengths in the same range share a searcher, so a short one doesn't shorten all shifts.
RANGES = (1, 2, 4, 8)

#: Bytes to bytes: A-Z to a-z, digits, a-z and all bytes from 0x80 stay, others become a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text: runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(FOLD).split()


class WuManber:
    """Finds all occurrences of word sequences that are each at least ``least`` words long."""

    def __init__(self, patterns: dict[tuple, list], block: int = 3):
        self.least = least = min(map(len, patterns))
        self.block = block = min(block, least)
        self.skip = least - block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, list] = {}
        for words, owners in patterns.items():
            for end in range(block, least + 1):
                key = words[end - block : end]
                self.shift[key] = min(self.shift.get(key, self.skip), least - end)
            self.buckets.setdefault(words[least - block : least], []).append((list(words), owners))

    def find(self, words: list) -> Iterator[tuple[int, int, list]]:
        """Start, end and owners of each occurrence, by start."""
        block, skip, least, shift, end = self.block, self.skip, self.least, self.shift, self.least
        while end <= len(words):
            key = tuple(words[end - block : end])
            if by := shift.get(key, skip):
                end += by
                continue
            start = end - least
            for pattern, owners in self.buckets[key]:
                if words[start : start + len(pattern)] == pattern:
                    yield start, start + len(pattern), owners
            end += 1


def searchers(items: list[tuple[str, bytes | None]], window: int = WINDOW) -> list[WuManber]:
    """One searcher for each range of pattern lengths that occurs."""
    by_range: dict[int, dict[tuple, list]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        if not size:
            continue
        group = window if size == window else max(x for x in RANGES if x <= size)
        patterns = by_range.setdefault(group, {})
        for start in range(len(words) - size + 1):
            owners = patterns.setdefault(tuple(words[start : start + size]), [])
            if item not in owners[-1:]:
                owners.append(item)
    return [WuManber(x) for x in by_range.values()]


def search(words: list, machines: list[WuManber]) -> tuple[list[tuple[int, int]], set]:
    """Maximal covered word ranges, and the items that have an occurrence."""
    found, items = [], set()
    for machine in machines:
        for start, end, owners in machine.find(words):
            found.append((start, end))
            items.update(owners)
    return merged(found), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cut(window: int):
    """Items as pieces of at most PIECE windows: the words of neighbours overlap so that each window is in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text)
                for k, start in enumerate(range(0, max(len(words) - window + 1, min(len(words), 1)), PIECE)):
                    made.append((item, k, b" ".join(words[start : start + PIECE + window - 1]).decode()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string()))], ["item", "piece", "text"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_bytes: int) -> tuple[str, int]:
    """The folder of the benchmark's pieces, one below it for each block, and the number of blocks."""
    items = narrow(benchmark, item_col, item_text_col).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("item"), "text")
    cut = saved(items.mapInArrow(_cut(window), "item string, piece int, text string"), "pieces")
    blocks = pieces(text_bytes(cut), block_bytes)
    path = scratch(benchmark.sparkSession, "blocks")
    cut.withColumn("block", F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)).cast("int")).repartitionById(blocks, "block").write.partitionBy("block").parquet(path)
    return path, blocks


#: The searchers of the block that this worker used last.
_COMPILED: dict[tuple[str, int], list[WuManber]] = {}


def _compiled(path: str, block: int, window: int) -> list[WuManber]:
    if (path, block) not in _COMPILED:
        _COMPILED.clear()
        store, at = fs.FileSystem.from_uri(f"{path}/block={block}")
        found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        rows = []
        for f in sorted(x.path for x in found if x.path.endswith(".parquet")):
            with store.open_input_file(f) as data:
                table = pq.ParquetFile(data).read(columns=["item", "text"])
            rows += zip(table.column("item").to_pylist(), table.column("text").cast(pa.binary()).to_pylist(), strict=True)
        _COMPILED[path, block] = searchers(rows, window)
    return _COMPILED[path, block]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
    window: int = WINDOW, one_in: int = 20, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: text_hash (which tells texts of one id apart), n_words, n_hit, item_ids (sorted as strings), spans (hit word ranges),
    contaminated (n_hit > 0 and one_in * n_hit >= n_words)."""
    rows = narrow(docs, id_col, text_col).select("*", text_hash())
    kind = rows.schema["doc_id"].dataType.simpleString()
    path, blocks = _blocks(benchmark, item_col, item_text_col, window, block_bytes)
    out = rows.mapInArrow(_scan(path, blocks, window), f"doc_id {kind}, text_hash long, n_words long, spans array<struct<start:int,end:int>>, items array<string>")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.col("items").alias("item_ids"), "spans", "text_hash").withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))
    )


def _scan(path: str, blocks: int, window: int):
    spans_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def searched(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple[list, set]]] = [[([], set()) for _ in range(x.num_rows)] for x in held]
        counts: list[list[int]] = [[0] * x.num_rows for x in held]
        for k in range(blocks):
            machines = _compiled(path, k, window)
            for batch, ranges, n in zip(held, found, counts, strict=True):
                for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                    words = words_of(text)
                    n[i] = len(words)
                    some, items = search(words, machines)
                    if some:
                        ranges[i][0].extend(some)
                        ranges[i][1].update(items)
        for batch, ranges, n in zip(held, found, counts, strict=True):
            spans = [[{"start": a, "end": b} for a, b in merged(x)] for x, _ in ranges]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(spans, spans_kind), pa.array([sorted(x) for _, x in ranges], pa.list_(pa.string()))], ["doc_id", "text_hash", "n_words", "spans", "items"])

    @lean_after
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if blocks == 1 or size >= GATHERED:
                yield from searched(held)
                held, size = [], 0
        if held:
            yield from searched(held)

    return scan
