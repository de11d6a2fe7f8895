"""Token ids in files of independent zstandard frames with a trailing seek table.

File format (one file for each shard, documents in ascending id order):

* data frames: zstandard frames that decompress alone. Content: a little-endian header (documents n as
  unsigned 32 bits, bytes per id w as unsigned 32 bits), n signed 64-bit document ids, n unsigned 64-bit
  counts of ids, then all ids, w bytes each;
* one index frame: for each data frame its first id, last id, documents and ids, as signed 64 bits;
* the seek table, a skippable frame: magic 0x184D2A5E and size, then for each frame the compressed size, the
  decompressed size and a checksum (low 32 bits of the XXH64 of the content), then the number of frames,
  a descriptor byte (0x80: checksums) and the magic 0x8F92EAB1.

A reader takes the seek table from the end of the file, then the index frame, then only the frames that can
hold the documents asked for, and checks the checksum of each.

Scale: ids and sizes of documents, without texts, are dealt by ranges of ids and summed, which gives the ids at which
shards of ``shard_bytes`` of text begin, whatever the sizes of documents. A text is encoded where it is read; ids (two
bytes each, where the vocabulary allows) are shuffled once, each shard to a task of its own. A task holds one frame and
its compressor, not a shard. A file is written under a name of its own and then moved to its place, so a repeated task
leaves the same file. The driver holds one row for each shard, and executors get 16 bytes for each (50 MB at 100 TB).

Defined cases: a null or empty text has no ids but the end id; a null document id counts as the smallest;
equal ids follow each other in the order of a hash of their texts, and may lie in several shards; an empty table gives no files and an empty result.
Ids of documents must be integers.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, dealt, narrow, pieces, saved, scratch

SHARD_BYTES = 32 << 20
FRAME_BYTES = 1 << 20
MAX_VOCAB_BYTES = 64 << 20
#: Rows of a range in which sizes are summed.
RANGE_ROWS = 1_000_000
#: Pre-tokens that a worker remembers with their ids.
REMEMBERED = 1_000_000
#: How the vocabulary marks a token that ends a word. Fixed value.
END_OF_WORD = "</w>"
#: Pre-tokens in Latin-1: the tokenizer's own pattern with its classes spelt out.
_LETTERS, _NUMBERS = ("".join(map(re.escape, (c for c in map(chr, range(256)) if unicodedata.category(c)[0] == kind))) for kind in "LN")
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0"
LATIN_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+").findall
TABLE_MAGIC, END_MAGIC = 0x184D2A5E, 0x8F92EAB1


# ---- the file format


class FrameWriter:
    """Writes documents, in order, to a binary stream."""

    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES, level: int = 1):
        self.out, self.width, self.most = out, width, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []
        self.ids: list[int] = []
        self.parts: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int, tokens: bytes) -> None:
        self.ids.append(doc_id)
        self.parts.append(tokens)
        self.held += len(tokens) + 16
        if self.held >= self.most:
            self._flush()

    def _frame(self, content: bytes) -> None:
        packed = self.packer.compress(content)
        self.out.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if not self.ids:
            return
        sizes = [len(x) // self.width for x in self.parts]
        head = struct.pack("<II", len(self.ids), self.width) + np.array(self.ids, "<i8").tobytes() + np.array(sizes, "<u8").tobytes()
        self._frame(b"".join([head, *self.parts]))
        self.index.append((self.ids[0], self.ids[-1], len(self.ids), sum(sizes)))
        self.ids, self.parts, self.held = [], [], 0

    def close(self) -> None:
        self._flush()
        self._frame(np.array(self.index, "<i8").tobytes())
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0x80, END_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(body)) + body)


class FrameReader:
    """Reads documents from a seekable binary stream; decompresses only the frames asked for."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        frames, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != END_MAGIC or flags != 0x80:
            raise ValueError("no seek table")
        source.seek(size - 9 - 12 * frames)
        table = np.frombuffer(source.read(12 * frames), "<u4").reshape(frames, 3)
        self.table = table.tolist()
        self.at = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)]).tolist()
        self.read_frames = 0
        self.index = np.frombuffer(self._content(frames - 1), "<i8").reshape(-1, 4).tolist()

    def _content(self, k: int) -> bytes:
        self.source.seek(self.at[k])
        packed, size, check = self.table[k]
        content = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        self.read_frames += 1
        return content

    def frame(self, k: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Position among the file's ids, document id and ids of each document of a frame."""
        content = self._content(k)
        n, width = struct.unpack_from("<II", content)
        docs = np.frombuffer(content, "<i8", n, 8)
        sizes = np.frombuffer(content, "<u8", n, 8 + 8 * n).astype(np.int64)
        ids = np.frombuffer(content, f"<u{width}", -1, 8 + 16 * n)
        ends = np.cumsum(sizes)
        base = sum(x[3] for x in self.index[:k])
        for doc, start, end in zip(docs.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            yield base + start, doc, ids[start:end]

    def all(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.frame(k)

    def documents(self, wanted: Iterable[int]) -> dict[int, list[np.ndarray]]:
        """Ids of the wanted documents; a frame without any of them isn't read."""
        wanted = sorted(set(wanted))
        out: dict[int, list[np.ndarray]] = {}
        for k, (first, last, _, _) in enumerate(self.index):
            i = bisect.bisect_left(wanted, first)
            if i < len(wanted) and wanted[i] <= last:
                some = set(wanted)
                for _, doc, ids in self.frame(k):
                    if doc in some:
                        out.setdefault(doc, []).append(ids)
        return out


def open_file(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(path)


def read_documents(path: str, wanted: Iterable[int]) -> dict[int, list[np.ndarray]]:
    """The ids of some documents of one file."""
    store, at = open_file(path)
    with store.open_input_file(at) as f:
        return FrameReader(f, f.size()).documents(wanted)


# ---- encoding


class WordCoder:
    """A tokenizers file whose pre-tokens are asked for once each.

    No token of the tokenizer reaches over a pre-token, and neither normalisation nor pre-tokens reach over a blank.
    In Latin-1 text, which lower-casing leaves in normal form, pre-tokens are found here; every other part between blanks
    and line breaks goes to the library as it is. A text that holds an added token (<|endoftext|>) goes there whole, and
    added tokens are matched as the library does by default.
    """

    def __init__(self, data: bytes, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_buffer(data)
        # Parts are found in texts without added tokens, and must not become one by lower-casing.
        self.coder.encode_special_tokens = True
        added = self.coder.get_added_tokens_decoder().values()
        self.added = [x.content for x in added]
        #: Added tokens that aren't found in texts as they are: then every text goes to the library.
        self.always = any(x.normalized or not x.special for x in added)
        self.width = 2 if max(self.coder.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
        self.end = self.packed([end_id])
        #: Ids that end a pre-token.
        self.ends = np.zeros(self.coder.get_vocab_size(with_added_tokens=True) + 1, bool)
        for token, k in self.coder.get_vocab(with_added_tokens=True).items():
            self.ends[k] = token.endswith(END_OF_WORD)
        self.known: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}

    def packed(self, ids) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def learn(self, new: list[str]) -> None:
        """Encodes pre-tokens, parted by blanks, in one call; a pre-token's ids end with an id that ends a word."""
        ids = np.array(self.coder.encode(" ".join(new), add_special_tokens=False).ids, f"<u{self.width}")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(new):  # not a tokenizer of this kind: ask for each
            self.known.update((x, self.packed(e.ids)) for x, e in zip(new, self.coder.encode_batch(new, add_special_tokens=False), strict=True))
            return
        data, at = ids.tobytes(), 0
        for x, end in zip(new, (last * self.width).tolist(), strict=True):
            self.known[x] = data[at:end]
            at = end

    def latin(self, text: str) -> bytes:
        known, parts = self.known, LATIN_PARTS(text.lower())
        if new := {x for x in parts if x not in known}:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(parts)
            self.learn(list(new))
        return b"".join(map(known.__getitem__, parts))

    def other(self, part: str) -> bytes:
        if part not in self.odd:
            if len(self.odd) > REMEMBERED // 10:
                self.odd.clear()
            self.odd[part] = self.packed(self.coder.encode(part, add_special_tokens=False).ids)
        return self.odd[part]

    def whole(self, text: str) -> bytes:
        self.coder.encode_special_tokens = False
        try:
            return self.packed(self.coder.encode(text, add_special_tokens=False).ids)
        finally:
            self.coder.encode_special_tokens = True

    def encode(self, text: str) -> bytes:
        """The ids of a text and the end id."""
        if self.always or any(x in text for x in self.added):
            return self.whole(text) + self.end
        if _is_latin(text):
            return self.latin(text) + self.end
        return b"".join([*(self.latin(x) if _is_latin(x) else self.other(x) for x in text.replace("\n", " ").split(" ") if x), self.end])


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_MADE: dict[tuple, WordCoder] = {}


def _coder(sent) -> WordCoder:
    data, end_id = sent.value
    key = (xxhash.xxh3_128_digest(data), end_id)
    if key not in _MADE:
        _MADE[key] = WordCoder(data, end_id)
    return _MADE[key]


def shard_firsts(rows: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """(doc_id, hash) of the first row of each shard of about ``shard_bytes`` of text, in order of doc_id and hash."""
    sizes = saved(rows.select("doc_id", "hash", (F.octet_length("text") + 8).cast("long").alias("size")), "sizes")
    found = dealt(sizes, ["doc_id", "hash"], pieces(sizes.count(), RANGE_ROWS), "by-id")
    before = found.groupBy("part").agg(F.sum("size").alias("_n"))
    running = lambda w: F.sum(F.col("_n")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    before = before.select("part", running(Window.orderBy("part")).alias("_before"))
    one = found.groupBy("part", "doc_id", "hash").agg(F.sum("size").alias("_n"))
    one = one.select("part", "doc_id", "hash", running(Window.partitionBy("part").orderBy("doc_id", "hash")).alias("_in")).join(before, "part")
    shard = F.expr(f"(_before + _in) div {shard_bytes}")
    return [tuple(r.first) for r in one.groupBy(shard.alias("shard")).agg(F.min(F.struct("doc_id", "hash")).alias("first")).orderBy("shard").collect()]


def shard_of(cuts: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The shard of each row: how many shards after the first begin at or before it."""
    low, high = (np.searchsorted(cuts[:, 0], ids, side=x) for x in ("left", "right"))
    for k in np.flatnonzero(low != high):
        low[k] += np.searchsorted(cuts[low[k] : high[k], 1], hashes[k], side="right")
    return low.astype(np.int32)


def write_tokens(docs: DataFrame, tokenizer: str, *, end_id: int, id_col="doc_id", text_col="text", shard_bytes: int = SHARD_BYTES, path: str | None = None) -> list[dict]:
    """Encodes the texts and writes the files below ``path`` (a new folder of the shared one, if none is named).
    Returns a row for each file, in order: shard, path, n_docs, n_ids, start (ids in the files before it)."""
    spark = docs.sparkSession
    data = Path(tokenizer).read_bytes()
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"{tokenizer} has over {MAX_VOCAB_BYTES} bytes")
    sent = spark.sparkContext.broadcast((data, end_id))
    text = F.coalesce("text", F.lit(""))
    rows = narrow(docs, id_col, text_col).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    firsts = shard_firsts(rows, shard_bytes)
    shards = max(1, len(firsts))
    cuts = spark.sparkContext.broadcast(np.array(firsts[1:], np.int64).reshape(-1, 2))
    folder = path or scratch(spark, "tokens")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                shard = shard_of(cuts.value, *(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
                tokens = [coder.encode(x) for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), batch.column(1), pa.array(tokens, pa.binary())], ["shard", "doc_id", "hash", "tokens"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _coder(sent).width
        store, base = open_file(folder)
        store.create_dir(base, recursive=True)
        now, done, writer, stream, name = None, [], None, None, ""

        def close():
            writer.close()
            stream.close()
            final = f"{base}/shard-{now:07d}.zst"
            if store.get_file_info(final).type != fs.FileType.NotFound:
                store.delete_file(final)
            store.move(name, final)
            done.append((now, f"shard-{now:07d}.zst", sum(x[2] for x in writer.index), sum(x[3] for x in writer.index)))

        for batch in batches:
            for shard, doc, tokens in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if shard != now:
                    if writer:
                        close()
                    now, name = shard, f"{base}/.{uuid.uuid4().hex}"
                    stream = store.open_output_stream(name)
                    writer = FrameWriter(stream, width)
                writer.add(doc, tokens)
        if writer:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "name", "n_docs", "n_ids"])

    files = (
        rows.mapInArrow(encode, "shard int, doc_id long, hash long, tokens binary")
        .repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "hash", "tokens")
        .mapInArrow(write, "shard int, name string, n_docs long, n_ids long").collect()
    )
    out, start = [], 0
    for r in sorted(files, key=lambda r: r.shard):
        out.append({"shard": r.shard, "path": f"{folder}/{r.name}", "n_docs": r.n_docs, "n_ids": r.n_ids, "start": start})
        start += r.n_ids
    return out


def read_tokens(spark: SparkSession, files: list[dict], id_type: str = "long") -> DataFrame:
    """What the files hold: doc_id, start (ids of all documents before it), n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers). One task for each file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = open_file(path)
                with store.open_input_file(at) as f:
                    reader = FrameReader(f, f.size())
                    for k in range(len(reader.index)):
                        rows = [(None if doc == NULL_ID else doc, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for at, doc, ids in reader.frame(k)]
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame([(x["path"], x["start"]) for x in files], "path string, start long")
    return listed.repartition(max(1, len(files))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
