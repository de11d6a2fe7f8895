"""Byte-level BPE encoding and decoding through a sentencepiece model made from the rank file itself.

Every token of the vocabulary becomes a piece: its bytes, each mapped to one letter of its own, with
the negative rank as score, so that sentencepiece's best-score-first merging is the merging by rank.
Normalisation is the identity, and no dummy prefix, blank folding or escaping takes place. A text is
cut into pre-tokens by the vocabulary's pattern and each is encoded by itself; a pre-token that is a
token as a whole is that token. Decoding maps ids back to bytes. Nothing is trained.

Scale: rows are independent, so there is no shuffle; each Python worker builds the model once and
keeps a bounded memory of pre-tokens. The model is shipped as the rank file's bytes, whose size is
checked against MAX_VOCAB_BYTES.

Defined cases: a null text is the empty text, with no ids and empty decoded bytes; texts of any length
are encoded whole; repeated rows and equal ids each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import lean_after, narrow

MAX_VOCAB_BYTES = 64 << 20
#: Pre-tokens that a worker remembers with their ids.
REMEMBERED = 250_000
#: The letter that stands for each byte.
LETTERS = {b: 0x100 + b for b in range(256)}


def ranks_of(data: bytes) -> list[bytes]:
    """Tokens in rank order from a rank file: lines of base64 and rank, ranks gapless from 0."""
    pairs = [(int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in data.splitlines() if line)]
    tokens = [token for _, token in sorted(pairs)]
    if [rank for rank, _ in sorted(pairs)] != list(range(len(tokens))):
        raise ValueError("ranks must be gapless from 0")
    return tokens


def lettered(token: bytes) -> str:
    """Each byte as one letter."""
    return token.decode("latin-1").translate(LETTERS)


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol buffer field: bytes as length-delimited, float as 32 bits, int as varint."""
    if isinstance(value, bytes):
        return _number(number << 3 | 2) + _number(len(value)) + value
    if isinstance(value, float):
        return _number(number << 3 | 5) + struct.pack("<f", value)
    return _number(number << 3) + _number(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; one unknown piece follows them."""
    # Fixed values of the public model format: piece (1) = text 1, score 2, type 3 (2 is unknown);
    # trainer (2) = model type 3 (2 is BPE), vocabulary size 4, ids of unknown 40, begin 41, end 42, padding 43;
    # normaliser (3) = name 1, dummy prefix 3, fold blanks 4, escape blanks 5.
    none = (1 << 64) - 1
    out = [_field(1, _field(1, lettered(token).encode()) + _field(2, -float(rank))) for rank, token in enumerate(tokens)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    size = len(tokens)
    out.append(_field(2, _field(3, 2) + _field(4, size + 1) + _field(40, size) + _field(41, none) + _field(42, none) + _field(43, none)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class ByteBpe:
    """Encoder and decoder for one vocabulary and pattern."""

    def __init__(self, data: bytes, pattern: str):
        self.tokens = ranks_of(data)
        self.whole = {token: rank for rank, token in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.tokens))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def learn(self, pre_tokens: set[str]) -> None:
        """Adds the ids of pre-tokens."""
        hard = []
        for x in pre_tokens:
            rank = self.whole.get(raw := x.encode())
            if rank is None:
                hard.append((x, lettered(raw)))
            else:
                self.known[x] = struct.pack("<I", rank)
        if hard:
            for (x, _), ids in zip(hard, self.model.encode([y for _, y in hard], num_threads=1), strict=True):
                self.known[x] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known = self.known
        parts = self.split(text)
        if new := {x for x in parts if x not in known}:
            if len(known) + len(new) > REMEMBERED:  # forget; a text's own pre-tokens are all kept until it is done
                known.clear()
                new = set(parts)
            self.learn(new)
        return b"".join(map(known.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_MADE: dict[tuple, ByteBpe] = {}


def _coder(sent) -> ByteBpe:
    data, pattern = sent.value
    key = hashlib.sha256(data).digest(), pattern
    if key not in _MADE:
        _MADE[key] = ByteBpe(data, pattern)
    return _MADE[key]


def _vocabulary(spark, path: str, pattern: str):
    data = Path(path).read_bytes()
    if len(data) > MAX_VOCAB_BYTES:
        raise ValueError(f"{path} has over {MAX_VOCAB_BYTES} bytes")
    return spark.sparkContext.broadcast((data, pattern))


def encode(docs: DataFrame, vocabulary: str, pattern: str, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_tokens, ids: the ids as consecutive little-endian unsigned 32-bit integers."""
    sent = _vocabulary(docs.sparkSession, vocabulary, pattern)
    rows = narrow(docs, id_col, text_col)

    @lean_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent)
        for batch in batches:
            for part in _parts(batch):
                found = [coder.encode(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_tokens", "ids"])
        coder.known.clear()  # an idle worker keeps the model alone

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decode(encoded: DataFrame, vocabulary: str, pattern: str, *, ids_col="ids", out_col="decoded") -> DataFrame:
    """encoded with one more column: the bytes that the ids stand for (null ids: empty)."""
    sent = _vocabulary(encoded.sparkSession, vocabulary, pattern)
    at = encoded.columns.index(ids_col)

    @lean_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent)
        for batch in batches:
            out = pa.array([coder.decode(x or b"") for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, out_col])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(out_col, BinaryType())]))


def _parts(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Shorter batches, so that texts and their ids aren't all in memory at once."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def text_of(column: str = "decoded"):
    """Decoded bytes as text."""
    return F.col(column).cast("string")
