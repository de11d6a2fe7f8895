"""Substring dedup: level-wise doubling over windows of words.

The lengths are 4, 8, and then the 13 asked for (in general: doubled while a window of the length asked for holds one of
the two extensions of every window that it holds). Level one: of each window of 13, the 4 words with the least
fingerprint. At each level chunks of documents ask which of their windows other documents have too; windows that only one
document has go no further, and each of those repeated is extended to twice its length, once to the left and once to the
right. Windows of the length asked for around what survived are the last level: those that also start in a document with
a smaller id are removed. No level looks at a window whose part at the level before wasn't repeated.

``longest_repeats`` goes on doubling beyond the length asked for, until no candidate survives, and tells each document the
longest length at which it shares a passage. That can't change what is removed, as each window of 13 in a longer
repeated one is repeated itself.

Scale: see ``repeats``. A level is two shuffles: fingerprints of windows, once a chunk (8 bytes; 24 at the last level), and
those that are repeated, back. A common phrase makes one entry a chunk. Levels before the last decide by 64 bits, which
can only let a window through; the last by 128.

Defined cases: a null text has no words; texts of fewer than ``window`` words lose nothing; rows of an equal id never
remove each other's words (a smaller id is asked for), so repeated rows get equal results; a null id counts as the
smallest; ids must be integers; an empty table gives an empty result; carried columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import repeats as R
from .common import narrow, pieces, saved, text_bytes

WINDOW = 13
#: Words of the first level.
FIRST = 4


def words_of(text: bytes) -> list[bytes]:
    """Runs of characters other than blank and the five ASCII white space controls."""
    return text.split()


def word_values(text: bytes) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, text.split()), np.uint64) | np.uint64(1)


def _kept(text: bytes, spans: list[list[int]]) -> tuple:
    words = text.split()
    out, at = [], 0
    for start, end in spans:
        out += words[at:start]
        at = end
    out += words[at:]
    return len(words), len(words) - len(out), [{"start": a, "end": b} for a, b in spans], b" ".join(out).decode()


def _kept_or_same(text: bytes, spans: list[list[int]]) -> tuple:
    found = _kept(text, spans)
    return found if spans else (*found[:3], text.decode())


# ---- levels


def levels(window: int) -> list[int]:
    """The lengths, ascending, that end with the window."""
    out = [min(FIRST, window)]
    while 3 * out[-1] <= window + 1 and 2 * out[-1] < window:
        out.append(2 * out[-1])
    return out if out[-1] == window else [*out, window]


class Piece:
    """Some documents of a chunk: their words' values and the places of windows."""

    def __init__(self, ids: np.ndarray, docs: list[np.ndarray], window: int):
        self.values, self.starts = A.padded(docs, window)
        self.sizes = np.array([len(x) for x in docs], np.int64)
        self.ids = ids
        self.prints = A.Fingerprints(self.values, window)

    def of(self, at: np.ndarray) -> np.ndarray:
        """The document of each place."""
        return np.searchsorted(self.starts, at, side="right") - 1

    def inside(self, at: np.ndarray, length: int) -> np.ndarray:
        """The windows that lie in a document, each once, in order."""
        at = np.unique(at)
        which = self.of(at).clip(0)
        return at[(at >= self.starts[which]) & (at + length <= self.starts[which] + self.sizes[which])] if len(at) else at

    def places(self, sizes: list[int], level: int, survived: np.ndarray | None) -> np.ndarray:
        """Where the windows of a level start: around what survived the level before."""
        at = A.anchors(self.values, self.starts, self.sizes, sizes[-1], sizes[0], self.prints)
        for size in sizes[: max(level - 1, 0)]:
            at = self.inside(np.concatenate([at - size, at]), 2 * size)
        if not level:
            return at
        size = sizes[level - 1]
        at = at[found_in(survived, self.prints.at(at, size))]
        if level < len(sizes) - 1 or not len(at):
            return self.inside(np.concatenate([at - size, at]), 2 * size)
        mark = np.zeros(len(self.values) + 1, np.int32)
        np.add.at(mark, (at + size - sizes[-1]).clip(0), 1)
        np.add.at(mark, at + 1, -1)
        return self.inside(np.flatnonzero(np.cumsum(mark) > 0), sizes[-1])

    def second(self, at: np.ndarray, window: int) -> np.ndarray:
        """The other half of a fingerprint of 128 bits."""
        return A.Fingerprints(A.mixed(self.values ^ np.uint64(A.MULTIPLIER)) * (self.values > 0), window).at(at, window)


def found_in(known: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(some), bool)
    return known[np.searchsorted(known, some).clip(0, len(known) - 1)] == some


def pieces_of(table: pa.Table, window: int) -> Iterator[tuple[Piece, np.ndarray]]:
    """A chunk's documents that have a window, some at a time, with their salts."""
    for part in R.unpacked_documents(table):
        ids, salts, texts = R.documents(part)
        for a, b in A.chunked([len(x) // 4 for x in texts], window):
            docs = [word_values(x) for x in texts[a:b]]
            some = np.array([k for k, x in enumerate(docs) if len(x) >= window], int)
            if len(some):
                yield Piece(ids[a:b][some], [docs[k] for k in some], window), salts[a:b][some]


ASKED, ANSWERED = ["<u8", "u1"], ["<u8"]
LAST_ASKED, LAST_ANSWERED = ["<u8", "<u8", "<i8", "u1"], ["<u8", "<u8", "<i8"]


def _ask(sizes: list[int], level: int, buckets: int):
    """A chunk's windows of a level, once each, with whether two of its ids have it; at the last level the least id too."""
    last = level == len(sizes) - 1

    def asked(left: pa.Table, survived: np.ndarray | None) -> pa.Table:
        held = []
        for piece, _ in pieces_of(left, sizes[-1]):
            at = piece.places(sizes, level, survived)
            if len(at):
                made = [piece.prints.at(at, sizes[level]), piece.second(at, sizes[-1]) if last else None, piece.ids[piece.of(at)]]
                held.append([x for x in made if x is not None])
        if not held:
            return R.rows([])
        chunk = left.column("bucket")[0].as_py()
        *keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, *keys[::-1]))
        *keys, ids = (x[order] for x in (*keys, ids))
        first = np.flatnonzero(R.heads(*keys))
        final = np.r_[first[1:], len(ids)] - 1
        several = (ids[first] != ids[final]).astype(np.uint8)
        arrays = [*(x[first] for x in keys), ids[first], several] if last else [keys[0][first], several]
        return R.rows([(b, chunk, p) for b, _, p in R.split(R.by_print(keys[0][first], buckets), 0, arrays)])

    if not level:
        return lambda left: asked(left, None)
    return lambda left, right: asked(left, np.sort(R.origins(right, ANSWERED)[1][0]))


def _answer(last: bool):
    """Which windows two ids have, to each chunk that asked; at the last level with the least id."""

    def run(table: pa.Table) -> pa.Table:
        chunk, (*keys, several) = R.origins(table, LAST_ASKED if last else ASKED)
        if not len(chunk):
            return R.rows([])
        least = keys.pop() if last else None
        order = np.lexsort((*([least] if last else []), *keys[::-1]))
        chunk, several, keys = chunk[order], several[order], [x[order] for x in keys]
        new = R.heads(*keys)
        first = R.first_rows(new)
        group = np.cumsum(new) - 1
        many = np.bincount(group, weights=several) > 0
        if last:
            least = least[order]
            many |= np.bincount(group, weights=least != least[first]) > 0
            keys.append(least[first])
        else:
            many |= np.bincount(group) > 1
        told = many[group]
        bucket = table.column("bucket")[0].as_py()
        return R.rows([(c, bucket, p) for c, _, p in R.split(chunk[told], 0, [x[told] for x in keys])])

    return run


def _apply(window: int, both: bool, finish, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        _, (one, two, least) = R.origins(right, LAST_ANSWERED)
        order = np.argsort(one, kind="stable")
        one, two, least = one[order], two[order], least[order]
        held = [(np.zeros(0, np.int64), *(np.zeros(0, np.uint32),) * 3)]
        for piece, salts in pieces_of(left, window) if len(one) else ():
            at = np.flatnonzero(found_in(one, piece.prints.all(window)))
            if not len(at):
                continue
            mine, other = piece.prints.at(at, window), piece.second(at, window)
            # Two windows of equal first halves are told apart by the second.
            k, end = np.searchsorted(one, mine), np.searchsorted(one, mine, side="right")
            while (step := (two[k] != other) & (k + 1 < end)).any():
                k += step
            which = piece.of(at)
            gone = (two[k] == other) & (both | (piece.ids[which] > least[k]))
            start = (at - piece.starts[which]).astype(np.uint32)
            held.append((piece.ids[which][gone], salts[which][gone], start[gone], start[gone] + np.uint32(window)))
        return R.finished(left, R.by_text(*(np.concatenate(x) for x in zip(*held, strict=True))), finish, schema)

    return run


def _repeated(docs: DataFrame, *, window: int, finish, result: str, kinds: list[pa.DataType], bucket_bytes: int, both: bool = False) -> DataFrame:
    """docs: doc_id, text and columns to carry. finish(text, spans): the values of ``result``, a DDL string; ``kinds`` are
    their Arrow types. ``both``: the first of equal windows is reported too."""
    ddl, schema = R.shape(docs, result, kinds)
    n = pieces(text_bytes(docs), bucket_bytes)
    sizes = levels(window)
    packed = R.dealt_by(R.packed_documents(docs, n), n)
    told = None
    for level in range(len(sizes)):
        ask = _ask(sizes, level, n)
        asked = packed.applyInArrow(R.leaner(ask), R.ROW) if told is None else packed.cogroup(R.dealt_by(told, n)).applyInArrow(R.leaner(ask), R.ROW)
        told = R.dealt_by(asked, n).applyInArrow(R.leaner(_answer(level == len(sizes) - 1)), R.ROW)
    return packed.cogroup(R.dealt_by(told, n)).applyInArrow(R.leaner(_apply(window, both, finish, schema)), ddl)


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", carry: list[str] | None = None, same_if_untouched: bool = False, window: int = WINDOW, bucket_bytes: int = R.BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed word ranges), kept (the words left, joined by one blank; if
    ``same_if_untouched``, the text as it was where nothing is removed) and, with ``carry``, row: a struct of these columns."""
    rows = narrow(docs, id_col, text_col)
    if carry:
        rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*(F.col(f"`{x}`") for x in carry)).alias("row"))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return _repeated(
        rows, window=window, finish=_kept_or_same if same_if_untouched else _kept,
        result="n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string", kinds=[pa.int64(), pa.int64(), span, pa.string()], bucket_bytes=bucket_bytes,
    )


def _spans(text: bytes, spans: list[list[int]]) -> tuple:
    words = text.split()
    return ([b" ".join(words[a:b]).decode() for a, b in spans],)


def longest_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", window: int = WINDOW, bucket_bytes: int = R.BUCKET_BYTES) -> DataFrame:
    """doc_id and words: the longest of ``window``, 2 ``window``, 4 ``window``, ... at which a window of the document also
    starts in a document with another id. Documents that share none aren't listed.

    Level by level: what survives at a length (in all documents that share it) are passages, and only those of at least
    twice the length are candidates at the next. Each level is a table in the shared folder; the loop ends when none survive.
    """
    level, size, found = narrow(docs, id_col, text_col), window, None
    while True:
        rows = _repeated(
            level, window=size, finish=_spans,
            result="passages array<string>", kinds=[pa.list_(pa.string())], bucket_bytes=bucket_bytes, both=True,
        )
        kept = saved(rows.where(F.size("passages") > 0).select("doc_id", F.explode("passages").alias("text")), "level")
        if not kept.take(1):
            break
        here = kept.select("doc_id", F.lit(size).cast("long").alias("words"))
        found = here if found is None else found.union(here)
        size *= 2
        level = kept.where(F.size(F.split("text", " ")) >= size)
    if found is None:
        return narrow(docs, id_col, text_col).select("doc_id", F.lit(window).cast("long").alias("words")).limit(0)
    return found.groupBy("doc_id").agg(F.max("words").alias("words"))
