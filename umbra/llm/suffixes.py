"""Suffix-array dedup: blockwise sorting of suffixes with a difference cover.

Places whose number, modulo the period of 57, is in a perfect difference cover (8 of 57) are the sample: for any two
places in two documents some offset below the period puts both into the sample. So of two equal strings of 100 bytes,
the 44 bytes from such an offset on begin two sampled suffixes.

1. Chunks of documents ask which of the 44 bytes at their sampled places occur elsewhere, by 4-byte tags within a range of
   fingerprints (a question costs 3 bytes; one in some thousand answers says yes to a suffix that is alone, at any size).
   A suffix that is alone goes no further.
2. Blocks: the others are dealt by ranges of their first bytes. One block at a time is sorted, by the first 8 bytes, then
   by the class of the 36 after these. Long ties are resolved by the class of all that surrounds a suffix within reach of
   a string of 100 bytes (56 bytes before, 100 after), computed when the sample was taken. A suffix whose class occurs
   earlier is settled, without reading texts again. What is left of a tie with several classes is undecided: there a
   repeated passage begins or ends.
3. Undecided suffixes fetch these bytes and are compared within their tie, a block of ties at a time; where a tie has
   over ``crowd`` classes, the strings of 100 bytes around them are compared instead, dealt over all tasks.
4. Ranges meet their documents.

Memory: a task holds a chunk of documents or a block, of about ``bucket_bytes`` of text, and a chunk asks about a prefix
once, however often it has it (see ``repeats``). A tie that over ``crowd`` chunks have is dealt by class, so a
passage that a third of all documents share, with whatever around it, doesn't gather in one task.

Beyond its first 8 bytes a suffix is ordered by classes (64-bit fingerprints), not by its bytes: that order decides nothing
but who meets whom. Strings of crowds are compared by 128 bits, all others as bytes or by classes within equal first bytes.

Defined cases: a null text is empty; texts of fewer than ``length`` bytes lose nothing; rows that share id and text get
equal results and don't remove each other's bytes; rows that share only the id follow each other in the order of a
hash of their texts; a null id counts as the smallest; ids must be integers; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from . import repeats as R
from .common import narrow, pieces, text_bytes

LENGTH, PERIOD, CROWD = 100, 57, 64
BUCKET_BYTES = 8 << 20
#: Bytes of text from which the limits of blocks are taken, and prefixes taken from it.
SAMPLED_BYTES, SAMPLED = 64 << 20, 1 << 20
#: Kinds of rows. ENTRIES: sampled suffixes, then undecided ones; RANGES: repeated bytes.
ENTRIES, RANGES, CONTEXTS, WINDOWS = range(4)
@dataclass(frozen=True)
class Plan:
    length: int
    period: int
    crowd: int
    buckets: int
    #: First prefix of each block but the first, ascending.
    limits: np.ndarray

    @property
    def prefix(self) -> int:
        return self.length - self.before

    @property
    def before(self) -> int:
        return self.period - 1

    @property
    def context(self) -> int:
        return self.length + self.before


# ---- step 1: blocks of sampled suffixes


class Suffixes:
    """The sampled suffixes of some documents. Documents stand in one array, 0xFF (in no UTF-8 text) between them."""

    def __init__(self, texts: list[bytes], length: int, period: int):
        self.prefix = length - period + 1
        edge = b"\xff" * length
        sizes = np.array([len(x) for x in texts], np.int64)
        self.data = np.frombuffer(edge + edge.join(texts) + edge + edge, np.uint8)
        self.begins = length + np.concatenate([[0], np.cumsum(sizes + length)])[: len(texts)]
        cover = A.positional(period, period)
        below = np.searchsorted(cover, np.arange(period))  # members of the cover below a remainder
        some = np.flatnonzero(sizes >= length)
        last = sizes[some] - self.prefix + 1
        counts = last // period * len(cover) + below[last % period]
        k = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        self.which = np.repeat(some, counts)
        self.at = k // len(cover) * period + cover[k % len(cover)]
        self.head = self.word(0).view(">u8").astype("<u8")
        self.tail = self.classes(8, self.prefix)

    def word(self, offset: int, some=slice(None)) -> np.ndarray:
        """The 8 bytes at an offset from each suffix."""
        found = np.lib.stride_tricks.sliding_window_view(self.data, 8)[self.begins[self.which[some]] + self.at[some] + offset]
        return np.ascontiguousarray(found).view("<u8").reshape(-1)

    def classes(self, start: int, end: int, some=slice(None)) -> np.ndarray:
        """Fingerprints of the bytes between two offsets, at least 8 apart."""
        out = A.mixed(self.word(start, some))
        for offset in [*range(start + 8, end - 7, 8), end - 8]:
            out = A.joined(out, self.word(offset, some))
        return out


def together(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Pairs of numbers as bytes of the same order."""
    return np.stack([head, tail], 1).astype(">u8").view("S16").reshape(-1)


def block_limits(docs: DataFrame, length: int, period: int, total_bytes: int, buckets: int) -> np.ndarray:
    """Beginnings that cut the sampled suffixes into blocks of like size, from a bounded sample of documents. Limits decide
    how even blocks are, and nothing else."""
    share = min(1.0, SAMPLED_BYTES / max(total_bytes, 1))
    thin = max(1, int(total_bytes * share) // 7 // SAMPLED)

    def run(batches):
        for batch in batches:
            found = Suffixes(R.documents(batch)[2], length, period)
            some = A.mixed(found.tail) % np.uint64(16 * thin) == 0
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in together(found.head[some], found.tail[some])], pa.binary())], ["start"])

    if buckets == 1:
        return np.zeros(0, "S16")
    found = docs.select("doc_id", "text").where(F.rand(7) < share).mapInArrow(run, "start binary").distinct()
    some = np.sort(np.array([bytes(r.start) for r in found.collect()], "S16"))
    return np.unique(some[(np.arange(1, buckets) * len(some)) // buckets]) if len(some) else some


def tagged(found: Suffixes, buckets: int):
    """The question of each suffix (a class of its first bytes); the questions in order, with how often each is asked, and
    where the ranges of fingerprints start."""
    keys = A.joined(found.head, found.tail)
    # Ranges are taken from the upper half of a mixed key (see by_print), tags from the lower half of the key.
    asked = R.by_print(keys, buckets).astype(np.uint64) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)
    order = np.argsort(asked)
    asked = asked[order]
    new = R.heads(asked)
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new) - 1
    asked = asked[new]
    return own, asked.astype(np.uint32), np.bincount(own, minlength=len(asked)), np.searchsorted(asked, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    ids, salts, texts, seen = [], [], [], set()
    for part in R.unpacked_documents(table):
        for i, s, text in zip(*R.documents(part), strict=True):
            if len(text) and (int(i), int(s)) not in seen:  # a repeated row isn't another document
                seen.add((int(i), int(s)))
                ids.append(i)
                salts.append(s)
                texts.append(text)
    return np.array(ids, np.int64), np.array(salts, np.uint32), texts


ASKED, ANSWERED = ["<u4", "u1"], ["u1"]
ALONE, TIED, CROWDED = range(3)


def _ask(plan: Plan):
    """A chunk's tags, once each, in order and as differences, with whether it has one several times."""

    def run(left: pa.Table) -> pa.Table:
        _, tags, counts, starts = tagged(Suffixes(_texts(left)[2], plan.length, plan.period), plan.buckets)
        chunk = left.column("bucket")[0].as_py()
        several = (counts > 1).astype(np.uint8)
        return R.rows([(k, chunk, R.pack(np.diff(tags[a:b], prepend=np.uint32(0)), several[a:b])) for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if b > a])

    return run


def _answer(plan: Plan):
    """For each tag of a question, in its order, whether it is alone, tied or crowded: four answers a byte."""

    def run(table: pa.Table) -> pa.Table:
        chunk, (steps, several) = R.origins(table, ASKED)
        if not len(steps):
            return R.rows([])
        at = np.r_[0, np.flatnonzero(np.diff(chunk)) + 1, len(chunk)]
        total = np.cumsum(steps, dtype=np.uint64)
        before = np.r_[np.uint64(0), total[at[1:-1] - 1]]
        tags = (total - np.repeat(before, np.diff(at))).astype(np.uint32)
        order = np.argsort(tags, kind="stable")
        group = np.cumsum(R.heads(tags[order])) - 1
        chunks = np.bincount(group)
        state = np.where(chunks > plan.crowd, CROWDED, np.where((chunks > 1) | (np.bincount(group, weights=several[order]) > 0), TIED, ALONE)).astype(np.uint8)
        told = np.empty(len(tags), np.uint8)
        told[order] = state[group]
        bucket = table.column("bucket")[0].as_py()
        return R.rows([(int(chunk[a]), bucket, R.pack(_quartered(told[a:b]))) for a, b in zip(at[:-1], at[1:], strict=True)])

    return run


def _quartered(states: np.ndarray) -> np.ndarray:
    four = np.concatenate([states, np.zeros(-len(states) % 4, np.uint8)]).reshape(-1, 4)
    return four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6


# ---- step 2: blocks of suffixes, and long ties


#: First bytes, class of the next, class of the surroundings, id, salt, place, bytes to the end (at most a string), state.
ENTRY = ["<u8", "<u8", "<u8", "<i8", "<u4", "<u4", "u1", "u1"]
#: Tie, id, salt, place, whether it is crowded.
UNDECIDED = ["<u8", "<i8", "<u4", "<u4", "u1"]


def _entries(plan: Plan):
    """Suffixes that aren't alone; of those of one tie and class only a chunk's first."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, salts, texts = _texts(left)
        found = Suffixes(texts, plan.length, plan.period)
        own, tags, _, starts = tagged(found, plan.buckets)
        state = np.zeros(len(tags), np.uint8)
        for bucket, payload in zip(right.column("kind").to_pylist(), right.column("payload").to_pylist(), strict=True):
            (four,) = R.unpack(payload, ANSWERED)
            a, b = starts[bucket], starts[bucket + 1]
            state[a:b] = np.stack([four >> (2 * k) & 3 for k in range(4)], 1).reshape(-1)[: b - a]
        some = np.flatnonzero(state[own] > ALONE)
        which, at = found.which[some], found.at[some]
        sizes = np.array([len(x) for x in texts], np.int64)
        rest = np.minimum(sizes[which] - at, plan.length).astype(np.uint8)
        held = [found.head[some], found.tail[some], found.classes(-plan.before, plan.length, some), ids[which], salts[which], at.astype(np.uint32), rest, (state[own[some]] == CROWDED).astype(np.uint8)]
        known, held = _sorted_block(held)
        out = _surroundings(plan, *(x[known] for x in held[3:7]))
        kept = [x[~known] for x in held]
        # A crowded tie is dealt by class, so its block is any.
        crowd = kept[7] > 0
        to = np.searchsorted(plan.limits, together(kept[0], kept[1]), side="right").astype(np.int32) if len(plan.limits) else np.zeros(len(crowd), np.int32)
        return R.rows(out + R.split(np.where(crowd, R.by_print(kept[2], plan.buckets), to), ENTRIES, kept))

    return run


def _sorted_block(held: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order of their first bytes, ties by class, equal classes by id, salt and place; which of them come
    after another of their tie and class."""
    head, tail, prints, ids, salts, at = held[:6]
    order = np.lexsort((at, salts, ids, prints, tail, head))
    held = [x[order] for x in held]
    return ~R.heads(*held[:3]), held


def byte_values(text: bytes) -> np.ndarray:
    return A.BYTE_VALUES[np.frombuffer(text, np.uint8)]


def _settled(*arrays) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorts strings by their two fingerprints, id, salt and place; which of them come after an equal one."""
    one, two, ids, salts, at = arrays
    order = np.lexsort((at, salts, ids, two, one))
    arrays = [x[order] for x in arrays]
    return ~R.heads(arrays[0], arrays[1]), arrays


def _surroundings(plan: Plan, ids, salts, at, rest) -> list[tuple[int, int, bytes]]:
    """The ranges of strings around some suffixes, clipped to their documents."""
    at = at.astype(np.int64)
    return R.ranges(RANGES, plan.buckets, ids, salts, np.maximum(at - plan.before, 0).astype(np.uint32), (at + rest).astype(np.uint32))


def _compare(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        out = [(b, k, p) for b, k, p in zip(*(x.to_pylist() for x in table.columns), strict=True) if k == RANGES]
        held = R.gathered(table, ENTRIES, ENTRY)
        if len(held[0]):
            known, held = _sorted_block(held)
            head, tail, _, ids, salts, at, rest, crowded = held
            out += _surroundings(plan, ids[known], salts[known], at[known], rest[known])
            group = np.cumsum(R.heads(head, tail)) - 1
            several = np.bincount(group, weights=~known)[group]
            # Of a crowded tie other tasks may hold other classes.
            open_ = ~known & ((several > 1) | (crowded > 0))
            crowd = ((several > plan.crowd) | (crowded > 0)).astype(np.uint8)
            tie = A.joined(head, tail)
            out += R.split(R.by_document(ids[open_], salts[open_], plan.buckets), ENTRIES, [x[open_] for x in (tie, ids, salts, at, crowd)])
        return R.rows(out)

    return run


# ---- step 3: undecided suffixes


def _fetch(plan: Plan):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = R.ranges(RANGES, plan.buckets, *R.gathered(right, RANGES, R.RANGE))
        tie, ids, salts, at, crowded = R.gathered(right, ENTRIES, UNDECIDED)
        if len(tie) and left.num_rows:
            wanted: dict[tuple[int, int], np.ndarray] = {}
            order = np.lexsort((at, salts, ids))
            new = np.flatnonzero(np.r_[R.heads(ids[order], salts[order]), True])
            for a, b in zip(new[:-1], new[1:], strict=True):
                wanted[int(ids[order[a]]), int(salts[order[a]])] = order[a:b]
            texts = {}
            for part in R.unpacked_documents(left):
                for i, s, text in zip(*R.documents(part), strict=True):
                    if (key := (int(i), int(s))) in wanted:
                        texts[key] = text
            out += _contexts(plan, texts, {k: v[crowded[v] == 0] for k, v in wanted.items()}, tie, ids, salts, at)
            out += _windows(plan, texts, {k: v[crowded[v] == 1] for k, v in wanted.items()}, at)
        return R.rows(out)

    return run


def _contexts(plan: Plan, texts, wanted, tie, ids, salts, at) -> list[tuple[int, int, bytes]]:
    """The bytes before and after the beginnings of suffixes (which are equal in a tie), 0xFF (in no UTF-8 text) outside
    the document."""
    picked, made = [], []
    for key, which in wanted.items():
        if len(which):
            edge = np.full(plan.length, 255, np.uint8)
            text = np.concatenate([edge, np.frombuffer(texts[key], np.uint8), edge])
            around = np.lib.stride_tricks.sliding_window_view(text, plan.context)[at[which].astype(np.int64) + plan.prefix]
            made.append(np.delete(around, slice(plan.before, plan.before + plan.prefix), 1))
            picked.append(which)
    if not made:
        return []
    which, made = np.concatenate(picked), np.concatenate(made)
    return R.split(R.by_print(tie[which], plan.buckets), CONTEXTS, [tie[which], ids[which], salts[which], at[which], made.view(f"V{2 * plan.before}").reshape(-1)])


def _windows(plan: Plan, texts, wanted, at) -> list[tuple[int, int, bytes]]:
    """Fingerprints of the strings around undecided suffixes; of equal ones of this chunk only the earliest go on."""
    names = [k for k, v in wanted.items() if len(v)]
    held = []
    for a, b in A.chunked([len(texts[k]) for k in names], plan.length):
        docs = [byte_values(texts[k]) for k in names[a:b]]
        values, starts = A.padded(docs, plan.length)
        places = []
        for k, start, doc in zip(names[a:b], starts.tolist(), docs, strict=True):
            mark = np.zeros(len(doc) - plan.length + 2, np.int32)
            p = at[wanted[k]].astype(np.int64)
            np.add.at(mark, np.clip(p - plan.before, 0, len(mark) - 1), 1)
            np.add.at(mark, np.clip(p + 1, 0, len(mark) - 1), -1)
            places.append(start + np.flatnonzero(np.cumsum(mark)[:-1] > 0))
        where = np.concatenate(places)
        counts = [len(x) for x in places]
        one = A.Fingerprints(values, plan.length).at(where, plan.length)
        two = A.Fingerprints(A.mixed(values) * (values > 0), plan.length).at(where, plan.length)
        held.append((one, two, np.repeat(np.array([k[0] for k in names[a:b]], np.int64), counts), np.repeat(np.array([k[1] for k in names[a:b]], np.uint32), counts), (where - np.repeat(starts, counts)).astype(np.uint32)))
    if not held:
        return []
    known, held = _settled(*(np.concatenate(x) for x in zip(*held, strict=True)))
    _, _, ids, salts, start = (x[known] for x in held)
    out = R.ranges(RANGES, plan.buckets, ids, salts, start, start + np.uint32(plan.length))
    kept = [x[~known] for x in held]
    return out + R.split(R.by_print(kept[0], plan.buckets), WINDOWS, kept)


def _decide(plan: Plan):
    def run(table: pa.Table) -> pa.Table:
        held = [R.gathered(table, RANGES, R.RANGE)]
        arrays = R.gathered(table, WINDOWS, ["<u8", "<u8", "<i8", "<u4", "<u4"])
        if len(arrays[0]):
            known, arrays = _settled(*arrays)
            _, _, ids, salts, start = (x[known] for x in arrays)
            held.append((ids, salts, start, start + np.uint32(plan.length)))
        tie, ids, salts, at, made = R.gathered(table, CONTEXTS, ["<u8", "<i8", "<u4", "<u4", f"V{2 * plan.before}"])
        if len(tie):
            order = np.lexsort((at, salts, ids, tie))
            tie, ids, salts, at, made = (x[order] for x in (tie, ids, salts, at, made))
            group = np.flatnonzero(R.heads(tie))
            # Some ties at a time; a tie has at most ``crowd`` suffixes here.
            cuts = group[np.unique(np.searchsorted(group, np.arange(0, len(tie), 4096)).clip(0, len(group) - 1))]
            for a, b in zip(cuts, [*cuts[1:], len(tie)], strict=True):
                held.append(_decide_contexts(plan, tie[a:b], ids[a:b], salts[a:b], at[a:b], made[a:b]))
        return R.rows(R.ranges(RANGES, plan.buckets, *(np.concatenate(x) for x in zip(*held, strict=True))))

    return run


def _decide_contexts(plan: Plan, tie, ids, salts, at, made):
    """Rows are sorted by tie, id, salt and place. All strings of a context overlap in the prefix, so the union of the
    repeated ones is one range."""
    n, width = len(tie), plan.context
    data = np.insert(np.frombuffer(made.tobytes(), np.uint8).reshape(n, -1), [plan.before] * plan.prefix, 0, axis=1)
    prints = A.Fingerprints(A.BYTE_VALUES[data.reshape(-1)], plan.length)
    inside = data != 255
    left, right = inside.argmax(1), width - inside[:, ::-1].argmax(1)
    group = (np.cumsum(R.heads(tie)) - 1).astype(np.uint64)
    low, high = np.full(n, width, np.int64), np.full(n, -1, np.int64)
    for offset in range(plan.before + 1):
        ok = np.flatnonzero((left <= offset) & (right >= offset + plan.length))
        if not len(ok):
            continue
        key = prints.at(ok * width + offset, plan.length)
        order = np.lexsort((key, group[ok]))
        hit = ok[order][~R.heads(group[ok][order], key[order])]
        low[hit] = np.minimum(low[hit], offset)
        high[hit] = offset
    some = high >= 0
    base = at[some].astype(np.int64) - plan.before
    return ids[some], salts[some], (base + low[some]).astype(np.uint32), (base + high[some] + plan.length).astype(np.uint32)


# ---- step 4


def _apply(finish, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return R.finished(left, R.by_text(*R.gathered(right, RANGES, R.RANGE)), finish, schema)

    return run


def _kept(text: bytes, spans: list[list[int]]) -> tuple:
    out, at = [], 0
    for start, end in spans:
        out.append(text[at:start])
        at = end
    kept = b"".join([*out, text[at:]])
    return len(text), len(text) - len(kept), [{"start": a, "end": b} for a, b in spans], kept


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", length: int = LENGTH, period: int = PERIOD, crowd: int = CROWD, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed byte ranges), kept (the bytes left)."""
    if length - period + 1 < 16 or length > 255:
        raise ValueError("the length is at most 255 bytes, and the period must leave a beginning of 16 bytes or more of it")
    rows = narrow(docs, id_col, text_col)
    total = text_bytes(rows)
    n = pieces(total, bucket_bytes)
    plan = Plan(length, period, crowd, n, block_limits(rows, length, period, total, n))
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    ddl, schema = R.shape(rows, "n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary", [pa.int64(), pa.int64(), span, pa.binary()])
    packed = R.dealt_by(R.packed_documents(rows, n), n)
    answered = R.dealt_by(packed.applyInArrow(R.leaner(_ask(plan)), R.ROW), n).applyInArrow(R.leaner(_answer(plan)), R.ROW)
    entries = packed.cogroup(R.dealt_by(answered, n)).applyInArrow(R.leaner(_entries(plan)), R.ROW)
    compared = R.dealt_by(entries, n).applyInArrow(R.leaner(_compare(plan)), R.ROW)
    fetched = packed.cogroup(R.dealt_by(compared, n)).applyInArrow(R.leaner(_fetch(plan)), R.ROW)
    decided = R.dealt_by(fetched, n).applyInArrow(R.leaner(_decide(plan)), R.ROW)
    return packed.cogroup(R.dealt_by(decided, n)).applyInArrow(R.leaner(_apply(_kept, schema)), ddl)
