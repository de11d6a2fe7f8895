"""MinHash near-dedup: ProbMinHash signatures of weighted word shingles, banding, verification, classes.

Signature: each distinct shingle of a text (5 words) is a Poisson process with its weight as rate, drawn from the shingle
alone. Its arrivals fall on random registers, and a register keeps the shingle that arrives first. A shingle stops as soon
as its next arrival is later than all of the text's registers. Two texts agree on a register with the probability Jaccard
similarity of their weighted shingles. A text is signed with weight 1 for each distinct shingle, so that this is the
similarity that decides, and again with weight 1 + ln of its count if any shingle repeats.

Banding: 48 bands of 8 registers. Texts that agree on a band, by either signature, share a group; at similarity 0.8 a pair
misses all bands once in about 6,700 times, whatever repeats. Verification: Jaccard similarity of the sets of shingles (64-bit hashes), exactly, >= 0.8.

Classes, without all pairs of a group: equal texts are one member. In a task, the members of a group are verified against
the task's first member of it only, and these first members against the first of all; links are joined to components.
Groups that share members make a crowd. In a crowd that still holds several components, the members outside its largest
component meet all members of other components through an inverted index of shingles, which counts the shingles that two
texts share for all pairs that share any; only links that join two components come out of it, one for each two
components. So a group of copies costs one comparison a copy, and no link between texts of one crowd that would join two
classes is lost. A crowd of over UNIT members is dealt to several tasks, each with a block of the members outside the
largest component and a block of all: n members, m of them outside, cost n * m / UNIT copies of their shingles. That is
the price of exactness for texts that are many, alike enough to share bands, and not alike enough to be one class.

Scale: texts are read once; what a batch has signed and its distinct texts, compressed, are written to the shared folder.
A batch sends a band's first member on, not all, so a band that a third of all texts share makes one entry a batch. Texts
move, each once, to meet their pairs. Components are found by alternating star contractions of the links, as tables in the shared
folder; edges of hubs meet them by a broadcast of at most 2 * HUBS rows, others by a join. The driver holds none of this.

Defined cases: words are runs between Unicode white space of the lower-cased text; a text of one to four words is one
shingle; a null text or one without words is a class of its own; a null id counts as the smallest id (and is written
back as null); repeated rows and equal ids give one row for each row, and each text of an id is judged by itself: rows
of one id are in one class only if their texts are; ids must be integers; an empty table gives an empty result; other
columns are ignored. A text is told by 128 bits; of two whose first 64 agree (once in 2 ** 64 pairs) the second has no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import MULTIPLIER, mixed
from .common import NULL_ID, lean, lean_after, narrow, pieces, saved, text_bytes
from .repeats import ROW, by_print, dealt_by, first_rows, gathered, heads, leaner, pack, rows, split, unpack

WORDS = 5
SIMILARITY = 0.8
BANDS, DEPTH = 48, 8
BUCKET_BYTES = 8 << 20
TAKEN = 500
#: Members of a crowd that a task compares with as many others.
UNIT = 2000
#: Rows that share a key from which the key is a hub: the greater of these and a HUBS-th of all rows.
HUB, HUBS = 500, 100_000
#: What a batch writes: blobs as in ROW, and texts with their member.
SIGNED = f"{ROW}, member long"
BAND_ROWS, MEMBERS, PAIRS, TEXTS = range(4)


# ---- shingles and signatures


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hashes of all shingles of a text, in order, repeats included."""
    found = text.decode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(x.encode()) for x in found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = mixed(out * np.uint64(MULTIPLIER) + h[k : k + n])
    return out


def signatures(docs: list[np.ndarray], registers: int) -> np.ndarray:
    """ProbMinHash of some documents, each given by its shingles: the shingle that each register keeps (0 if none)."""
    kept = np.zeros((len(docs), registers), np.uint64)
    first = np.full((len(docs), registers), np.inf)
    which, hashes, pace = [], [], []
    for k, x in enumerate(docs):
        if len(x):
            own, counts = np.unique(x, return_counts=True)
            which.append(np.full(len(own), k, np.int64))
            hashes.append(own)
            pace.append(1 / (1 + np.log(counts)))
    if not which:
        return kept
    doc, element, pace = np.concatenate(which), np.concatenate(hashes), np.concatenate(pace)
    state, time = element.copy(), np.zeros(len(doc))
    flat_first, flat_kept = first.reshape(-1), kept.reshape(-1)
    while len(doc):
        state = state + np.uint64(MULTIPLIER)
        drawn = mixed(state)
        # 40 bits give the time to the next arrival, the other 24 the register.
        time = time - np.log(((drawn >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40) * pace
        at = doc * registers + (((drawn & np.uint64(0xFFFFFF)) * np.uint64(registers)) >> np.uint64(24)).astype(np.int64)
        sooner = np.flatnonzero(time < flat_first[at])
        np.minimum.at(flat_first, at[sooner], time[sooner])
        won = sooner[time[sooner] == flat_first[at[sooner]]]
        flat_kept[at[won]] = element[won]
        # Early end: later arrivals of a shingle can't be the first in any register of its document.
        on = time < first.max(1)[doc]
        if not on.all():
            doc, element, pace, state, time = doc[on], element[on], pace[on], state[on], time[on]
    return kept


def band_hashes(kept: np.ndarray, bands: int, depth: int) -> np.ndarray:
    """One hash for each document and band."""
    out = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(kept), bands)).copy()
    parts = kept.reshape(len(kept), bands, depth)
    for k in range(depth):
        out = mixed(out * np.uint64(MULTIPLIER) + parts[:, :, k])
    return out


def banded(docs: list[np.ndarray], bands: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, band) hashes: those of the sets of shingles and, where they differ, those of the weighted shingles."""
    sets = [np.unique(x) for x in docs]
    plain = band_hashes(signatures(sets, bands * depth), bands, depth)
    more = np.array([k for k, x in enumerate(docs) if len(sets[k]) < len(x)], np.int64)
    weighted = band_hashes(signatures([docs[k] for k in more], bands * depth), bands, depth)
    differ = weighted != plain[more]
    return np.r_[np.repeat(np.arange(len(docs)), bands), more[np.nonzero(differ)[0]]], np.r_[plain.reshape(-1), weighted[differ]]


def _sign(buckets: int, words: int, bands: int, depth: int):
    """Rows (doc_id, text, hash) as blobs of members and of their bands (the first member of each band of a batch goes on,
    others are paired with it), and the distinct texts."""

    @lean_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            if not whole.num_rows:
                continue
            band_of, key_of = [], []
            ids = whole.column(0).to_numpy(zero_copy_only=False)
            hashes = whole.column(2).to_numpy(zero_copy_only=False)
            texts = [x or b"" for x in whole.column(1).cast(pa.binary()).to_pylist()]
            keys = np.array([_key(x) for x in texts], np.uint64)
            # Of equal texts of a batch only one is signed.
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            order = order[heads(keys[order, 0], keys[order, 1])]
            order = order[(keys[order] != 0).any(1)]
            for start in range(0, len(order), TAKEN):
                some = order[start : start + TAKEN]
                at, band = banded([shingles(texts[k], words) for k in some], bands, depth)
                band_of.append(band)
                key_of.append(keys[some[at], 0])
            out = [(0, MEMBERS, pack(keys[:, 0], keys[:, 1], ids, hashes))]
            if band_of:
                band, key = np.concatenate(band_of), np.concatenate(key_of)
                sorted_ = np.lexsort((key, band))
                band, key = band[sorted_], key[sorted_]
                new = heads(band)
                pair = ~new & (key != key[first_rows(new)])
                out += [(0, PAIRS, pack(key[first_rows(new)][pair], key[pair]))] if pair.any() else []
                out += split(by_print(band[new], buckets), BAND_ROWS, [band[new], key[new]])
            made = rows(out)
            yield made.append_column("member", pa.nulls(made.num_rows, pa.int64())).to_batches()[0]
            for start in range(0, len(order), TAKEN):
                some = order[start : start + TAKEN]
                to = by_print(keys[some, 0], buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to), pa.array(np.full(len(some), TEXTS, np.int32)), pa.array([packer.compress(texts[k]) for k in some], pa.binary()), pa.array(np.ascontiguousarray(keys[some, 0]).view(np.int64))],
                    ["bucket", "kind", "payload", "member"],
                )
            lean()

    return run


def _key(text: bytes) -> tuple[int, int]:
    """128 bits that stand for a text's words; (0, 0) for none."""
    found = text.decode().lower().split()
    if not found:
        return 0, 0
    h = xxhash.xxh3_128_intdigest(" ".join(found).encode())
    return (h >> 64) | 1, h & (1 << 64) - 1


# ---- groups


def _group(table: pa.Table) -> pa.Table:
    """Of each bucket: pairs of a band's first member with each other one."""
    band, key = gathered(table, BAND_ROWS, ["<u8", "<u8"])
    order = np.lexsort((key, band))
    band, key = band[order], key[order]
    first = key[first_rows(heads(band))] if len(key) else key
    some = np.unique(np.stack([first, key], 1)[first != key], axis=0) if len(key) else np.zeros((0, 2), np.uint64)
    return pa.table([pa.array(np.ascontiguousarray(some[:, k]).view(np.int64)) for k in (0, 1)], names=["a", "b"])


def _unpacked(kinds: list[str], names: list[str]):
    """Blobs back to rows of signed 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in unpack(payload, kinds)], names)

    return run


# ---- texts


def packed_texts(signed: DataFrame, buckets: int) -> DataFrame:
    """bucket, member and compressed text of each member, grouped by bucket."""
    made = signed.where(F.col("kind") == TEXTS).select("bucket", "member", "payload").repartitionById(buckets, "bucket")
    return made.groupBy("bucket", "member").agg(F.first("payload").alias("payload")).groupBy("bucket")


def texts_of(table: pa.Table, wanted: set[int]) -> dict[int, bytes]:
    unpacker = zstandard.ZstdDecompressor()
    found = {}
    members, payloads = table.column("member"), table.column("payload")
    for k, m in enumerate(members.to_pylist()):
        if m in wanted:
            found[m] = unpacker.decompress(payloads[k].as_py())
    return found


# ---- verification


def _fetch_texts(buckets: int):
    """Pairs (a, b) meet the text of a and move, with it, to the bucket of b."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _pairs_of(right)
        out = []
        if len(a):
            texts = texts_of(left, set(a.tolist()))
            to = by_print(b.view(np.uint64), buckets)
            out = split(to, PAIRS, [a, b])
            for bucket in np.unique(to).tolist():
                some = np.unique(a[to == bucket]).tolist()
                data = pa.table([pa.array(some, pa.int64()), pa.array([texts.get(x, b"") for x in some], pa.binary())], names=["id", "text"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, data.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(data)
                out.append((bucket, TEXTS, sink.getvalue().to_pybytes()))
        return rows(out)

    return run


def _pairs_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    if not table.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return table.column("a").to_numpy(), table.column("b").to_numpy()


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted arrays of distinct values."""
    if not len(x) and not len(y):
        return 0.0
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def _verify(words: int, least: float):
    """Pairs whose texts are similar enough."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = gathered(right, PAIRS, ["<i8", "<i8"])
        found_a, found_b = [], []
        if len(a):
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = heads(a, b)
            a, b = a[new], b[new]
            sets = {i: np.unique(shingles(x, words)) for i, x in texts_of(left, set(b.tolist())).items()}
            at = np.flatnonzero(np.r_[heads(a), True])
            place = {int(a[s]): (s, e) for s, e in zip(at[:-1], at[1:], strict=True)}
            seen = set()
            for kind, blob in zip(right.column("kind").to_pylist(), right.column("payload").to_pylist(), strict=True):
                if kind != TEXTS:
                    continue
                data = pa.ipc.open_stream(blob).read_all()
                for i, text in zip(data.column(0).to_pylist(), data.column(1).to_pylist(), strict=True):
                    if i in seen:
                        continue
                    seen.add(i)
                    x = np.unique(shingles(text, words))
                    s, e = place[i]
                    for j in b[s:e].tolist():
                        y = sets.get(j)
                        if y is None or min(len(x), len(y)) < least * max(len(x), len(y)):
                            continue
                        if jaccard(x, y) >= least:
                            found_a.append(i)
                            found_b.append(j)
        return pa.table([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return run


def verified(packed, pairs: DataFrame, buckets: int, words: int, least: float) -> DataFrame:
    """The pairs (a, b) that are similar; saved in the shared folder. packed: texts grouped by bucket."""
    keyed = pairs.mapInArrow(_with_bucket(buckets), "bucket int, a long, b long")
    moved = packed.cogroup(dealt_by(keyed, buckets)).applyInArrow(leaner(_fetch_texts(buckets)), ROW)
    return saved(packed.cogroup(dealt_by(moved, buckets)).applyInArrow(leaner(_verify(words, least)), "a long, b long"), "links")


def _with_bucket(buckets: int):
    @lean_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array(by_print(x.column(0).to_numpy().view(np.uint64), buckets)), x.column(0), x.column(1)], ["bucket", "a", "b"])

    return run


# ---- crowds that hold several components


def open_members(pairs: DataFrame, roots: DataFrame, unit: int = UNIT) -> DataFrame:
    """unit, side (0: outside the crowd's largest component; 1: any), member, root of all members of crowds with two
    components or more; a member is in as many units as it has blocks to meet."""
    crowds = components(pairs)
    nodes = pairs.select(F.col("a").alias("member")).union(pairs.select("b")).distinct()
    rooted = nodes.join(crowds.select(F.col("node").alias("member"), F.col("root").alias("crowd")), "member", "left").withColumn("crowd", F.coalesce("crowd", "member"))
    rooted = rooted.join(roots.select(F.col("node").alias("member"), "root"), "member", "left").withColumn("root", F.coalesce("root", "member"))
    sizes = rooted.groupBy("crowd", "root").count()
    sizes = sizes.groupBy("crowd").agg(F.sum("count").alias("n"), F.max_by("root", F.struct("count", "root")).alias("largest"), F.max("count").alias("most")).where("n > most")
    sizes = sizes.select("crowd", "largest", F.ceil((F.col("n") - F.col("most")) / unit).alias("minor_blocks"), F.ceil(F.col("n") / unit).alias("blocks"))
    found = rooted.join(sizes, "crowd")
    block = lambda n: F.pmod(F.xxhash64("member"), F.col(n))
    side = lambda k, i, j: found.select("crowd", F.lit(k).alias("side"), "member", "root", "largest", i.alias("i"), j.alias("j"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    minor = side(0, block("minor_blocks"), F.lit(None).cast("long")).join(sizes.select("crowd", "blocks"), "crowd").where("root <> largest").withColumn("j", every("blocks"))
    all_ = side(1, F.lit(None).cast("long"), block("blocks")).join(sizes.select("crowd", "minor_blocks"), "crowd").withColumn("i", every("minor_blocks"))
    both = minor.select("crowd", "i", "j", "side", "member", "root").union(all_.select("crowd", "i", "j", "side", "member", "root"))
    return both.select(F.xxhash64("crowd", "i", "j").alias("unit"), "side", "member", "root")


def _fetch_sets(words: int, buckets: int):
    """Members of units meet their texts and move, as sets of shingles, to their units."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return rows([])
        unit, side, member, root = (right.column(x).to_numpy() for x in ("unit", "side", "member", "root"))
        texts = texts_of(left, set(member.tolist()))
        out = []
        to = by_print(unit.view(np.uint64), buckets)
        for bucket in np.unique(to).tolist():
            own = np.flatnonzero(to == bucket)
            order = np.argsort(member[own], kind="stable")
            own = own[order]
            sets, sizes = [], []
            for k, m in enumerate(member[own].tolist()):
                if k and member[own[k - 1]] == m:
                    sizes.append(-1)  # the same set as the row before
                else:
                    sets.append(np.unique(shingles(texts.get(m, b""), words)))
                    sizes.append(len(sets[-1]))
            head = pack(unit[own], side[own].astype(np.int64), member[own], root[own], np.array(sizes, np.int64))
            out.append((bucket, TEXTS, np.array([len(head)], "<u8").tobytes() + head + pack(np.concatenate(sets))))
        return rows(out)

    return run


def _link_units(least: float):
    """Links between components within each unit: one for each two components."""

    def run(table: pa.Table) -> pa.Table:
        by: dict[int, list[tuple[int, int, int, np.ndarray]]] = {}
        for blob in table.column("payload").to_pylist():
            cut = 8 + int(np.frombuffer(blob, "<u8", 1)[0])
            unit, side, member, root, sizes = unpack(blob[8:cut], ["<i8"] * 5)
            (values,) = unpack(blob[cut:], ["<u8"])
            at, last = 0, values[:0]
            for k, size in enumerate(sizes.tolist()):
                if size >= 0:
                    last, at = values[at : at + size], at + size
                by.setdefault(int(unit[k]), []).append((int(side[k]), int(member[k]), int(root[k]), last))
        links = [x for members in by.values() for x in joining(members, least)]
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def joining(members: list[tuple[int, int, int, np.ndarray]], least: float) -> list[tuple[int, int]]:
    """members: (side, member, root, shingles). Pairs of similar members of different roots, one for each two roots."""
    minor, others = [x for x in members if x[0] == 0], [x for x in members if x[0] == 1]
    if not minor or not others:
        return []
    sizes = np.array([len(x[3]) for x in others])
    roots = np.array([x[2] for x in others])
    postings = np.concatenate([x[3] for x in others])
    owners = np.repeat(np.arange(len(others)), sizes)
    order = np.argsort(postings, kind="stable")
    postings, owners = postings[order], owners[order]
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for _, member, root, own in minor:
        low, high = np.searchsorted(postings, own, "left"), np.searchsorted(postings, own, "right")
        shared = np.zeros(len(others), np.int64)
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            shared[owners[a:b]] += 1  # an owner has a shingle once
        near = np.flatnonzero((shared >= least * (len(own) + sizes - shared)) & (shared > 0) & (roots != root))
        for k in near.tolist():
            found.setdefault((min(root, int(roots[k])), max(root, int(roots[k]))), (member, others[k][1]))
    return list(found.values())


def rejoined(packed, members: DataFrame, buckets: int, words: int, least: float) -> DataFrame:
    """Links that join components of a crowd; saved in the shared folder."""

    @lean_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array(by_print(x.column(2).to_numpy().view(np.uint64), buckets)), *x.columns], ["bucket", *x.schema.names])

    keyed = members.mapInArrow(run, "bucket int, unit long, side int, member long, root long")
    sets = packed.cogroup(dealt_by(keyed, buckets)).applyInArrow(leaner(_fetch_sets(words, buckets)), ROW)
    return saved(dealt_by(sets, buckets).applyInArrow(leaner(_link_units(least)), "a long, b long"), "links")


# ---- components


def by_hubs(big: DataFrame, small: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """big joined with small, which has a row for each key and ``n``, how many rows of big have it. Rows of hubs, of which
    there are at most HUBS among ``total`` rows, meet them by broadcast; so no task gets all rows of a key."""
    hub = max(HUB, total // HUBS)
    hubs = small.where(F.col("n") > hub).drop("n")
    cold = big.join(F.broadcast(hubs.select(key)), key, "left_anti").join(small.where(F.col("n") <= hub).drop("n"), key, how)
    return cold.unionByName(big.join(F.broadcast(hubs), key))


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) for each node that isn't a root, by alternating star contractions.

    Each step points every node at the smallest node near it; it ends when a step changes nothing. Minima are taken by
    partial aggregation, and edges of hubs learn them by broadcast; no component is gathered in one place.
    """
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = _sum(edges)
    while True:
        total = 2 * before[0]
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = saved(by_hubs(both, least, "u", total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = by_hubs(large, least, "u", total)
        small = small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges = saved(small, "edges")
        if (after := _sum(edges)) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.select(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())


# ---- the whole


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", words: int = WORDS, least: float = SIMILARITY, bands: int = BANDS, depth: int = DEPTH, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row for each document: doc_id, class_id (the smallest id of its class), text_hash (Spark's xxhash64 of the text,
    null as empty) and first: whether it is the class's first row by doc_id and text_hash (equal rows are so together)."""
    whole = narrow(docs, id_col, text_col)
    kind = whole.schema["doc_id"].dataType
    text = F.coalesce("text", F.lit(""))
    whole = whole.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    buckets = pieces(text_bytes(whole), bucket_bytes)
    signed = saved(whole.mapInArrow(_sign(buckets, words, bands, depth), SIGNED), "signed")
    packed = packed_texts(signed, buckets)
    blobs = lambda k, kinds, names: signed.where(F.col("kind") == k).select("payload").mapInArrow(_unpacked(kinds, names), ", ".join(f"{x} long" for x in names))

    grouped = dealt_by(signed.where(F.col("kind") == BAND_ROWS).drop("member"), buckets).applyInArrow(leaner(_group), "a long, b long")
    pairs = saved(grouped.union(blobs(PAIRS, ["<u8", "<u8"], ["a", "b"])).distinct(), "pairs")
    roots = components(verified(packed, pairs, buckets, words, least))
    more = rejoined(packed, open_members(pairs, roots), buckets, words, least)
    if more.take(1):
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))

    # Members with their smallest row, then classes with theirs; a text without words is no member.
    every = blobs(MEMBERS, ["<u8", "<u8", "<i8", "<i8"], ["member", "two", "doc_id", "hash"])
    row = F.struct("doc_id", "hash")
    known = saved(every.groupBy("member", "two").agg(F.min(row).alias("least"), F.count("*").alias("n")), "members")
    alone = known.groupBy("member").agg(F.min("two").alias("two"))
    known = known.join(alone, ["member", "two"], "left_semi").where("member <> 0 or two <> 0")
    rooted = known.join(roots.select(F.col("node").alias("member"), "root"), "member", "left").withColumn("root", F.coalesce("root", "member"))
    classes = rooted.groupBy("root").agg(F.min("least").alias("class"), F.count("*").alias("n"))
    total = docs.count()
    of = by_hubs(rooted.select("member", "two", F.col("n").alias("rows"), "root"), classes, "root", total)
    of = saved(of.select(F.struct("member", "two").alias("key"), F.col("rows").alias("n"), "class"), "classes")
    found = by_hubs(every.select(F.struct("member", "two").alias("key"), "doc_id", "hash"), of, "key", total, "left")
    found = found.withColumn("class", F.coalesce("class", row))
    null = lambda c: F.when(c != NULL_ID, c).cast(kind)
    return found.select(null(F.col("doc_id")).alias("doc_id"), null(F.col("class.doc_id")).alias("class_id"), F.col("hash").alias("text_hash"), (row == F.col("class")).alias("first"))
