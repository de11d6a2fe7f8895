from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from umbra.llm import anchors, queries, repeats, substring, suffixes
from umbra.llm.common import NULL_ID


def brute_bytes(rows, length=100):
    """Row by row: the bytes removed, by the contract's words."""
    order = sorted({(NULL_ID if d is None else d, repeats.salt((t or "").encode()), (t or "").encode()) for d, t in rows})
    seen: set[bytes] = set()
    gone = {}
    for d, s, t in order:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            x = t[i : i + length]
            if x in seen:
                cover[i : i + length] = True
            seen.add(x)
        gone[d, s] = cover
    out = Counter()
    for d, t in rows:
        t = (t or "").encode()
        cover = gone[NULL_ID if d is None else d, repeats.salt(t)]
        spans = int((np.diff(np.r_[0, cover.astype(int), 0]) == 1).sum())
        out[d, len(t), int(cover.sum()), spans, bytes(b for b, c in zip(t, cover, strict=True) if not c)] += 1
    return out


def brute_words(rows, window=13):
    least: dict[tuple, int] = {}
    split = lambda t: [x for x in (t or "").encode().split()]
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, d if d is not None else NULL_ID), d if d is not None else NULL_ID)
    out = Counter()
    for d, t in rows:
        w, gone = split(t), set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (NULL_ID if d is None else d):
                gone.update(range(i, i + window))
        out[d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()] += 1
    return out


@pytest.fixture(scope="module")
def shared(docs):
    """More rows: passages shared by many, at edges, in hot groups, and equal ids with different texts."""
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    passage = rows[10][1] and next(t for _, t in rows if t and len(t) > 800)[:400]
    for k in range(90):
        rows.append((1000 + k, f"begin{k} " * (k % 4) + passage[k % 7 :] + f" end {k}" * (k % 3)))
    rows += [(2000, passage), (2000, passage + " other"), (2001, passage * 3), (2002, "ab" * 500), (2003, "ab" * 300), (2004, "é" * 400)]
    return docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(7), rows


@pytest.mark.parametrize(("bucket_bytes", "period", "crowd"), [(suffixes.BUCKET_BYTES, 57, 64), (30_000, 57, 64), (30_000, 57, 2), (60_000, 73, 0), (60_000, 70, 5)])
def test_bytes_against_brute_force(shared, bucket_bytes, period, crowd):
    """Also with crowds of three and of all: every way of deciding gives the same."""
    df, rows = shared
    found = suffixes.remove_repeats(df, bucket_bytes=bucket_bytes, period=period, crowd=crowd).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found) == brute_bytes(rows)


@pytest.mark.parametrize("bucket_bytes", [repeats.BUCKET_BYTES, 30_000])
def test_words_against_brute_force(shared, bucket_bytes):
    df, rows = shared
    found = substring.remove_repeats(df, bucket_bytes=bucket_bytes).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found) == brute_words(rows)


def test_carried_columns(docs):
    out = substring.remove_repeats(docs, carry=["lang", "source", "n_chars", "n_words"], same_if_untouched=True)
    assert out.columns == ["doc_id", "n_words", "n_removed", "spans", "kept", "row"]
    rows = out.collect()
    assert Counter((r.doc_id, r.row.source, r.row.n_chars, r.row.n_words) for r in rows) == Counter((r.doc_id, r.source, r.n_chars, r.n_words) for r in docs.collect())
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert all((r.doc_id, r.kept) in texts for r in rows if not r.n_removed) and any(r.n_removed for r in rows)


def test_levels_double():
    assert substring.levels(13) == [4, 8, 13] and substring.levels(26) == [4, 8, 16, 26] and substring.levels(3) == [3] and substring.levels(100) == [4, 8, 16, 32, 64, 100]


def test_structured_sequences_do_not_meet(spark):
    """Thue-Morse sequences and their complements, on which polynomials modulo a power of two agree."""
    bits = [bin(k).count("1") % 2 for k in range(4096)]
    one, two = " ".join("ab"[b] for b in bits), " ".join("ba"[b] for b in bits)
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    shared = max(size for size in (13, 26, 52, 104, 208, 416, 832, 1664, 3328) if {one[2 * i : 2 * (i + size) - 1] for i in range(4097 - size)} & {two[2 * i : 2 * (i + size) - 1] for i in range(4097 - size)})
    assert {r.doc_id: r.words for r in substring.longest_repeats(df).collect()} == {1: shared, 2: shared}
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df).collect()) == brute_words([(1, one), (2, two)])


def test_a_hot_phrase_asks_once_a_chunk(spark):
    """A third of all documents share a passage amid words of their own: both operators, against brute force, and what a
    range of fingerprints is asked."""
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(30)) + (" one passage that a third of all of the documents here share between other words" if k % 3 == 0 else " none") + f" end{k} of{k}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(df, bucket_bytes=20_000).collect()) == brute_words(rows)
    found = suffixes.remove_repeats(df, bucket_bytes=20_000, crowd=3).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in found) == brute_bytes(rows)
    packed = repeats.dealt_by(repeats.packed_documents(df, 8), 8)
    asked = packed.applyInArrow(substring._ask(substring.levels(13), 0, 8), repeats.ROW).collect()
    n = Counter()
    for r in asked:
        n.update(repeats.unpack(bytes(r.payload), substring.ASKED)[0].tolist())
    assert max(n.values()) <= 8 and sum(n.values()) > 1000


def test_longest_repeats(shared):
    df, rows = shared
    rows = [(d, t) for d, t in rows if d is not None and (not t or len(t) < 20_000)]
    df = df.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want: dict[int, int] = {}
    size = 13
    while True:
        where: dict[tuple, set] = {}
        for d, t in rows:
            w = (t or "").split()
            for i in range(len(w) - size + 1):
                where.setdefault(tuple(w[i : i + size]), set()).add(d)
        found = {d for ds in where.values() if len(ds) > 1 for d in ds}
        if not found:
            break
        want |= dict.fromkeys(found, size)
        size *= 2
    assert size > 52
    for bucket_bytes in (repeats.BUCKET_BYTES, 40_000):
        assert {r.doc_id: r.words for r in substring.longest_repeats(df, bucket_bytes=bucket_bytes).collect()} == want


def test_empty(none):
    assert substring.longest_repeats(none).count() == 0
    assert substring.remove_repeats(none).count() == 0
    assert suffixes.remove_repeats(none).count() == 0


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    found = queries.op6_suffixes(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in found) == Counter({(d, n, g, s): c for (d, n, g, s, _), c in brute_bytes(rows).items()})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=120), st.lists(st.integers(0, 3), min_size=0, max_size=30), st.integers(0, 1))
def test_equal_windows_share_an_anchor(one, two, which):
    window, sub = 10, 4
    docs = [np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1) for x in (one, one[5:] + two, two + one)]
    values, starts = anchors.padded(docs, window)
    sizes = np.array([len(x) for x in docs])
    prints = anchors.Fingerprints(values, window)
    at = set(anchors.anchors(values, starts, sizes, window, sub, prints).tolist())
    by: dict[tuple, set] = {}
    for start, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        for i in range(start, start + n - window + 1):
            inside = {p - i for p in range(i, i + window - sub + 1) if p in at}
            assert inside
            key = tuple(values[i : i + window].tolist())
            by[key] = by.get(key, inside) & inside
    assert all(by.values())


def test_difference_cover():
    for period in (7, 13, 21, 31, 57, 64, 70, 73, 91):
        members = anchors.positional(period, period).tolist()
        assert {(a - b) % period for a in members for b in members} == set(range(period))
