import random
from collections import defaultdict

import numpy as np
import pytest
from umbra.llm import neardup
from umbra.llm.common import NULL_ID

from .conftest import prose


def sets(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(rows, least=0.8):
    """(doc_id, text) to the smallest id of its component; all pairs of different texts."""
    rows = sorted({(NULL_ID if d is None else d, t or "") for d, t in rows})
    shingled = {t: sets(t) for _, t in rows}
    root = {t: t for t in shingled}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted((t for t in shingled if shingled[t]), key=lambda t: len(shingled[t]))
    for k, a in enumerate(order):
        x = shingled[a]
        for b in order[k + 1 :]:
            y = shingled[b]
            if len(x) < least * len(y):
                break
            if (n := len(x & y)) >= least * (len(x) + len(y) - n):
                root[find(a)] = find(b)
    smallest = {}
    for d, t in rows:
        if shingled[t]:
            smallest.setdefault(find(t), d)
    return {(d, t): smallest[find(t)] if shingled[t] else d for d, t in rows}


def classes_of(df, **options):
    """The same of the operator; a row is known by its id and text."""
    texts = {(r.doc_id, r.h): r.text for r in df.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    null = lambda x: NULL_ID if x is None else x
    out = neardup.near_duplicates(df, **options).collect()
    assert len(out) == df.count()
    assert all(r.first == (null(r.doc_id) == null(r.class_id)) or r.doc_id == r.class_id for r in out)
    return {(null(r.doc_id), texts[r.doc_id, r.text_hash]): null(r.class_id) for r in out}


def near(text, seed, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**9)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows(docs):
    out = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").distinct().collect()]
    base = prose(500, 160)
    out += [(5000 + k, near(base, k, k % 6)) for k in range(150)]  # one large group of near copies, J from 0.6 to 1
    out += [(6000 + k, base) for k in range(40)]
    passage = prose(501, 60)
    out += [(7000 + k, prose(800 + k, 30) + " " + passage + " " + prose(900 + k, 30)) for k in range(60)]  # share half, aren't near
    out += [(8000 + 10 * k + j, near(prose(2000 + k, 120), j, j)) for k in range(15) for j in range(3)]
    chain = prose(502, 200).split()
    out += [(9000 + k, " ".join(chain[6 * k :] + [f"x{k}y{i}" for i in range(6 * k)])) for k in range(8)]  # linked only through neighbours
    return out


@pytest.mark.parametrize("unit", [2000, 7])
def test_classes_against_brute_force(spark, rows, unit, monkeypatch):
    monkeypatch.setattr(neardup.open_members, "__defaults__", (unit,))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_classes(rows)
    for bucket_bytes in (neardup.BUCKET_BYTES, 40_000):
        assert classes_of(df, bucket_bytes=bucket_bytes) == want
        monkeypatch.setattr(neardup, "HUB", 5)


def test_passages_repeated_more_often_in_one_text(spark):
    rows = []
    for k in range(80):
        passage, rest = prose(3000 + k, 60), prose(4000 + k, 140)
        rows += [(2 * k, f"{passage} {rest}"), (2 * k + 1, " ".join([passage] * (20, 100)[k % 2] + [near(rest, k, k % 4)]))]
    want = brute_classes(rows)
    assert sum(a[0] != b for a, b in want.items()) > 70
    assert classes_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want


def test_on_a_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    assert classes_of(d) == brute_classes(rows)


def test_recall_against_all_pairs(spark):
    """Every document whose id is divisible by 20 against all: pairs at 0.8 or more that share a class; and how many of
    the looser ones do."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    owners = defaultdict(list)
    sizes = {}
    for k, t in texts.items():
        sizes[k] = len(x := sets(t))
        for s in x:
            owners[s].append(k)
    cls = {r.doc_id: r.class_id for r in neardup.near_duplicates(d).collect()}
    found = defaultdict(lambda: [0, 0])
    for q in (k for k in texts if k % 20 == 0):
        shared = defaultdict(int)
        for s in sets(texts[q]):
            for k in owners[s]:
                shared[k] += 1
        for k, n in shared.items():
            j = n / (sizes[q] + sizes[k] - n)
            if k != q:
                for least in (0.8, 0.7, 0.6, 0.5):
                    if j >= least:
                        found[least][0] += 1
                        found[least][1] += cls[k] == cls[q]
    print({k: (n, m, m / n) for k, (n, m) in found.items()})
    assert found[0.8][0] > 50 and found[0.8][1] == found[0.8][0]


def test_a_hot_band_makes_one_entry_a_batch(spark):
    """A third of all texts are near copies of each other: what a bucket of bands holds, and the longest list of a key."""
    base = prose(9, 150)
    df = spark.createDataFrame([(k, near(base, k, 1) if k % 3 == 0 else prose(k, 60), 0) for k in range(900)], "doc_id long, text string, hash long").repartition(6)
    made = df.mapInArrow(neardup._sign(4, 5, 48, 8), neardup.SIGNED).collect()
    n = defaultdict(int)
    for r in made:
        if r.kind == neardup.BAND_ROWS:
            for band in neardup.unpack(bytes(r.payload), ["<u8", "<u8"])[0].tolist():
                n[band] += 1
    assert max(n.values()) <= 6


def test_each_text_of_an_id_is_judged(spark):
    a, b = prose(1, 80), prose(2, 100)
    rows = [(1, a), (9, a), (9, b), (12, near(b, 3, 1)), (20, prose(3, 80)), (20, prose(3, 80)), (None, prose(4, 50)), (None, prose(5, 50)), (30, prose(5, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert classes_of(df) == brute_classes(rows)
    out = neardup.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.first) for r in out) == [(0, 0, True), (0, 0, True), (1, 1, True), (9, 1, False), (9, 9, True), (12, 9, False), (20, 20, True), (20, 20, True), (30, 0, False)]


def test_odd_tables(none, docs):
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.near_duplicates(docs).count() == docs.count()


def test_registers_estimate_similarity():
    a = neardup.mixed(np.arange(1, 801, dtype=np.uint64))
    b = neardup.mixed(np.arange(101, 901, dtype=np.uint64))
    est = []
    for k in range(20):
        s = neardup.signatures([neardup.mixed(a + np.uint64(k)), neardup.mixed(b + np.uint64(k)), a[:0]], 384)
        est.append((s[0] == s[1]).mean())
        assert not s[2].any() and s[:2].all()
    assert abs(np.mean(est) - 700 / 900) < 0.01


def test_weights_count():
    """Probability Jaccard of weights 1 + ln n: an element seen more often is kept by more registers."""
    a = neardup.mixed(np.arange(1, 51, dtype=np.uint64))
    s = np.concatenate([neardup.signatures([np.r_[x, np.repeat(x[:1], 99)]], 384)[0] == x[0] for x in (neardup.mixed(a + np.uint64(k)) for k in range(20))])
    assert abs(s.mean() - (1 + np.log(100)) / (49 + 1 + np.log(100))) < 0.02


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(230)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0
