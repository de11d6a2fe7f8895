import hashlib
import re
import zlib
from collections import Counter

import numpy as np
from umbra.llm import common, decontaminate, quality, queries, rules, shard

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_hits(text, items, window=13):
    words = WORD.findall(lower(text))
    hit, names = set(), set()
    for name, other in items:
        w = WORD.findall(lower(other))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    names.add(str(name))
    return len(words), len(hit), sorted(names)


def test_decontaminate_against_brute_force(spark, docs):
    texts = [r.text for r in docs.orderBy("doc_id").collect() if r.text and 60 < len(r.text) < 3000]
    items = [(1, texts[0][:140]), (10, texts[0][:140].upper()), (2, " ".join(texts[4].split()[5:40])), (3, "one two"), (4, None), (5, ""), (6, "word"), (7, texts[9]), (7, "never seen anywhere"), (None, texts[2][30:160])]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    for block_bytes in (1 << 20, 200):
        found = decontaminate.decontaminate(docs, bench, block_bytes=block_bytes).collect()
        got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found)
        want = Counter()
        for r in docs.collect():
            n, h, names = brute_hits(r.text, [("" if k is None else k, x) for k, x in items])
            want[r.doc_id, n, h, tuple(names)] += 1
        assert got == want
        assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in found)
        assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in found)


def test_a_long_item_is_cut_and_blocks_make_one_python_node(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 40)
    texts = [r.text for r in docs.orderBy("doc_id").collect() if r.text]
    long = next(x for x in texts if len(x.split()) == 6000)
    items = [(1, long), (2, long[2000:2200] + " " + long[:300])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    some = docs.where("length(text) > 25000 or length(text) < 400")
    out = decontaminate.decontaminate(some, bench, block_bytes=8_000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "hashpartitioning" not in plan
    path, blocks = decontaminate._blocks(bench, "item_id", "text", 13, 8_000)
    assert blocks > 4
    mine = {r.doc_id: r for r in out.collect()}
    whole = {r.doc_id: r for r in decontaminate.decontaminate(some, bench).collect()}
    assert mine == whole and any(r.n_hit == r.n_words == 6000 for r in mine.values())


def test_the_bound_of_contamination_is_exact(spark):
    """7 of 140 words are one in twenty; in floating point 0.05 * 140 is more than 7."""
    words = " ".join(f"w{k}" for k in range(133))
    docs = spark.createDataFrame([(1, words + " a b c d e f g"), (2, words + " x a b c d e f g")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontaminate.decontaminate(docs, bench).collect()} == {1: (140, 7, True), 2: (141, 7, False)}


def test_decontaminate_empty(none, docs):
    bench = none.selectExpr("doc_id as item_id", "text")
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert {r.n_hit for r in decontaminate.decontaminate(docs, bench).collect()} == {0}


def brute_statistics(text):
    text = text or ""
    words = [x for x in re.split("[ \t\n\x0b\x0c\r]+", text) if x]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force(docs):
    found = rules.statistics(docs).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found)
    assert got == Counter((r.doc_id, *brute_statistics(r.text)) for r in docs.collect())


def test_statistics_are_native(docs):
    plan = rules.statistics(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rule_learning():
    row = lambda a, b: dict.fromkeys(["a"], a) | {"b": b}
    data = [(row(k % 10 / 10, k % 7), 0 if k % 10 >= 8 and k % 7 < 3 else 1) for k in range(700)]
    found = rules.learn_rules(data)
    assert found and all(any(rules.covers(r, x) for r in found) == (y == 0) for x, y in data)
    assert rules.learn_rules([(x, 1) for x, _ in data]) == []
    assert rules.learn_rules([]) == []


def test_rules_on_held_out_rows(spark):
    """Learnt without the rows that it is tried on; the registered query learns from all labels."""
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    held_out = quality.remainder("doc_id") == 0
    stats, found = rules.judge(spark.read.parquet(f"{d}/documents.parquet"), labels.where(~held_out))
    out = stats.join(labels.where(held_out), "doc_id").collect()
    good, bad = [r for r in out if r.quality == 1], [r for r in out if r.quality == 0]
    assert found and len(good) > 500 and len(bad) > 50
    assert sum(r.kept_by_rules for r in good) >= 0.99 * len(good)
    assert sum(r.kept_by_rules for r in bad) <= 0.1 * len(bad)


def test_labels_without_documents_change_nothing(spark):
    d = "/root/testdata/sf0.01"
    stats = rules.saved(rules.statistics(spark.read.parquet(f"{d}/documents.parquet")), "test")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    other = spark.range(10**9, 10**9 + 2_000_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    odd = spark.createDataFrame([(0, None), (None, 0), (None, 1)], "doc_id long, quality int")
    found = rules.learn(stats, labels)
    assert found and rules.learn(stats, labels.union(other).union(odd)) == found


def test_more_labels_than_rows_to_learn_from(spark):
    stats = rules.statistics(spark.range(600).selectExpr("id as doc_id", "repeat('ab ', int(id)) || if(id % 4 = 0, '# # # # # #', '') as text").repartition(6))
    labels = spark.range(600).selectExpr("id as doc_id", "if(id % 4 = 0, 0, 1) as quality")
    seen = []
    assert rules.learn(stats, labels, max_rows=150) == rules.learn(stats.repartition(3), labels.repartition(2), max_rows=150) != []
    real, rules.learn_rules = rules.learn_rules, lambda rows, **_: seen.extend(rows)
    try:
        rules.learn(stats, labels, max_rows=150)
    finally:
        rules.learn_rules = real
    first = sorted(range(600), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())[:150]
    assert [y for _, y in seen] == [int(k % 4 != 0) for k in first]


def test_thresholds_come_from_all_rows():
    rows = [({"a": float(k)}, 1) for k in range(9000)] + [({"a": 9000.0 + k}, 0) for k in range(60)]
    assert rules.learn_rules(rows) == [(rules.Condition("a", True, 9000.0),)]  # between 8999 and 9001: 9000 is among the rows to prune by


def test_verdict_against_brute_force(spark):
    """Which documents the registered query keeps, by the rules' own reading of each row."""
    d = "/root/testdata/sf0.01"
    stats, found = rules.judge(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    values = stats.select("doc_id", "n_words", "n_repeat_words", *(x.alias(f"r_{k}") for k, x in rules.ratios().items())).collect()
    want = {}
    for r in values:
        row = {k: r[f"r_{k}"] for k in rules.ratios()}
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        want[r.doc_id] = not failed and not any(rules.covers(x, row) for x in found)
    assert found and {r.doc_id: r.kept for r in queries.op9_rules(spark, d).collect()} == want


def test_rules_empty(none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out, found = rules.judge(none, labels)
    assert out.count() == 0 and found == []


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    out = queries.op4_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    y, s = np.array([r.quality for r in out]), np.array([r.score for r in out])
    assert all(r.predicted == (r.score >= 0.3) for r in out) and s.min() >= 0 and s.max() <= 1
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    for v in np.unique(s):
        ranks[s == v] = np.flatnonzero(s[order] == v).mean() + 1
    auc = (ranks[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    predicted = s >= 0.3
    print("auc", auc, "kept good", predicted[y == 1].mean(), "kept bad", predicted[y == 0].mean())
    assert auc > 0.9
    assert predicted[y == 1].mean() > 0.98


def test_quality_odd_tables(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, labels).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0
    labels = spark.createDataFrame([(3, 1), (6, 0), (6, None), (9, 1), (12, 0), (12, 0)], "doc_id long, quality int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)


def test_ridge_and_calibration_against_plain_ones(spark):
    """Weights of one least-squares problem over all rows, and levels by the min-max formula of isotonic regression."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    x = rules.saved(quality.features(spark.read.parquet(f"{d}/documents.parquet")), "test")
    model = quality.fit(x, labels, train=quality.remainder("doc_id") != 0)
    rows = x.join(labels, "doc_id").where(quality.remainder("doc_id") != 0).collect()
    a, y = np.array([r.x for r in rows]), np.array([r.quality for r in rows], float)
    z = np.clip((a - a.mean(0)) / (a.std(0) + 1e-6), -5, 5)
    z = np.c_[np.sqrt(2 / len(model.phases)) * np.cos(z @ model.directions + model.phases), np.ones(len(z))]
    n, dim = z.shape
    ridge = quality.RIDGE * n / (dim - 1)
    plain = np.linalg.lstsq(np.r_[z, np.sqrt(ridge) * np.eye(dim)], np.r_[y, np.zeros(dim)], rcond=None)[0]
    assert np.abs(z @ plain - model.lifted(a) @ model.weights).max() < 1e-4
    raw = np.clip(z @ plain, -0.5, 1.5)
    at = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    bins = np.unique(at)
    ones, counts = np.array([y[at == k].sum() for k in bins]), np.array([(at == k).sum() for k in bins])
    mean = lambda i, j: ones[i : j + 1].sum() / counts[i : j + 1].sum()
    levels = [max(min(mean(i, j) for j in range(k, len(bins))) for i in range(k + 1)) for k in range(len(bins))]
    assert len(model.levels) == len(levels) and np.abs(model.levels - levels).max() < 1e-6


def test_monotone():
    assert quality.monotone(np.array([2, 0, 2, 4]), np.array([1, 0, 0, 4])).tolist() == [0.25, 0.25, 1.0]


def test_interleave(docs, none):
    rows = docs.collect()
    for run in (50_000, 4):
        out = shard.interleave(docs, 24, run=run).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
        by = Counter(r.shard for r in out)
        assert max(by.values()) - min(by.get(k, 0) for k in range(24)) <= 1
        for k in by:
            assert sorted(r.slot for r in out if r.shard == k) == list(range(by[k]))
    assert len({tuple(sorted((str(r.doc_id), r.shard, r["size"]) for r in shard.interleave(docs, 24, run=n).collect())) for n in (50_000, 4)}) == 1
    assert shard.interleave(none, 24).count() == 0


def test_interleave_keeps_the_mixture(spark):
    d = spark.range(10_000).selectExpr("id as doc_id", "'x' as text", "if(id % 3 = 0, 'hot', cast(id % 7 as string)) as source")
    out = Counter((r.shard, r.source) for r in shard.interleave(d, 10, run=900).collect())
    total = Counter()
    for (_, s), n in out.items():
        total[s] += n
    assert all(abs(n - total[s] / 10) <= 1.5 for (_, s), n in out.items())


def test_many_small_sources_and_a_hot_one_are_dealt_evenly(spark):
    """Every row of 20,000 sources of one row has the fraction 1/2; a source with a third of all rows is one stratum."""
    d = spark.range(30_000).selectExpr("id as doc_id", "'x' as text", "if(id < 20000, cast(id as string), 'hot') as source")
    rows = d.selectExpr("doc_id", "if(source = 'hot', doc_id / 10000, 0.5D) as fraction")
    sizes = [r["count"] for r in common.dealt(rows, ["fraction", "doc_id"], 10, "test").groupBy("part").count().collect()]
    assert max(sizes) < 6000
    out = shard.interleave(d, 24, run=3000).collect()
    by = Counter(r.shard for r in out)
    assert len(out) == 30_000 and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == k) == list(range(by[k])) for k in by)


def test_digest_columns(spark):
    r = queries.op1_decontaminate(spark, "/root/testdata/sf0.001").where("n_items = 0").first()
    assert r.items_sha256 == hashlib.sha256(b"").hexdigest()
