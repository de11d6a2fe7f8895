import base64
import struct

import corpus_pipeline as cp
import public_tokenizers as P
import pytest
import tiktoken
from umbra.llm import quality

from .conftest import prose
from .test_neardup import brute_classes
from .test_repeats import brute_words
from .test_rows import brute_hits

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    d = "/root/testdata/sf0.001"
    docs = [spark.read.parquet(f"{d}/documents.parquet")]
    for _, f in cp.STAGES:
        docs.append(cp.common.saved(f(spark, docs[-1], d), "test"))
    return [{r.doc_id: r for r in x.collect()} for x in docs], docs


def test_columns(stages):
    assert all(x.columns == COLUMNS and x.dtypes == stages[1][0].dtypes for x in stages[1][1:-1])
    assert stages[1][-1].columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_quality(spark, stages):
    rows, docs = stages
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs[0], labels).where("score >= 0.3").collect()}
    assert set(rows[1]) == good and 0.5 < len(good) / len(rows[0]) < 1


def test_near_duplicates(stages):
    rows, _ = stages
    want = brute_classes([(r.doc_id, r.text) for r in rows[1].values()])
    assert set(rows[2]) == set(want.values())


def test_each_text_of_an_id_is_judged(spark):
    a, b, c, d = (prose(k, 80) for k in (1, 2, 3, 4))
    rows = [(None, a), (5, a), (None, b), (9, b), (7, c), (7, d), (7, d), (8, ""), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.near_duplicate_stage(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(0, a), (0, b), (7, c), (7, d), (8, ""), (0, "")])
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").where("length(text) > 100").first().text
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in [(None, a), (None, bench), (3, bench), (3, b)]], docs.schema)
    out = cp.decontamination_stage(spark, docs, "/root/testdata/sf0.001")
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(0, a), (3, b)])


def test_substrings(stages):
    rows, _ = stages
    want = {d: (n, gone, kept) for d, n, gone, kept in brute_words([(r.doc_id, r.text) for r in rows[2].values()])}
    assert set(rows[3]) == set(rows[2])
    for d, r in rows[3].items():
        _, gone, kept = want[d]
        assert r.text == (kept if gone else rows[2][d].text) and r.n_chars == len(r.text) and (r.lang, r.source) == (rows[2][d].lang, rows[2][d].source)


def test_decontamination(spark, stages):
    rows, _ = stages
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    clean = set()
    for d, r in rows[3].items():
        n, hit, _ = brute_hits(r.text, items)
        if not hit or 20 * hit < n:
            clean.add(d)
    assert set(rows[4]) == clean


def test_tokens(stages):
    rows, _ = stages
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(cp.VOCABULARY), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(rows[5]) == set(rows[4])
    for d, r in rows[5].items():
        ids = coder.encode_ordinary(rows[4][d].text)
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)


def test_odd_documents(spark, docs):
    odd = docs.select(*COLUMNS)
    d = "/root/testdata/sf0.001"
    out = odd
    for _, f in cp.STAGES[:-1]:
        out = cp.common.saved(f(spark, out, d), "odd")
        assert out.columns == COLUMNS
    assert cp.STAGES[-1][1](spark, out, d).count() == out.count()
    empty = odd.limit(0)
    for _, f in cp.STAGES[:-1]:
        empty = f(spark, empty, d)
        assert empty.count() == 0


def test_run(spark):
    before = len(cp.common.WRITTEN)
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 100
    assert [x.rpartition("/")[2].split("-")[:3] for x in cp.common.WRITTEN[before:]] == [["umbra", "stage", "tokens"]]
