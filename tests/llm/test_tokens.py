import base64
import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from umbra.llm import bytebpe, queries, tokenfiles

VOCAB = P.path("byte_bpe_multi_50k.tiktoken")


def test_byte_bpe_is_tiktoken(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bytebpe.decode(bytebpe.encode(docs, VOCAB, P.PATTERN), VOCAB, P.PATTERN).collect()
    want = Counter()
    for r in docs.collect():
        ids = coder.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), struct.pack(f"<{len(ids)}I", *ids), (r.text or "").encode()] += 1
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in found) == want


def test_byte_bpe_forgets_without_loss(monkeypatch):
    coder = bytebpe.ByteBpe(open(VOCAB, "rb").read(), P.PATTERN)
    texts = [f"word{k} and {'ab' * k} more{k}" for k in range(50)]
    want = [coder.encode(x) for x in texts]
    monkeypatch.setattr(bytebpe, "REMEMBERED", 5)
    assert [coder.encode(x) for x in texts] == want


def test_ranks_must_be_gapless():
    with pytest.raises(ValueError):
        bytebpe.ranks_of(b"YQ== 0\nYg== 2\n")


def test_empty(none):
    assert bytebpe.encode(none, VOCAB, P.PATTERN).count() == 0
    assert queries.tokenfiles.write_tokens(none, P.path("word_bpe_49k.json"), end_id=2) == []
    assert tokenfiles.read_tokens(none.sparkSession, []).count() == 0


def expected_files(rows):
    coder = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    hashed = lambda x: int(np.int64(np.uint64(xxhash.xxh64_intdigest((x or "").encode(), seed=42))))
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, hashed(r.text)))
    made = [(r.doc_id, coder.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in rows]
    out, start = [], 0
    for doc, ids in made:
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out, made


@pytest.mark.parametrize("shard_bytes", [1 << 30, 20_000])
def test_token_files(spark, docs, shard_bytes, monkeypatch):
    files = tokenfiles.write_tokens(docs, P.path("word_bpe_49k.json"), end_id=2, shard_bytes=shard_bytes)
    assert (len(files) > 1) == (shard_bytes < 1 << 20)
    want, made = expected_files(docs.collect())
    assert sorted(map(tuple, tokenfiles.read_tokens(spark, files).collect()), key=lambda x: x[1]) == want
    some = {doc: ids for doc, ids in made if doc in (6, 33)}
    got = {}
    for f in files:
        got |= tokenfiles.read_documents(f["path"], [6, 33])
    assert {k: v[0].tolist() for k, v in got.items() if k != 6} == {33: some[33]} and len(got[6]) == 2


def test_shards_of_long_documents_and_of_a_hot_id(spark):
    rows = [(k, "word " * (20_000 if k == 7 else 3)) for k in range(40)] + [(50, f"text {k} " * 40) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    files = tokenfiles.write_tokens(df, P.path("word_bpe_49k.json"), end_id=2, shard_bytes=20_000)
    assert len(files) > 5 and max(f["n_docs"] for f in files) < 100
    want, _ = expected_files(df.collect())
    assert sorted(map(tuple, tokenfiles.read_tokens(spark, files).collect()), key=lambda x: x[1]) == want
    n = files[-1]["shard"] + 1
    ones = spark.createDataFrame([(k,) for k in range(n)], "shard int").repartitionById(n, "shard")
    assert ones.groupBy(F.spark_partition_id()).count().where("count > 1").count() == 0


def test_added_tokens_are_matched_as_by_default():
    coder = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own = tokenfiles.WordCoder(open(P.path("word_bpe_49k.json"), "rb").read(), 2)
    texts = ["Hello <|endoftext|> world", "a<|startoftext|>b\n日本 é<|endoftext|>", "<|endoftext|>", "<|ENDOFTEXT|> x", "<|endoftext |> 日本<|ENDOFTEXT|>", "endoftext|> <|", "plain world"]
    for x in [*texts, *texts]:
        assert own.encode(x) == struct.pack(f"<{len(ids := coder.encode(x, add_special_tokens=False).ids) + 1}H", *ids, 2)
    assert coder.encode(texts[0], add_special_tokens=False).ids == [3306, 49407, 1002]


def test_reader_takes_only_needed_frames_and_checks(tmp_path):
    path = tmp_path / "x.zst"
    with path.open("wb") as f:
        w = tokenfiles.FrameWriter(f, 2, frame_bytes=64)
        for k in range(40):
            w.add(k, struct.pack("<20H", *range(k, k + 20)))
        w.close()
    with path.open("rb") as f:
        r = tokenfiles.FrameReader(f, path.stat().st_size)
        assert len(r.index) > 10
        before = r.read_frames
        assert r.documents([17])[17][0].tolist() == list(range(17, 37))
        assert r.read_frames == before + 1
    data = bytearray(path.read_bytes())
    data[30] ^= 1
    path.write_bytes(data)
    with path.open("rb") as f, pytest.raises(Exception):  # noqa: B017
        list(tokenfiles.FrameReader(f, len(data)).all())


def test_queries_agree_with_operators(spark):
    rows = queries.op5_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
