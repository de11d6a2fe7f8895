import numpy as np
import pytest
from pyspark.sql import functions as F
from umbra.operators import images, recognizers
from umbra.plans import evaluation, pipeline
from umbra.sources import gold


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_round_trip(channels):
    px = np.random.default_rng(channels).integers(0, 256, (13, 17, channels), dtype=np.uint8)
    assert (images.decode_png(images.encode_png(px)) == px).all()
    assert images.decode_png(b"no picture") is None and images.decode_png(images.encode_png(px)[:40]) is None


def test_png_filters():
    """Each of the five line filters, written by hand."""
    import struct
    import zlib

    px = np.random.default_rng(5).integers(0, 256, (5, 6, 3), dtype=np.uint8)
    raw, above = b"", np.zeros(18, int)
    for how in range(5):
        line = px[how].reshape(-1).astype(int)
        left, corner = np.r_[np.zeros(3, int), line[:-3]], np.r_[np.zeros(3, int), above[:-3]]
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        raw += bytes([how]) + ((line - [0 * line, left, above, (left + above) // 2, near][how]) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert (images.decode_png(png) == px).all()


def test_card(spark):
    image, words, boxes = gold.card(spark)
    lines = images.group_lines(images.readable(words))
    ids = images.identity_cards(lines)
    found = images.card_boxes(lines, ids).unionByName(images.text_boxes(lines, recognizers.detect, None, ids)).distinct()
    assert ids.first().is_id
    s = evaluation.image_scores(image, found, boxes).first()
    assert (s.pii_hidden, s.pii_boxes, s.other_hidden) == (3, 3, 0)


def test_pictures_there_and_back(spark):
    px = np.full((40, 50, 3), 200, np.uint8)
    pictures = spark.createDataFrame([("a", images.encode_png(px)), ("b", b"\xff\xd8\xffjpeg")], "image_id string, content binary")
    raw = images.decoded(pictures)
    assert {r.image_id: r.data is None for r in raw.collect()} == {"a": False, "b": True}
    boxes = spark.createDataFrame([("a", "PERSON", 5, 5, 20, 15, "x")], images.BOXES)
    out = images.encoded(images.paint(raw, boxes)).collect()
    assert [r.image_id for r in out] == ["a"] and images.decode_png(bytes(out[0].content))[10, 10].tolist() == [0, 0, 0]


def test_report(spark):
    sample = gold.sample(spark).withColumn("doc_id", F.lit(1).cast("long")).withColumn("container_id", F.lit("c"))
    detected = recognizers.detect(sample).drop("entities", "sha1")
    rows = evaluation.by_hash(detected, sample.select(F.col("unit_id").alias("gold_id"), "text", "sha1", "entities"))
    s = evaluation.score(rows)
    assert s.tokens.first().recall == 1.0
    redacted, _, _ = pipeline.redact(sample)
    leaked = evaluation.leaks(sample, redacted)
    assert leaked.agg(F.sum("leaked")).first()[0] == 0
    text = evaluation.markdown({"sample": s}, leaked)
    assert "## sample" in text and "ALL" in text and "Saunders" not in text
    compact = sample.select("unit_id", "sha1", "entities")
    assert evaluation.by_index(detected, compact).count() == compact.count()
    with pytest.raises(Exception, match="no text like it"):
        evaluation.by_hash(detected, spark.createDataFrame([(0, "unheard of", None, [])], "gold_id int, text string, sha1 string, entities array<struct<start:int,end:int,type:string,text:string>>")).collect()
