import io
import json
import zipfile
from xml.etree import ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F
from umbra import cli
from umbra import config as C
from umbra.functions.text import is_public_host
from umbra.operators import images, recognizers, replace, scoring
from umbra.sources import docx, gold, sinks
from umbra.streaming import units as streaming

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="urn:w14" mc:Ignorable="w14"'


def run(text, bold=False):
    return f'<w:r><w:rPr>{"<w:b/>" if bold else ""}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'


def p(*runs):
    return f"<w:p><w:pPr/>{''.join(runs)}</w:p>"


PNG = b"\x89PNG fake"


def document(body: str, header: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        sect = '<w:sectPr><w:headerReference r:id="h1"/><w:headerReference r:id="h1"/></w:sectPr>' if header else ""
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}{sect}</w:body></w:document>")
        rels = '<Relationship Id="h1" Target="header1.xml" Type="x/header"/>' if header else ""
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}<Relationship Id="l1" Type="x/hyperlink" TargetMode="External" Target="mailto:leela.menon@gmail.com"/></Relationships>')
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {NS}>{header}</w:hdr>")
        z.writestr("word/media/image1.png", PNG)
        z.writestr("docProps/core.xml", '<c:coreProperties xmlns:c="urn:c" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>Leela Menon</dc:creator><dc:title>Keep</dc:title></c:coreProperties>')
    return out.getvalue()


def texts(content: bytes) -> list[str]:
    return [u["text"] for u in docx.units(content)]


CELL = "<w:tc>{}</w:tc>"
BODY = (
    p(run("Contact "), run("Leela ", True), run("Menon", True), run(" today"))
    + p() + p("<w:r><w:t>GULL</w:t><w:tab/></w:r>", run("Securities Limited"))
    + f"<w:tbl><w:tr>{CELL.format(p(run('DIN (Director No 1)')))}</w:tr><w:tr>{CELL.format(p(run('48210937')))}</w:tr></w:tbl>"
    + p(run("Mail "), f'<w:hyperlink r:id="l1">{run("leela.menon@gmail.com")}</w:hyperlink>', '<w:r><w:instrText>HYPERLINK "mailto:leela.</w:instrText></w:r><w:r><w:instrText>menon@gmail.com"</w:instrText></w:r>')
    + p("<w:del><w:r><w:delText>gone</w:delText></w:r></w:del>", run("kept"))
)


def test_units():
    got = list(docx.units(document(BODY, p(run("Head")))))
    assert [u["text"] for u in got] == ["Contact Leela Menon today", "GULL\tSecurities Limited", "DIN (Director No 1)", "48210937", "Mail leela.menon@gmail.com", "kept", "Head"]
    assert [u["unit_id"] for u in got] == list(range(7))
    assert got[3]["context"] == ["DIN", "Director", "No"] and got[2]["context"] == []
    assert got[0]["container_id"] == got[1]["container_id"] != got[3]["container_id"]
    assert got[-1]["part_name"] == "word/header1.xml" and got[4]["links"] == ["mailto:leela.menon@gmail.com"]


def test_rewriting():
    source = document(BODY)
    new = docx.rewrite(source, {0: [(8, 19, "Ian Webb")], 1: [(0, 23, "Rege Securities Limited")], 4: [(5, 26, "a.b@x.example.com")]}, {}, {"leela.menon@gmail.com": "a.b@x.example.com"}, {"word/media/image1.png": b"new"})
    assert texts(new)[:2] == ["Contact Ian Webb today", "Rege Securities Limited"] and texts(new)[4] == "Mail a.b@x.example.com"
    z = zipfile.ZipFile(io.BytesIO(new))
    body = z.read("word/document.xml").decode()
    root = ET.fromstring(body)
    runs = [(("".join(t.text or "" for t in r.iter(docx.W + "t"))), r.find(f"{docx.W}rPr/{docx.W}b") is not None) for r in root.iter(docx.W + "r")][:4]
    assert runs == [("Contact ", False), ("Ian Webb", True), ("", True), (" today", False)]
    assert "<w:tab" not in body and "leela.menon" not in body and 'xmlns:w14="urn:w14"' in body and len(list(root.iter(docx.W + "p"))) == 7
    assert "leela" not in z.read("word/_rels/document.xml.rels").decode()
    core = z.read("docProps/core.xml").decode()
    assert "Leela" not in core and "Keep" in core and z.read("word/media/image1.png") == b"new"


def test_two_ranges_and_a_range_without_text():
    source = document(p(run("Email a@x.com or call +91 94460 71355.")) + p("<w:r><w:tab/></w:r>", run("x")))
    t = "Email a@x.com or call +91 94460 71355."
    new = docx.rewrite(source, {0: [(t.index("a@"), t.index("a@") + 7, "j.d@example.com"), (t.index("+91"), t.index("+91") + 15, "+91 12345 67890")], 1: [(0, 1, "T ")]}, {}, {})
    assert texts(new) == ["Email j.d@example.com or call +91 12345 67890.", "T x"]


def test_links():
    assert docx.rewritten_link('HYPERLINK "http://www.acme.in/x?y" \\h', {"acme.in": "f.example.com"}, {}) == 'HYPERLINK "http://www.f.example.com" \\h'
    assert docx.rewritten_link("https://www.sebi.gov.in/a", {}, {}) == "https://www.sebi.gov.in/a"


def test_segments_natively(spark):
    found = next(iter(docx.units(document(BODY))))
    df = spark.createDataFrame([(found["segments"], [(8, 19, "Ian Webb")])], f"segments array<{docx.SEGMENT}>, replaced array<struct<start:int,end:int,fake:string>>")
    out = df.select(replace.rewrite_segments(F.col("segments"), F.col("replaced")).alias("s")).first().s
    assert [x.text for x in out] == ["Contact ", "Ian Webb", "", " today"]


def test_bad_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        docx.read_binary(spark, str(tmp_path / "missing.docx"))
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(ValueError):
        docx.read_binary(spark, str(tmp_path / "notes.txt"))
    with pytest.raises(docx.Unreadable):
        list(docx.units(b"no zip"))


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "in"
    folder.mkdir()
    body = p(run("Contact Person: Leela Menon; E-mail: leela.menon@gmail.com")) + p(run("LEELA MENON agreed, see "), run("www.gmail.com")) + p(run("The Company Secretary stays."))
    (folder / "a.docx").write_bytes(document(body))
    (folder / "b.docx").write_bytes(document(p(run("Nothing here"))))
    assert cli.main([str(folder), str(folder)]) == 2
    assert cli.main([str(tmp_path / "none.docx"), str(tmp_path / "out")]) == 1
    assert cli.main([str(folder), str(tmp_path / "out"), "--report", str(tmp_path / "r.json"), "--mapping", str(tmp_path / "m.json")]) == 0
    out = (tmp_path / "out" / "a.docx").read_bytes()
    lines = texts(out)
    name = lines[0].split(": ")[1].split(";")[0]
    assert lines[1].startswith(name.upper()) and lines[2] == "The Company Secretary stays." and "gmail" not in " ".join(lines)
    assert b"Leela" not in zipfile.ZipFile(io.BytesIO(out)).read("docProps/core.xml")
    assert "gmail" not in zipfile.ZipFile(io.BytesIO(out)).read("word/_rels/document.xml.rels").decode()
    assert texts((tmp_path / "out" / "b.docx").read_bytes()) == ["Nothing here"]
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["documents"] == 2 and report["units"] == 4 and "eela" not in json.dumps(report)
    assert "leela menon" in (tmp_path / "m.json").read_text()


def test_documents_of_one_name_and_a_card(spark, tmp_path):
    """Both documents are written, each in its folder; the card in one of them has black boxes, and only where it should."""
    image, words, boxes = gold.card(spark)
    r = image.first()
    card = images.encode_png(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels))
    known = [tuple(w) for w in words.collect()]

    def reader(batches):
        import pandas as pd

        for b in batches:
            found = [(i, *w[1:]) for i, c in zip(b.image_id, b.content, strict=True) if bytes(c) == card for w in known]
            yield pd.DataFrame(found, columns=["image_id", "word_id", "text", "left", "top", "width", "height", "conf"])

    for folder, content in (("a", document(p(run("Contact Person: Leela Menon")))), ("b", document(p(run("Nothing here"))))):
        (tmp_path / "in" / folder).mkdir(parents=True)
        changed = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(changed, "w") as new:
            for n in old.namelist():
                if n == "[Content_Types].xml":
                    new.writestr(n, '<Types xmlns="urn:t"><Default Extension="bin" ContentType="application/x"/><Override PartName="/custom/card.bin" ContentType="image/png"/></Types>')
                else:
                    new.writestr(n, old.read(n))
            if folder == "a":
                new.writestr("custom/card.bin", card)
        (tmp_path / "in" / folder / "x.docx").write_bytes(changed.getvalue())
    report = cli.redact_documents(spark, str(tmp_path / "in"), str(tmp_path / "out"), C.RunConfig(), reader=reader)
    assert (report["documents"], report["images"], report["images_modified"], report["images_skipped"]) == (2, 3, 1, 2)
    assert texts((tmp_path / "out" / "b" / "x.docx").read_bytes()) == ["Nothing here"]
    out = (tmp_path / "out" / "a" / "x.docx").read_bytes()
    assert "Leela" not in texts(out)[0]
    z = zipfile.ZipFile(io.BytesIO(out))
    assert z.read("word/media/image1.png") == PNG
    px = images.decode_png(z.read("custom/card.bin"))
    for b in boxes.collect():
        l, t, r_, b_ = map(int, b.box)
        black = (px[t:b_, l:r_] == 0).all(2).mean()
        assert black >= 0.9 if b.pii else black < 0.5, b.text
    with pytest.raises(ValueError, match="2 documents would be written to x.docx"):
        docx.save(docx.read_binary(spark, str(tmp_path / "in")), str(tmp_path / "flat"))


def test_images_of_documents(spark):
    df = spark.createDataFrame([(1, "a.docx", document(BODY))], "doc_id bigint, path string, content binary")
    rows = docx.images(df).withColumn("format", images.image_format(F.col("content"))).collect()
    assert [(r.image_id, r.format, bytes(r.content)) for r in rows] == [("1/word/media/image1.png", "PNG", PNG)]
    assert docx.text_units(df).count() == 6


# ---- images

WORDS = [
    ("c", 0, "GOVERNMENT", 10, 10, 100, 20, 90.0), ("c", 1, "OF", 115, 11, 20, 20, 90.0), ("c", 2, "INDIA", 140, 10, 50, 20, 90.0),
    ("c", 3, "Name", 10, 60, 50, 20, 90.0), ("c", 4, "Grace", 70, 60, 60, 20, 90.0), ("c", 5, "Webb", 135, 61, 40, 20, 90.0),
    ("c", 6, "DOB", 10, 100, 40, 20, 90.0), ("c", 7, "14/07/1986", 60, 100, 100, 20, 90.0), ("c", 8, "x", 500, 100, 10, 20, 10.0), ("c", 9, "HUGE", 10, 200, 300, 200, 90.0),
    ("c", 10, "Signature", 300, 180, 80, 20, 90.0), ("n", 0, "mail", 0, 0, 40, 10, 99.0), ("n", 1, "a.b@c.example.org", 45, 0, 150, 10, 99.0),
]


@pytest.fixture(scope="module")
def lines(spark):
    words = spark.createDataFrame(WORDS, images.WORDS)
    return images.group_lines(images.readable(words)).cache()


def test_lines(lines):
    rows = {(r.image_id, r.text): (r.l, r.t, r.r, r.b) for r in images.line_texts(lines).collect()}
    assert rows["c", "GOVERNMENT OF INDIA"] == (10, 10, 190, 31) and ("c", "Name Grace Webb") in rows and not any("HUGE" in t or t == "x" for _, t in rows)
    assert {r.word_id: r.at for r in lines.where("image_id = 'c'").collect()}[5] == len("Name Grace ")
    assert {r.image_id: r.is_id for r in images.identity_cards(lines).collect()} == {"c": True, "n": False}
    assert images.context_words(lines, 2).where("image_id = 'c'").first().context == ["government", "of"]


def test_boxes(spark, lines):
    ids = images.identity_cards(lines)
    cards = {(r.entity_type, r.l, r.t, r.r, r.b) for r in images.card_boxes(lines, ids).collect()}
    assert ("PERSON", 70, 60, 175, 81) in cards and ("DATE_OF_BIRTH", 60, 100, 160, 120) in cards and any(k[0] == "SIGNATURE" for k in cards)
    found = images.text_boxes(lines, recognizers.detect, None, ids).collect()
    assert [(r.image_id, r.entity_type, r.l, r.r) for r in found if r.image_id == "n"] == [("n", "EMAIL_ADDRESS", 45, 195)]
    assert not any(r.source == C.NER and r.image_id == "c" for r in found)
    known = spark.createDataFrame([("c", "grace webb", "PERSON")], "doc_id string, key string, entity_type string")
    assert any(r.source == C.PROPAGATED for r in images.text_boxes(lines, recognizers.detect, known, ids).collect())


def test_geometry(spark):
    kind = "image_id string, id int, l int, t int, r int, b int"
    a = spark.createDataFrame([("i", 1, 0, 0, 10, 10), ("i", 2, 20, 20, 40, 40)], kind)
    b = spark.createDataFrame([("i", 9, 1, 1, 10, 10)], kind)
    assert [r.id for r in images.agreeing(a, b).collect()] == [1] and [r.id for r in images.without(a, b).collect()] == [2]
    assert tuple(images.expanded_faces(a).first()) == ("i", "FACE", -6, -7, 16, 20, "face")
    codes = spark.createDataFrame([("i", "https://www.sebi.gov.in/x", 0, 0, 5, 5), ("i", "upi://pay", 10, 10, 20, 20)], "image_id string, payload string, l int, t int, r int, b int")
    assert [r.l for r in images.code_boxes(codes, is_public_host).collect()] == [10]


def test_pixels(spark):
    px = np.full((60, 80, 3), 200, np.uint8)
    raw = spark.createDataFrame([("i", 60, 80, 3, px.tobytes()), ("j", 60, 80, 3, px.tobytes())], "image_id string, height int, width int, channels int, data binary")
    boxes = spark.createDataFrame([("i", "PERSON", 10, 10, 30, 20, "x")], images.BOXES)
    out = images.paint(raw, boxes)
    rows = {r.image_id: r for r in out.collect()}
    assert rows["i"].modified and not rows["j"].modified and bytes(rows["j"].data) == px.tobytes()
    g = spark.createDataFrame([("i", "a", True, [10.0, 10.0, 30.0, 20.0]), ("i", "b", False, [40.0, 40.0, 60.0, 50.0])], "image_id string, text string, pii boolean, box array<double>")
    cov = images.coverage(out, g)
    assert {r.text: r.covered for r in cov.collect()} == {"a": 1.0, "b": 0.0}
    assert tuple(scoring.box_scores(cov).first()) == (1, 1, 1, 0)
    assert images.painted(np.zeros((5, 5, 4), np.uint8), [(0, 0, 2, 2)], 0)[0, 0, 3] == 255
    assert images.preprocess(px, 2).shape == (120, 160) and images.scale_to(400, 300) == 4 and images.scale_to(3000, 10) == 1 and images.languages("auto", {"eng"}) == "eng"
    noise = np.full((320, 320), 255, np.uint8)
    noise[96:192, 96:192] = np.random.default_rng(1).integers(0, 2, (96, 96)) * 255
    assert len(images.texture(noise)) == 1
    noise[128:144, 128:144] = 255  # a gap in the middle is closed, two regions apart aren't joined, a bar is no code
    assert len(images.texture(noise)) == 1
    shaded = np.linspace(60, 255, 320).astype(np.uint8)[None, :].repeat(320, 0)
    assert images.texture(shaded) == []
    bar = np.full((320, 320), 255, np.uint8)
    bar[96:128, 32:288] = np.random.default_rng(2).integers(0, 2, (32, 256)) * 255
    assert images.texture(bar) == []
    raw_noise = spark.createDataFrame([("q", 320, 320, 1, noise.tobytes())], images.RAW)
    assert images.textures(raw_noise).count() == 1
    rep = images.reports(raw, spark.createDataFrame([], images.LINES), spark.createDataFrame([], "image_id string, is_id boolean"), boxes)
    assert {r.image_id: (r.modified, r.skipped, r.boxes and r.boxes[0].box) for r in rep.collect()} == {"i": (True, False, [10, 10, 20, 10]), "j": (False, False, None)}


# ---- gold, sinks, streams


def test_gold_files(spark, tmp_path):
    full = {"description": "d", "units": [{"text": "Grace Webb", "entities": [{"start": 0, "end": 10, "type": "PERSON", "text": "Grace Webb"}], "sha1": "x"}], "image": {"size": [2, 2], "boxes": [{"text": "t", "pii": True, "box": [0, 0, 1.5, 2]}]}}
    (tmp_path / "g.json").write_text(json.dumps(full, indent=1))
    r = gold.read_units(spark, str(tmp_path / "g.json")).first()
    assert (r.gold_id, r.text, r.sha1, r.entities[0].type) == (0, "Grace Webb", "x", "PERSON")
    assert gold.read_boxes(spark, str(tmp_path / "g.json")).first().box == [0.0, 0.0, 1.5, 2.0]
    (tmp_path / "c.json").write_text(json.dumps({"units": [{"index": 4, "sha1": "y", "spans": [[1, 5, "URL"]]}]}))
    c = gold.read_compact(spark, str(tmp_path / "c.json")).first()
    assert (c.unit_id, c.sha1, c.entities[0].start, c.entities[0].end, c.entities[0].type) == (4, "y", 1, 5, "URL")


def test_sinks(spark):
    df = spark.createDataFrame([("a", 0.5, None)], "k string, v double, n int")
    assert sinks.markdown(df).splitlines() == ["| k | v | n |", "|---|---|---|", "| a | 0.5 | – |"]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "mail a.b@c.example.org", []), (1, 1, "none", [])], "doc_id bigint, unit_id int, text string, context array<string>").withColumn("arrived", F.lit("2024-01-01 00:00:30").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    units = streaming.detect(streaming.read_units(spark, str(tmp_path / "in")))
    streaming.write(units, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.unit_id: r.spans for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [s.entity_type for s in got[0]] == ["EMAIL_ADDRESS"] and got[1] == []
    q = streaming.counts(units).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.entity_type, r.n) for r in spark.table("counted").collect()] == [("EMAIL_ADDRESS", 1)]
