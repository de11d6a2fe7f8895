import re

import pytest
from pyspark.sql import functions as F
from umbra import config as C
from umbra.functions import names
from umbra.operators import docpass, recognizers, replace, scoring
from umbra.plans import cases, pipeline, queries
from umbra.sources import gold


def detected(spark, texts, context=()):
    rows = spark.createDataFrame([(k, t, list(context)) for k, t in enumerate(texts)], "k int, text string, context array<string>")
    return [[(s.entity_type, r.text[s.start : s.end]) for s in r.spans] for r in recognizers.detect(rows).orderBy("k").collect()]


CASES = [*((t, w) for t, c, w in cases.DETECTION if not c), ("", []), (None, []), ("   ", [])]


def test_cases(spark):
    got = detected(spark, [t for t, _ in CASES])
    for (text, want), found in zip(CASES, got, strict=True):
        assert found == want, text


def test_context_of_the_unit(spark):
    assert detected(spark, ["1990-02-17"], ("Day", "of", "Birth")) == [[("DATE_OF_BIRTH", "1990-02-17")]]
    assert detected(spark, ["48210937"], ("DIN",)) == [[("IN_DIN", "48210937")]]


def test_memoised_is_the_same(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([c[0] for c in CASES] * 2)], "k int, text string")
    plain = {r.k: r.spans for r in recognizers.detect(rows).collect()}
    assert {r.k: r.spans for r in recognizers.detect(rows, memoise=True).collect()} == plain


def test_registering_a_type(spark, monkeypatch):
    monkeypatch.setattr(recognizers, "REGISTRY", dict(recognizers.REGISTRY))
    recognizers.register("ticket", ["TICKET"], lambda t, c: recognizers.find_spans(t, r"WB-\d+", "TICKET", 0.9, "ticket"))
    rows = spark.createDataFrame([("see WB-123456",)], "text string")
    out = recognizers.detect(rows, C.RunConfig(entities=("TICKET",))).first().spans
    assert [(s.start, s.end, s.entity_type) for s in out] == [(4, 13, "TICKET")]


def test_patterns_need_no_python(spark):
    rows = spark.createDataFrame([("x",)], "text string")
    plan = recognizers.detect(rows, names_too=False)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_sample_scores(spark):
    units = recognizers.detect(gold.sample(spark)).cache()
    labels = scoring.token_labels(units)
    all_ = scoring.token_confusion(labels).first()
    assert all_.precision >= 0.988 and all_.recall == 1.0, scoring.errors(labels, "fp").collect()
    assert {r.entity_type: r.f1 for r in scoring.type_confusion(labels).collect()}["PERSON"] >= 0.96
    total = {r.entity_type: r for r in scoring.status_totals(scoring.entity_status(labels)).collect()}["ALL"]
    assert total.full == total.total and total.missed == 0


ROWS = [
    (1, 0, "Contact Person: Naveen Pillai; E-mail: naveen.pillai@ferry.com; Telephone: +91 94460 71355", "c1"),
    (1, 1, "NAVEEN PILLAI founded Seabright Salvage Private Limited.", "c1"),
    (1, 2, "The Chief Engineer and the Trustees approved the Offer.", "c1"),
    (1, 3, "Since then Seabright and (Naveen  Pillai) have moved, but naveen pillai is no name, see www.ferry.com/x", "c1"),
    (1, 4, "countersigned Naveen", "c2"), (1, 5, "Pillai for the crew", "c2"), (1, 6, "countersigned Naveen", "c3"), (1, 7, "Pillai aside", "c4"),
    (1, 8, "Godown 3, Lantern Road", "c5"), (1, 9, "Alappuzha – 688 012", "c5"), (1, 10, "Kerala, India", "c5"), (1, 11, "Ministry of Finance", "c6"), (1, 12, "5 Compass Street, Kollam 691 001", "c6"),
    (2, 0, "Naveen Pillai again, Seabright is a colour", "c1"),
]


@pytest.fixture(scope="module")
def redacted(spark):
    units = spark.createDataFrame(ROWS, "doc_id long, unit_id int, text string, container_id string").withColumn("context", F.array().cast("array<string>"))
    out, found, made = pipeline.redact(units)
    return {(r.doc_id, r.unit_id): r for r in out.collect()}, out, found, made


def sources(r):
    return [(r.text[s.start : s.end], s.entity_type, s.source) for s in r.spans]


def test_passes(redacted):
    by = redacted[0]
    assert sources(by[1, 1])[0][2] in (C.PROPAGATED, C.NER) and by[1, 2].spans == []
    assert ("Seabright", "ORGANIZATION", C.SHORT_FORM) in sources(by[1, 3])
    assert ("Naveen  Pillai", "PERSON") in [x[:2] for x in sources(by[1, 3])] and not any(x[0] == "naveen pillai" for x in sources(by[1, 3]))
    assert sources(by[1, 4]) == [("Naveen", "PERSON", C.PROPAGATED)] and sources(by[1, 5]) == [("Pillai", "PERSON", C.CONTINUATION)]
    assert sources(by[1, 7]) == []
    assert [x[2] for x in sources(by[1, 8])] == [C.ADDRESS_BLOCK] and [x[2] for x in sources(by[1, 10])] == [C.ADDRESS_BLOCK]
    assert sources(by[1, 12]) == [] and not any(x[0] == "Seabright" for x in sources(by[2, 0]))


def test_redaction(redacted):
    by = redacted[0]
    first = by[1, 0].redacted
    name = first.split("Contact Person: ")[1].split(";")[0]
    mail = first.split("E-mail: ")[1].split(";")[0]
    a, b = name.lower().split()
    assert mail.startswith(f"{a}.{b}@") and mail.endswith(".example.com")
    assert by[1, 1].redacted.startswith(name.upper()) and "Private Limited" in by[1, 1].redacted
    assert by[1, 2].redacted == by[1, 2].text
    assert by[1, 3].redacted.endswith("www." + mail.split("@")[1]) and f"({name})" in by[1, 3].redacted
    assert by[1, 4].redacted == f"countersigned {name}" and by[1, 5].redacted == " for the crew"
    joined = " ".join(r.redacted for (d, _), r in by.items() if d == 1)
    assert not any(x in joined for x in ("NAVEEN", "94460 71355", "naveen.pillai@ferry.com", "Salvage"))
    assert name not in by[2, 0].redacted


def test_report_and_mapping(redacted):
    _, out, found, made = redacted
    r = pipeline.report(out).first()
    assert r.units == len(ROWS) and r.by_entity_type["PERSON"] >= 5 and r.by_source[C.SHORT_FORM] == 1
    assert "Naveen" not in str(r) and "naveen" not in str(r)
    m = {(x.scope_id, x.entity_type): x["values"] for x in replace.mapping(made).collect()}
    assert "naveen pillai" in m["1", "PERSON"]
    assert {x.entity_type: x.n for x in found.by_type().collect()} == r.by_entity_type


def test_fakes_are_unique(spark):
    rows = spark.createDataFrame([(1, k, f"Contact Person: Person Number{chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(200)], "doc_id long, unit_id int, text string").withColumn("container_id", F.lit("c"))
    spans = spark.createDataFrame([("1", 1, k, 0, 5, "PERSON", "x", f"Person N{k}", f"Person N{k}", f"person n{k}") for k in range(400)], "scope_id string, doc_id int, unit_id int, start int, end int, entity_type string, source string, raw string, original string, key string")
    made = replace.replacements(spans, C.RunConfig()).collect()
    assert len({m.fake.lower() for m in made}) == 400 and rows.count() == 200


def test_mentions_against_brute_force(spark):
    """Also a unit of 100,000 words; what moves with a word isn't the text."""
    long = " ".join(f"w{k % 977}" for k in range(99_990)) + " then Tara Sen, tara sen, TARA  SEN-Roy, Mc.Tara Sen and O'Neil & Sons (Kochi) left"
    rows = [(1, 0, long), (1, 1, "Tara Sen Tara Sen Roy xTara Sen Tara\nSen"), (2, 0, "Tara Sen"), (1, 2, "see www.Tara Sen or Tara Sen@x or (Tara Sen)."), (3, 0, "")]
    keys = [(1, "tara sen", "A"), (1, "tara sen roy", "B"), (1, "o'neil & sons (kochi)", "C"), (1, "gone", "D")]
    units = spark.createDataFrame(rows, "doc_id long, unit_id int, text string")
    known = spark.createDataFrame(keys, "doc_id long, key string, kind string")

    def brute(guard):
        out = set()
        left, right = (r"(?<![\w@./-])", r"(?![\w@-]|\.\w)") if guard else (r"(?<!\w)", r"(?!\w)")
        for d, u, t in rows:
            own = sorted(((k, x) for e, k, x in keys if e == d), key=lambda k: -len(k[0]))
            for m in re.finditer(f"{left}(?i:{'|'.join(re.escape(k).replace(chr(92) + ' ', chr(92) + 's+') for k, _ in own)}){right}", t) if own else ():
                key = " ".join(m[0].lower().split())
                if m[0] != m[0].lower():
                    out.add((d, u, m.start(), m.end(), key, dict(own)[key]))
        return out

    for guard in (False, True):
        found = docpass.mentions(units, known, ["kind"], guard)
        assert {tuple(r) for r in found.collect()} == brute(guard) and len(brute(guard)) > 4
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan


def test_mails_of_one_host_have_different_fakes(spark):
    """2,000 addresses of one host, of people whose fakes may share words; and names that could mirror each other."""
    rows = spark.range(2000).selectExpr("'1' as scope_id", "1 as doc_id", "int(id) as unit_id", "0 as start", "5 as end", "'EMAIL_ADDRESS' as entity_type", "'x' as source", "'u' || id || '@one.example' as raw")
    people = spark.createDataFrame([("1", 1, 5000 + k, 0, 5, "PERSON", "x", f"Ann Lee{k}") for k in range(40)], rows.schema)
    mirrored = spark.createDataFrame([("1", 1, 6000 + k, 0, 5, "EMAIL_ADDRESS", "x", f"ann.lee{k % 40}{'_.-'[k // 40]}x@one.example") for k in range(120)], rows.schema)
    spans = rows.union(people).union(mirrored).withColumn("original", F.col("raw")).withColumn("key", F.lower("raw"))
    made = [m for m in replace.replacements(spans, C.RunConfig()).collect()]
    assert len(made) == 2160 and len({m.fake.lower() for m in made}) == 2160
    again = {(m.entity_type, m.key): m.fake for m in replace.replacements(spans.repartition(7), C.RunConfig()).collect()}
    assert again == {(m.entity_type, m.key): m.fake for m in made}


def test_spellings_of_one_value(spark):
    rows = spark.createDataFrame([("PHONE_NUMBER", "+91 48 4266 0193"), ("PHONE_NUMBER", "+91 4842660193"), ("PERSON", "Tara  Joy\tGeorge"), ("PERSON", "TARA JOY GEORGE"), ("URL", "http://www.quay.example/"), ("URL", "www.quay. example")], "t string, v string")
    keys = [r.k for r in rows.select(replace.norm_key(F.col("t"), F.col("v")).alias("k")).collect()]
    assert keys[0] == keys[1] and keys[2] == keys[3] and keys[4] == keys[5]


def test_vocabulary_spans(spark):
    rows = spark.createDataFrame([x[:3] for x in cases.VOCABULARY], "doc_id int, k int, value string")
    words = spark.createDataFrame([(2, "reed"), (2, "basket"), (1, "basket")], "doc_id int, word string")
    assert {r.k: r.is_vocabulary for r in docpass.vocabulary_spans(rows, words).collect()} == {k: ok for _, k, _, ok in cases.VOCABULARY}


def test_matching_gold_units(spark):
    g = spark.createDataFrame([(0, "a", None), (1, "a", None), (2, "b", None), (3, "zz", None)], "gold_id int, text string, sha1 string")
    u = spark.createDataFrame([(10, "a"), (11, "b"), (12, "a"), (13, "a")], "unit_id int, text string")
    out = {r.gold_id: r.unit_id for r in scoring.match_by_hash(g, u, ["unit_id"]).collect()}
    assert out == {0: 10, 1: 12, 2: 11, 3: None}
    by_index = spark.createDataFrame([(10, "86f7e437faa5a7fce15d1ddcb9eaeaea377667b8")], "unit_id int, sha1 string")
    assert scoring.match_by_index(by_index, u).first().text == "a"
    with pytest.raises(Exception, match="doesn't match"):
        scoring.match_by_index(by_index.withColumn("sha1", F.lit("x")), u).collect()


def test_leaks(spark):
    g = spark.createDataFrame([(1, "PERSON", "Uma Nair"), (1, "PERSON", "Oscar Webb"), (1, "ORGANIZATION", "Limited"), (1, "PERSON", "Jo")], "doc_id int, entity_type string, value string")
    r = spark.createDataFrame([(1, "UMA  NAIR stays"), (1, "Webb goes")], "doc_id int, text string")
    assert [tuple(x) for x in scoring.leaks(g, r).collect()] == [("PERSON", 2, 1)]


BESIDE = [
    ("on 4913187196670932 53.121.55.90 it", [("CREDIT_CARD", "4913187196670932"), ("IP_ADDRESS", "53.121.55.90")]),
    ("the 4495589438270767 42.73.240.87 the", [("CREDIT_CARD", "4495589438270767"), ("IP_ADDRESS", "42.73.240.87")]),
    ("room 42 4913187196670932, 7", [("CREDIT_CARD", "4913187196670932")]),
    ("9331 4913 1871 9667 0932 53", [("CREDIT_CARD", "4913 1871 9667 0932")]),
    ("12 3782-822463-10005 6", [("CREDIT_CARD", "3782-822463-10005")]),
    ("6304 9850 2809 0561 515 and 55555 55555 55444 4", [("CREDIT_CARD", "6304 9850 2809 0561 515"), ("CREDIT_CARD", "55555 55555 55444 4")]),
    ("5555 5555 5555 4445 12, 49131871966709324913, 0.4913187196670932", []),
]


def test_cards_beside_numbers(spark):
    rows = spark.createDataFrame([(k, t, "en") for k, (t, _) in enumerate(BESIDE)], "doc_id long, text string, lang string")
    config = C.RunConfig(entities=("CREDIT_CARD", "IP_ADDRESS"))
    got = [[(s.entity_type, r.text[s.start : s.end]) for s in r.spans] for r in recognizers.detect(rows, config, names_too=False).orderBy("doc_id").collect()]
    assert got == [w for _, w in BESIDE]


def test_round_trip_hides_cards_beside_numbers(spark, tmp_path):
    """A card that is found in one line mustn't stay readable in another, where a number follows it."""
    rows = [(1, "pay 4913187196670932 now\n4913187196670932 53.121.55.90"), (2, "plain\n \nlines"), (3, None), (4, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r)[::2] for r in queries.redaction_round_trip(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(1, 0), (2, 0)]


def test_contacts_without_a_label():
    assert names.contacts("Grace Webb called") == []
