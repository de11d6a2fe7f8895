"""Queries that run operators on small invented cases; their SQL states the results that the cases must have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import checksums, fakes, text
from ..functions.spans import splice, value_of
from ..operators import docpass, images, recognizers, replace, scoring
from ..sources import gold
from . import pipeline
from .queries import query, values


def expected(rows: list[tuple], columns: str, kinds: str) -> str:
    """SQL for rows of given types."""
    names, types = columns.split(", "), kinds.split()
    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types, strict=True))
    return f"SELECT {cast} FROM {values(rows, columns)}"


def _short(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    return spark.createDataFrame(rows, kind)


# ---- detection: text, context words, what is found

DETECTION = [
    # dates of birth: a cue in the sentence, or in the unit's context
    ("The pony's rider, DOB: 09/04/2001. The saddle was bought on 12/08/2019.", "", [("DATE_OF_BIRTH", "09/04/2001")]),
    ("Gopal Bhatt was born on 28 October 1966.", "", [("PERSON", "Gopal Bhatt"), ("DATE_OF_BIRTH", "28 October 1966")]),
    ("The exhibition opens on 05/11/2026.", "", []), ("1990-02-17", "", []), ("1990-02-17", "Birth", [("DATE_OF_BIRTH", "1990-02-17")]),
    # numbers of people and things
    ("48210937", "", []), ("48210937", "DIN", [("IN_DIN", "48210937")]),
    ("taxpayer ID 219-07-6631 paid with 5555 5555 5555 4444 from 198.51.100.9", "", [("US_SSN", "219-07-6631"), ("CREDIT_CARD", "5555 5555 5555 4444"), ("IP_ADDRESS", "198.51.100.9")]),
    ("a card that fails its check, 5555 5555 5555 4445, and release 7.2.1 of section 3.1.4", "", []),
    ("consignment 6017744120 left with waybill WB-2025-03381", "", []),
    ("the gateway 2001:db8:4::beef:12 answered at 23:59", "", [("IP_ADDRESS", "2001:db8:4::beef:12")]),
    ("income tax PAN is BQRPT5521L, Aadhaar is 2341 2341 2346", "", [("IN_PAN", "BQRPT5521L"), ("IN_AADHAAR", "2341 2341 2346")]),
    ("serial BQRPT5521L of lot 2341 2341 2346", "", []),
    # phones, in every form
    ("reach us at +91 94460 71355, or +44 20 7946 0991", "", [("PHONE_NUMBER", "+91 94460 71355"), ("PHONE_NUMBER", "+44 20 7946 0991")]),
    ("dial 91-80-2558 4471 or phone 080 2558 4471", "", [("PHONE_NUMBER", "91-80-2558 4471"), ("PHONE_NUMBER", "080 2558 4471")]),
    ("landline 0361-2540019, mobile 8876543210, cell 99571 20846, helpline 1800 345 6789", "", [("PHONE_NUMBER", "0361-2540019"), ("PHONE_NUMBER", "8876543210"), ("PHONE_NUMBER", "99571 20846"), ("PHONE_NUMBER", "1800 345 6789")]),
    # sites and mail
    ("look at www.harbour-museum. org or https://tides.example/today, not at http://intranet/ or www.rbi.org.in", "", [("URL", "www.harbour-museum. org"), ("URL", "https://tides.example/today")]),
    ("write to curator@harbour-museum.example, not to info@sebi.gov.in", "", [("EMAIL_ADDRESS", "curator@harbour-museum.example")]),
    # companies and people
    ("The lighthouse was leased by Gull & Anchor Marine Private Limited until spring", "", [("ORGANIZATION", "Gull & Anchor Marine Private Limited")]),
    ("Account holder: Coral Reef Bank Limited, Kochi", "", [("ORGANIZATION", "Coral Reef Bank Limited")]),
    ("a long term bank loan and a Commercial Bank licence", "", []),
    ("Contact Person: Padma Trivedi Registration No.: KL/2291", "", [("PERSON", "Padma Trivedi")]),
    ("Contact Persons: Roger Spencer/ Jaya Sen, Fax: none", "", [("PERSON", "Roger Spencer"), ("PERSON", "Jaya Sen")]),
    ("Iravati Phadnis, Chief Engineer and Compliance Officer, met the Deputy Director", "", [("PERSON", "Iravati Phadnis")]),
    ("Mr Oluwaseun Adeyemi of Zephyr Analytics/ Tidal Logistics spoke", "", [("PERSON", "Oluwaseun Adeyemi"), ("ORGANIZATION", "Zephyr Analytics"), ("ORGANIZATION", "Tidal Logistics")]),
    ("The Harbour Committee Report and the Lease Agreement follow the Shipping Act.", "", []),
    ("Dues are paid to the Reserve Bank of India and to BSE Limited.", "", []),
    # addresses
    ("Store: Shed 9, Jetty Road, Willingdon Island, Kochi – 682 003, Kerala, India; open daily", "", [("ADDRESS", "Shed 9, Jetty Road, Willingdon Island, Kochi – 682 003, Kerala, India")]),
    ("Return it to 77 Pebble Lane, Rockport, ME 04856 by post.", "", [("ADDRESS", "77 Pebble Lane, Rockport, ME 04856")]),
    ("Berth BRT-660214 is free", "", []), ("tonnage in Fiscal 2024 rose by 310 200 units", "", []),
]


@query(expected([(k, t, v) for k, (_, _, found) in enumerate(DETECTION) for t, v in found], "id, entity_type, found", "INTEGER VARCHAR VARCHAR"))
def detection_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _short(spark, [(k, t, c.split()) for k, (t, c, _) in enumerate(DETECTION)], "id int, text string, context array<string>")
    out = recognizers.detect(rows).select("id", "text", F.explode("spans").alias("s"))
    return out.select("id", F.col("s.entity_type").alias("entity_type"), value_of(F.col("text"), F.col("s")).alias("found"))


# ---- passes over documents

PAGES = [
    (1, 0, "Contact Person: Naveen Pillai; E-mail: naveen.pillai@quay.example", "c1"), (1, 1, "NAVEEN PILLAI founded Seabright Salvage Private Limited.", "c1"),
    (1, 2, "Since then Seabright and (Naveen  Pillai) have moved, but naveen pillai is no name", "c1"), (1, 3, "countersigned Naveen", "c2"), (1, 4, "Pillai for the crew", "c2"), (1, 5, "countersigned Naveen", "c3"), (1, 6, "Pillai aside", "c4"),
    (1, 7, "Godown 3, Lantern Road", "c5"), (1, 8, "Alappuzha – 688 012", "c5"), (1, 9, "Kerala, India", "c5"), (1, 10, "Ministry of Finance", "c6"), (1, 11, "5 Compass Street, Kollam 691 001", "c6"),
    (2, 0, "Seabright is a colour here", "c1"),
]
PASSES = [
    (1, 2, "Seabright", C.SHORT_FORM), (1, 2, "Naveen  Pillai", C.PROPAGATED), (1, 3, "Naveen", C.PROPAGATED), (1, 4, "Pillai", C.CONTINUATION), (1, 7, "Godown 3, Lantern Road", C.ADDRESS_BLOCK),
    (1, 8, "Alappuzha – 688 012", "address"), (1, 9, "Kerala, India", C.ADDRESS_BLOCK),
]


def _pages(spark: SparkSession) -> DataFrame:
    return _short(spark, PAGES, "doc_id long, unit_id int, text string, container_id string").withColumn("context", F.array().cast("array<string>"))


@query(expected(PASSES, "doc_id, unit_id, found, source", "BIGINT INTEGER VARCHAR VARCHAR"))
def document_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the passes add from the third unit on."""
    out = pipeline.detect(_pages(spark)).units.select("doc_id", "unit_id", "text", F.explode("spans").alias("s")).where("unit_id > 1")
    return out.select("doc_id", "unit_id", value_of(F.col("text"), F.col("s")).alias("found"), F.col("s.source").alias("source"))


VOCABULARY = [(1, 0, "Cooking", True), (1, 1, "Bridges", True), (1, 2, "Uma Nair", False), (1, 3, "Reed Basket", False), (2, 4, "Reed Basket", True), (1, 5, "LNG Boat", True), (1, 6, "LNG", False)]


@query(expected([(k, ok) for _, k, _, ok in VOCABULARY], "k, is_vocabulary", "INTEGER BOOLEAN"))
def vocabulary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _short(spark, [x[:3] for x in VOCABULARY], "doc_id int, k int, value string")
    return docpass.vocabulary_spans(rows, _short(spark, [(2, "reed"), (2, "basket"), (1, "basket")], "doc_id int, word string")).select("k", "is_vocabulary")


# ---- text and replacement

KEYS = [
    ("PHONE_NUMBER", "+91 484 266 0193", "4842660193"), ("PERSON", "Tara  Joy\tGeorge", "tara joy george"), ("URL", "http://www.Quay.example/", "quay.example"), ("URL", "www.quay. example", "quay.example"),
    ("CREDIT_CARD", "5105-1051 0510 5100", "5105105105105100"), ("ORGANIZATION", "Spindrift Works Ltd.", "spindrift works ltd"),
]


@query(expected([(k, x[2]) for k, x in enumerate(KEYS)], "id, key", "INTEGER VARCHAR"))
def normal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _short(spark, [(k, *x[:2]) for k, x in enumerate(KEYS)], "id int, t string, v string")
    return rows.select("id", replace.norm_key(F.col("t"), F.col("v")).alias("key"))


NAMES = [("Spindrift Ropes Private Limited", "Spindrift Ropes", " Private Limited"), ("Gull & Anchor LLP", "Gull & Anchor", " LLP"), ("EBB AND FLOW PVT LTD", "EBB AND FLOW", " Pvt Ltd"), ("Coral Bank of India", "Coral", " Bank of India"), ("Lone Buoy", "Lone Buoy", "")]


@query(expected([(k, x[1], x[2]) for k, x in enumerate(NAMES)], "id, bare, ending", "INTEGER VARCHAR VARCHAR"))
def company_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _short(spark, [(k, x[0]) for k, x in enumerate(NAMES)], "id int, v string")
    return rows.select("id", text.strip_org_suffix(F.col("v")).alias("bare"), text.org_suffix(F.col("v")).alias("ending"))


@query(expected([("met Uma Sen at q.z", 4, 11, "PERSON"), ("met Uma Sen at q.z", 15, 18, "URL")], "text, start, stop, type", "VARCHAR INTEGER INTEGER VARCHAR"))
def marked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _short(spark, [("met [[PERSON:Uma Sen]] at [[URL:q.z]]",)], "v string").select(text.parse_marks(F.col("v")).alias("m"))
    return rows.select("m.text", F.explode("m.entities").alias("e")).select("text", "e.start", F.col("e.end").alias("stop"), "e.type")


@query(expected([("Ahoy Z, ring us",)], "out", "VARCHAR"))
def spliced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.array(F.struct(F.lit(5).alias("start"), F.lit(10).alias("end"), F.lit("Z").alias("fake")), F.struct(F.lit(17).alias("start"), F.lit(28).alias("end"), F.lit("us").alias("fake")))
    return _short(spark, [("Ahoy Roger, ring 0123456789X",)], "v string").select(splice(F.col("v"), r).alias("out"))


@query(expected([("Ask for ", 0), ("Ian Webb", 1), ("", 2), (" later", 3)], "text, k", "VARCHAR INTEGER"))
def rewritten_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range over two runs and a tab: the fake goes to the first run, the tab goes."""
    segments = [("text", 0, 8, "Ask for "), ("text", 8, 13, "Nikhi"), ("tab", 13, 14, "\t"), ("text", 14, 19, "Menon"), ("text", 19, 25, " later")]
    rows = _short(spark, [(segments, [(8, 19, "Ian Webb")])], "s array<struct<kind:string,start:int,end:int,text:string>>, r array<struct<start:int,end:int,fake:string>>")
    return rows.select(F.posexplode(replace.rewrite_segments(F.col("s"), F.col("r"))).alias("k", "g")).select("g.text", "k")


FAKED = [("CREDIT_CARD", "5105 1051 0510 5100"), ("CREDIT_CARD", "6011 0009 9013 9424"), ("IN_AADHAAR", "3675 9834 6012"), ("US_SSN", "219-07-6631"), ("IP_ADDRESS", "172.16.40.2"), ("IN_PAN", "BQRPT5521L"), ("PHONE_NUMBER", "+91 48 4266 0193")]
SHAPES = {"CREDIT_CARD": r"^\d{4} \d{4} \d{4} \d{4}$", "IN_AADHAAR": r"^[2-9]\d{3} \d{4} \d{4}$", "US_SSN": r"^9\d{2}-\d{2}-\d{4}$", "IP_ADDRESS": r"^(192\.0\.2|198\.51\.100|203\.0\.113)\.\d+$", "IN_PAN": r"^[A-Z]{3}P[A-Z]\d{4}[A-Z]$", "PHONE_NUMBER": r"^\+91 \d\d \d{4} \d{4}$"}


@query(expected([(k, t, True, False, False) for k, (t, _) in enumerate(FAKED)], "id, entity_type, shaped, valid, same", "INTEGER VARCHAR BOOLEAN BOOLEAN BOOLEAN"))
def fake_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fakes keep their shape, fail the checks of their kind and differ from what they replace."""
    rows = _short(spark, [(k, t, v, fakes.fake(42, "s", t, v, v), SHAPES[t]) for k, (t, v) in enumerate(FAKED)], "id int, entity_type string, v string, fake string, shape string")
    valid = F.when(F.col("entity_type") == "CREDIT_CARD", checksums.luhn_valid(F.col("fake"))).when(F.col("entity_type") == "IN_AADHAAR", checksums.verhoeff_valid(F.col("fake"))).otherwise(F.lit(False))
    return rows.select("id", "entity_type", F.expr("fake rlike shape").alias("shaped"), valid.alias("valid"), (F.col("fake") == F.col("v")).alias("same"))


@query(expected([(True, True, True)], "mirrors, same_site, capitals", "BOOLEAN BOOLEAN BOOLEAN"))
def mirrored_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's fake name is in the fake of their mail address, whose host is that of the fake site."""
    named = lambda k, kind, value: ("1", 1, k, 0, 5, kind, "x", value, value)
    rows = [named(0, "PERSON", "Leela Mahajan"), named(1, "PERSON", "LEELA MAHAJAN"), named(2, "EMAIL_ADDRESS", "leela.mahajan@quay.example"), named(3, "URL", "www.quay.example")]
    spans = _short(spark, rows, "scope_id string, doc_id int, unit_id int, start int, end int, entity_type string, source string, raw string, original string")
    spans = spans.withColumn("key", replace.norm_key(F.col("entity_type"), F.col("original")))
    out = replace.faked(spans, C.RunConfig()).agg(*(F.max(F.when(F.col("unit_id") == k, F.col("fake"))).alias(n) for k, n in enumerate(("person", "capitals", "mail", "url"))))
    mirrors = F.substring_index("mail", "@", 1) == F.replace(F.lower("person"), F.lit(" "), F.lit("."))
    return out.select(mirrors.alias("mirrors"), (F.concat(F.lit("www."), F.substring_index("mail", "@", -1)) == F.col("url")).alias("same_site"), (F.col("capitals") == F.upper("person")).alias("capitals"))


# ---- scores and images

@query(expected([(0, 10), (1, 12), (2, 11), (3, None)], "gold_id, unit_id", "INTEGER INTEGER"))
def gold_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _short(spark, [(0, "a", None), (1, "a", None), (2, "b", None), (3, "zz", None)], "gold_id int, text string, sha1 string")
    u = _short(spark, [(10, "a"), (11, "b"), (12, "a"), (13, "a")], "unit_id int, text string")
    return scoring.match_by_hash(g, u, ["unit_id"]).select("gold_id", "unit_id")


CARD_LINES = [("DRIVING LICENCE", 40, 30), ("Name HELEN PORTER", 40, 110), ("Father's Name ARTHUR PORTER", 40, 160), ("Date of Birth 19/09/1982", 40, 210), ("Signature", 560, 330)]


def _card_lines(spark: SparkSession) -> DataFrame:
    return images.group_lines(images.readable(gold.card(spark)[1]))


@query(expected([(k, *x) for k, x in enumerate(CARD_LINES)], "line_id, text, l, t", "INTEGER VARCHAR INTEGER INTEGER"))
def card_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.line_texts(_card_lines(spark)).select("line_id", "text", "l", "t")


@query(expected([("DATE_OF_BIRTH", 230, 210), ("PERSON", 140, 110), ("PERSON", 230, 160), ("SIGNATURE", 535, 230)], "entity_type, l, t", "VARCHAR INTEGER INTEGER"))
def card_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _card_lines(spark)
    return images.card_boxes(lines, images.identity_cards(lines)).select("entity_type", "l", "t").distinct()


@query(expected([(3, 3, 5, 0)], "pii_boxes, pii_hidden, other_boxes, other_hidden", "BIGINT BIGINT BIGINT BIGINT"))
def card_painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    image, _, boxes = gold.card(spark)
    lines = _card_lines(spark)
    return scoring.box_scores(images.coverage(images.paint(image, images.card_boxes(lines, images.identity_cards(lines))), boxes))


@query(expected([("FACE", -6, -7, 16, 20)], "entity_type, l, t, r, b", "VARCHAR INTEGER INTEGER INTEGER INTEGER"))
def face_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.expanded_faces(_short(spark, [("i", 0, 0, 10, 10)], "image_id string, l int, t int, r int, b int")).select("entity_type", "l", "t", "r", "b")


@query(expected([("PNG", 1), ("JPEG", 2), ("BMP", 3), ("GIF", 4), (None, 5)], "format, id", "VARCHAR INTEGER"))
def image_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, bytearray(b"\x89PNG...")), (2, bytearray(b"\xff\xd8\xff..")), (3, bytearray(b"BM..")), (4, bytearray(b"GIF89a")), (5, bytearray(b"none"))]
    return _short(spark, rows, "id int, c binary").select(images.image_format(F.col("c")).alias("format"), "id")
