"""Gold labels: JSON of labelled units, compact JSON of places alone, boxes of images, and marked text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_marks

ENTITY = "struct<start:int,end:int,type:string,text:string>"
FULL = f"description string, units array<struct<text:string,entities:array<{ENTITY}>,sha1:string>>, image struct<size:array<int>,boxes:array<struct<text:string,pii:boolean,box:array<double>>>>"
COMPACT = "units array<struct<index:int,sha1:string,spans:array<array<string>>>>"
UNITS = f"unit_id int, text string, sha1 string, entities array<{ENTITY}>"


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """gold_id, text, sha1 and entities of a labelled corpus."""
    rows = spark.read.schema(FULL).json(path, multiLine=True)
    return rows.select(F.posexplode("units").alias("gold_id", "u")).select("gold_id", "u.text", F.coalesce("u.sha1", F.sha1("u.text")).alias("sha1"), "u.entities")


def read_boxes(spark: SparkSession, path: str, image_id: str = "image") -> DataFrame:
    """image_id, text, pii and box of the corpus' image."""
    rows = spark.read.schema(FULL).json(path, multiLine=True)
    return rows.select(F.lit(image_id).alias("image_id"), F.explode("image.boxes").alias("b")).select("image_id", "b.text", "b.pii", "b.box")


def read_compact(spark: SparkSession, path: str) -> DataFrame:
    """unit_id, sha1 and entities (without text) of a corpus whose texts aren't handed on."""
    rows = spark.read.schema(COMPACT).json(path, multiLine=True).select(F.explode("units").alias("u"))
    entity = lambda s: F.struct(s[0].cast("int").alias("start"), s[1].cast("int").alias("end"), s[2].alias("type"), F.lit(None).cast("string").alias("text"))
    return rows.select(F.col("u.index").alias("unit_id"), "u.sha1", F.transform("u.spans", entity).alias("entities"))


def from_marks(rows: DataFrame) -> DataFrame:
    """unit_id, text, sha1, entities of rows (unit_id, marked) whose values are marked [[TYPE:value]]."""
    parsed = rows.select("unit_id", parse_marks(F.col("marked")).alias("m"))
    return parsed.select("unit_id", "m.text", F.sha1("m.text").alias("sha1"), "m.entities")


#: A small labelled corpus of an animal clinic, its laboratory and its suppliers: marked lines, then table rows under
#: their headers. Written for this library.
LINES = (
    "The spaniel was brought in by [[PERSON:Harold Saunders]], who asked for the X-rays to go to [[EMAIL_ADDRESS:h.saunders@kennel.example.org]].",
    "If the cat stops eating, ring the owner on [[PHONE_NUMBER:+91 90040 61728]] before noon.",
    "Night line of the ward: call [[PHONE_NUMBER:044 2815 9036]].",
    "The vet was born on [[DATE_OF_BIRTH:6 March 1974]]; the licence was renewed on 14/02/2021.",
    "Stable keeper's DOB: [[DATE_OF_BIRTH:23/10/1988]], tetanus booster due 30/06/2026.",
    "The deposit of Rs. 8,400 was charged to card [[CREDIT_CARD:5105 1051 0510 5100]] and later released.",
    "Microchip 985112004873316 was read twice; the scanner at [[IP_ADDRESS:192.0.2.77]] then went offline.",
    "Vaccines are supplied by [[ORGANIZATION:Meadowlark Biologicals Private Limited]], syringes by [[ORGANIZATION:Thornfield & Abbey LLP]].",
    "Contact person: [[PERSON:Leela Goswami]]; fax of the depot [[PHONE_NUMBER:+44 20 7946 0815]].",
    "Our farrier, [[PERSON:Walter Graham]], gave his SSN as [[US_SSN:408-55-7719]] on the tax form.",
    "Send the collar to [[ADDRESS:31 Larkspur Crescent, Ashford, VT 05301]] with the next parcel.",
    "House calls: [[ADDRESS:Bungalow 4, Peacock Lane, Koregaon, Satara – 415 501, Maharashtra, India]]",
    "Blood sample LB-77120 weighed 3.5 g and took 48 hours; kit version 2.11.4 was used.",
    "Backups of the clinic's server run from [[IP_ADDRESS:10.61.7.20]] to [[IP_ADDRESS:2001:db8:77::4e:19]] at 03:15.",
    "Dosage tables are at [[URL:www.feline-dosage.example]] and in the binder by the door.",
    "Aadhaar [[IN_AADHAAR:2341 2341 2346]] and PAN [[IN_PAN:AFZPK7190K]] were shown for the cattle loan.",
    "Invoice 7710032945 covers 12 tins of feed, batch QX-2291, and one brush.",
    "The grant was approved by [[PERSON:Indira Chatterjee]] of [[ORGANIZATION:Sparrow Hill Foundation]] in April.",
    "Please thank [[PERSON:Oscar Fletcher]] for the blankets.",
    "The pound reported 2,118 strays in 2023, down from 2,460 a year before.",
)
HEADERS = ("Chip", "Owner", "Email", "Phone", "Date of Birth", "Animal")
CELLS = (
    ("985112004873317", "[[PERSON:Amrita Khanna]]", "[[EMAIL_ADDRESS:khanna.a@example.net]]", "[[PHONE_NUMBER:+91 87654 02319]]", "[[DATE_OF_BIRTH:17/05/1995]]", "Parrot"),
    ("985112004873318", "[[PERSON:Edward Bailey]]", "[[EMAIL_ADDRESS:ned@bailey.example]]", "[[PHONE_NUMBER:+1 206 555 0143]]", "[[DATE_OF_BIRTH:02/12/1961]]", "Tortoise"),
)


def sample(spark: SparkSession) -> DataFrame:
    """unit_id, text, sha1, entities, context of the corpus above."""
    rows = [(k, x, []) for k, x in enumerate(LINES)]
    for cells in CELLS:
        for header, cell in zip(HEADERS, cells, strict=True):
            rows.append((len(rows), cell, header.split()))
    marked = spark.createDataFrame(rows, "unit_id int, marked string, context array<string>")
    return from_marks(marked).join(marked.select("unit_id", "context"), "unit_id")


#: An invented identity card: label or value, whether it is personal, and its place.
CARD = (
    ("DRIVING LICENCE", False, (40, 30, 300, 60)), ("Name", False, (40, 110, 110, 135)), ("HELEN PORTER", True, (140, 110, 340, 135)), ("Father's Name", False, (40, 160, 200, 185)),
    ("ARTHUR PORTER", True, (230, 160, 430, 185)), ("Date of Birth", False, (40, 210, 190, 235)), ("19/09/1982", True, (230, 210, 370, 235)), ("Signature", False, (560, 330, 680, 355)),
)


def card(spark: SparkSession, width: int = 900, height: int = 520) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The card as a raw image (grey bars where words are), its words as a recogniser would give them, and gold boxes."""
    pixels = np.full((height, width, 3), 235, np.uint8)
    words = []
    for text, _, (l, t, r, b) in CARD:
        pixels[t:b, l:r] = 120
        parts, step = text.split(), (r - l) / len(text)
        at = 0
        for part in parts:
            words.append(("card", len(words), part, int(l + at * step), t, int(len(part) * step), b - t, 95.0))
            at += len(part) + 1
    image = spark.createDataFrame([("card", height, width, 3, pixels.tobytes())], "image_id string, height int, width int, channels int, data binary")
    boxes = spark.createDataFrame([("card", text, pii, [float(x) for x in box]) for text, pii, box in CARD], "image_id string, text string, pii boolean, box array<double>")
    return image, spark.createDataFrame(words, "image_id string, word_id int, text string, `left` int, top int, width int, height int, conf double"), boxes
