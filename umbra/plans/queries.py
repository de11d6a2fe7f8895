"""The registered queries of the engine and their SQL counterparts.

Queries on the driver's tables run over whole tables. Operators that these tables hold no case for run on small invented
tables, which the SQL has as VALUES.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import checksums, text
from ..functions.spans import resolve_overlaps, span, splice, value_of
from ..operators import docpass, images, recognizers, replace, scoring
from ..sources import gold
from . import pipeline
from .tables import table

QUERIES: dict = {}
ORACLE: dict = {}
PATTERN_TYPES = ("EMAIL_ADDRESS", "IP_ADDRESS", "CREDIT_CARD", "PHONE_NUMBER")
PATTERNS_ONLY = C.RunConfig(entities=PATTERN_TYPES)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) AS v({columns}))"


# ---- SQL for places of matches: pieces between matches and matches alternate

MAIL_RE = "[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+"
OCTET_RE = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
IP_RE = f"{OCTET_RE}(?:\\.{OCTET_RE}){{3}}"
CARD_RE = "[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
PHONE_RE = "\\+1 \\([0-9]{3}\\) [0-9]{3}-[0-9]{4}"  # all that the tables hold
LUHN = "list_sum(list_transform(list_reverse(regexp_extract_all(regexp_replace(v, '[^0-9]', '', 'g'), '.')), lambda d, i: CASE WHEN i % 2 = 1 THEN CAST(d AS INT) WHEN CAST(d AS INT) > 4 THEN 2 * CAST(d AS INT) - 9 ELSE 2 * CAST(d AS INT) END)) % 10 = 0"


def _places(pattern: str, source: str = "documents", key: str = "doc_id", column: str = "text") -> str:
    return f"""(SELECT k AS {key}, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS start, m[i] AS v
    FROM (SELECT {key} AS k, string_split_regex({column}, '{pattern}') AS g, regexp_extract_all({column}, '{pattern}') AS m FROM {source}) AS s, LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) AS u)"""


def _hits(spark, sf_dir, builder) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("doc_id", "text", F.explode(builder(F.col("text"), F.array().cast("array<string>"))).alias("s"))
    return rows.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), value_of(F.col("text"), F.col("s")).alias("value"))


_SELECT = "SELECT doc_id, start, CAST(start + length(v) AS INT) AS \"end\", v AS value FROM "


@query(_SELECT + _places(MAIL_RE))
def pii_hits_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, recognizers.emails)


@query(_SELECT + _places(IP_RE))
def pii_hits_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, recognizers.ipv4s)


@query(_SELECT + _places(CARD_RE) + f" WHERE {LUHN}")
def pii_hits_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, recognizers.cards)


@query(_SELECT + _places(PHONE_RE))
def pii_hits_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms of numbers that reach the threshold, with what stands before them; the tables hold one form."""
    return _hits(spark, sf_dir, lambda t, c: F.filter(recognizers.phones(t, c), lambda s: s["score"] >= C.THRESHOLDS["PHONE_NUMBER"]))


_ALL = " UNION ALL ".join(
    f"SELECT doc_id, '{t}' AS entity_type FROM {_places(p)}{w}"
    for t, p, w in (("EMAIL_ADDRESS", MAIL_RE, ""), ("IP_ADDRESS", IP_RE, ""), ("CREDIT_CARD", CARD_RE, f" WHERE {LUHN}"), ("PHONE_NUMBER", PHONE_RE, ""))
)


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognizers.detect(table(spark, sf_dir, "documents"), PATTERNS_ONLY, names_too=False)


@query(f"SELECT entity_type, count(*) AS n FROM ({_ALL}) GROUP BY entity_type")
def pii_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.counts(_detected(spark, sf_dir), "entity_type")


@query(f"SELECT lang, entity_type, count(*) AS n FROM ({_ALL}) JOIN documents USING (doc_id) GROUP BY lang, entity_type")
def pii_counts_by_lang_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _detected(spark, sf_dir).select("lang", F.explode("spans").alias("s"))
    return rows.groupBy("lang", F.col("s.entity_type").alias("entity_type")).agg(F.count("*").alias("n"))


@query(f"SELECT (SELECT count(*) FROM documents) AS units, count(DISTINCT doc_id) AS units_with_pii FROM ({_ALL})")
def pii_units_with_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).agg(F.count("*").alias("units"), F.count_if(F.size("spans") > 0).alias("units_with_pii"))


@query(f"SELECT v AS value, count(*) AS n FROM {_places(CARD_RE)} WHERE {LUHN} GROUP BY v")
def luhn_valid_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, recognizers.cards).groupBy("value").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '{MAIL_RE}', '[EMAIL_ADDRESS]', 'g'), '{IP_RE}', '[IP_ADDRESS]', 'g')) AS digest FROM documents")
def redacted_text_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans replaced by the names of their types."""
    found = recognizers.detect(table(spark, sf_dir, "documents"), C.RunConfig(entities=("EMAIL_ADDRESS", "IP_ADDRESS")), names_too=False)
    named = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["entity_type"], F.lit("]")).alias("fake")))
    return found.select("doc_id", F.sha2(splice(F.coalesce("text", F.lit("")), named), 256).alias("digest"))


@query(f"""SELECT value, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(CASE WHEN length(m[i]) > 2 THEN m[i][1] || repeat('*', length(m[i]) - 2) || m[i][length(m[i])] ELSE repeat('*', length(m[i])) END, '')), '') AS masked
FROM (SELECT v AS value, string_split_regex(v, '[A-Za-z0-9_]+') AS g, regexp_extract_all(v, '[A-Za-z0-9_]+') AS m FROM {_places(MAIL_RE)})""")
def mask_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, recognizers.emails).select("value", text.mask(F.col("value")).alias("masked"))


#: Characters of words, and of what mail and site addresses are made of.
_W = "\\p{L}\\p{M}\\p{N}\\p{Pc}"


@query(f"""SELECT doc_id, count(DISTINCT w) AS n_words FROM (SELECT doc_id, regexp_extract(run, '^([a-z]{{2,}}(?:-[a-z]+)*)(?:$|[^{_W}@.]|\\.$|\\.[^{_W}])', 1) AS w
FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[{_W}@./:-]+')) AS run FROM documents)) WHERE w <> '' GROUP BY doc_id""")
def doc_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case words of each document, parts of links left out. The SQL, without look-arounds, takes runs apart."""
    return docpass.vocabulary(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_words"))


@query(f"""SELECT entity_type, count(*) AS n FROM (SELECT 'EMAIL_ADDRESS' AS entity_type FROM {_places(MAIL_RE, "(SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages)", 'page_id', 't')}
UNION ALL SELECT 'IP_ADDRESS' FROM {_places(IP_RE, "(SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages)", 'page_id', 't')}) GROUP BY entity_type""")
def pages_html_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return pipeline.counts(recognizers.detect(rows, C.RunConfig(entities=("EMAIL_ADDRESS", "IP_ADDRESS")), names_too=False), "entity_type")


@query("""WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS occurrence FROM documents)
SELECT a.doc_id AS gold_id, b.doc_id AS doc_id FROM h AS a JOIN h AS b ON a.digest = b.digest AND a.occurrence = b.occurrence""")
def sha1_occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units matched by text digest, equal texts used up in order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    left = docs.select(F.col("doc_id").alias("gold_id"), "text", F.lit(None).cast("string").alias("sha1"))
    return scoring.match_by_hash(left, docs.select(F.col("doc_id").alias("unit_id"), "text", "doc_id"), ["doc_id"]).select("gold_id", "doc_id")


@query()
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents by line, all passes, with fakes: the text's digest and how many spans were replaced."""
    units = pipeline.as_units(table(spark, sf_dir, "documents"))
    redacted, _, _ = pipeline.redact(units)
    return redacted.groupBy("doc_id").agg(F.sum(F.size("spans")).alias("n_spans"), F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "redacted"))), lambda x: x["redacted"]), "\n")).alias("sha1"))


_LINES = "list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')"


@query(f"SELECT doc_id, sha256(array_to_string({_LINES}, chr(10))) AS digest, 0 AS values_left FROM documents WHERE len({_LINES}) > 0")
def redaction_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents redacted with all passes and made whole again: where a fake stands in the redacted text, the original
    value is put back, which must give the documents' lines. values_left: mail addresses, cards, phones and IP addresses of
    a document that can still be read in its redacted text."""
    redacted, found, _ = pipeline.redact(pipeline.as_units(table(spark, sf_dir, "documents")))
    back = lambda acc, r: F.struct(
        (acc["shift"] + F.length(r["fake"]) - (r["end"] - r["start"])).alias("shift"),
        F.concat(acc["out"], F.array(F.struct((r["start"] + acc["shift"]).alias("start"), (r["start"] + acc["shift"] + F.length(r["fake"])).alias("end"), F.substring(F.col("text"), r["start"] + 1, r["end"] - r["start"]).alias("fake")))).alias("out"),
    )
    none = F.array().cast("array<struct<start:int,end:int,fake:string>>")
    inverse = F.aggregate("replaced", F.struct(F.lit(0).alias("shift"), none.alias("out")), back, lambda acc: acc["out"])
    hidden = F.transform(F.filter("spans", lambda s: s["entity_type"].isin(*PATTERN_TYPES)), lambda s: value_of(F.col("text"), s))
    units = redacted.select("doc_id", "unit_id", "redacted", splice(F.col("redacted"), inverse).alias("restored"), hidden.alias("hidden"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", c))), lambda x: x[c]), "\n")
    docs = units.groupBy("doc_id").agg(ordered("restored").alias("restored"), ordered("redacted").alias("redacted"), F.array_distinct(F.flatten(F.collect_list("hidden"))).alias("hidden"))
    left = F.size(F.filter("hidden", lambda v: F.instr(F.col("redacted"), v) > 0))
    return docs.select("doc_id", F.sha2("restored", 256).alias("digest"), left.alias("values_left"))


@query("SELECT 0 AS keys_with_several_fakes, 0 AS fakes_of_several_keys, 0 AS valid_cards")
def replacement_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fake a key, one key a fake, and no fake card that passes its check."""
    found = recognizers.detect(pipeline.as_units(table(spark, sf_dir, "documents")), PATTERNS_ONLY, names_too=False)
    config = C.RunConfig(scope="corpus")
    made = replace.replacements(replace.spans_of(found, config), config)
    one = made.groupBy("entity_type", "key").agg(F.count_distinct("fake").alias("n")).where("n > 1").select(F.lit("key").alias("kind"))
    two = made.groupBy(F.lower("fake").alias("f")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("fake").alias("kind"))
    three = made.where((F.col("entity_type") == "CREDIT_CARD") & checksums.luhn_valid(F.col("fake"))).select(F.lit("card").alias("kind"))
    count = lambda kind, name: F.count_if(F.col("kind") == kind).cast("int").alias(name)
    return one.union(two).union(three).agg(count("key", "keys_with_several_fakes"), count("fake", "fakes_of_several_keys"), count("card", "valid_cards"))


# ---- on small invented tables

URLS = [(1, "https://www.sebi.gov.in/x"), (2, "www.gull-anchor.com/a"), (3, "http://10.2.3.4/x"), (4, "https://localhost/x"), (5, "www.example. com"), (6, "http://portal.nseindia.com")]
_HOST = r"regexp_extract(regexp_replace(url, '\.\s+', '.', 'g'), '(?i)^(?:https?://)?(?:www\.)?([^/\s:?#]+)', 1)"


@query(f"SELECT id, lower({_HOST}) AS host, {' OR '.join(f'''lower({_HOST}) = '{d}' OR lower({_HOST}) LIKE '%.{d}' ''' for d in C.PUBLIC_DOMAINS)} AS is_public FROM {values(URLS, 'id, url')}")
def url_public_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = text.host_of(F.col("url"))
    return spark.createDataFrame(URLS, "id int, url string").select("id", host.alias("host"), text.is_public_host(host).alias("is_public"))


PHONES = [(1, "+91 94460 71355"), (2, "123-4567"), (3, "080 2558 4471"), (4, "1800 22 33"), (5, "(080) 2558 4471")]


@query(f"SELECT id, length(regexp_replace(v, '[^0-9]', '', 'g')) >= 8 AS kept FROM {values(PHONES, 'id, v')}")
def phone_digit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(PHONES, "id int, v string").select("id", (F.length(checksums.digits(F.col("v"))) >= 8).alias("kept"))


NUMBERS = [(1, "2363"), (2, "2364"), (3, "2341 2341 2346"), (4, "9876 5432 1012"), (5, "123451"), (6, "84736430954837284567892")]


@query(f"""SELECT id, list_reduce(list_prepend(0, list_transform(list_reverse(regexp_extract_all(regexp_replace(v, '[^0-9]', '', 'g'), '.')), lambda d, i: {checksums.POWERS}[((i - 1) % 8) * 10 + CAST(d AS INT) + 1])), lambda c, d: {checksums.PRODUCT}[c * 10 + d + 1]) = 0 AS valid FROM {values(NUMBERS, 'id, v')}""")
def verhoeff_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(NUMBERS, "id int, v string").select("id", checksums.verhoeff_valid(F.col("v")).alias("valid"))


OVERLAPS = [(3, 9, "PERSON", 0.99, "a"), (3, 31, "ADDRESS", 0.5, "b"), (28, 40, "URL", 0.9, "c"), (50, 64, "CREDIT_CARD", 1.0, "d"), (50, 64, "IN_AADHAAR", 0.5, "e"), (70, 80, "CREDIT_CARD", 1.0, "f"), (70, 80, "IN_PAN", 0.6, "g"), (79, 84, "UNKNOWN", 0.9, "h"), (90, 95, "UNKNOWN", 0.9, "i")]


@query(f"SELECT * FROM {values([(3, 31, 'ADDRESS'), (50, 64, 'IN_AADHAAR'), (70, 80, 'IN_PAN'), (90, 95, 'UNKNOWN')], 'start, \"end\", entity_type')}")
def resolve_overlaps_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array(*(span(F.lit(a), F.lit(b), t, s, o) for a, b, t, s, o in OVERLAPS))
    return spark.range(1).select(F.explode(resolve_overlaps(spans)).alias("s")).select("s.start", "s.end", "s.entity_type")


UNITS = [
    (1, 0, "Ministry of Finance", "", 0, 0), (1, 1, "100 Garden Road, Kollam 691 001", "ADDRESS", 0, 31), (1, 2, "Grace Webb of Spindrift Ropes LLP", "PERSON", 0, 10), (1, 3, "said GRACE WEBB, not grace webb", "", 0, 0),
    (2, 0, "Head office", "", 0, 0), (2, 1, "5 Hill Road, Pune 411 001", "ADDRESS", 0, 25), (2, 2, "Grace Webb wasn't there", "", 0, 0),
]


def _units(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(UNITS, "doc_id long, unit_id int, text string, t string, s int, e int")
    found = F.filter(F.array(span(F.col("s"), F.col("e"), F.col("t"), 0.9, "test")), lambda x: x["entity_type"] != "")
    return rows.select("doc_id", "unit_id", "text", F.lit("c").alias("container_id"), found.alias("spans"))


_U = values(UNITS, "doc_id, unit_id, text, t, s, e")


@query(f"SELECT CAST(doc_id AS BIGINT) AS doc_id, unit_id, CASE WHEN t = 'ADDRESS' AND lower(before) IN ({', '.join(_literal(x) for x in sorted(C.PUBLIC_BODIES))}) THEN 0 WHEN t = '' THEN 0 ELSE 1 END AS n FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY unit_id) AS before FROM {_U})")
def neighbour_address_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docpass.drop_public_body_addresses(_units(spark)).select("doc_id", "unit_id", F.size("spans").alias("n"))


@query(f"""WITH u AS {_U}, known AS (SELECT DISTINCT doc_id, lower(substring(text, s + 1, e - s)) AS k FROM u WHERE t = 'PERSON')
SELECT CAST(doc_id AS BIGINT) AS doc_id, unit_id, CAST(strpos(lower(text), k) - 1 AS INT) AS start FROM u JOIN known USING (doc_id) WHERE strpos(lower(text), k) > 0 AND substring(text, strpos(lower(text), k), length(k)) <> k""")
def known_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _units(spark)
    out = docpass.propagate_known(units, docpass.known_names(units))
    return out.select("doc_id", "unit_id", F.explode("spans").alias("s")).where("s.entity_type = 'PERSON'").select("doc_id", "unit_id", "s.start")


LABELS = [("PERSON", "PERSON", 0), ("PERSON", None, 0), ("PERSON", "PERSON", 9), (None, None, None), (None, "URL", None), ("URL", "PERSON", 20), (None, None, None), ("ADDRESS", None, 30)]
_L = values(LABELS, "g, p, gold_start")
_RATES = """round(tp / nullif(tp + fp, 0), 4) AS "precision", round(tp / nullif(tp + fn, 0), 4) AS recall,
CASE WHEN tp + fp > 0 AND tp + fn > 0 THEN CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 4) END END AS f1, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 4) AS accuracy"""


def _labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "g string, p string, gold_start int")


@query(f"SELECT *, {_RATES} FROM (SELECT count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS tp, count(*) FILTER (g IS NULL AND p IS NOT NULL) AS fp, count(*) FILTER (g IS NOT NULL AND p IS NULL) AS fn, count(*) FILTER (g IS NULL AND p IS NULL) AS tn FROM {_L})")
def token_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.token_confusion(_labels(spark))


@query(f"""SELECT *, {_RATES} FROM (SELECT entity_type, count(*) FILTER (g = entity_type AND p = entity_type) AS tp, count(*) FILTER (g IS DISTINCT FROM entity_type AND p = entity_type) AS fp, count(*) FILTER (g = entity_type AND p IS DISTINCT FROM entity_type) AS fn, 0::BIGINT AS tn
FROM (SELECT g, p, unnest(list_distinct([g, p])) AS entity_type FROM {_L}) WHERE entity_type IS NOT NULL GROUP BY entity_type)""")
def type_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.type_confusion(_labels(spark))


_STATUS = f"(SELECT g AS entity_type, CASE WHEN count(p) = count(*) THEN 'full' WHEN count(p) > 0 THEN 'partial' ELSE 'missed' END AS status FROM {_L} WHERE g IS NOT NULL GROUP BY g, gold_start)"


@query(f"SELECT coalesce(entity_type, 'ALL') AS entity_type, count(*) FILTER (status = 'full') AS \"full\", count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'missed') AS missed, count(*) AS total FROM {_STATUS} GROUP BY ROLLUP (entity_type)")
def entity_status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.status_totals(scoring.entity_status(_labels(spark)))


VALUES = [(1, "PERSON", "Grace Webb"), (1, "PERSON", "Oscar Hunt"), (1, "ORGANIZATION", "Limited"), (1, "ORGANIZATION", "Spindrift Ropes LLP"), (1, "PERSON", "Al")]
REDACTED = [(1, "Here GRACE  WEBB stays, Hunt goes"), (1, "and Spindrift Rope LLP")]


@query(f"SELECT * FROM {values([('PERSON', 2, 1), ('ORGANIZATION', 1, 0)], 'entity_type, checked, leaked')}".replace("SELECT * FROM (SELECT *", "SELECT entity_type, CAST(checked AS BIGINT) AS checked, CAST(leaked AS BIGINT) AS leaked FROM (SELECT *", 1))
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.leaks(spark.createDataFrame(VALUES, "doc_id int, entity_type string, value string"), spark.createDataFrame(REDACTED, "doc_id int, text string"))


WORDS = [("i", 0, 0, 10, 40, 20), ("i", 0, 1, 55, 30, 20), ("i", 0, 2, 200, 30, 20), ("i", 0, 3, 235, 30, 20), ("i", 1, 4, 0, 30, 10), ("i", 1, 5, 56, 30, 10), ("j", 0, 6, 0, 10, 10)]
_WORDS = values(WORDS, "image_id, row_id, word_id, \"left\", width, height")


@query(f"""SELECT image_id, word_id, CAST(sum(CASE WHEN gap > 2.5 * taller THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, row_id ORDER BY "left") AS BIGINT) AS part
FROM (SELECT *, "left" - lag("left" + width) OVER w AS gap, greatest(height, lag(height) OVER w) AS taller FROM {_WORDS} WINDOW w AS (PARTITION BY image_id, row_id ORDER BY "left"))""")
def ocr_line_gap_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(WORDS, "image_id string, row_id int, word_id int, `left` int, width int, height int")
    return images.split_at_gaps(rows).select("image_id", "word_id", "part")


@query(f"SELECT image_id, min(\"left\") AS l, min(height) AS t, max(\"left\" + width) AS r, max(height + height) AS b FROM {_WORDS} GROUP BY image_id")
def union_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(WORDS, "image_id string, row_id int, word_id int, `left` int, width int, height int").withColumn("top", F.col("height"))
    return rows.groupBy("image_id").agg(*images.union_box_columns())


ONE = [("i", 1, 0, 0, 10, 10), ("i", 2, 20, 20, 40, 40), ("j", 3, 0, 0, 10, 10)]
TWO = [("i", 1, 1, 1, 10, 10), ("i", 2, 30, 30, 60, 60)]


@query(f"""SELECT DISTINCT a.image_id, a.id FROM {values(ONE, 'image_id, id, l, t, r, b')} AS a JOIN {values(TWO, 'image_id, id, l, t, r, b')} AS c ON a.image_id = c.image_id
WHERE (greatest(least(a.r, c.r) - greatest(a.l, c.l), 0) * greatest(least(a.b, c.b) - greatest(a.t, c.t), 0))::DOUBLE / ((a.r - a.l) * (a.b - a.t) + (c.r - c.l) * (c.b - c.t) - greatest(least(a.r, c.r) - greatest(a.l, c.l), 0) * greatest(least(a.b, c.b) - greatest(a.t, c.t), 0)) > 0.4""")
def box_iou_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "image_id string, id int, l int, t int, r int, b int"
    return images.agreeing(spark.createDataFrame(ONE, kind), spark.createDataFrame(TWO, kind)).select("image_id", "id")


CASES = [(1, "LEELA MENON", "Anna Baker"), (2, "Leela Menon", "Anna Baker"), (3, "leela", "Anna"), (4, "X", "Anna")]


@query(f"SELECT id, CASE WHEN length(o) > 1 AND o = upper(o) THEN upper(f) WHEN o = lower(o) THEN lower(f) ELSE f END AS fake FROM {values(CASES, 'id, o, f')}")
def match_case_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(CASES, "id int, o string, f string").select("id", text.match_case(F.col("o"), F.col("f")).alias("fake"))


def _sample() -> list[tuple[str, list[tuple[str, str]]]]:
    """The marked lines as text and marks, read without the engine."""
    lines = [*gold.LINES, *(cell for row in gold.CELLS for cell in row)]
    mark = re.compile(r"\[\[([A-Z_]+):(.*?)\]\]")
    return [(mark.sub(r"\2", x), mark.findall(x)) for x in lines]


def _sample_counts() -> list[tuple]:
    """Tokens by type, if all are found and nothing else is."""
    found = Counter(t for _, marks in _sample() for t, v in marks for _ in re.findall(r"\w+(?:[.'’@-]\w+)*|[^\w\s]", v))
    return [(t, n, 0, 0, 0, 1.0, 1.0, 1.0, 1.0) for t, n in found.items()]


@query("SELECT entity_type, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, CAST(p AS DOUBLE) AS \"precision\", CAST(r AS DOUBLE) AS recall, CAST(f AS DOUBLE) AS f1, CAST(a AS DOUBLE) AS accuracy FROM " + values(_sample_counts(), "entity_type, tp, fp, fn, tn, p, r, f, a"))
def sample_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection on the labelled sample, scored by type: each label is found, and nothing else."""
    units = recognizers.detect(gold.sample(spark))
    return scoring.type_confusion(scoring.token_labels(units))


@query("SELECT unit_id, sha1, n FROM " + values([(k, hashlib.sha1(t.encode()).hexdigest(), len(m)) for k, (t, m) in enumerate(_sample())], "unit_id, sha1, n"))
def sample_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked text as text and places."""
    return gold.sample(spark).select("unit_id", "sha1", F.size("entities").alias("n"))
