"""Replacement: one fake for each value within a scope, put where the spans are.

Values are grouped by (scope, type, normal key); only distinct keys get a fake, so generators run on few rows. Fakes
depend on the seed, scope, type and key alone, not on the order of rows, and none stands for two values of a scope.
People come first, so that mail addresses can mirror them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import config as C
from ..functions import fakes
from ..functions.checksums import digits
from ..functions.spans import splice, value_of
from ..functions.text import host_of, match_case, squeezed, strip_org_suffix

DIGITS_ONLY = ("IN_AADHAAR", "CREDIT_CARD", "US_SSN", "IN_DIN")


def norm_key(entity: Column, value: Column) -> Column:
    """What makes two spellings one value."""
    low = F.lower(squeezed(value))
    url = F.rtrim(F.regexp_replace(F.regexp_replace(low, r"\.\s+", "."), r"^(?:https?://)?(?:www\.)?", ""), F.lit("/"))
    return (
        F.when(entity == "PHONE_NUMBER", F.right(digits(value), F.lit(10)))
        .when(entity.isin(*DIGITS_ONLY), digits(value)).when(entity == "URL", url).otherwise(F.rtrim(low, F.lit(" .,;:")))
    )


def spans_of(units: DataFrame, config: C.RunConfig) -> DataFrame:
    """A row for each span: scope_id, doc_id, unit_id, start, end, entity_type, source, original (whole value), raw, key."""
    rows = units.select("doc_id", "unit_id", "text", F.explode("spans").alias("s"))
    raw = value_of(F.col("text"), F.col("s"))
    original = F.coalesce("s.value", raw)
    scope = F.col("doc_id").cast("string") if config.scope == "document" else F.lit("corpus")
    return rows.select(scope.alias("scope_id"), "doc_id", "unit_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.entity_type").alias("entity_type"), F.col("s.source").alias("source"), raw.alias("raw"), original.alias("original")).withColumn("key", norm_key(F.col("entity_type"), F.col("original")))


@F.pandas_udf(StringType())
def _fake(seed: pd.Series, scope: pd.Series, entity: pd.Series, key: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
    return pd.Series([fakes.fake(*x) for x in zip(seed, scope, entity, key, value, attempt, strict=True)])


def _apart(rows: DataFrame, rounds: int = 2) -> DataFrame:
    """rows (scope_id, entity_type, key, fake) with fakes that differ, whatever their letter case, within a scope: equal
    ones are numbered, mail addresses before the @. What a number makes equal to another gets one more, then a hash."""
    order = Window.partitionBy("scope_id", F.lower("fake")).orderBy("entity_type", "key")
    for k in range(rounds + 1):
        mark = F.col("_n").cast("string") if k < rounds else F.lower(F.hex(F.xxhash64("entity_type", "key")))
        local, host = F.substring_index("fake", "@", 1), F.concat(F.lit("@"), F.substring_index("fake", "@", -1))
        marked = F.when(F.col("fake").contains("@"), F.concat(local, mark, host)).otherwise(F.concat("fake", F.lit(" "), mark))
        rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("fake", F.when(F.col("_n") == 1, F.col("fake")).otherwise(marked)).drop("_n")
    return rows


def _fresh(rows: DataFrame, seed: int) -> DataFrame:
    """rows (scope_id, entity_type, key, value) with fakes; equal ones are drawn once more before they are numbered."""
    drawn = lambda attempt: _fake(F.lit(seed), "scope_id", "entity_type", "key", "value", attempt)
    rows = rows.withColumn("fake", drawn(F.lit(0)))
    again = F.row_number().over(Window.partitionBy("scope_id", F.lower("fake")).orderBy("entity_type", "key")) - 1
    rows = rows.withColumn("_n", again).withColumn("fake", F.when(F.col("_n") == 0, F.col("fake")).otherwise(drawn(F.col("_n")))).drop("_n")
    return _apart(rows)


def person_tokens(people: DataFrame) -> DataFrame:
    """scope_id, token, fake_token: words of people's names and of their fakes, place by place; the first key counts."""
    one, two = F.split("key", " "), F.split("fake", " ")
    at = lambda a, k: F.get(a, k)
    rows = people.select("scope_id", "key", F.posexplode(one).alias("k", "token"), two.alias("two"), F.size(one).alias("n"))
    other = F.when(F.col("k") == F.col("n") - 1, F.element_at("two", -1)).otherwise(at(F.col("two"), F.col("k")))
    rows = rows.withColumn("fake_token", other).where(F.col("fake_token").isNotNull())
    return rows.groupBy("scope_id", "token").agg(F.min_by("fake_token", F.struct("key", "k")).alias("fake_token"))


def domains(hosts: DataFrame, seed: int) -> DataFrame:
    """hosts (scope_id, host) with fake_host, below example.com, another for each host of a scope."""
    names = F.array(*(F.lit(x.lower()) for x in fakes.LAST))
    rows = hosts.where("host <> ''").distinct().withColumn("_h", F.xxhash64(F.lit(seed), "scope_id", "host"))
    rows = rows.withColumn("_name", F.get(names, F.pmod(F.col("_h"), F.lit(len(fakes.LAST))).cast("int")))
    again = F.row_number().over(Window.partitionBy("scope_id", "_name").orderBy("host"))
    name = F.when(again == 1, F.col("_name")).otherwise(F.concat("_name", again))
    return rows.withColumn("fake_host", F.concat(name, F.lit(".example.com"))).select("scope_id", "host", "fake_host")


def _emails(mails: DataFrame, people: DataFrame, hosts: DataFrame, seed: int) -> DataFrame:
    """Fakes of mail addresses: words of the local part that are a person's become that person's fake words."""
    rows = mails.withColumn("local", F.substring_index("key", "@", 1)).withColumn("host", F.substring_index("key", "@", -1)).join(hosts, ["scope_id", "host"], "left")
    parts = rows.select("scope_id", "key", "local", F.posexplode(F.split("local", "(?<=[._-])|(?=[._-])")).alias("k", "part"))
    parts = parts.withColumn("token", F.regexp_replace("part", r"\d+$", "")).withColumn("tail", F.regexp_extract("part", r"(\d+)$", 1))
    parts = parts.join(person_tokens(people), ["scope_id", "token"], "left").withColumn("new", F.coalesce(F.concat(F.lower("fake_token"), "tail"), "part"))
    made = parts.groupBy("scope_id", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "new"))), lambda x: x["new"]), "").alias("made"), F.count("fake_token").alias("hits"))
    names = F.array(*(F.lit(x.lower()) for x in fakes.FIRST))
    h = F.xxhash64(F.lit(seed), "scope_id", "key")
    user = F.concat(F.get(names, F.pmod(h, F.lit(len(fakes.FIRST))).cast("int")), F.pmod(F.shiftright(h, 16), F.lit(900)) + 100)
    rows = rows.join(made, ["scope_id", "key"])
    return _apart(rows.select("scope_id", "entity_type", "key", "value", F.concat(F.when(F.col("hits") > 0, F.col("made")).otherwise(user), F.lit("@"), F.coalesce("fake_host", F.lit("mail.example.com"))).alias("fake")))


def replacements(spans: DataFrame, config: C.RunConfig, stage=lambda df, name: df) -> DataFrame:
    """scope_id, entity_type, key, fake for all distinct values but sites, whose hosts alone are replaced."""
    keys = spans.where((F.col("entity_type") != "URL") & (F.col("source") != C.CONTINUATION)).groupBy("scope_id", "entity_type", "key").agg(F.min_by("original", F.struct("doc_id", "unit_id", "start")).alias("value"))
    keys = stage(keys, "keys")
    plain = stage(_fresh(keys.where("entity_type <> 'EMAIL_ADDRESS'"), config.seed), "fakes")
    people = plain.where("entity_type = 'PERSON'").select("scope_id", "key", "fake")
    mails = keys.where("entity_type = 'EMAIL_ADDRESS'")
    return plain.unionByName(_emails(mails, people, site_hosts(spans, config.seed), config.seed)).select("scope_id", "entity_type", "key", "fake")


def site_hosts(spans: DataFrame, seed: int) -> DataFrame:
    """scope_id, host, fake_host of all hosts in mail addresses and sites."""
    host = F.when(F.col("entity_type") == "EMAIL_ADDRESS", F.substring_index("key", "@", -1)).otherwise(host_of(F.col("original")))
    return domains(spans.where(F.col("entity_type").isin("EMAIL_ADDRESS", "URL")).select("scope_id", host.alias("host")), seed)


def fake_url(original: Column, fake_host: Column) -> Column:
    """Scheme and www. stay, the host is replaced, the path goes."""
    lead = F.regexp_extract(F.regexp_replace(original, r"\.\s+", "."), r"(?i)^((?:https?://)?(?:www\.)?)", 1)
    return F.concat(lead, F.coalesce(fake_host, F.lit("site.example.com")))


def faked(spans: DataFrame, config: C.RunConfig, found: DataFrame | None = None) -> DataFrame:
    """spans with fake: the text that takes the span's place."""
    found = found if found is not None else replacements(spans, config)
    rows = spans.withColumn("host", F.when(F.col("entity_type") == "URL", host_of(F.col("original"))))
    rows = rows.join(found, ["scope_id", "entity_type", "key"], "left").join(site_hosts(spans, config.seed), ["scope_id", "host"], "left")
    whole = F.when(F.col("entity_type") == "URL", fake_url(F.col("original"), F.col("fake_host"))).otherwise(F.col("fake"))
    cased = F.when(F.col("entity_type").isin("PERSON", "ORGANIZATION", "ADDRESS"), match_case(F.col("raw"), whole)).otherwise(whole)
    one_word = ~squeezed(F.col("raw")).contains(" ")
    short = match_case(F.col("raw"), F.when(one_word, F.element_at(F.split("fake", " "), 1)).otherwise(strip_org_suffix(F.col("fake"))))
    out = F.when(F.col("source") == C.CONTINUATION, F.lit("")).when(F.col("source") == C.SHORT_FORM, short).otherwise(cased)
    return rows.withColumn("fake", F.coalesce(out, F.lit(""))).drop("fake_host", "host")


def redact(units: DataFrame, config: C.RunConfig | None = None, rows: DataFrame | None = None) -> DataFrame:
    """units with redacted, the text with all spans replaced, and replaced, what was put where."""
    config = config or C.RunConfig()
    rows = rows if rows is not None else faked(spans_of(units, config), config)
    made = rows.groupBy("doc_id", "unit_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "fake"))).alias("replaced"))
    out = units.join(made, ["doc_id", "unit_id"], "left").withColumn("replaced", F.coalesce("replaced", F.array().cast("array<struct<start:int,end:int,fake:string>>")))
    return out.withColumn("redacted", splice(F.col("text"), F.col("replaced")))


def rewrite_segments(segments: Column, replaced: Column) -> Column:
    """Text segments (kind, start, end, text) after replacement: a fake goes to the first text segment that a range
    touches, what else the range covers is cut, and tabs and breaks wholly inside it are removed."""
    touched = lambda g: F.filter(replaced, lambda r: (r["start"] < g["end"]) & (g["start"] < r["end"]))

    def text_of(g: Column) -> Column:
        first = lambda r: F.array_min(F.transform(F.filter(segments, lambda o: (o["kind"] == "text") & (r["start"] < o["end"]) & (o["start"] < r["end"])), lambda o: o["start"]))
        pieces = F.transform(touched(g), lambda r: F.struct((F.greatest(r["start"], g["start"]) - g["start"]).alias("start"), (F.least(r["end"], g["end"]) - g["start"]).alias("end"), F.when(first(r) == g["start"], r["fake"]).otherwise(F.lit("")).alias("fake")))
        return splice(g["text"], pieces)

    inside = lambda g: F.exists(replaced, lambda r: (r["start"] <= g["start"]) & (g["end"] <= r["end"]))
    return F.transform(
        F.filter(segments, lambda g: (g["kind"] == "text") | ~inside(g)),
        lambda g: F.struct(g["kind"].alias("kind"), g["start"].alias("start"), g["end"].alias("end"), F.when(g["kind"] == "text", text_of(g)).otherwise(g["text"]).alias("text")),
    )


def mapping(found: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """scope_id, entity_type and a map from key to fake; with hosts also a DOMAIN row. Only for those who ask for it."""
    rows = found.select("scope_id", "entity_type", "key", "fake")
    if hosts is not None:
        rows = rows.union(hosts.select("scope_id", F.lit("DOMAIN"), "host", "fake_host"))
    return rows.groupBy("scope_id", "entity_type").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "fake")))).alias("values"))
