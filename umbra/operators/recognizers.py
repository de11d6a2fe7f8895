"""Recognisers: texts to scored spans. Patterns are native expressions; names and addresses run in Arrow batches.

A registry maps names to builders, so a type is added by registering a builder and, if need be, a threshold and a fake.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import names
from ..functions.checksums import digits, luhn_valid, verhoeff_valid
from ..functions.spans import SPANS, find_spans, last_words, let, matches, no_spans, overlaps, resolve_overlaps, span, value_of
from ..functions.text import host_of, is_public_host

# Patterns, in Java's syntax. Each is a shape between two guards: what mustn't stand before it and after it.


def guarded(shape: str, before: str, after: str = "", flags: str = "") -> str:
    return f"{flags}(?<!{before}){shape}" + (f"(?!{after})" if after else "")


_LABEL_OF_HOST = r"[A-Za-z0-9-]+"
EMAIL = guarded(rf"[\w.+-]+@{_LABEL_OF_HOST}(?:\.{_LABEL_OF_HOST})+", r"[\w.+-]")
URL = guarded(r"(?:https?://|www\.)[^\s<>\"'|]+", r"[\w@.]", flags="(?i)")
#: A site whose last dot is followed by a blank, as line breaks leave it.
BROKEN_URL = rf"(?i)\b(?<!\.)www(?:\.{_LABEL_OF_HOST})+\.\s(?:co\.in|com|in|net|org)\b"
SSN = guarded(r"(?!000|666)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", r"[\d-]", r"[\d-]")
#: How cards are written, and where such a number begins: its first group, so that no number before or after it hides it.
CARDS = (r"\d{13,19}", r"\d{4}(?:[ -]\d{4}){3}", r"\d{4}[ -]\d{6}[ -]\d{4,5}", r"\d{4}(?:[ -]\d{4}){3}[ -]\d{3}", r"\d{6}[ -]\d{13}")
CARD_START = guarded(r"(?:\d{13,19}|\d{4}(?=(?:[ -]\d{4}){3}|[ -]\d{6}[ -]\d{4})|\d{6}(?=[ -]\d{13}))", r"\d|\d\.", r"\d")
#: Other groupings, as far as the number goes. A group as long as a card is a number of its own.
OTHER_CARD = guarded(r"\d(?:[ -]?\d){12,18}", r"[\d.-]", r"[\d-]")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV4 = guarded(rf"{_OCTET}(?:\.{_OCTET}){{3}}", r"[\d.]", r"\d|\.\d")
_HEX = "[0-9a-f]{1,4}"
IPV6 = guarded(rf"(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|::(?:{_HEX}:){{0,5}}{_HEX})", r"[\w:]", r"[\w:]", "(?i)")
PAN = guarded(r"[A-Z]{5}\d{4}[A-Z]", "[A-Z0-9]", "[A-Z0-9]")
#: Twelve digits in three groups of four, beginning with 2 to 9.
AADHAAR = guarded(r"[2-9]\d{3}(?:[ -]?\d{4}){2}", r"[\d.,]", r"[\d.,]")
DIN = guarded(r"\d{8}", r"[\d,./-]", r"[\d,./-]")


def _digits(least: int, most: int, gap: str = "[ -]?") -> str:
    """So many digits, each but the first after an optional gap."""
    return rf"\d(?:{gap}\d){{{least - 1},{most - 1}}}"


#: Numbers by how they are written: shape, what mustn't be beside it, and the score.
PHONES = tuple(
    (guarded(shape, before, after), score)
    for shape, before, after, score in (
        (rf"\+ ?91[ -]*(?:\( ?\d{{2,4}} ?\)[ -]*)?{_digits(8, 11)}", r"[\w+]", r"[\d-]|\.\d", 0.7),  # India's code, with a plus
        (r"91(?:-\d{2,4}){2} ?\d{4}", r"[\d+]", r"\d", 0.6),  # the same without, in groups
        (r"\+(?! ?91)\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}", r"[\w+]", r"[\d-]|\.\d", 0.6),  # other countries
        (r"0\d{2,4}(?:[ -]\d{3,4}){1}[ -]\d{4}", r"[\w-]", r"[\d-]", 0.4),  # a town's code and two groups
        (r"0\d{2,4}[ -]\d{6,8}", r"[\w-]", r"[\d-]", 0.35),  # a town's code and one
        (r"[6-9]\d{9}", r"[\w.,/-]", r"[\w/-]|[.,]\w", 0.35),  # a mobile
        (r"[6-9]\d{4} \d{5}", r"[\d.,]", r"\d|[.,]\d", 0.35),  # the same in halves
        (r"1800(?:[ -]?\d{3})[ -]?\d{3,4}", r"\d", r"\d", 0.35),  # free of charge
    )
)
_MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 4 else m for m in _MONTHS) + r"|June?|July?|Sept)\.?"
_DAY, _YEAR = r"\d{1,2}(?:st|nd|rd|th)?", r"(?:19|20)\d{2}"
DATES = "|".join((
    guarded(rf"\d{{1,2}}[/.-]\d{{1,2}}[/.-]{_YEAR}", r"\d", r"\d"), guarded(rf"{_YEAR}-\d{{2}}-\d{{2}}", r"\d", r"\d"),
    rf"\b{_DAY}\s+{_MONTH},?\s+{_YEAR}\b", rf"\b{_MONTH}\s+{_DAY},?\s+{_YEAR}\b",
))
BIRTH = r"(?i)\b(?:d\.?o\.?b\b\.?|birthda(?:y|te)|(?:date|day)\s+of\s+birth|birth\s+date|born)(?!\w)|जन्म"
#: A mark and a blank, but not after a single letter (an initial).
SENTENCE_END = r"[;!?]\s|(?<!\b\p{L})\.\s|\n"
#: Words that make a number one of a kind. Lower case.
CONTEXT = {
    "PHONE_NUMBER": ("phone", "telephone", "tel", "mobile", "contact", "fax", "call", "cell", "dial", "helpline", "landline", "whatsapp", "ring"),
    "IN_AADHAAR": ("aadhaar", "aadhar", "uid", "uidai", "आधार", "enrolment", "identification", "identity"),
    "IN_DIN": ("din", "director identification"),
    "IN_PAN": ("pan", "permanent account", "income tax", "taxpayer"),
    "DATE_OF_BIRTH": ("dob", "birth", "born", "birthday", "birthdate", "जन्म"),
}
BOOST, BOOSTED_LEAST = 0.35, 0.4


def _boosted(spans: Column, text: Column, context: Column, entity: str) -> Column:
    """Scores raised where a cue is among the five words before a span or in the unit's own context."""
    cues = F.array(*map(F.lit, CONTEXT[entity]))
    outside = F.lower(F.array_join(context, " "))

    def raised(s: Column) -> Column:
        near = F.concat(F.lit(" "), last_words(F.substring(text, F.lit(1), s["start"])), F.lit(" "), outside, F.lit(" "))
        hit = F.exists(cues, lambda w: F.instr(near, F.concat(F.lit(" "), w, F.lit(" "))) > 0)
        score = F.when(hit, F.least(F.lit(1.0), F.greatest(s["score"] + BOOST, F.lit(BOOSTED_LEAST)))).otherwise(s["score"])
        return span(s["start"], s["end"], s["entity_type"], score, s["source"], s["value"])

    return F.transform(spans, raised)


def emails(text: Column, context: Column) -> Column:
    trimmed = lambda m: span(m["start"], m["start"] + F.length(F.rtrim(m["value"], F.lit(".-"))), "EMAIL_ADDRESS", 1.0, "email")
    return F.transform(matches(F.when(text.contains("@"), text), EMAIL), trimmed)


def urls(text: Column, context: Column) -> Column:
    some = F.when(F.lower(text).contains("www.") | text.contains("://"), text)
    return F.concat(find_spans(some, URL, "URL", 0.6, "url"), find_spans(some, BROKEN_URL, "URL", 0.6, "broken_url"))


def ssns(text: Column, context: Column) -> Column:
    return find_spans(text, SSN, "US_SSN", 0.5, "ssn")


def cards(text: Column, context: Column) -> Column:
    """Numbers that pass the check: those written as cards are, whatever other numbers are beside them, then other groupings."""
    made = lambda start, end: span(start, end, "CREDIT_CARD", 1.0, "card")

    def written(m: Column) -> Column:
        rest = F.substring(text, m["start"] + 1, F.lit(24))
        shapes = F.filter(F.array(*(F.regexp_extract(rest, rf"^{p}(?!\d)", 0) for p in CARDS)), luhn_valid)
        return made(m["start"], m["start"] + F.length(F.get(shapes, F.lit(0))))

    usual = resolve_overlaps(F.filter(F.transform(matches(text, CARD_START), written), lambda s: s["end"].isNotNull()))
    other = F.filter(matches(text, OTHER_CARD), lambda m: ~m["value"].rlike(r"\d{13}") & luhn_valid(m["value"]))
    return let(usual, lambda u: F.concat(u, F.filter(F.transform(other, lambda m: made(m["start"], m["end"])), lambda o: ~F.exists(u, lambda x: overlaps(x, o)))))


def ipv4s(text: Column, context: Column) -> Column:
    return find_spans(F.when(text.rlike(r"[0-9]\.[0-9]"), text), IPV4, "IP_ADDRESS", 0.6, "ip")


def ipv6s(text: Column, context: Column) -> Column:
    return find_spans(F.when(text.contains(":"), text), IPV6, "IP_ADDRESS", 0.6, "ip")


def phones(text: Column, context: Column) -> Column:
    found = F.concat(*(find_spans(text, p, "PHONE_NUMBER", score, "phone") for p, score in PHONES))
    return _boosted(found, text, context, "PHONE_NUMBER")


def aadhaars(text: Column, context: Column) -> Column:
    found = F.transform(matches(text, AADHAAR), lambda m: span(m["start"], m["end"], "IN_AADHAAR", F.when(verhoeff_valid(m["value"]), 0.35).otherwise(0.2), "aadhaar"))
    return _boosted(found, text, context, "IN_AADHAAR")


def dins(text: Column, context: Column) -> Column:
    return _boosted(find_spans(text, DIN, "IN_DIN", 0.05, "din"), text, context, "IN_DIN")


def pans(text: Column, context: Column) -> Column:
    return _boosted(find_spans(text, PAN, "IN_PAN", 0.3, "pan"), text, context, "IN_PAN")


def births(text: Column, context: Column) -> Column:
    """Dates; with a cue in the text only the first after a cue in its sentence counts, else the unit's context decides."""
    dates = find_spans(text, DATES, "DATE_OF_BIRTH", 0.05, "birth_date")

    def by_cue(d: Column) -> Column:
        def scored(s: Column, cues: Column, ends: Column) -> Column:
            sentence = F.coalesce(F.array_max(F.transform(F.filter(ends, lambda e: e["end"] <= s["start"]), lambda e: e["end"])), F.lit(0))
            cue = F.array_max(F.transform(F.filter(cues, lambda c: (c["start"] >= sentence) & (c["end"] <= s["start"])), lambda c: c["end"]))
            between = F.exists(d, lambda o: (o["start"] >= cue) & (o["start"] < s["start"]))
            return span(s["start"], s["end"], s["entity_type"], F.when(cue.isNotNull() & ~between, 0.85).otherwise(s["score"]), s["source"])

        return let(matches(text, BIRTH), lambda cues: let(matches(text, SENTENCE_END), lambda ends: F.transform(d, lambda s: scored(s, cues, ends))))

    return F.when(text.rlike(DATES), F.when(text.rlike(BIRTH), let(dates, by_cue)).otherwise(_boosted(dates, text, context, "DATE_OF_BIRTH"))).otherwise(no_spans())


Builder = Callable[[Column, Column], Column]
#: Recognisers by name: the types each finds, its builder, and whether what it finds has two digits in a row.
REGISTRY: dict[str, tuple[frozenset[str], Builder, bool]] = {
    "email": (frozenset(["EMAIL_ADDRESS"]), emails, False), "url": (frozenset(["URL"]), urls, False), "ipv6": (frozenset(["IP_ADDRESS"]), ipv6s, False),
    "ssn": (frozenset(["US_SSN"]), ssns, True), "card": (frozenset(["CREDIT_CARD"]), cards, True), "phone": (frozenset(["PHONE_NUMBER"]), phones, True), "aadhaar": (frozenset(["IN_AADHAAR"]), aadhaars, True),
    "din": (frozenset(["IN_DIN"]), dins, True), "pan": (frozenset(["IN_PAN"]), pans, True), "birth_date": (frozenset(["DATE_OF_BIRTH"]), births, True), "ipv4": (frozenset(["IP_ADDRESS"]), ipv4s, False),
}


def register(name: str, entities, builder: Builder, two_digits: bool = False) -> None:
    """Adds or replaces a recogniser: builder(text, context) gives an array of spans. With ``two_digits`` it sees a null
    text where no two digits stand in a row."""
    REGISTRY[name] = frozenset(entities), builder, two_digits


def pattern_hits(text: Column, context: Column, config: C.RunConfig) -> Column:
    """Hits of all registered recognisers whose types are asked for. The test for digits is made once for a text."""
    wanted = [(b, digits_too) for kinds, b, digits_too in REGISTRY.values() if kinds & set(config.entities)]
    plain = [b(text, context) for b, digits_too in wanted if not digits_too]
    counted = [b for b, digits_too in wanted if digits_too]
    if counted:
        plain.append(F.when(text.rlike("[0-9][0-9]"), F.concat(no_spans(), *(b(text, context) for b in counted))).otherwise(no_spans()))
    return F.concat(no_spans(), *plain)


def name_hits(text: Column, config: C.RunConfig, ner: Callable | None = names.guessed) -> Column:
    """Verified names and addresses, in Arrow batches."""
    least = {t: config.threshold(t) for t in (*C.PRIORITY,)}
    wanted = set(config.entities)

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        keys = ("start", "end", "entity_type", "score", "source")
        return texts.map(lambda t: [dict(zip(keys, x, strict=True)) | {"value": None} for x in names.name_spans(t, ner, least) if x[2] in wanted] if t else [])

    return run(text)


def passes(text: Column, config: C.RunConfig) -> Callable[[Column], Column]:
    """The filters of values: score, blank, phone digits, public sites and mail, odd sites."""
    limits = F.create_map(*(x for t in C.PRIORITY for x in (F.lit(t), F.lit(config.threshold(t)))))

    def keep(s: Column) -> Column:
        value = value_of(text, s)
        host = host_of(value)
        kind = s["entity_type"]
        return (
            (s["score"] >= F.coalesce(F.element_at(limits, kind), F.lit(config.default_threshold))) & (F.btrim(value) != "")
            & ((kind != "PHONE_NUMBER") | (F.length(digits(value)) >= 8))
            & ((kind != "URL") | (~is_public_host(host) & host.contains(".") & ~host.rlike(r"^[0-9.]+$")))
            & ((kind != "EMAIL_ADDRESS") | ~is_public_host(F.lower(F.substring_index(value, "@", -1))))
        )

    return keep


def edges(text: Column) -> Callable[[Column], Column]:
    """Spans without what clings to their ends: blanks and marks at phones, closing marks at sites."""

    def cut(s: Column) -> Column:
        value = value_of(text, s)
        left = F.when(s["entity_type"] == "PHONE_NUMBER", F.length(value) - F.length(F.ltrim(value, F.lit(" ,;:")))).otherwise(F.lit(0))
        marks = F.when(s["entity_type"] == "PHONE_NUMBER", F.lit(" ,;:-")).when(s["entity_type"] == "URL", F.lit(".,;)")).otherwise(F.lit(""))
        right = F.when(marks == "", F.lit(0)).otherwise(F.length(value) - F.length(F.rtrim(value, marks)))
        return span(s["start"] + left, s["end"] - right, s["entity_type"], s["score"], s["source"], s["value"])

    return cut


def prefer_rules(spans: Column) -> Column:
    """Without recognised names that overlap one found by a company ending or a label."""
    rules = F.filter(spans, lambda s: s["source"].isin(C.ORG_RULE, C.LABEL_RULE))
    return let(rules, lambda r: F.filter(spans, lambda s: (s["source"] != C.NER) | ~F.exists(r, lambda o: overlaps(o, s))))


def detect(units: DataFrame, config: C.RunConfig | None = None, *, text_col: str = "text", context_col: str | None = "context", ner: Callable | None = names.guessed, names_too: bool = True, memoise: bool = False) -> DataFrame:
    """units with one more column, spans: verified, without overlaps, in order. Blank and null texts have none.

    ``memoise`` detects each distinct (text, context) once and joins back, which pays where texts repeat a lot.
    """
    config = config or C.RunConfig()
    if context_col and context_col not in units.columns:
        context_col = None
    if memoise:
        keys = [text_col] + ([context_col] if context_col else [])
        distinct = detect(units.select(*keys).distinct(), config, text_col=text_col, context_col=context_col, ner=ner, names_too=names_too)
        renamed = distinct.select(*(F.col(k).alias(f"_key_{k}") for k in keys), "spans")
        same = None
        for k in keys:
            c = F.col(k).eqNullSafe(F.col(f"_key_{k}"))
            same = c if same is None else same & c
        return units.join(renamed, same, "left").drop(*(f"_key_{k}" for k in keys))
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), "\t", " ")
    context = F.coalesce(F.col(context_col).cast("array<string>"), F.array().cast("array<string>")) if context_col else F.array().cast("array<string>")
    rows = units
    if names_too:
        rows = rows.withColumn("_names", name_hits(text, config, ner))

    # Everything that is used more than once is bound by a lambda, so that no expression is computed again.
    def verified(t: Column) -> Column:
        hits = pattern_hits(t, context, config)
        return let(F.concat(hits, F.col("_names")) if names_too else hits, lambda h: F.when(F.size(h) == 0, h).otherwise(let(F.filter(F.transform(h, edges(t)), passes(t, config)), settled)))

    def settled(kept: Column) -> Column:
        return F.when(F.size(kept) < 2, kept).otherwise(resolve_overlaps(prefer_rules(kept)))

    blank = F.coalesce(F.btrim(F.col(text_col)) == "", F.lit(True))
    return rows.withColumn("spans", F.when(blank, no_spans()).otherwise(let(text, verified))).drop("_names")
