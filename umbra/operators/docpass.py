"""Passes over a document's units, in their fixed order: each adds spans to, or removes spans from, the units' spans.

units: doc_id, unit_id (dense, in reading order), text, container_id, spans. Everything is keyed by document; names are
matched to texts by an equality join on their first word, in which a text is the set of its words; only texts that may
hold a name move, once. So work grows with the text, not with text times names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.names import ADDRESS_CUE
from ..functions.spans import let, matches, no_spans, overlaps, resolve_overlaps, span, value_of
from ..functions.text import is_title, squeezed, stems, strip_org_suffix, tokens

LOWER_WORD = r"(?U)(?<![\w@./:-])[a-z][a-z]+(?:-[a-z]+)*(?![\w@]|\.\w)"
#: How much of a unit's end and of the next one's start a split name may take.
TAIL = 80
NAMES = ("PERSON", "ORGANIZATION")


def _literals(words) -> Column:
    return F.array(*map(F.lit, sorted(words)))


def _order() -> Window:
    return Window.partitionBy("doc_id").orderBy("unit_id")


def vocabulary(units: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """doc_id, word: the words that a document writes in lower case, outside mail and site addresses. ``of`` names the
    documents (doc_id) whose words are wanted; the texts of others aren't looked at."""
    if of is not None:
        units = units.join(of.select("doc_id").distinct(), "doc_id", "left_semi")
    return units.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LOWER_WORD), F.lit(0))).alias("word")).distinct()


def _in_lists(word: Column) -> Column:
    """Ordinary by the lists alone: generic words and labels; else neither a name word nor outside the dictionary."""
    low = F.lower(F.rtrim(word, F.lit(".")))
    return low.isin(*sorted(C.GENERIC | C.LABELS))


def _ordinary(word: Column, in_document: Column) -> Column:
    low = F.lower(F.rtrim(word, F.lit(".")))
    acronym = (F.length(low) <= 5) & (word == F.upper(word))
    return _in_lists(word) | in_document | (~low.isin(*sorted(C.NAME_WORDS)) & (acronym | F.arrays_overlap(stems(low), _literals(C.DICTIONARY))))


def vocabulary_spans(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """candidates (doc_id, key columns, value) with is_vocabulary: all their words are ordinary ones."""
    keys = [c for c in candidates.columns if c != "value"]
    rows = candidates.select("*", F.explode_outer(tokens(F.col("value"))).alias("token")).withColumn("word", F.lower("token"))
    rows = rows.join(words.withColumn("_seen", F.lit(True)), ["doc_id", "word"], "left")
    capitals = F.col("value") == F.upper("value")
    ordinary = _ordinary(F.when(capitals, F.initcap("token")).otherwise(F.col("token")), F.coalesce("_seen", F.lit(False)))
    return rows.groupBy(*keys, "value").agg(F.bool_and(ordinary).alias("is_vocabulary"))


def drop_vocabulary_names(units: DataFrame) -> DataFrame:
    """Without recognised names whose words are all ordinary words of the document or of the language."""
    named = units.select("doc_id", "unit_id", "text", F.explode(F.filter("spans", lambda s: (s["source"] == C.NER) & s["entity_type"].isin(*NAMES))).alias("s"))
    named = named.select("doc_id", "unit_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), value_of(F.col("text"), F.col("s")).alias("value"))
    drop = vocabulary_spans(named, vocabulary(units, named)).where("is_vocabulary").groupBy("doc_id", "unit_id").agg(F.collect_set(F.struct("start", "end")).alias("_drop"))
    out = units.join(drop, ["doc_id", "unit_id"], "left")
    gone = lambda s: F.coalesce(F.array_contains("_drop", F.struct(s["start"].alias("start"), s["end"].alias("end"))), F.lit(False)) & (s["source"] == C.NER)
    return out.withColumn("spans", F.filter("spans", lambda s: ~gone(s))).drop("_drop")


#: Lines that hold something else.
_LABEL_LINE = r"(?i)\b(?:tel(?:ephone)?|phone|fax|e-?mail|website|contact\s+persons?|cin|(?:firm|sebi)\s+registration|peer\s+review)\b"
_STATE_ONLY = r"^\s*\(?[A-Z][a-z]+(?:\s[A-Z][a-z]+)?\)?,?\s*India\.?\s*$"


def address_fragment(text: Column) -> Column:
    """Where the address part of a line begins (null: the line isn't part of an address)."""
    after = F.greatest(F.length(F.regexp_extract(text, r"^(.*:\s)", 1)), F.length(F.regexp_extract(text, r"(?i)^(.*\b(?:Limited|LLP|Bank)\b,?\s*)", 1)))
    part = F.substring(text, after + 1, F.length(text))
    plain = F.size(F.regexp_extract_all(part, F.lit(r"\b[a-z]{4,}\b"), F.lit(0)))
    ok = (F.length(text) <= 220) & ~text.rlike(_LABEL_LINE) & (F.btrim(part) != "") & (plain <= 3) & part.rlike(ADDRESS_CUE)
    lead = after + F.length(part) - F.length(F.ltrim(part))
    return F.when(ok, lead)


def extend_address_blocks(units: DataFrame) -> DataFrame:
    """Up to three lines before an address that begins its unit, and a "State, India" line after one that ends its unit."""
    w = _order()
    is_address = lambda s: s["entity_type"] == "ADDRESS"
    found = F.filter("spans", is_address)
    first = F.array_min(F.transform(found, lambda s: s["start"]))
    last = F.array_max(F.transform(found, lambda s: s["end"]))
    near = F.max(F.size(found)).over(w.rowsBetween(-1, 3)) > 0
    rows = units.withColumn("_heads", F.coalesce(F.btrim(F.substring(F.col("text"), F.lit(1), first)) == "", F.lit(False))).withColumn("_ends", F.coalesce(F.btrim(F.substring(F.col("text"), last + 1, F.length("text"))) == "", F.lit(False)))
    rows = rows.withColumn("_near", near).withColumn("_from", F.when(F.col("_near"), address_fragment(F.when(F.col("_near"), F.col("text")))))

    def joined(k: int) -> Column:
        """Whether the unit k after this one begins with an address that reaches back to this one."""
        out = F.lead("_heads", k).over(w) & (F.lead("container_id", k).over(w).eqNullSafe(F.col("container_id")))
        for between in range(1, k):
            out = out & (F.lead("_from", between).over(w) == 0) & F.lead("container_id", between).over(w).eqNullSafe(F.col("container_id"))
        return F.coalesce(out, F.lit(False))

    rows = rows.withColumn("_part", (joined(1) | joined(2) | joined(3)) & F.col("_from").isNotNull())
    after = F.coalesce(F.lag("_ends").over(w) & F.lag("container_id").over(w).eqNullSafe(F.col("container_id")), F.lit(False)) & F.col("text").rlike(_STATE_ONLY)
    rows = rows.withColumn("_after", after)
    end = F.length(F.rtrim("text"))
    block = lambda start: F.array(span(start, end, "ADDRESS", 0.7, C.ADDRESS_BLOCK))
    lead = F.length("text") - F.length(F.ltrim("text"))
    extra = F.concat(F.when(F.col("_part"), block(F.col("_from"))).otherwise(no_spans()), F.when(F.col("_after"), block(lead)).otherwise(no_spans()))
    spans = F.when(F.col("_part") | F.col("_after"), resolve_overlaps(F.concat("spans", extra))).otherwise(F.col("spans"))
    return rows.withColumn("spans", spans).drop("_heads", "_ends", "_near", "_from", "_part", "_after")


def drop_public_body_addresses(units: DataFrame) -> DataFrame:
    """Addresses in the unit after one that is a public body and nothing else stay readable."""
    previous = F.lower(F.btrim(squeezed(F.lag("text").over(_order())), F.lit(" ,:;")))
    keep = F.filter("spans", lambda s: s["entity_type"] != "ADDRESS")
    return units.withColumn("_public", F.coalesce(previous.isin(*sorted(C.PUBLIC_BODIES)), F.lit(False))).withColumn("spans", F.when(F.col("_public"), keep).otherwise(F.col("spans"))).drop("_public")


def known_names(units: DataFrame) -> DataFrame:
    """doc_id, key (lower case, single blanks), entity_type: names of two words or more; the first type seen counts."""
    rows = units.select("doc_id", "unit_id", "text", F.explode("spans").alias("s")).where(F.col("s.entity_type").isin(*NAMES))
    value = squeezed(value_of(F.col("text"), F.col("s")))
    rows = rows.select("doc_id", "unit_id", F.col("s.start").alias("start"), F.col("s.entity_type").alias("entity_type"), F.lower(value).alias("key"))
    rows = rows.where((F.size(F.split("key", " ")) >= 2) & (F.length("key") >= 6) & ~is_title(F.col("key")) & ~F.col("key").isin(*sorted(C.PUBLIC_BODIES)))
    return rows.groupBy("doc_id", "key").agg(F.min_by("entity_type", F.struct("unit_id", "start")).alias("entity_type"))


#: Words and the single marks between them: what texts and names are cut into alike.
PIECE = r"(?U)\w+|[^\w\s]"


def pieces_of(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def pattern_of(key: Column) -> Column:
    """A pattern for a key's pieces one after the other, whatever blanks are between them; words are whole ones."""
    quoted = lambda p: F.when(F.rlike(p, F.lit(r"(?U)^\w")), F.concat(F.lit(r"\b"), p, F.lit(r"\b"))).otherwise(F.concat(F.lit("\\"), p))
    return F.array_join(F.transform(pieces_of(key), quoted), r"\s*")


def candidates(texts: DataFrame, keys: DataFrame, by: list[str], extra: list[str]) -> DataFrame:
    """``by`` columns of texts and _keys, the keys (doc_id, key, extra) whose first piece a text has. Narrow on both sides:
    a text is here the set of its pieces, and the text itself doesn't move."""
    first = F.get(pieces_of("key"), F.lit(0))
    words = texts.select(*by, F.explode(F.array_distinct(F.transform(pieces_of("text"), F.lower))).alias("_first"))
    return words.join(keys.select("doc_id", "key", *extra, first.alias("_first")), ["doc_id", "_first"]).groupBy(*by).agg(F.collect_set(F.struct("key", *extra)).alias("_keys"))


def mentions(units: DataFrame, keys: DataFrame, extra: list[str], guard_links: bool = False) -> DataFrame:
    """doc_id, unit_id, start, end, key and the ``extra`` columns of keys: where a key's pieces follow each other in a text.

    Leftmost first, of those the longest; none within another; not where the text is all lower case; bounded by what
    isn't a word character (with ``guard_links`` nor part of a mail or site address). A unit's text moves once, to meet
    the keys that may be in it, and is searched for all of them at once.
    """
    found = candidates(units, keys, ["doc_id", "unit_id"], extra)
    rows = units.select("doc_id", "unit_id", "text").join(found, ["doc_id", "unit_id"])
    left, right = (r"(?<![\w@./-])", r"(?![\w@-]|\.\w)") if guard_links else (r"(?<!\w)", r"(?!\w)")
    longest = F.transform(F.array_sort(F.transform("_keys", lambda k: F.struct((-F.length(k["key"])).alias("n"), k["key"].alias("key")))), lambda k: pattern_of(k["key"]))
    pattern = F.concat(F.lit(f"(?iuU){left}(?:"), F.array_join(F.array_distinct(longest), "|"), F.lit(f"){right}"))
    hit = rows.withColumn("_p", pattern).select("doc_id", "unit_id", "_keys", F.explode(matches(F.col("text"), F.col("_p"))).alias("m"))
    key = F.lower(squeezed(F.col("m.value")))
    hit = hit.where(F.col("m.value") != F.lower("m.value")).select("doc_id", "unit_id", "m", F.get(F.filter("_keys", lambda k: k["key"] == key), F.lit(0)).alias("k")).where("k is not null")
    return hit.select("doc_id", "unit_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("k.key").alias("key"), *(F.col(f"k.{x}").alias(x) for x in extra))


def _attach(units: DataFrame, rows: DataFrame, struct: Column) -> DataFrame:
    found = rows.groupBy("doc_id", "unit_id").agg(F.collect_list(struct).alias("_extra"))
    return units.join(found, ["doc_id", "unit_id"], "left").withColumn("_extra", F.coalesce("_extra", no_spans()))


def by_start(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("k"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def propagate_known(units: DataFrame, known: DataFrame) -> DataFrame:
    """All other mentions of known names; a longer mention replaces shorter names within it, nothing else."""
    rows = mentions(units, known, ["entity_type"])
    out = _attach(units, rows, span(F.col("start"), F.col("end"), F.col("entity_type"), 0.8, C.PROPAGATED))

    def fits(m: Column) -> Column:
        inside = lambda o: o["entity_type"].isin(*NAMES) & (m["start"] <= o["start"]) & (o["end"] <= m["end"]) & (o["end"] - o["start"] < m["end"] - m["start"])
        return F.forall("spans", lambda o: ~overlaps(o, m) | inside(o))

    out = out.withColumn("_extra", F.filter("_extra", fits))
    return out.withColumn("spans", F.when(F.size("_extra") > 0, resolve_overlaps(F.concat("spans", "_extra"))).otherwise(F.col("spans"))).drop("_extra")


def short_forms(units: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, key, full: what companies found by their legal ending are called for short; the first full name counts."""
    rows = units.select("doc_id", "unit_id", "text", F.explode(F.filter("spans", lambda s: s["source"] == C.ORG_RULE)).alias("s"))
    rows = rows.select("doc_id", "unit_id", F.col("s.start").alias("start"), squeezed(value_of(F.col("text"), F.col("s"))).alias("full")).withColumn("bare", strip_org_suffix(F.col("full")))
    low = F.split(F.lower("bare"), " ")
    generic = _literals(C.GENERIC | C.ORG_WORDS | {"&", "of", "and"})
    bare = rows.where((F.size(low) >= 2) & ~F.lower("bare").isin(*sorted(C.PUBLIC_BODIES)) & ~F.forall(low, lambda t: F.array_contains(generic, t)))
    first = rows.withColumn("word", F.element_at(F.split("full", " "), 1)).withColumn("key", F.lower("word"))
    long_enough = F.length("word") >= F.when(F.col("word") == F.upper("word"), 3).otherwise(4)
    lists = C.NAME_WORDS | C.TITLE_HEADS | C.PUBLIC_BODIES | C.GENERIC
    first = first.where(long_enough & F.col("word").rlike(r"^[A-Za-z][A-Za-z-]*$") & (F.col("word") != F.col("key")) & ~F.col("key").isin(*sorted(lists)) & ~F.arrays_overlap(stems(F.col("key")), _literals(C.DICTIONARY)))
    people = known.where("entity_type = 'PERSON'").select("doc_id", F.explode(F.split("key", " ")).alias("key")).distinct()
    first = first.join(people, ["doc_id", "key"], "left_anti").join(vocabulary(units, first).withColumnRenamed("word", "key"), ["doc_id", "key"], "left_anti")
    both = bare.select("doc_id", F.lower("bare").alias("key"), "full", "unit_id", "start").unionByName(first.select("doc_id", "key", "full", "unit_id", "start"))
    return both.groupBy("doc_id", "key").agg(F.min_by("full", F.struct("unit_id", "start")).alias("full"))


def propagate_short_forms(units: DataFrame, short: DataFrame) -> DataFrame:
    """Mentions of short forms that overlap no span, as spans that stand for the full name."""
    rows = mentions(units, short, ["full"], guard_links=True)
    out = _attach(units, rows, span(F.col("start"), F.col("end"), "ORGANIZATION", 0.7, C.SHORT_FORM, F.col("full")))
    out = out.withColumn("_extra", F.filter("_extra", lambda m: ~F.exists("spans", lambda o: overlaps(o, m))))
    return out.withColumn("spans", F.when(F.size("_extra") > 0, by_start(F.concat("spans", "_extra"))).otherwise(F.col("spans"))).drop("_extra")


def join_split_names(units: DataFrame, known: DataFrame) -> DataFrame:
    """A known name that begins in one unit and ends in the next: the name's span, and a continuation to be blanked."""
    w = _order()
    pairs = units.withColumn("_next", F.lead("text").over(w)).withColumn("_same", F.lead("container_id").over(w).eqNullSafe(F.col("container_id"))).where(F.col("_same") & F.col("_next").isNotNull())
    pairs = pairs.withColumn("_skip", F.greatest(F.length("text") - TAIL, F.lit(0))).withColumn("_cut", F.length("text") - F.col("_skip"))
    joined = pairs.select("doc_id", "unit_id", F.concat(F.right("text", F.lit(TAIL)), F.lit(" "), F.substring("_next", 1, TAIL)).alias("text"))
    rows = mentions(joined, known, ["entity_type"]).join(pairs.select("doc_id", "unit_id", "_skip", "_cut", F.length(F.rtrim("text")).alias("_end"), (F.length("_next") - F.length(F.ltrim("_next"))).alias("_lead")), ["doc_id", "unit_id"])
    rows = rows.where((F.col("start") < F.col("_cut")) & (F.col("end") > F.col("_cut") + 1))
    rows = rows.withColumn("a", F.col("_skip") + F.col("start")).withColumn("b", F.col("end") - F.col("_cut") - 1).where((F.col("a") < F.col("_end")) & (F.col("_lead") < F.col("b")))
    one = rows.select("doc_id", "unit_id", span(F.col("a"), F.col("_end"), F.col("entity_type"), 0.8, C.PROPAGATED, F.col("key")).alias("s"))
    two = rows.select("doc_id", (F.col("unit_id") + 1).cast(units.schema["unit_id"].dataType).alias("unit_id"), span(F.col("_lead"), F.col("b"), F.col("entity_type"), 0.8, C.CONTINUATION).alias("s"))
    out = _attach(units, one.union(two), F.col("s"))
    kept = F.filter("spans", lambda s: ~F.exists("_extra", lambda o: overlaps(o, s)))
    return out.withColumn("spans", F.when(F.size("_extra") > 0, by_start(F.concat(kept, "_extra"))).otherwise(F.col("spans"))).drop("_extra")


def run(units: DataFrame, stage=lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """All passes in order; returns the units and the known names. ``stage`` may write intermediate results (df, name)."""
    units = stage(drop_public_body_addresses(extend_address_blocks(drop_vocabulary_names(units))), "addresses")
    known = stage(known_names(units), "known")
    units = stage(propagate_known(units, known), "known_names")
    units = stage(propagate_short_forms(units, stage(short_forms(units, known), "short")), "short_forms")
    return join_split_names(units, known), known


__all__ = ["run", "mentions", "known_names", "short_forms", "vocabulary", "vocabulary_spans", "let"]
