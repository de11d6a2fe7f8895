"""Text expressions: normal forms, letter case, company suffixes, masks, stems and inline marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CAPITAL_ENDINGS, ENDINGS, MORE_ENDINGS, PUBLIC_DOMAINS, TITLE_HEADS, TITLE_MODIFIERS
from .spans import let

def _pattern(ending: str) -> str:
    """An ending however its blanks are written; the dots of abbreviations may lack, those between capitals not."""
    return r"\s+".join(w.replace(".", r"\.") if w.count(".") > 1 else w.replace(".", r"\.?") for w in ending.split())


#: The legal forms that names end with, longest first.
ORG_ENDINGS = "(?:" + "|".join(_pattern(x) for x in sorted((*ENDINGS, *MORE_ENDINGS), key=lambda x: (-len(x), x))) + ")"
_CAPITALS = "|".join(x.replace(".", r"\.") for x in sorted(CAPITAL_ENDINGS))
WORD = r"(?U)[\w][\w'’.&-]*"


def squeezed(value: Column) -> Column:
    return F.btrim(F.regexp_replace(value, r"(?U)\s+", " "))


def normal(value: Column) -> Column:
    """Blanks collapsed, punctuation at the edges gone, lower case."""
    return F.lower(F.regexp_replace(squeezed(value), r"(?U)^[^\w(]+|[^\w).]+$", ""))


def tokens(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(WORD), F.lit(0))


def match_case(original: Column, fake: Column) -> Column:
    """fake in capitals if the original is (more than one letter), in lower case if it is, else as it is."""
    letters = F.regexp_replace(original, r"(?U)[^\p{L}]", "")
    return F.when((F.length(letters) > 1) & (letters == F.upper(letters)), F.upper(fake)).when((letters != "") & (letters == F.lower(letters)), F.lower(fake)).otherwise(fake)


def strip_org_suffix(name: Column) -> Column:
    return F.btrim(F.regexp_replace(name, rf"(?i)(?:[\s,]+{ORG_ENDINGS})+\s*$", ""))


def org_suffix(name: Column) -> Column:
    """The company ending of a name, in title case but for those that are capitals; empty if none."""
    found = F.regexp_extract(squeezed(name), rf"(?i)((?:[\s,]+{ORG_ENDINGS})+)$", 1)
    title = F.transform(F.split(found, " "), lambda w: F.when(F.lower(w).rlike(rf"^(?:{_CAPITALS})[.,]*$"), F.upper(w)).when(F.lower(w) == "of", F.lit("of")).otherwise(F.initcap(w)))
    return F.array_join(title, " ")


def mask(value: Column) -> Column:
    """Each word of over two letters keeps its first and last, shorter ones are starred."""
    out = F.regexp_replace(value, r"(?U)\b\w\w\b", "**")
    out = F.regexp_replace(out, r"(?U)(?<![\w*])\w(?![\w*])", "*")
    return F.regexp_replace(out, r"(?U)(?<=\w)\w(?=\w)", "*")


def stems(word: Column) -> Column:
    """A word and what it may be an ending of: -ing, -ed, -es, -s, -ies, with a lost e or a doubled letter."""
    w = F.lower(word)
    cut = lambda end: F.when(w.endswith(end) & (F.length(w) > len(end) + 2), F.substring(w, F.lit(1), F.length(w) - len(end)))
    base = F.array(w, cut("ing"), cut("ed"), cut("es"), cut("s"), F.when(w.endswith("ies"), F.concat(cut("ies"), F.lit("y"))))
    more = F.transform(base, lambda x: F.concat(x, F.lit("e")))
    single = F.transform(base, lambda x: F.when(F.right(x, F.lit(1)) == F.substring(x, F.length(x) - 1, F.lit(1)), F.substring(x, F.lit(1), F.length(x) - 1)))
    return F.array_distinct(F.filter(F.concat(base, more, single), lambda x: x.isNotNull()))


def is_title(key: Column) -> Column:
    """Whether a phrase, in lower case, is a job title or several: heads, each with any modifiers before it."""
    parts = F.filter(F.split(F.replace(key, F.lit(","), F.lit(" ")), " "), lambda w: w != "")
    known = F.array(*map(F.lit, sorted(TITLE_HEADS | TITLE_MODIFIERS | {"and"})))
    heads = F.array(*map(F.lit, sorted(TITLE_HEADS)))
    return let(parts, lambda p: F.coalesce(F.array_contains(heads, F.get(p, F.size(p) - 1)), F.lit(False)) & F.forall(p, lambda w: F.array_contains(known, w)))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_replace(url, r"\.\s+", "."), r"(?i)^(?:https?://)?(?:www\.)?([^/\s:?#]+)", 1))


def is_public_host(host: Column) -> Column:
    out = F.lit(False)
    for d in PUBLIC_DOMAINS:
        out = out | (host == d) | host.endswith("." + d)
    return out


def parse_marks(text: Column) -> Column:
    """Text with inline marks [[TYPE:value]] as struct<text, entities: array<struct<start,end,type,text>>>."""
    mark = r"\[\[[A-Z_]+:[^\]]*\]\]"
    entity = "array<struct<start:int,end:int,type:string,text:string>>"

    def fold(gaps: Column, marks: Column) -> Column:
        step = lambda acc, x: F.struct(
            F.concat(acc["text"], x["gap"], x["value"]).alias("text"),
            F.concat(acc["entities"], F.array(F.struct((F.length(acc["text"]) + F.length(x["gap"])).alias("start"), (F.length(acc["text"]) + F.length(x["gap"]) + F.length(x["value"])).alias("end"), x["type"].alias("type"), x["value"].alias("text")))).alias("entities"),
        )
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(marks)), marks, lambda g, m: F.struct(g.alias("gap"), F.regexp_extract(m, r"\[\[([A-Z_]+):", 1).alias("type"), F.regexp_extract(m, r":([^\]]*)\]\]", 1).alias("value")))
        done = F.aggregate(pairs, F.struct(F.lit("").alias("text"), F.array().cast(entity).alias("entities")), step)
        return let(done, lambda d: F.struct(F.concat(d["text"], F.element_at(gaps, -1)).alias("text"), d["entities"].alias("entities")))

    return let(F.split(text, mark, -1), lambda g: let(F.regexp_extract_all(text, F.lit(mark), F.lit(0)), lambda m: fold(g, m)))
