"""Quality rules: learned decision lists over text statistics, in DataFrame functions only.

``statistics`` gives word, symbol, line and repetition counts of each whole text as column expressions.
``learn`` runs sequential covering over labelled statistics: a rule grows by the threshold that gains most (FOIL's
gain) on two thirds of the rows until it covers no row of label 1, is pruned from its end on the other third, and is
kept if it is precise enough there; the rows it covers are then set aside and the next rule grows. ``as_column`` turns
the list into one ordered conditional expression: the first rule that holds rejects; no rule keeps.

Scale: statistics are computed within each row, so there is no shuffle of texts. The one shuffle is the join of
statistics (a dozen numbers a row) with the labels. The learner runs on the driver on at most ``max_rows`` labelled
documents, those with the smallest digests of their id: a documented bound, taken after the join, alike at every size
and whatever other ids the labels have.

Defined cases: a null or empty text has no words: all counts are 0. A null label is no label; of several labels of an id
the least counts, and of several texts of an id the one with the least statistics is learnt from. Labels without a
document change nothing. Repeated rows and equal ids each give a row. Without labels of both kinds the list is empty and keeps all. Words are runs of characters other
than blank and the five ASCII white space controls.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, saved

#: ASCII white space that parts words, and characters that count as symbols. Fixed values.
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MAX_ROWS = 20_000


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row: a lambda's variable is never computed again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _repeated(words: Column) -> Column:
    """Words that are in a three-word window that occurs twice or more.

    Windows are compared by 64-bit hashes within one text: two different windows of a text of a million words
    meet with a chance of about 3e-8.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def starts(h: Column) -> Column:
        """Where repeated windows start, ascending: equal neighbours of the sorted (hash, start) pairs."""
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s: F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        pick = lambda s: let(same(s), lambda e: F.transform(s, lambda x, k: F.when(F.get(e, k) | F.coalesce(F.get(e, k - 1), F.lit(False)), x["i"])))
        return F.array_sort(F.filter(let(pairs, pick), lambda x: x.isNotNull()))

    covered = lambda s: F.aggregate(F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda x, y: x + y)
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(starts(h), covered)))
    return F.when(n < 4, F.lit(0)).otherwise(counted)


def statistics(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id and counts (long) of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_chars,
    n_upper, n_digits, n_marks (sentence marks), n_bars, n_bangs, n_lines, n_distinct_words."""
    rows = narrow(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    split = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    from_words = let(split, lambda w: F.struct(F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).alias("n_distinct_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    from_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    n_chars = F.length(text)
    counts = {
        "word_chars": _without(text, BLANKS),
        "n_symbols": n_chars - _without(text, SYMBOLS),
        "n_chars": n_chars,
        "n_upper": n_chars - F.length(F.regexp_replace(text, "\\p{Lu}+", "")),
        "n_digits": n_chars - _without(text, "0123456789"),
        "n_marks": n_chars - _without(text, ".?,;:"),
        "n_bars": n_chars - _without(text, "|"),
        "n_bangs": n_chars - _without(text, "!"),
    }
    made = rows.select("doc_id", from_words.alias("w"), from_lines.alias("l"), *(x.alias(k) for k, x in counts.items()))
    out = made.select("doc_id", "w.*", "l.*", *counts)
    return out.select("doc_id", *(F.col(x).cast("long").alias(x) for x in out.columns if x != "doc_id"))


def ratios() -> dict[str, Column]:
    """What thresholds are put on, from the columns of ``statistics``."""
    words, chars, lines = (F.greatest(F.col(x), F.lit(1)).cast("double") for x in ("n_words", "word_chars", "n_lines"))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "duplicate_lines": F.col("n_dup_lines") / lines,
        "repeated_words": F.col("n_repeat_words") / words,
        "distinct_words": F.col("n_distinct_words") / words,
        "upper_share": F.col("n_upper") / chars,
        "digit_share": F.col("n_digits") / chars,
        "marks_per_word": F.col("n_marks") / words,
        "bars_per_word": F.col("n_bars") / words,
        "bangs_per_word": F.col("n_bangs") / words,
        "words_per_line": words / lines,
    }


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    value: float

    def holds(self, row: dict) -> bool:
        return row[self.name] > self.value if self.above else row[self.name] <= self.value

    def column(self, by_name: dict[str, Column]) -> Column:
        return by_name[self.name] > F.lit(self.value) if self.above else by_name[self.name] <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.value:g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, row: dict) -> bool:
    return all(c.holds(row) for c in rule)


def _best(table: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[Condition | None, float]:
    """The condition of most gain over all thresholds that lie halfway between two values that occur."""
    base = math.log2(bad.sum() / len(bad))
    best, gain = None, 1e-9
    for k, name in enumerate(names):
        order = np.argsort(table[:, k], kind="stable")
        values, below = table[order, k], np.cumsum(bad[order])
        cuts = np.flatnonzero(values[1:] > values[:-1])
        if not len(cuts):
            continue
        for above in (True, False):
            p = (below[-1] - below[cuts] if above else below[cuts]).astype(float)
            of = len(bad) - 1 - cuts if above else cuts + 1
            worth = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / of) - base), 0.0)
            at = int(worth.argmax())
            if worth[at] > gain + 1e-9:
                best, gain = Condition(name, above, float((values[cuts[at]] + values[cuts[at] + 1]) / 2)), worth[at]
    return best, gain


def _grow(table: np.ndarray, bad: np.ndarray, names: list[str], longest: int) -> Rule:
    rule: Rule = ()
    while bad.any() and not bad.all() and len(rule) < longest:
        best, _ = _best(table, bad, names)
        if best is None:
            break
        rule += (best,)
        inside = _covered(rule[-1:], table, names)
        table, bad = table[inside], bad[inside]
    return rule


def _covered(rule: Rule, table: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(table), bool)
    for c in rule:
        values = table[:, names.index(c.name)]
        out &= values > c.value if c.above else values <= c.value
    return out


def _worth(rule: Rule, table: np.ndarray, bad: np.ndarray, names: list[str]) -> float:
    held = bad[_covered(rule, table, names)]
    return (2 * held.sum() - len(held)) / len(held) if len(held) else -1.0


def learn_rules(rows: list[tuple[dict, int]], *, precision: float = 0.95, longest: int = 4, least: int = 2) -> list[Rule]:
    """Rules that cover rows of label 0. rows: statistics and label, in an order that doesn't depend on either.
    Every value that occurs in a row may become a threshold; the list ends when the next rule isn't precise enough."""
    if not rows:
        return []
    names = list(rows[0][0])
    table, bad = np.array([[x[k] for k in names] for x, _ in rows], float), np.array([y == 0 for _, y in rows])
    prune = np.arange(len(rows)) % 3 == 0
    rules: list[Rule] = []
    while (bad & ~prune).any() and (~bad & ~prune).any():
        rule = _grow(table[~prune], bad[~prune], names, longest)
        while len(rule) > 1 and _worth(rule[:-1], table[prune], bad[prune], names) >= _worth(rule, table[prune], bad[prune], names):
            rule = rule[:-1]
        inside = _covered(rule, table, names)
        if not rule or (p := (bad & inside).sum()) < least or p < precision * inside.sum():
            break
        rules.append(rule)
        left = ~(bad & inside)
        table, bad, prune = table[left], bad[left], prune[left]
    return rules


def learn(stats: DataFrame, labels: DataFrame, *, id_col="doc_id", label_col="quality", max_rows: int = MAX_ROWS, **options) -> list[Rule]:
    """Learns from at most ``max_rows`` labelled documents: those whose id has the smallest digest."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    names = list(ratios())
    joined = stats.select("doc_id", *(x.alias(k) for k, x in ratios().items())).join(known, "doc_id")
    digest = F.md5(F.col("doc_id").cast("string").cast("binary"))
    joined = saved(
        joined.groupBy("doc_id").agg(F.min(F.struct(*names)).alias("row"), F.min("label").alias("label"))
        .select("row.*", "label", digest.alias("digest"), F.conv(F.substring(digest, 1, 3), 16, 10).cast("int").alias("part")), "labelled"
    )
    # Counts of ranges of digests tell, exactly, beyond which range no row can be among the first ``max_rows``.
    held, last = 0, -1
    for part, n in sorted(map(tuple, joined.groupBy("part").count().collect())):
        if held >= max_rows:
            break
        held, last = held + n, part
    taken = joined.where(F.col("part") <= last).orderBy("digest", *names).limit(max_rows).collect()
    return learn_rules([({k: r[k] for k in names}, r["label"]) for r in taken], **options)


def as_column(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: false for the first rule that holds, else true."""
    by_name = ratios()
    out = None
    for rule in rules:
        holds = rule[0].column(by_name)
        for c in rule[1:]:
            holds = holds & c.column(by_name)
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_id_col="doc_id", label_col="quality", max_rows: int = MAX_ROWS, **options) -> tuple[DataFrame, list[Rule]]:
    """The statistics with kept_by_rules, and the rules. Statistics are computed once and kept in the shared folder."""
    stats = saved(statistics(docs, id_col=id_col, text_col=text_col), "statistics")
    rules = learn(stats, labels, id_col=label_id_col, label_col=label_col, max_rows=max_rows, **options)
    return stats.withColumn("kept_by_rules", as_column(rules)), rules
