"""Quality classifier: random Fourier features, ridge regression by normal equations, isotonic calibration.

``features`` computes some twenty statistics of each whole text (never of its label, language, source or id).
``fit`` standardises them, approximates a Gaussian kernel by cosines of random projections, sums the normal
equations on the executors (one partial sum for each of at most SUMS partitions), solves the ridge system on the
driver, then counts raw scores in BINS bins by label and fits a monotone calibration to them (pool adjacent violators).
``score`` applies the model.

Scale: texts are read once; the statistics (20 numbers a row) are kept in the shared folder and serve fitting and
scoring. The driver gets at most SUMS matrices of DIM x DIM and BINS counts, whatever the input's size. All labelled
rows are used.

Defined cases: a null text is the empty text and gets a score too; a null label is no label; an id labelled twice has
the mean of its labels; without any label the score is 0.5 for all; equal ids and repeated rows each give a row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean_after, narrow, saved, text_hash

DIM = 256
SUMS = 32
BINS = 1024
RIDGE = 1e-3
SEED = 20_240

_DIGITS = np.array([48 <= b <= 57 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_HIGH = np.array([b >= 128 for b in range(256)])
_BLANK = np.array([b in b" \t\n\x0b\f\r" for b in range(256)])
_MARK = np.array([b in b".?,;:" for b in range(256)])
_SYMBOL = np.array([b in b"#*$%&<>=_{}[]\\^~@" for b in range(256)])
_CLASSES = np.stack([_DIGITS, _UPPER, _LOWER, _HIGH, _BLANK, _MARK, _SYMBOL]).astype(float)
_INNER = re.compile(rb"[a-z\x80-\xff][A-Z]|[A-Za-z][0-9]|[0-9][A-Za-z]")
NAMES = [
    "log_bytes", "digits", "upper", "lower", "high", "blank", "marks", "symbols", "bangs", "bars", "entropy", "word_length", "word_spread",
    "distinct_words", "top_word", "short_words", "long_words", "repeated_triples", "duplicate_lines", "log_lines", "words_per_line", "ended_lines", "inner_case", "capitals", "pure_words", "log_words",
]


def describe(text: bytes) -> list[float]:
    """The statistics of one text, in the order of NAMES."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if n else np.zeros(256, int)
    shares = (_CLASSES @ counts / max(n, 1)).tolist()
    p = counts[counts > 0] / max(n, 1)
    words = text.split()
    m = max(len(words), 1)
    lengths = np.array([len(x) for x in words] or [0], float)
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    triples = list(zip(words, words[1:], words[2:]))  # noqa: B905
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    return [
        float(np.log1p(n)), *shares, float(counts[33]) / m, float(counts[124]) / m, float(-(p * np.log2(p)).sum()) if n else 0.0, float(lengths.mean()), float(lengths.std()),
        len(seen) / m, max(seen.values(), default=0) / m, float((lengths <= 3).sum()) / m, float((lengths >= 14).sum()) / m, 1 - len(set(triples)) / max(len(triples), 1), 1 - len(set(lines)) / k if lines else 0.0,
        float(np.log1p(len(lines))), len(words) / k, sum(x.rstrip()[-1:] in b".!?" for x in lines) / k, len(_INNER.findall(text)) / m, sum(x[:1].isupper() for x in words) / m, sum(x.isalpha() or not x.isascii() for x in words) / m, float(np.log1p(len(words))),
    ]


def features(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, text_hash (which tells texts of one id apart) and x, the statistics."""
    rows = narrow(docs, id_col, text_col).select("*", text_hash())

    @lean_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                x = [describe(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "text_hash", "x"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash long, x array<double>")


def remainder(column: str) -> Column:
    """crc32 of an id as text, modulo 5."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.concatenate([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.lifted(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.edges, self.levels), 0.0, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(rows: DataFrame, of) -> list[np.ndarray]:
    """Adds up, over all rows, the arrays that ``of`` makes of (x, y): one partial sum a partition."""

    @lean_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                made = of(_matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
                total = made if total is None else [a + b for a, b in zip(total, made, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["sums"])

    total = None
    for r in rows.select("x", "y").coalesce(SUMS).mapInArrow(run, "sums binary").collect():
        made = pickle.loads(r.sums)
        total = made if total is None else [a + b for a, b in zip(total, made, strict=True)]
    return total


def monotone(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Non-decreasing means of each bin by pooling adjacent violators; bins without rows take their neighbours' level."""
    blocks: list[list[float]] = []
    for k in np.flatnonzero(counts):
        blocks.append([float(ones[k]), float(counts[k]), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], a, strict=True)]
    return np.concatenate([np.full(int(n), a / b) for a, b, n in blocks])


def fit(x: DataFrame, labels: DataFrame, *, id_col="doc_id", label_col="quality", train: Column | None = None, dim: int = DIM, ridge: float = RIDGE, seed: int = SEED) -> Model | None:
    """A model from the labelled rows of ``x`` (those for which ``train``, a condition on doc_id, holds)."""
    known = labels.where(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(F.avg(label_col).alias("y"))
    if train is not None:
        known = known.where(train)
    rows = saved(x.join(known, "doc_id").select("x", "y"), "labelled")
    moments = _sums(rows, lambda a, y: [np.array([len(a)]), a.sum(0), (a * a).sum(0)])
    if moments is None:
        return None
    n = moments[0][0]
    mean = moments[1] / n
    scale = np.sqrt(np.maximum(moments[2] / n - mean**2, 0)) + 1e-6
    random = np.random.default_rng(seed)
    width = len(mean)
    model = Model(mean, scale, random.normal(0, 1 / np.sqrt(width), (width, dim)), random.uniform(0, 2 * np.pi, dim), np.zeros(dim + 1), np.array([0.0]), np.array([0.5]))

    def normal(a: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z = model.lifted(a)
        return [z.T @ z, z.T @ y]

    left, right = _sums(rows, normal)
    model.weights = np.linalg.solve(left + ridge * n / dim * np.eye(dim + 1), right)

    def binned(a: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        k = np.clip(((model.raw(a) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return [np.bincount(k, minlength=BINS), np.bincount(k, weights=y, minlength=BINS)]

    counts, ones = _sums(rows, binned)
    model.edges, model.levels = ((np.flatnonzero(counts) + 0.5) / BINS * 2 - 0.5), monotone(counts, ones)
    return model


def score(x: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text_hash and score (0 to 1)."""
    sent = x.sparkSession.sparkContext.broadcast(model)

    @lean_after
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = sent.value
        for batch in batches:
            s = made.score(_matrix(batch.column(2))) if made and batch.num_rows else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], ["doc_id", "text_hash", "score"])

    return x.select("doc_id", "text_hash", "x").mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, text_hash long, score double")


def classify(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_id_col="doc_id", label_col="quality", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text divisible by 5; not learnt from), score, predicted, text_hash."""
    x = saved(features(docs, id_col=id_col, text_col=text_col), "features")
    model = fit(x, labels, id_col=label_id_col, label_col=label_col, train=remainder("doc_id") != 0)
    return score(x, model).select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "text_hash")
