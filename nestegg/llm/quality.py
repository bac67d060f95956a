"""Quality classifier: regularised quadratic discriminant over document statistics.

One map-only pass turns each whole text into ``STATISTICS`` (shares, lengths and rates, on log or
logit scales). The model has a mean and a shrunken covariance for each class,
(1 - g) ((1 - a) own + a pooled) + g diagonal, kept as Cholesky factors; a document's raw score is
the difference of the two Mahalanobis log-densities plus the log prior, and a logistic line fitted
on the sample calibrates it to a probability.

Training: at most ``SAMPLE_ROWS`` labelled documents, taken in the order of a hash of the id. The
statistics of all documents are staged once, and used for fitting and scoring.

Defined cases: null and empty texts have the statistics of an empty text and get a score; with
labels of one class only, the score is that class's (1 or 0); without labels it is 0.5; ids, sources
and languages are never inputs.
"""

from __future__ import annotations

import operator
import string
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestegg.llm.common import as_bytes, fresh, labelled_sample, ship, stage, with_text_columns

SAMPLE_ROWS = 20_000
SHRINK_TO_POOLED, SHRINK_TO_DIAGONAL = 0.1, 0.05
CHARS, WORDS = 60.0, 20.0  # weight of the usual shares, in characters and words
STATISTICS = ("log_words", "word_length", "word_spread", "upper", "digits", "symbols", "marks", "letters", "distinct_words",
              "repeated_words", "lines", "distinct_lines", "line_words", "ends", "short_words", "long_words")
UPPER, DIGITS = string.ascii_uppercase.encode(), string.digits.encode()
MARKS, SYMBOLS = b".,;:?'\"", b"#$%&*!|@<>{}[]()_=+~^/\\-"
LETTERS = string.ascii_letters.encode() + bytes(range(0x80, 0x100))


def log_share(part: float, whole: float, usual: float, prior: float) -> float:
    """Logit of a share, drawn to the usual one by ``prior`` counts, so that short texts don't stand out."""
    return float(np.log((part + prior * usual) / (whole - part + prior * (1 - usual))))


def statistics(text: bytes | None) -> tuple[float, ...]:
    text = text or b""
    words, lines, size = text.split(), [x for x in text.split(b"\n") if x], len(text)
    n = len(words)
    count = lambda chars: size - len(text.translate(None, chars))
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    distinct = len(set(words))
    again = sum(map(operator.eq, words, islice(words, 1, None)))
    chars = lambda part, usual: log_share(part, size, usual, CHARS)
    per_word = lambda part, usual: log_share(part, n, usual, WORDS)
    mean = (lengths.sum() + 5.0 * WORDS) / (n + WORDS)
    spread = (((lengths - mean) ** 2).sum() * bool(n) + 8.0 * WORDS) / (n + WORDS)
    return (
        float(np.log1p(n)), float(np.log(mean)), float(np.log(spread)),
        chars(count(UPPER), 0.03), chars(count(DIGITS), 0.01), chars(count(SYMBOLS), 0.005), chars(count(MARKS), 0.03), chars(count(LETTERS), 0.8),
        float(np.log((distinct + WORDS) / (n + WORDS))) + 0.15 * float(np.log1p(n / WORDS)), per_word(again, 0.01),
        float(np.log1p(len(lines))), float(np.log((len(set(lines)) + 2) / (len(lines) + 2))), float(np.log1p(n / max(1, len(lines)))),
        per_word(min(n, text.count(b". ") + text.count(b".\n") + text.endswith(b".")), 0.08),
        per_word(int((lengths <= 3).sum()) * bool(n), 0.35), per_word(int((lengths >= 14).sum()), 0.02),
    )


def with_statistics(docs: DataFrame, out: str, text_col: str = "text") -> DataFrame:
    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([statistics(t) for t in as_bytes(texts)], pa.list_(pa.float64()))]

    return with_text_columns(docs, text_col, [T.StructField(out, T.ArrayType(T.DoubleType()))], compute)


class Discriminant(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # one row for each class
    factors: np.ndarray  # Cholesky factors of the classes' covariances
    inverses: np.ndarray  # of the factors
    log_prior: float
    line: tuple[float, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = []
        for mean, factor, inverse in zip(self.means, self.factors, self.inverses):
            solved = np.einsum("nj,ij->ni", z - mean, inverse)
            density.append(-0.5 * (solved**2).sum(axis=1) - np.log(np.diag(factor)).sum())
        return density[1] - density[0] + self.log_prior

    def score(self, x: np.ndarray) -> np.ndarray:
        a, b = self.line
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -30, 30)))


def triangular_inverse(factor: np.ndarray) -> np.ndarray:
    """Inverse of a lower triangular matrix, row by row."""
    out = np.eye(len(factor))
    for i, row in enumerate(factor):
        out[i] = (out[i] - (row[:i, None] * out[:i]).sum(axis=0)) / row[i]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a' b, without the threads of a BLAS library: the driver and the workers are processes that fork."""
    return np.einsum("ni,nj->ij", a, b)


def fit(x: np.ndarray, y: np.ndarray) -> Discriminant:
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = (x - centre) / scale
    groups = [z[y == k] for k in (0, 1)]
    means = np.array([g.mean(axis=0) for g in groups])
    own = [products(g - m, g - m) / len(g) for g, m in zip(groups, means)]
    pooled = sum(len(g) * c for g, c in zip(groups, own)) / len(z)
    factors = []
    for c in own:
        c = (1 - SHRINK_TO_POOLED) * c + SHRINK_TO_POOLED * pooled
        c = (1 - SHRINK_TO_DIAGONAL) * c + SHRINK_TO_DIAGONAL * np.diag(np.diag(c))
        factors.append(np.linalg.cholesky(c + 1e-3 * np.eye(len(c))))
    inverses = np.array([triangular_inverse(f) for f in factors])
    model = Discriminant(centre, scale, means, np.array(factors), inverses, float(np.log(len(groups[1]) / len(groups[0]))), (1.0, 0.0))
    # Calibration: a logistic line through the raw scores, the far ones drawn in.
    raw = np.clip(model.raw(x), -50, 50)
    w, design = np.array([0.5, 0.0]), np.stack([raw, np.ones_like(raw)], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip((design * w).sum(axis=1), -30, 30)))
        slope = products(design, (p - y)[:, None])[:, 0]
        step = np.linalg.solve(products(design * (p * (1 - p) + 1e-6)[:, None], design) + 1e-3 * np.eye(2), slope)
        w = w - np.clip(step, -1, 1)
    return model._replace(line=(max(float(w[0]), 1e-3), float(w[1])))


def with_quality(docs: DataFrame, labels: DataFrame, out: str = "score", rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``docs`` without its text, with the score. ``labels``: the rows to learn from."""
    features, out = fresh(docs, "statistics"), fresh(docs, out)
    seen = stage(with_statistics(docs, features, text_col).drop(text_col), "quality")
    sample = labelled_sample(labels, id_col, label_col, rows)
    learn = seen.join(F.broadcast(sample), F.col(id_col) == F.col("sample_id")).select("sample_id", features, "label")
    found = learn.distinct().orderBy("sample_id", features).limit(2 * rows).collect()
    y = np.array([r[2] for r in found])
    if len(set(y.tolist())) < 2:
        return seen.drop(features).withColumn(out, F.lit(float(y[0]) if len(y) else 0.5))
    shipped = ship(docs.sparkSession, fit(np.array([r[1] for r in found]), y))
    schema = T.StructType([f for f in seen.schema.fields if f.name != features] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        model = shipped()
        for batch in batches:
            x = np.asarray(batch.column(features).flatten()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names) if n != features), pa.array(model.score(x))], names=schema.names)

    return seen.mapInArrow(run, schema)
