"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Folding: accents go, look-alike letters of other scripts and digits that stand for letters become
the letter they imitate (l, 1 and | count as i), zero-width marks go, all else between words
becomes one space character. Lexicon and text are folded alike, so that a disguised word meets its
entry. An entry is a whole word or a stem (a word's beginning); hits inside an exception phrase
don't count.

Training: from a sample of at most ``sample_rows`` labelled documents. One pass counts, per task
before the shuffle, in how many toxic and clean documents each word and stem occurs; what is
significantly toxic becomes a candidate. A second pass over the sample lists each document's
candidates with their share of its words, and the lexicon, of what takes a far larger share in toxic
texts than in clean ones (long clean texts may hold it once by chance), takes the most significant one, sets aside the documents that hold it,
and repeats, so that the words around a toxic word (in its copies, say) don't get in; then all that
stay significant when documents that begin and end alike count once. A third pass finds the
exceptions: whole words that a stem hits, and pairs of neighbouring words of which one is hit, that
are no more common in toxic documents than in clean ones and significantly cleaner than the entry's
other documents (phrases of the caller's own may be added). The score is a logistic of the weighted
hits and of the weighted hits per word, fitted on the sample.

Scoring is a map-only pass over whole texts.

Defined cases: null and empty texts have no hits and get the score of a text without hits; without
labels of both classes the lexicon is empty and the score is the share of toxic labels (0 if there
are none); ids are never an input; rows that repeat are scored each.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import accumulate
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestegg.llm.common import fresh, ship, text_pieces, with_text_columns

SAMPLE_ROWS = 12000
STEM_SIZES = (4, 5, 6)
MIN_DOCS = 4
MIN_ODDS = 2.5  # of an entry: its mean share of the words is 12 times as large in toxic documents (log)
FEATURES_AT_ONCE = 150_000

# Letters of other scripts, and digits and signs, with the Latin letter they imitate.
LOOK_ALIKES = dict(zip("авекмнорстухіјѕһԁԛԝαβγεηικνορτυχωϲ", "abekmhopctyxijshdqwabyeniknoptuxwc"))
DIGITS = dict(zip("01345789l|", "oieastbgii"))
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e", "£": "l"}
#: A sign stands for a letter only in front of a letter or digit.
SIGN = re.compile(r"[@$!|€£](?=[^\W_])")


class FoldTable(dict):
    """Character to folded character, worked out once for each character that occurs."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if unicodedata.category(char) in ("Mn", "Me", "Cf"):
            out = ""
        else:
            base = unicodedata.normalize("NFKD", char).lower()
            base = "".join(LOOK_ALIKES.get(c, c) for c in base if not unicodedata.combining(c))
            out = "".join(DIGITS.get(c, c) for c in base if c.isalnum() or c == "|") or " "
        self[code] = out
        return out


def fold(text: str | None, table: FoldTable) -> str:
    """The folded words, each with a space on both sides."""
    if not text:
        return " "
    text = SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(table).split())} "


def features(folded: str) -> set[str]:
    """Whole words (a space on both sides) and stems (a space in front)."""
    words = set(folded.split())
    return {f" {w} " for w in words if 2 < len(w) <= 40} | {f" {w[:k]}" for w in words for k in STEM_SIZES if len(w) > k}


def shares(folded: str, wanted: set[str]) -> dict[str, float]:
    """The wanted features with their share of the words."""
    words = Counter(folded.split())
    counts: Counter[str] = Counter()
    for word, n in words.items():
        for f in features(word) & wanted:
            counts[f] += n
    return {f: n / words.total() for f, n in sorted(counts.items())}


class Lexicon(NamedTuple):
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: tuple[float, float, float]


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.table, self.lexicon = FoldTable(), lexicon
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in lexicon.exceptions:
            entry = fold(phrase, self.table)
            self.automaton.add_word(entry, (len(entry), 0.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> tuple[float, int]:
        """(weight of the hits outside exception phrases, number of words). A word counts once."""
        folded = fold(text, self.table)
        n_words = folded.count(" ") - 1
        if not len(self.automaton):
            return 0.0, n_words
        found: dict[int, float] = {}
        excepted = []
        for end, (size, weight) in self.automaton.iter(folded):
            start = end - size + 1
            if weight:
                found[start] = max(weight, found.get(start, 0.0))
            else:
                excepted.append((start, end))
        # In an exception: of those that begin at or before the hit, the one that reaches farthest ends behind it.
        excepted.sort()
        begins, reach = [a for a, _ in excepted], [-1, *accumulate((b for _, b in excepted), max)]
        total = sum(w for at, w in found.items() if reach[bisect_right(begins, at)] <= at)
        return total, n_words

    def inputs(self, text: str | None) -> tuple[float, float, float]:
        total, n_words = self.hits(text)
        return 1.0, math.log1p(total), math.log1p(100 * total / max(1, n_words))


def significance(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of a of n1 against b of n0; 0 where the share in n1 isn't the larger."""
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / np.maximum(e, 1e-12)), 0.0)
    p = (a + b) / (n1 + n0)
    llr = 2 * (part(a, p * n1) + part(b, p * n0) + part(n1 - a, (1 - p) * n1) + part(n0 - b, (1 - p) * n0))
    return np.where(a * n0 > b * n1, llr, 0.0)


def counted_features(sample: DataFrame, text_col: str) -> DataFrame:
    """feature, n1, n0: documents of either class that hold it, summed in each task before the shuffle."""

    def run(batches):
        table, counts = FoldTable(), Counter()
        out = lambda: pa.RecordBatch.from_pydict({"feature": [k for k, _ in counts], "label": [x for _, x in counts], "n": list(counts.values())})
        for piece in text_pieces(batches, text_col):
            for text, label in zip(piece.column(text_col).to_pylist(), piece.column("label").to_pylist()):
                counts.update((f, label) for f in features(fold(text, table)))
                if len(counts) > FEATURES_AT_ONCE:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    partial = sample.select(text_col, F.col("label").cast("long").alias("label")).mapInArrow(run, "feature string, label long, n long")
    return partial.groupBy("feature").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n1"),
                                          F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n0"))


def chosen_entries(held: list[dict[str, float]], labels: np.ndarray, ends: list[str], n_words: list[int], threshold: float) -> dict[str, float]:
    """Entries with the logarithm of how many times their mean share of the words is larger in toxic texts.

    First the most significant candidate, then the most significant in the documents without it,
    and so on. Then all others that are as significant when documents that begin and end alike
    (copies) count once.
    """
    lists: dict[str, list[int]] = defaultdict(list)
    for i, h in enumerate(held):
        for f in h:
            lists[f].append(i)
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    # What is in no text of a class counts as half a word in a text of the usual length.
    least = 0.5 / max(1.0, float(np.median(n_words)))

    def odds(f: str, rows: list[int]) -> float:
        toxic = math.fsum(held[i][f] for i in rows if labels[i] == 1)
        clean = math.fsum(held[i][f] for i in rows if labels[i] == 0)
        return math.log((toxic + least) / (n1 + 1)) - math.log((clean + least) / (n0 + 1))

    weights = {f: odds(f, rows) for f, rows in lists.items()}
    # Of equally significant entries the longest comes first: the whole word, not its beginning.
    names = sorted((f for f in lists if weights[f] >= MIN_ODDS), key=lambda f: (-len(f), f))
    out: dict[str, float] = {}
    left, rest = np.ones(len(held), bool), names
    while rest and left.any():
        rows = [[i for i in lists[f] if left[i]] for f in rest]
        a = np.array([sum(labels[i] == 1 for i in r) for r in rows], float)
        b = np.array([len(r) for r in rows], float) - a
        llr = significance(a, b, int((labels[left] == 1).sum()), int((labels[left] == 0).sum()))
        best = int(np.argmax(llr))
        if llr[best] < threshold or a[best] < MIN_DOCS:
            break
        out[rest[best]] = weights[rest[best]]
        left[rows[best]] = False
        rest = [f for f, x, y in zip(rest, llr, a) if x >= threshold / 2 and y >= MIN_DOCS and f not in out]
    alike = [len({e for e, y in zip(ends, labels) if y == k}) for k in (0, 1)]
    for f in names:
        a, b = (len({ends[i] for i in lists[f] if labels[i] == k}) for k in (1, 0))
        known = any(f.startswith(g) or g.startswith(f) and len(lists[f]) <= 1.05 * len(lists[g]) for g in out)
        if a >= MIN_DOCS and not known and significance(np.array([a]), np.array([b]), alike[1], alike[0])[0] >= threshold:
            out[f] = weights[f]
    return out


def learned_exceptions(sample: DataFrame, weights: dict[str, float], text_col: str, threshold: float) -> list[str]:
    """Words and pairs of words around hits that the labels show to be harmless."""

    def run(batches):
        folding, known, counts = FoldTable(), shipped(), Counter()
        out = lambda: pa.RecordBatch.from_pydict({"entry": [k[0] for k in counts], "phrase": [k[1] for k in counts], "label": [k[2] for k in counts], "n": list(counts.values())})
        for piece in text_pieces(batches, text_col):
            for text, label in zip(piece.column(text_col).to_pylist(), piece.column("label").to_pylist()):
                words = fold(text, folding).split()
                hit = {w: features(w) & known for w in set(words)}
                found = set()
                for i, word in enumerate(words):
                    for entry in hit[word]:
                        found.add((entry, "", label))
                        phrases = [] if entry == f" {word} " else [word]
                        phrases += [" ".join(words[k:k + 2]) for k in (i - 1, i) if 0 <= k < len(words) - 1]
                        found.update((entry, phrase, label) for phrase in phrases)
                counts.update(found)
                if len(counts) > FEATURES_AT_ONCE:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    shipped = ship(sample.sparkSession, set(weights))
    partial = sample.select(text_col, F.col("label").cast("long").alias("label")).mapInArrow(run, "entry string, phrase string, label long, n long")
    counts = partial.groupBy("entry", "phrase").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"),
                                                    F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    classes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    clean = counts.filter((F.col("phrase") == "") | (F.col("b") >= MIN_DOCS) & (F.col("a") * classes[0] <= F.col("b") * classes[1]))
    rows = clean.toPandas()
    of = {r.entry: (r.a, r.b) for r in rows.itertuples() if not r.phrase}
    out = set()
    for r in rows[rows.phrase != ""].itertuples():
        a, b = of[r.entry]
        # Among the entry's documents: is the phrase's share in clean ones larger than in toxic ones?
        if a and b and significance(np.array([r.b]), np.array([r.a]), b, a)[0] >= threshold:
            out.add(r.phrase)
    return sorted(out)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_lexicon(sample: DataFrame, text_col: str = "text", exceptions: tuple[str, ...] = ()) -> Lexicon:
    """``sample``: a bounded table of texts with ``label`` 0 or 1; ``exceptions``: known phrases, beside those learned."""
    classes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n1, n0 = classes.get(1, 0), classes.get(0, 0)
    if not n1 or not n0:
        return Lexicon({}, exceptions, (30.0 if n1 else -30.0, 0.0, 0.0))
    counts = counted_features(sample, text_col).filter(F.col("n1") >= MIN_DOCS)
    counts = counts.filter(F.col("n1") * n0 > 2 * F.col("n0") * n1)
    table = counts.toPandas()
    threshold = 2 * math.log(len(table) + 1000) + 4
    llr = significance(table.n1.to_numpy(float), table.n0.to_numpy(float), n1, n0)
    candidates = set(table.feature[llr >= threshold / 2])

    def run(batches):
        folding, wanted = FoldTable(), shipped()
        for piece in text_pieces(batches, text_col):
            folded = [fold(t, folding) for t in piece.column(text_col).to_pylist()]
            held = [shares(f, wanted) for f in folded]
            ends = [" ".join([*w[:5], *w[-5:]]) for w in map(str.split, folded)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([list(h) for h in held], pa.list_(pa.string())), pa.array([list(h.values()) for h in held], pa.list_(pa.float64())),
                 pa.array(ends, pa.string()), pa.array([f.count(" ") - 1 for f in folded], pa.int64()), piece.column("label").cast(pa.int64())],
                names=["held", "share", "ends", "n_words", "label"])

    shipped = ship(sample.sparkSession, candidates)
    rows = sample.select(text_col, F.col("label").cast("long").alias("label")).mapInArrow(run, "held array<string>, share array<double>, ends string, n_words long, label long").collect()
    weights = chosen_entries([dict(zip(r.held, r.share)) for r in rows], np.array([r.label for r in rows]), [r.ends for r in rows],
                             [r.n_words for r in rows], threshold)
    harmless = learned_exceptions(sample, weights, text_col, threshold) if weights else []
    lexicon = Lexicon(weights, tuple(dict.fromkeys([*exceptions, *harmless])), (0.0, 0.0, 0.0))
    ready = ship(sample.sparkSession, lexicon)

    def measure(batches):
        matcher = Matcher(ready())
        for piece in text_pieces(batches, text_col):
            x = [matcher.inputs(t) for t in piece.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), piece.column("label").cast(pa.int64())], names=["x", "label"])

    rows = sample.select(text_col, F.col("label").cast("long").alias("label")).mapInArrow(measure, "x array<double>, label long").collect()
    w = fitted(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float))
    return lexicon._replace(coefficients=tuple(map(float, w)))


def with_toxicity(docs: DataFrame, lexicon: Lexicon, out: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the toxicity score, from 0 to 1."""
    shipped = ship(docs.sparkSession, lexicon)

    def compute(texts: pa.Array, ready: list[Matcher] = []) -> list[pa.Array]:  # noqa: B006  one matcher a task
        if not ready:
            ready.append(Matcher(shipped()))
        x = np.array([ready[0].inputs(t) for t in texts.to_pylist()]).reshape(-1, 3)
        return [pa.array(1 / (1 + np.exp(-np.clip(x @ np.array(lexicon.coefficients), -30, 30))))]

    return with_text_columns(docs, text_col, [T.StructField(fresh(docs, out), T.DoubleType())], compute)
