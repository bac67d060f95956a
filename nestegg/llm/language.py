"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of variable order, up to ``order`` bytes, with escape
probabilities (method C, with exclusion): a symbol seen after a context has count / (n + d), the
d / (n + d) that is left goes to the symbols not seen there, shared as the next shorter context
does. Statistics are frozen after training, so the code length of a symbol after a context is a
fixed number, and the exact code length of a text is a sum of them. A-Z are lower-cased and digits
are one symbol; each other byte is a symbol of its own, ``SYMBOLS`` in all. The language with the
shortest code wins.

Tables are sparse: a language has, for each length of context, the contexts and following symbols
it was seen with, and what an escape from each context costs. Their size follows the text learned
from, and the order is the same however many languages there are. A piece of text is coded by its
distinct contexts with symbols, each looked up once a language.

Training: the documents of at most ``SAMPLE_DOCS`` ids a language, whatever their length, taken in
the order of a hash of the id. At most ``SAMPLE_CHARS`` characters of each document are learned from;
of a longer one, ``SLICES`` slices of equal length, spread evenly from its start to its end.

Defined cases: a null text, or one without letters, is ``und`` with score 0; rows with a null
language are scored but not learned from; without any learned language all is ``und``; equal code
lengths go to the language that sorts first.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestegg.llm.common import fresh, ship, with_text_columns

SAMPLE_DOCS, SAMPLE_CHARS, SLICES = 300, 20_000, 20
ORDER = 3
MOST_BITS = 40.0
EVIDENCE = 64  # bytes of text that the score's confidence is based on at most
PIECE_BYTES = 1 << 20
LETTER = re.compile(r"[^\W\d_]")


def folded_symbols() -> np.ndarray:
    """The symbol of each byte."""
    folded = np.arange(256)
    folded[65:91] += 32
    folded[48:58] = 48
    return np.unique(folded, return_inverse=True)[1].astype(np.uint32)


SYMBOL = folded_symbols()
SYMBOLS = int(SYMBOL.max()) + 1


class Contexts(NamedTuple):
    """What a language was seen with after the contexts of one length; codes ascend."""

    codes: np.ndarray  # number of the context and symbol
    bits: np.ndarray  # code length of the symbol
    contexts: np.ndarray
    escapes: np.ndarray  # what any other symbol costs beside its code length after the shorter context


def places(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``codes`` stands, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return at, sorted_codes[at] == codes


def code_lengths(tree: list[Contexts], codes: np.ndarray) -> np.ndarray:
    """Bits of each symbol after its context, given as numbers of contexts of the tree's greatest length."""
    bits, todo = np.zeros(len(codes)), np.arange(len(codes))
    for k in range(len(tree) - 1, -1, -1):
        now = codes[todo] % SYMBOLS ** (k + 1)
        at, seen = places(tree[k].codes, now)
        bits[todo[seen]] += tree[k].bits[at[seen]]
        todo, now = todo[~seen], now[~seen] // SYMBOLS
        at, seen = places(tree[k].contexts, now)
        bits[todo[seen]] += tree[k].escapes[at[seen]]
    bits[todo] += np.log2(SYMBOLS)
    return bits


class Models(NamedTuple):
    languages: list[str]
    order: int
    trees: list[list[Contexts]]  # of each language: its contexts by length

    def code_lengths(self, language: int, codes: np.ndarray) -> np.ndarray:
        return np.minimum(code_lengths(self.trees[language], codes), MOST_BITS)

    @property
    def bits(self) -> np.ndarray:
        """Code length of every symbol after each full context of any language: (context and symbol, language)."""
        contexts = np.unique(np.concatenate([tree[-1].contexts for tree in self.trees]))
        codes = (contexts[:, None] * SYMBOLS + np.arange(SYMBOLS, dtype=np.uint32)).ravel()
        return np.stack([self.code_lengths(i, codes) for i in range(len(self.trees))], axis=1)


def context_codes(symbols: np.ndarray, order: int) -> np.ndarray:
    """For each position from ``order`` on, the number of its context and symbol (32 bits hold order 3)."""
    n = len(symbols) - order
    codes = np.zeros(n, np.uint32)
    for k in range(order + 1):
        codes = codes * SYMBOLS + symbols[k : k + n]
    return codes


def learned_tree(texts: list[bytes], order: int) -> list[Contexts]:
    joined = SYMBOL[np.frombuffer((b"\n" * order).join([b"", *texts, b""]), np.uint8)]
    tree: list[Contexts] = []
    for k in range(order + 1):
        codes, counts = np.unique(context_codes(joined[order - k :], k), return_counts=True)
        contexts, of, d = np.unique(codes // SYMBOLS, return_inverse=True, return_counts=True)
        n = np.bincount(of, counts)
        # The context without its first symbol was seen with all symbols that follow this one.
        shorter = 2.0 ** -code_lengths(tree, codes % SYMBOLS**k)
        rest = 1 - np.bincount(of, shorter)
        total = np.where(d == SYMBOLS, n, n + d)
        escapes = np.log2(total) - np.log2(d) + np.log2(np.maximum(rest, 1e-12))
        tree.append(Contexts(codes, np.log2(total[of]) - np.log2(counts), contexts, escapes))
    return [c._replace(bits=c.bits.astype(np.float32), escapes=c.escapes.astype(np.float32)) for c in tree]


def sampled_slices(text_col: str) -> Column:
    """The text, or slices of it that have ``SAMPLE_CHARS`` characters together."""
    size, n = SAMPLE_CHARS // SLICES, F.char_length(text_col)
    starts = [F.floor((n - size) * i / (SLICES - 1)).cast("int") + 1 for i in range(SLICES)]
    return F.when(n <= SAMPLE_CHARS, F.array(text_col)).otherwise(F.array(*[F.substr(F.col(text_col), a, F.lit(size)) for a in starts]))


def learn_models(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Models:
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.col(text_col) != "")).select(id_col, lang_col, text_col)
    nth = F.row_number().over(W.partitionBy("sample_lang").orderBy(F.xxhash64("sample_id"), "sample_id"))
    ids = known.select(F.col(id_col).alias("sample_id"), F.col(lang_col).alias("sample_lang")).withColumn("nth", nth).filter(F.col("nth") <= SAMPLE_DOCS)
    sample = known.join(F.broadcast(ids.drop("nth").distinct()), (F.col(id_col) == F.col("sample_id")) & (F.col(lang_col) == F.col("sample_lang")))
    by_language: dict[str, list[bytes]] = {}
    # The order of the ids, so that reruns add up the same texts; repeated rows count once.
    # An id on many rows gets no more than a language's share: rows are counted again, in the same order.
    row = F.row_number().over(W.partitionBy("sample_lang").orderBy(F.xxhash64("sample_id"), "sample_id", F.xxhash64("slices")))
    slices = sample.select("sample_id", "sample_lang", sampled_slices(text_col).alias("slices")).withColumn("row", row)
    slices = slices.filter(F.col("row") <= SAMPLE_DOCS).select("sample_lang", "slices").distinct().orderBy("sample_lang", "slices")
    for lang, texts in slices.collect():
        by_language.setdefault(lang, []).extend(t.encode() for t in texts)
    languages = sorted(by_language)
    return Models(languages, ORDER, [learned_tree(by_language[x], ORDER) for x in languages])


def text_bits(texts: list[bytes], models: Models) -> np.ndarray:
    """Code length of each text in each language."""
    k = models.order
    joined = np.frombuffer((b"\n" * k).join([b"", *texts]), np.uint8)
    codes, of = np.unique(context_codes(SYMBOL[joined], k), return_inverse=True)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + k)
    starts = ends - sizes - k
    # Position i of bits is byte i + k: each text's bytes, then the breaks in front of the next text.
    breaks = (ends[:-1, None] - k + np.arange(k)).ravel()
    out = np.zeros((len(texts), len(models.languages)))
    some = np.flatnonzero(sizes)
    for i in range(len(models.languages) if len(some) else 0):
        bits = np.append(models.code_lengths(i, codes).astype(np.float32)[of], np.float32(0))
        bits[breaks] = 0
        out[some, i] = np.add.reduceat(bits, starts[some], dtype=np.float64)
    return out


def with_language(docs: DataFrame, models: Models, lang_out: str = "lang_pred", score_out: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the language of the shortest code and a score from 0 to 1."""
    shipped = ship(docs.sparkSession, models)

    def compute(texts: pa.Array, ready: list[Models] = []) -> list[pa.Array]:  # noqa: B006  loaded once a task
        if not ready:
            ready.append(shipped())
        values = texts.to_pylist()
        lettered = [bool(t and ready[0].languages and LETTER.search(t)) for t in values]
        raw = [t.encode() for t, y in zip(values, lettered) if y]
        langs, scores = np.full(len(values), "und", object), np.zeros(len(values))
        if raw:
            bits = text_bits(raw, ready[0])
            best, size = bits.argmin(axis=1), np.array([len(t) for t in raw])
            nats = (bits - bits.min(axis=1, keepdims=True)) * (np.log(2) * np.minimum(1, EVIDENCE / size))[:, None]
            langs[lettered] = np.array(ready[0].languages, object)[best]
            scores[lettered] = 1 / np.exp(-nats).sum(axis=1)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    fields = [T.StructField(fresh(docs, lang_out), T.StringType()), T.StructField(fresh(docs, score_out), T.DoubleType())]
    return with_text_columns(docs, text_col, fields, compute, PIECE_BYTES)
