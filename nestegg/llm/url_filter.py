"""URL filters: host and path rules, then a Bloom filter cascade over the corpus's key universe.

The universe is every distinct key (host) of the pages. Level 0 of the cascade encodes the listed
keys; level 1 the keys of the universe that pass level 0 though they aren't listed; level 2 the
listed keys that pass level 1, and so on, until no key is wrongly passed. So membership is exact
for every key of the corpus, and pages are judged by the broadcast bits alone, without a join.

A cascade holds about ``PART_KEYS`` keys at most in any level: with more listed keys, or a universe
of which level 0 would pass more by mistake, keys are split by a hash into parts, each with its own
cascade, and one more pass over the pages for each part, so that what is broadcast at a time stays
bounded.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is
judged by its (empty) host; a rule's path must begin the url's path, so rules with a path never fit
an empty path; of several rules that fit, the longest wins; an empty list allows what no rule blocks.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestegg.llm.common import fresh, ship, stage

PART_KEYS = 4_000_000
FIRST_RATE, NEXT_RATE = 0.02, 0.3  # share of wrong keys that a level may pass
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


class Level(NamedTuple):
    seed: int
    bits: int
    hashes: int
    words: np.ndarray  # the bits, 8 to a byte

    def places(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        step = h >> 64 | 1
        return [((h & 0xFFFFFFFFFFFFFFFF) + j * step) % self.bits for j in range(self.hashes)]

    def passes(self, key: str) -> bool:
        return all(self.words[p >> 3] >> (p & 7) & 1 for p in self.places(key))


class Cascade(NamedTuple):
    levels: list[Level]

    def listed(self, key: str) -> bool:
        """The level that first turns a key away tells its side; a key that all pass is of the last one's."""
        for nth, level in enumerate(self.levels):
            if not level.passes(key):
                return nth % 2 == 1
        return len(self.levels) % 2 == 1


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def built_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of the ``n`` keys: each task sets bits, the bits of all tasks are united byte by byte."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    empty = Level(seed, bits, max(1, round(-math.log2(rate))), np.zeros(-(-bits // 8), np.uint8))
    plain = (empty.seed, empty.bits, empty.hashes)

    def run(batches):
        level = Level(*plain, np.zeros(0, np.uint8))
        for batch in batches:
            places = np.unique(np.array([p for k in batch.column("key").to_pylist() for p in level.places(k)], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(places >> 3), pa.array(1 << (places & 7))], names=["at", "byte"])

    rows = keys.select("key").mapInArrow(run, "at long, byte long").groupBy("at").agg(F.bit_or("byte").alias("byte")).toArrow()
    empty.words[rows.column("at").to_numpy()] = rows.column("byte").to_numpy()
    return empty


def passing(keys: DataFrame, level: Level) -> DataFrame:
    shipped = ship(keys.sparkSession, level)

    def run(batches):
        this = shipped()
        for batch in batches:
            yield batch.filter(pa.array([this.passes(k) for k in batch.column("key").to_pylist()], pa.bool_()))

    return keys.mapInArrow(run, keys.schema)


def build_cascade(universe: DataFrame) -> Cascade:
    """``universe``: key, listed (each key once). Level after level, until none is passed wrongly."""
    levels: list[Level] = []
    inside, outside = universe.filter("listed"), universe.filter("not listed")
    n = inside.count()
    while n:
        level = built_level(inside, n, NEXT_RATE if levels else FIRST_RATE, len(levels))
        levels.append(level)
        # The wrongly passed are the next level's keys; what it must tell them from are this one's.
        inside, outside = stage(passing(outside, level), "cascade"), inside
        n = inside.count()
    return Cascade(levels)


def with_listed(pages: DataFrame, key_col: str, universe: DataFrame, out: str, part_keys: int = PART_KEYS) -> DataFrame:
    """``pages`` with a boolean: is the key listed? ``universe``: key, listed, for all keys of the pages."""
    universe = stage(universe.select("key", "listed"), "universe")
    inside, outside = universe.agg(F.count_if(F.col("listed")), F.count_if(~F.col("listed"))).first()
    parts = max(1, math.ceil(max(inside, FIRST_RATE * outside) / part_keys))
    schema = T.StructType([*pages.schema.fields, T.StructField(out, T.BooleanType())])
    found, columns = pages, pages.columns
    for nth in range(parts):
        shipped = ship(pages.sparkSession, build_cascade(universe.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == nth)))
        mine = found.withColumn(part := fresh(found, "part"), F.pmod(F.xxhash64(key_col), F.lit(parts)) == nth)

        def run(batches, shipped=shipped, part=part, first=not nth):
            cascade = shipped()
            for batch in batches:
                keys, own = batch.column(key_col).to_pylist(), batch.column(part).to_pylist()
                known = {k: cascade.listed(k) for k in {k for k, y in zip(keys, own) if y}}
                old = [False] * len(keys) if first else batch.column(out).to_pylist()
                flags = pa.array([known[k] if y else o for k, y, o in zip(keys, own, old)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), flags], names=schema.names)

        found = mine.mapInArrow(run, schema)
    return found


def judged(pages: DataFrame, rules: list[Rule], listed: Column, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict. ``listed``: which hosts (column ``key``) are on the list."""
    host, path, rule, verdict, flag = (fresh(pages, n) for n in ("host", "path", "rule", "verdict", "listed"))
    keyed = pages.withColumns({host: host_of(F.col(url_col)), path: path_of(F.col(url_col))})
    universe = keyed.select(F.col(host).alias("key")).distinct().select("key", listed.alias("listed"))
    found = with_listed(keyed, host, universe, flag)
    name, ruled = rule_of(rules, F.col(host), F.col(path))
    return found.withColumns({rule: name, verdict: F.coalesce(ruled, F.when(F.col(flag), "block").otherwise("allow"))}).drop(flag)
