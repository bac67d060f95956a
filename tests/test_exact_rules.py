"""The similarity ratio and display rounding against Python's own."""

import difflib
import random
import struct

from pyspark.sql import functions as F

from nestegg.functions.common import python_round1
from nestegg.operators.resolve import similarity


def test_similarity_equals_difflib(spark):
    rnd = random.Random(8)
    pairs = [("", ""), ("", "a"), ("a", ""), ("abcd", "bcda"), ("abab", "baba"), ("삼성생명보험", "삼성 생명"), ("😀a😀", "a😀😀"), ("aaa", "aaaa"), ("qabxcd", "abycdf")]
    for alphabet in ("ab", "abc ", "가나다라마", "abcdefghij"):
        pairs += [tuple("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(14))) for _ in "12") for _ in range(60)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").repartition(4)
    for r in df.withColumn("r", similarity(F.col("a"), F.col("b"))).collect():
        assert r.r == difflib.SequenceMatcher(None, r.a, r.b).ratio(), (r.a, r.b)


def test_python_round(spark):
    rnd = random.Random(9)
    values = [0.35, 72.65, 0.25, 0.75, 0.05, 0.15, 2.675, -0.35, -72.65, -0.25, -0.04, 0.0, 1e14 + 0.05, 1e15 + 0.5, 1e300, 5e-324, float("inf")]
    values += [k / 20 for k in range(0, 4000)] + [rnd.uniform(-100, 100) for _ in range(2000)] + [round(rnd.uniform(0, 100), 2) for _ in range(2000)]
    values += [struct.unpack("d", struct.pack("q", struct.unpack("q", struct.pack("d", k / 20))[0] + d))[0] for k in range(1, 400) for d in (-1, 1)]
    got = spark.createDataFrame([(v,) for v in values], "x double").withColumn("r", python_round1(F.col("x"))).collect()
    assert [(r.x, repr(r.r)) for r in got] == [(v, repr(round(v, 1))) for v in values]
