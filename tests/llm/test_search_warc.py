"""Ranked lexical search and WARC archives against brute force, on planted and awkward rows."""

import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestegg.llm import lexical_search as ls
from nestegg.llm import warc

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 97} long{i % 31}" for i in range(30_000))
AWKWARD = [None, "", " \n\t", "One.", "ÉTÉ çà İ ſ K", "same text", "same text", LONG, "\0 nul \0", "a" * 5000]


def terms_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def ranked(docs, items, k):
    """(item_row, rank, doc_id, score) by the formula, document by document."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs, n_words = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for row, (item, text) in enumerate(items):
        found = []
        for i, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // max(1, n_words)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in set(terms_of(text)) if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, n, f[3], -f[0]) for n, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize("block_terms", [ls.BLOCK_TERMS, 40])
def test_search_equals_brute_force(spark, block_terms):
    rnd = random.Random(3)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i, t) for i, t in enumerate(AWKWARD)] + [(100 + i, text(rnd.choice([1, 3, 40, 200]))) for i in range(300)]
    docs += [docs[-1], (None, text(50)), (None, docs[-2][1]), (-5, docs[-1][1])]  # repeated rows, null ids, ties
    phrase = text(6)
    items = [(i, f"{phrase} {text(rnd.choice([0, 2, 30]))}") for i in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere"), (None, "same text"), (3, "W1 w2 W1"), (3, "W1 w2 W1")]
    frame = spark.createDataFrame([(i, t, "x", 1, "s") for i, t in docs], "doc_id long, text string, item_id string, rank int, score string").repartition(5)
    got = ls.search(frame, spark.createDataFrame(items, "item_id long, text string"), k=10, block_terms=block_terms)
    assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == ranked(docs, items, 10)


def test_search_in_small_document_blocks(spark, monkeypatch):
    rnd = random.Random(5)
    docs = [(i, " ".join(f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(1, 20)))) for i in range(400)]
    items = [(i, " ".join(f"w{rnd.randrange(30)}" for _ in range(8))) for i in range(20)]
    monkeypatch.setattr(ls, "BLOCK_CELLS", 1)
    got = ls.search(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string"), k=7)
    assert Counter(tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == ranked(docs, items, 7)


def test_search_of_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ls.search(none, one).collect() == []
    assert ls.search(one.withColumnRenamed("item_id", "doc_id"), one.limit(0)).collect() == []


def test_shared_sets_keep_every_item_and_save_additions():
    rnd = random.Random(1)
    common = [rnd.sample(range(200), 12) for _ in range(5)]
    items = [sorted({*common[i % 5], *rnd.sample(range(200), 4)}) for i in range(60)] + [[], [7]]
    plan = ls.shared_sets(items, 200)

    def spread(s):
        return [s] if s < 200 else [t for x in plan.rules[s - 200] for t in spread(x)]

    assert [sorted(t for s in row for t in spread(s)) for row in plan.items] == [sorted(i) for i in items]
    assert plan.additions() < 0.75 * sum(map(len, items))


def sent(rows):
    """The result that the contract asks for."""
    groups = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            groups[html] = min(i, groups.get(html, i))
    out = []
    for i, _, html in rows:
        payload, first = (html or "").encode(), groups.get(html)
        again = first is not None and i != first
        out.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", first if again else None))
    return Counter(out)


PAGES = [
    (5, "http://a/", "x" * 100), (3, "http://b/ c\r\nWARC-Type: x", "x" * 100), (9, None, "x" * 100), (4, "u", "y" * 99), (2, "u", "y" * 99),
    (7, "u", None), (8, "u", ""), (10, "ü", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9), (11, "u", "é\0\r\n\r\n" * 80), (None, "u", "z" * 200),
    (None, "u", "z" * 200), (None, "u", "x" * 100), (3, "again", "x" * 100), (12, "u", "long " * 600_000), (1, "u", "long " * 600_000),
]


def test_warc_round_trip(spark):
    rows = PAGES + [(1000 + i, "http://h/", "copy of one page " * 20) for i in range(500)]
    frame = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "page_id long, url string, html string, record_type string, payload int, digest string").repartition(6)
    got = warc.round_trip(frame)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert Counter(tuple(r) for r in got.collect()) == sent(rows)
    assert warc.round_trip(frame.limit(0)).collect() == []


def test_index_names_members_that_stand_alone(spark):
    frame = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    index = warc.archived(frame)
    by_archive = {}
    for r in index.collect():
        by_archive.setdefault(r.archive, []).append(r)
    seen = []
    for archive, rows in by_archive.items():
        raw = open(archive.removeprefix("file:"), "rb").read()
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            member = gzip.decompress(raw[r.offset : r.offset + r.length])
            assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")
            assert r.record_id.encode() in member
            seen.append(member)
        assert at == len(raw)
        # The normalised archive holds what the monolithic one held, and normalising it again changes nothing.
        assert [x.raw for x in warc.split_records(warc.inflated(io.BytesIO(raw)))] == [gzip.decompress(raw[r.offset : r.offset + r.length]) for r in sorted(rows, key=lambda r: r.offset)]
    assert len(seen) == len(PAGES)
    found = {r.record_id: r for r in warc.records(index).collect()}
    assert bytes(found["<urn:page:11>"].payload).decode() == "é\0\r\n\r\n" * 80
    assert found["<urn:page:5>"].payload == b"" and found["<urn:page:5>"].headers["warc-refers-to"] == "<urn:page:3>"
    assert found["<urn:page:9>"].target == "about:blank"


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_streams_of_any_shape(step):
    raw = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % n + bytes(np.random.default_rng(n).integers(0, 256, n, np.uint8)) + b"\r\n\r\n" for n in (0, 1, 5000, 70_000))
    half = len(raw) // 2
    for packed in (gzip.compress(raw), gzip.compress(raw[:half]) + gzip.compress(raw[half:]), gzip.compress(b"") + gzip.compress(raw)):
        assert b"".join(warc.inflated(io.BytesIO(packed), step)) == raw
    assert list(warc.inflated(io.BytesIO(b""))) == []
    assert b"".join(r.raw for r in warc.split_records(raw[i : i + 999] for i in range(0, len(raw), 999))) == raw
    assert b"".join(warc.inflated(io.BytesIO(gzip.compress(b"0" * 10_000_000)))) == b"0" * 10_000_000


def test_damaged_streams_are_errors():
    raw = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    for bad in (raw[:-1], raw[:12], raw.replace(b": 5", b": 4"), raw.replace(b"Content-Length", b"Content-Size"), b"x" + raw):
        with pytest.raises(ValueError):
            list(warc.split_records([bad]))
    with pytest.raises(ValueError):
        list(warc.inflated(io.BytesIO(gzip.compress(raw)[:-9])))


def test_one_payload_on_most_pages_is_dealt_out(spark):
    rows = spark.range(20_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 > 0, F.repeat(F.lit("c"), F.lit(300))).otherwise(F.col("id").cast("string")).alias("html"))
    typed = warc.typed_pages(rows)
    got = typed.groupBy("record_type").count().collect()
    assert {r.record_type: r["count"] for r in got} == {"response": 6667 + 1, "revisit": 13_332}
