"""Collocations against brute force, and the counting quotient filter against plain counters."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from nestegg.llm import collocations as cl
from nestegg.llm import quotient_filter as qf


def best(rows, min_count, longest, top):
    """The contract, with plain counters."""
    out = Counter()
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out[(lang, rank, phrase.decode(), -a, l, r, n[lang], -score)] += 1
    return out


def random_rows(seed):
    rnd = random.Random(seed)
    words = ["the", "THE", "of", "ünd", "É", "é", "a\x00b", "x\x1fy", "日本", "q" * 300] + [f"w{i}" for i in range(40)]
    fixed = ["new york city hall now", "de la", "a b a b a b", "a a a a a a"]
    rows = []
    for _ in range(500):
        parts = [rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(words) + rnd.choice(["", "", "", ".", ",", "\n", "\r\n", "\t"]) for _ in range(rnd.randrange(1, 40))]
        rows.append((rnd.choice(["en", "en", "en", "de", None, "und", ""]), rnd.choice([" ", " ", "  ", "\t"]).join(parts)))
    rows += [("en", None), ("en", ""), (None, None), ("fr", " .,;\n"), ("en", "new york " * 20_000)]
    return rows + rows[:50]


@pytest.mark.parametrize("min_count, top, held", [(20, 2000, cl.HELD_KEYS), (100, 5, 50)])
def test_collocations_equal_brute_force(spark, monkeypatch, min_count, top, held):
    monkeypatch.setattr(cl, "HELD_KEYS", held)
    monkeypatch.setattr(cl, "SLICE_WORDS", 1000)
    monkeypatch.setattr(cl, "HELD_WORDS", held)
    rows = random_rows(min_count)
    docs = spark.createDataFrame([(t, lang, "x", 1, [1]) for lang, t in rows], "text string, lang string, phrase string, n int, words array<int>").repartition(7)
    got = cl.collocations(docs, min_count=min_count, top=top)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), *((c, "bigint") for c in ("a", "l", "r", "n", "score"))]
    want = best(rows, min_count, 5, top)
    assert sum(want.values()) > 10
    assert Counter(tuple(r) for r in got.collect()) == want


def test_ties_at_the_last_rank_go_by_phrase(spark):
    rows = [("en", f"p{i} q{i}.") for i in range(40) for _ in range(6)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert Counter(tuple(r) for r in cl.collocations(docs, min_count=6, top=3).collect()) == best(rows, 6, 5, 3)


def test_tables_without_collocations(spark):
    schema = "text string, lang string"
    for rows in ([], [(None, None), ("", "en")], [("one two three", "en")], [("a. a. a.", "en")]):
        assert cl.collocations(spark.createDataFrame(rows, schema), min_count=3).collect() == []


@pytest.mark.parametrize("length, bits", [(2, 1), (2, 17), (3, 3), (3, 17), (4, 20), (5, 1), (5, 17), (5, 24)])
def test_packed_keys_are_permuted_and_come_back(length, bits):
    rng = np.random.default_rng(length * 100 + bits)
    packing = qf.Packing(length, bits)
    words = [rng.integers(0, 1 << bits, 3000) for _ in range(length)]
    left, right = packing.pack(words)
    assert all((a == b).all() for a, b in zip(packing.unpack(left, right), words))
    moved = packing.permute(left, right)
    assert max(int(m.max()) for m in moved) < 1 << packing.half
    assert len(set(zip(*map(np.ndarray.tolist, moved)))) == len(set(zip(*map(np.ndarray.tolist, words))))
    assert all((a == b).all() for a, b in zip(packing.invert(*moved), (left, right)))


@pytest.mark.parametrize("length, bits, slice_bits", [(2, 3, 1), (2, 17, 4), (5, 17, 1), (5, 24, 6)])
def test_filters_count_without_loss(length, bits, slice_bits):
    rng = np.random.default_rng(bits)
    packing, want, shards = qf.Packing(length, bits), Counter(), defaultdict(list)
    for _ in range(4):
        words = [np.minimum(rng.geometric(0.01, 5000), (1 << bits) - 1) for _ in range(length)]
        for i in range(length):
            words[i][:2000] = 1  # one key far beyond a byte's counter
        want.update(zip(*(w.tolist() for w in words)))
        parts = qf.combined(packing.half, *packing.permute(*packing.pack(words)), np.ones(5000, np.int64))
        for f in qf.slices(packing, slice_bits, *parts):
            assert all((x[1:] >= x[:-1]).all() for x in f.entries()[:1])
            shards[f.slice_number].append(f)
    got = Counter()
    for filters in shards.values():
        left, right, counts = qf.merged(filters)
        got.update(dict(zip(zip(*(w.tolist() for w in packing.unpack(*packing.invert(left, right)))), counts.tolist())))
    assert got == want


def test_filter_is_smaller_than_its_keys():
    packing = qf.Packing(2, 17)
    words = [np.arange(60_000) % 500, np.arange(60_000) // 500]
    left, right, counts = qf.combined(packing.half, *packing.permute(*packing.pack(words)), np.ones(60_000, np.int64))
    assert sum(f.nbytes() for f in qf.slices(packing, 1, left, right, counts)) < 60_000 * 6


def test_too_many_words_for_a_packed_key(spark):
    with pytest.raises(ValueError, match="min_count"):
        cl.phrase_counts(spark.createDataFrame([], "tokens binary"), 1 << 24, 10, 1, 5)
