"""Each operator against a brute-force restatement or held-out accuracy, and on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from nestegg.llm import decontaminate as dc
from nestegg.llm import language as lg
from nestegg.llm import mixing as mx
from nestegg.llm import neighbours as nb
from nestegg.llm import quality as ql
from nestegg.llm import queries as qs
from nestegg.llm import secret_scan as ss
from nestegg.llm import simhash as sh
from nestegg.llm import suffix_dedup as sd
from nestegg.llm import toxicity as tx
from nestegg.llm import url_filter as uf

DDL = "doc_id long, text string, lang string, source string, n_chars long, score string, uid string, spans string, words string, fp string"
LONG = " ".join(f"w{i % 97} long{i % 31}" for i in range(30_000))
AWKWARD = [None, "", " \n\t", "One.", "ÉTÉ çà İ ſ K", "same text here for all", "same text here for all", LONG, "\0 nul \0", "a" * 5000]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "xx", "s" if i % 3 else None, None, "x", "y", "z", "w", "v") for i, t in enumerate(AWKWARD)]
    rows += [rows[5], (None, "no id", None, None, None, *["c"] * 5)]
    return spark.createDataFrame(rows, DDL)


def test_mixing_meets_targets(spark, docs):
    rnd = random.Random(1)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 200, 3000])), rnd.choice("aaaaaabc") if i % 9 else None) for i in range(300)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string, source string"), docs):
        mixed = mx.mix(df, [3, 1, 2], keep_text=True)
        got = mx.taken_words(mixed).collect()
        sizes, names = defaultdict(int), []
        for r in df.select("source", "text").collect():
            sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        target, left, open_ = {}, 1.5 * sum(sizes.values()), set(names)
        while open_:  # share by weight, cap, share the excess again
            level = left / sum(weight[s] for s in open_)
            full = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
            if not full:
                target |= {s: level * weight[s] for s in open_}
                break
            target |= {s: 2.0 * sizes[s] for s in full}
            left, open_ = left - sum(2 * sizes[s] for s in full), open_ - full
        taken = Counter()
        for r in got:
            assert r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
            assert r.target == pytest.approx(target[r.source])
            taken[r.source] += r.taken
        assert len(got) == df.count()
        assert all(abs(taken[s] - target[s]) <= mx.BLOCK_WORDS for s in names)
        again = mx.taken_words(mx.mix(df, [3, 1, 2])).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, again))
    slots = mixed.slots.collect()
    assert len({(r.shard, r.position) for r in slots}) == len(slots)
    texts = mx.block_texts(mixed).collect()
    assert sum(len(r.text.split(" ")) for r in texts) == sum(sizes.values())


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_equals_brute_force(spark, docs, block_bytes):
    items = [(1, "w1 long1 w2 long2 w3 long3 w4 long4 w5 long5 w6"), (2, "Été çà"), (2, "Été çà"), (3, None), (4, " .. "), (None, "one"),
             (10, "same text here for all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])] |= {str(i)} if i is not None else set()
    got = dc.contamination(docs, bench, block_bytes=block_bytes).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in got:
        w, hit, found = words(texts[r.doc_id]), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[key]
        cols = r.asDict()
        assert (cols["n_words"], cols["n_hit"], cols["items"]) == (len(w), len(hit), sorted(found)), r.doc_id
    clean = dc.decontaminate(docs, bench, block_bytes=block_bytes)
    assert clean.schema == docs.schema and clean.filter("doc_id = 9").first().text == "a" * 5000
    assert "same" not in (clean.filter("doc_id = 5").first().text or "")
    assert dc.contamination(docs, bench.limit(0)).filter("n_hit > 0").isEmpty()


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash_equals_brute_force(spark, docs):
    rows = docs.collect()
    got = {(r.doc_id, r._fp & (1 << 64) - 1): r.component_id for r in sh.near_duplicates(docs, keep_columns=True).collect()}
    prints = [(r.doc_id, fingerprint(r.text)) for r in rows]
    assert set(got) == set(prints)
    for i, p in prints:
        near = {p}
        while more := {q for _, q in prints if q not in near and any((q ^ x).bit_count() <= 2 for x in near)}:
            near |= more
        assert got[i, p] == min((j for j, q in prints if q in near and j is not None), default=None)
    kept = sh.deduplicate(docs)
    assert kept.schema == docs.schema
    assert sorted(map(repr, kept.select("doc_id").collect())) == sorted({f"Row(doc_id={c})" for c in got.values()})


def test_deduplicate_keeps_a_row_of_every_component(spark):
    """Components without ids, and components that share their smallest id, are not one component."""
    one, two, three, four = ("red apples grow on old trees", "ships sail far over cold seas", "who wrote this long letter today", "rain fell on seven hills")
    rows = [(None, one), (None, two), (None, two), (7, three), (7, four), (9, four), (None, three)]
    kept = sh.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(None, one), (None, two), (7, three), (7, four)]))


def test_bk_links_connect_what_brute_force_connects(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(40)]
    prints = sorted({x ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) * rnd.randrange(2) for x in base for _ in range(12)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in sh.components(sh.fingerprint_links(df)).collect()}
    group = {}
    for p in prints:
        if p not in group:
            todo = [p]
            while todo:
                x = todo.pop()
                group[x] = p
                todo += [q for q in prints if q not in group and (q ^ x).bit_count() <= 2]
    by_root = defaultdict(set)
    for p, s in zip(prints, signed):
        by_root[roots.get(s, s)].add(group[p])
    assert all(len(g) == 1 for g in by_root.values()) and len(by_root) == len(set(group.values()))


@pytest.mark.parametrize("heavy_texts, bucket_rows", [(16, 16384), (2, 16384), (1000, 3)])
def test_suffix_dedup_equals_brute_force(spark, docs, monkeypatch, heavy_texts, bucket_rows):
    """The plain way; with most keys heavy; with most buckets overflowing."""
    monkeypatch.setattr(sd, "HEAVY_TEXTS", heavy_texts)
    monkeypatch.setattr(sd, "BUCKET_ROWS", bucket_rows)
    rnd = random.Random(5)
    parts = ["".join(rnd.choice("abc") for _ in range(rnd.randint(0, 300))) for _ in range(20)]
    rows = [(i, rnd.choice(parts)[rnd.randint(0, 60):] + rnd.choice(parts) + "é" * rnd.randint(0, 30)) for i in range(40)]
    df = spark.createDataFrame(rows + [(r.doc_id, r.text) for r in docs.filter("length(text) < 6000 or text is null").collect()], "doc_id long, text string")
    for length, spread in ((20, 12), (60, 16)):
        seen, expected = Counter(), []
        raw = [(i, (t or "").encode()) for i, t in map(tuple, df.collect())]
        for _, b in raw:
            seen.update(b[p : p + length] for p in range(len(b) - length + 1))
        for i, b in raw:
            cut = bytearray(len(b))
            for p in range(len(b) - length + 1):
                if seen[b[p : p + length]] > 1:
                    cut[p : p + length] = b"\1" * length
            runs = len(re.findall(b"\1+", bytes(cut)))
            expected.append((i, len(b), sum(cut), runs, hashlib.sha256(bytes(x for x, y in zip(b, cut) if not y)).hexdigest()))
        got = sd.deduplicated(df, length, spread, keep_text=False).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert sd.deduplicated(df.limit(0)).isEmpty()


def test_url_rules_and_cascade(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Www.Example.ORG/es/a?b#c", "x://example.org/en/12", "x://example.org?/en/1", "a://b://c/d",
            "x://m.spam-farm.example.net/q", "x://badorg/", "x://com/de/", "x://é.com/fr/\nx", "x://example.org/en/1"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = [uf.Rule("allow", "org", "/"), uf.Rule("block", "example.org", "/es/"), uf.Rule("block", "example.org", "/en/1"),
             uf.Rule("allow", "com", "/fr/"), uf.Rule("block", "com", "/de/")]
    listed = F.col("key").contains("spam-farm")
    for r in uf.judged(pages, rules, listed).collect():
        u, host, path = r.url or "", "", ""
        if "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = lower(host)
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.host + x.path), default=None)
        expected = (host, path, best and best.host + best.path, best.verdict if best else "block" if "spam-farm" in host else "allow")
        assert (r._host, r.path, r.rule, r.verdict) == expected
    universe = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    found = uf.with_listed(universe.select("key"), "key", universe, "flag", part_keys=200)
    assert found.join(universe, "key").filter("flag != listed").isEmpty() and found.count() == 3000
    assert uf.judged(pages.limit(0), rules, listed).isEmpty()


def test_neighbours_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [float("nan")] + [1.0] * 15), (None, [1.0] * 16), (2080, [1.0, None] + [1.0] * 14)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nb.nearest_neighbours(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    x = x.astype(np.float64)
    hits = 0
    for q in range(0, 1500, 20):
        s = (x * x[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:20]
        hits += len({i for i, _ in got[q]} & set(best))
        assert all(s[i] == v for i, v in got[q]) and len(got[q]) == 20
    assert set(got) == set(range(0, 1500, 20)) and hits >= 0.9 * 20 * 75
    assert [i for i, _ in got[0][:20]] == list(range(100, 120))  # ties go to the smaller id
    assert nb.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0, 20).isEmpty()
    few = nb.nearest_neighbours(df.filter("vec_id < 5"), F.col("vec_id") % 20 == 0, 20)
    assert few.count() == 4


def test_quality_separates_junk(spark, docs):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 9)))
    good = lambda: ". ".join(" ".join(word() for _ in range(12)).capitalize() for _ in range(rnd.randint(1, 20))) + "."
    junk = [lambda: " ".join(word().upper() + "!!" for _ in range(60)), lambda: f"{word()} " * 50, lambda: " | ".join(word() + "$$$" for _ in range(60))]
    rows = [(i, good() if i % 4 else rnd.choice(junk)()) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400) if i % 3] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in ql.with_quality(df, labels).collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 4 > 0) for i in range(0, 400, 3)]) > 0.97
    scored = ql.with_quality(docs, labels).collect()
    assert len(scored) == docs.count() and all(0 <= r["_score"] <= 1 for r in scored)
    assert {r.score for r in ql.with_quality(df, labels.limit(0)).collect()} == {0.5}


def test_language_models_are_distributions_and_separate(spark, docs):
    rnd = random.Random(4)
    make = lambda parts: " ".join("".join(rnd.choice(parts) for _ in range(3)) for _ in range(40))
    langs = {"aa": ["th", "er", "ing", "on"], "bb": ["sch", "ung", "ü", "ei"], "cc": ["ción", "que", "ado", "ñ"]}
    rows = [(i, make(langs[x]), x if i % 2 else None) for i, x in enumerate(["aa", "bb", "cc"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = lg.learn_models(df)
    p = 2.0 ** -models.bits[:, 0].astype(np.float64).reshape(-1, lg.SYMBOLS)
    assert np.abs(p.sum(axis=1) - 1).max() < 0.02
    got = {r.doc_id: r.lang_pred for r in lg.with_language(df, models).collect()}
    assert all(got[i] == x for i, x in enumerate(["aa", "bb", "cc"] * 40))
    odd = lg.with_language(docs, models).collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in odd)
    none = lg.with_language(docs, lg.learn_models(df.limit(0))).collect()
    assert {(r.lang_pred, r["_score"]) for r in none} == {("und", 0.0)}


def test_language_bytes_of_many_scripts_stay_apart(spark):
    """Two languages that differ in one rare letter each, among scripts with more bytes than 44."""
    rnd = random.Random(8)
    make = lambda parts: " ".join("".join(rnd.choice(parts) for _ in range(4)) for _ in range(60))
    cyrillic = [chr(c) for c in range(0x430, 0x43A)] * 4
    parts = {"ru": [*cyrillic, "ы"], "uk": [*cyrillic, "ї"], "el": [chr(c) for c in range(0x3B1, 0x3C9)], "en": [chr(c) for c in range(97, 123)]}
    rows = [(i, make(parts[x]), x) for i, x in enumerate([*parts] * 30)]
    models = lg.learn_models(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(i, make(parts[x]), x) for i, x in enumerate(["ru", "uk"] * 40)]
    got = lg.with_language(spark.createDataFrame(tests, "doc_id long, text string, lang string"), models).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95


def test_language_is_learned_from_long_documents_and_beside_many(spark):
    """A language of books only, among more languages than dense tables of order 3 had room for."""
    rnd = random.Random(9)
    letters = [chr(c) for c in range(97, 123)]
    parts = {f"l{i:02}": ["".join(rnd.choice(letters) for _ in range(3)) for _ in range(8)] for i in range(20)}
    make = lambda x, n: " ".join("".join(rnd.choice(parts[x]) for _ in range(3)) for _ in range(n))
    rows = [(i, make(x, 3000 if x == "l07" else 60), x) for i, x in enumerate([*parts] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = lg.learn_models(df)
    assert models.languages == sorted(parts) and models.order == 3
    got = lg.with_language(df, models).collect()
    assert all(r.lang_pred == r.lang for r in got)
    text = "".join(chr(0x4E00 + i % 9000) for i in range(50_001))
    cut = spark.createDataFrame([(text,), ("x" * 20_000,)], "text string").select(lg.sampled_slices("text").alias("s")).collect()
    assert [len(t) for t in cut[0].s] == [1000] * 20 and cut[0].s[0] == text[:1000] and cut[0].s[-1] == text[-1000:]
    assert cut[1].s == ["x" * 20_000]


def test_language_code_lengths_are_those_of_the_definition():
    texts = ["das haus, die maus 12".encode(), "größe über alles".encode(), b"Aus aus aus"]
    tree = lg.learned_tree(texts, 3)
    joined = lg.SYMBOL[np.frombuffer(b"\n\n\n".join([b"", *texts, b""]), np.uint8)].tolist()

    def probability(context, symbol):
        shorter = (lambda s: probability(context[1:], s)) if context else lambda s: 1 / lg.SYMBOLS
        k = len(context)
        counts = Counter(joined[i] for i in range(3, len(joined)) if joined[i - k : i] == context)
        n, d = sum(counts.values()), len(counts)
        if not n or symbol in counts:
            return counts[symbol] / (n + d) if n else shorter(symbol)
        return d / (n + d) * shorter(symbol) / (1 - sum(map(shorter, counts)))

    for raw in (b"\n\n\nd", b"aus ", b"aus!", b"xyzq", b" maz", "ßx".encode() + b"a", b"1 us"):
        s = lg.SYMBOL[np.frombuffer(raw, np.uint8)]
        assert lg.code_lengths(tree, lg.context_codes(s, 3))[0] == pytest.approx(-np.log2(probability(s[:3].tolist(), int(s[3]))), abs=1e-3)


def test_toxicity_lexicon(spark, docs):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("tbaeinshr") for _ in range(rnd.randint(2, 7)))
    rows = [(" ".join([word() for _ in range(30)] + (["Scumbag", "dorkish" + rnd.choice(["ly", "ness", "est"])] if i % 5 == 0 else [])), int(i % 5 == 0)) for i in range(600)]
    lexicon = tx.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    tests = ["you scumbag", "ѕcumbаg", "5cumb@g!!", "ſcumbag", "such a dorkishly one", "plain words only", "scum bag", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tests)], "doc_id long, text string")
    got = [r.score for r in tx.with_toxicity(df, lexicon).orderBy("doc_id").collect()]
    assert all(s > 0.5 for s in got[:5]) and all(s < 0.5 for s in got[5:])
    excepted = tx.Matcher(lexicon._replace(exceptions=("scumbag steve",)))
    assert excepted.hits("the scumbag steve meme")[0] == 0 < excepted.hits("scumbag")[0]
    assert len(tx.with_toxicity(docs, lexicon).columns) == len(docs.columns) + 1
    empty = tx.learn_lexicon(spark.createDataFrame([], "text string, label int"))
    assert all(r["_score"] < 0.01 for r in tx.with_toxicity(docs, empty).collect())


def test_secret_spans(spark, docs):
    texts = ["token = \"24be64439e3e49cf46b2d7c90f3602a3\" é", "AKIA1234567890ABCD x AKIA1", "PassWd: token=abcdef0123456789", "password=short token:aaaaaaaaaaaa", None, ""]
    spec = [("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
            ("access", r"AKIA[A-Z0-9]+", 18, 0), ("hex", r"[0-9a-f]+", 16, 0)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    network = ss.learn_network(df)
    for r in ss.with_secrets(df, network).collect():
        expected = sorted((m.start(), k, m.end()) for k, (_, p, n, g) in enumerate(spec) for m in re.finditer(p, texts[r.doc_id] or "") if len(m[g]) >= n)
        assert [(s.start, ss.KINDS.index(s.kind), s.end) for s in r.spans if s.kind != "model"] == expected
    windows, labels = ss.made_findings(np.random.default_rng(11), 600)
    taken = network.probability(windows) >= network.threshold
    assert taken[labels == 1].mean() > 0.9 and taken[labels == 0].mean() < 0.1
    clean = ss.redact(docs, network)
    assert clean.schema == docs.schema and clean.count() == docs.count()
    assert "24be" not in ss.redact(df, network).filter("doc_id = 0").first().text
    assert ss.redact(df.limit(0), ss.learn_network(df.limit(0))).isEmpty()


def test_secrets_of_other_forms_in_the_corpus_are_found(spark, tmp_path):
    """Planted secrets that no pattern knows aren't learned as harmless, whatever share of the corpus they are."""
    rnd = random.Random(12)
    base62 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda n: "".join(rnd.choice(base62) for _ in range(n - 2)) + "7x"
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8)))
    secret = [lambda: f"sk-{pick(32)}", lambda: pick(40), lambda: f"ghp_{pick(36)}", lambda: f"{pick(20)}+{pick(18)}="]
    harmless = [lambda: f"mail{rnd.randint(0, 9)}.example.com", lambda: f"www.{word()}.com/{word()}/{word()}/{rnd.randint(1, 99)}", lambda: f"{word()}-{word()}-{word()}-{word()}-{rnd.randint(1, 99)}"]
    rows = []
    for i in range(600):
        planted = rnd.choice(secret if i % 2 else harmless)()
        rows.append((i, f"{word()} {word()} {planted} {word()} {word()}" + (" password=abcdef0123456789" if i % 10 == 0 else "")))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: "model" in r.spans for r in qs.op9_secrets(spark, str(tmp_path)).collect()}
    known = {i for i, t in rows if not any(k == 2 for _, k, _ in ss.base_spans(t))}
    assert np.mean([got[i] for i in known if i % 2]) >= ss.RECALL
    assert np.mean([got[i] for i in known if i % 2 == 0]) < 0.1


def test_secret_threshold_keeps_the_recall_of_low_scores():
    """Few positives that look like the negatives score far below one half, and are kept nevertheless."""
    windows, _ = ss.made_findings(np.random.default_rng(5), 1000)
    labels = (np.arange(1000) % 10 < 2).astype(float)
    network = ss.trained(windows, labels)
    check = np.random.default_rng(7).permutation(1000)[:250]
    positive = [windows[i] for i in check if labels[i]]
    assert (network.probability(positive) >= network.threshold).mean() >= ss.RECALL


def test_secrets_are_found_anywhere_in_long_runs(spark, tmp_path):
    rnd = random.Random(13)
    base62 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 8)))
    path = lambda n: f"www.{word()}.com/" + "/".join(f"{word()}-{word()}-{rnd.randint(1, 99)}" for _ in range(n))
    rows = []
    for i in range(300):
        planted = "".join(rnd.choice(base62) for _ in range(40))
        text = [path(12), f"{path(12)}/{planted}", f"{path(6)}/{planted}/{path(6)}"][i % 3]
        rows.append((i, f"{word()} {word()} {text} {word()} {word()}"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: "model" in r.spans for r in qs.op9_secrets(spark, str(tmp_path)).collect()}
    assert np.mean([got[i] for i in got if i % 3]) >= ss.RECALL
    assert np.mean([got[i] for i in got if i % 3 == 0]) < 0.1
    text = "".join(chr(0x4E00 + i) for i in range(500))
    for start, end in [(100, 116), (100, 148), (100, 149), (100, 300), (0, 500)]:
        read = [ss.window(text, p) for p in ss.places(start, end)]
        assert all(any(text[k : k + min(48, end - start)] in w for w in read) for k in range(start, end - min(48, end - start) + 1))
        assert len(read) == 1 if end - start <= 48 else read[-1].rstrip("\n").endswith(text[end : end + 24])
