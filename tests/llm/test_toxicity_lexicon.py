"""The learned lexicon: hits against plain search, stems that clean texts hold by chance, exceptions from labels."""

import random

from nestegg.llm import toxicity as tx


def made_up(seed, n, toxic_every, plant):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("tbaeinshr") for _ in range(rnd.randint(2, 7)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rnd.randint(20, 60))]
        label = int(i % toxic_every == 0)
        for extra in plant(rnd, i, label):
            words.insert(rnd.randrange(len(words)), extra)
        rows.append((i, " ".join(words), label))
    return rows


def plain_hits(text, lexicon):
    """Every entry and exception searched at every place."""
    folded = tx.fold(text, tx.FoldTable())
    excepted = []
    for phrase in lexicon.exceptions:
        p = tx.fold(phrase, tx.FoldTable())
        excepted += [(i, i + len(p) - 1) for i in range(len(folded)) if folded.startswith(p, i)]
    best = {}
    for entry, weight in lexicon.weights.items():
        for i in range(len(folded)):
            if folded.startswith(entry, i) and not any(a <= i < b for a, b in excepted):
                best[i] = max(weight, best.get(i, 0.0))
    return sum(best.values()), len(folded.split())


def test_hits_equal_plain_search():
    rnd = random.Random(3)
    lexicon = tx.Lexicon({" ab ": 2.0, " ab": 1.0, " abc": 3.0, " ca ": 1.5}, ("ab ca", "ca ab b", "abcc"), (0.0, 1.0, 1.0))
    matcher = tx.Matcher(lexicon)
    for _ in range(300):
        text = " ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(0, 30)))
        total, n = matcher.hits(text)
        assert n == plain_hits(text, lexicon)[1] and abs(total - plain_hits(text, lexicon)[0]) < 1e-9
    assert matcher.hits(None) == matcher.hits("") == (0, 0)


def test_stems_that_clean_texts_hold_by_chance(spark):
    # Toxic texts hold the stem several times in ever new words; one clean text in eight holds it once, among more words.
    def plant(rnd, i, label):
        tail = lambda: "".join(rnd.choice("tbaeinshr") for _ in range(3))
        if label:
            return ["dorkel" + tail() for _ in range(4)]
        return ["dorkel" + tail(), *[tail() + tail() for _ in range(60)]] if i % 8 == 0 else []

    rows = made_up(5, 900, 9, plant)
    train, test = rows[:600], rows[600:]
    lexicon = tx.learn_lexicon(spark.createDataFrame([r[1:] for r in train], "text string, label int"))
    assert any(entry.startswith(" dork") for entry in lexicon.weights)
    got = {r.doc_id: r.score >= 0.5 for r in tx.with_toxicity(spark.createDataFrame(test, "doc_id long, text string, label int"), lexicon).collect()}
    toxic = [got[i] for i, _, label in test if label]
    clean = [got[i] for i, _, label in test if not label]
    assert sum(toxic) >= 0.95 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_exceptions_are_learned(spark):
    def plant(rnd, i, label):
        if label:
            return ["clown"]
        return ["clown fish"] if i % 40 == 1 else []

    rows = made_up(7, 900, 9, plant)
    lexicon = tx.learn_lexicon(spark.createDataFrame([r[1:] for r in rows], "text string, label int"))
    assert lexicon.exceptions == ("ciown fish",)  # l folds to i
    tests = [(0, "a clown fish swims here"), (1, "you clown, go away from here"), (2, None), (3, "")]
    got = {r.doc_id: r.score for r in tx.with_toxicity(spark.createDataFrame(tests, "doc_id long, text string"), lexicon).collect()}
    assert got[1] > 0.5 > got[0] == got[2] == got[3]
