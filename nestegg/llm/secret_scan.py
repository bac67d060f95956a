"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Patterns give the base spans (``assign``, ``access``, ``hex``), which always stay. A candidate is a
run of at least 16 characters of ``A-Za-z0-9+/_.=-`` that holds a digit and a letter (shorter runs, and
those without a digit or without a letter, are left to the patterns). The network reads windows of
``WIDTH`` characters, ``LEFT`` of them before their place: the first window is placed at the start of
the candidate; one that is longer than a window is read to its end in steps of ``LEFT``, so that
each ``WIDTH - LEFT`` characters in a row are together in a window, and the last window holds ``LEFT``
characters behind it. A window goes as character classes through embedding, convolution, ReLU,
maximum over positions, logistic; a candidate's score is the greatest of its windows' scores. It
is written in numpy and trained by Adam on labelled findings: all different windows of secrets that
the patterns find in the documents, and made findings of further forms of secrets and of harmless
strings, so that it learns more than the patterns. What no pattern finds in the documents may be a
secret or not, so it has no label and isn't learned from. Scores are calibrated (Platt) on findings
that training didn't see, and the threshold is the highest one that keeps at least ``RECALL`` of
their positives, both of the documents' and of the made ones. A candidate at or above it that no base
span touches becomes a ``model`` span.

Training is distributed: the documents' windows are dealt by their hash into parts of about
``PART_WINDOWS``; in each epoch a task goes through each part, together with the made findings, from
the weights and moments of the epoch before, and the results are averaged. Held-out windows come
back as counts of their logits in steps of ``1 / LOGIT_STEPS``. The documents' windows weigh as much
as ``PART_WINDOWS`` at most against the made ones in the calibration, as they do in each part.
Averages are sums of whole numbers and the order in a part is seeded, so reruns agree whatever the
tasks are; scanning is a map-only pass over whole texts. Offsets are code points, ends exclusive.

Defined cases: null and empty texts have no spans; without documents the network learns from the
made findings alone; matches of the patterns that are too short are dropped but use up their text.
"""

from __future__ import annotations

import re
import string
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestegg.llm.common import bound_batches, fresh, ship, stage, text_pieces, with_text_columns

PART_WINDOWS, MADE = 3000, 3000
EPOCHS = 6
LOGIT_STEPS, MOST_LOGIT = 1024, 60
FIXED = 2.0**50  # averages are summed as whole numbers of this unit
LEFT, WIDTH = 24, 72
KNOWN_BY = 12  # characters of a secret that a window is labelled by
EMBED, KERNEL, FILTERS = 8, 5, 24
RECALL = 0.95
KINDS = ("assign", "access", "hex", "model")

# The patterns, the least length of what must match, and the group that it holds for.
_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
ASSIGN = re.compile(rf"""(?:{_ANY_CASE}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # All runs of at least 16 are the maximal runs that aren't dropped.
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    spans = ((m.start(), m.end(), m[0]) for m in CANDIDATE.finditer(text))
    return [(a, b) for a, b, s in spans if not s.isalpha() and re.search("[0-9]", s) and re.search("[A-Za-z]", s)]


def window(text: str, start: int) -> str:
    """The candidate with its surroundings, at a fixed place in a string of ``WIDTH`` characters."""
    return text[max(0, start - LEFT) : start].rjust(LEFT, "\n") + text[start : start + WIDTH - LEFT].ljust(WIDTH - LEFT, "\n")


def places(start: int, end: int) -> list[int]:
    """Where the windows of a candidate are placed."""
    last = end - (WIDTH - 2 * LEFT) if end - start > WIDTH - LEFT else start
    return [*range(start, last, LEFT), last]


def holding(places: list[int], spans: list[tuple[int, int]]) -> list[int]:
    """The places whose windows hold enough of one of the spans to know it by, or all of it."""
    return [p for p in places if any(min(e, p + WIDTH - LEFT) - max(s, p - LEFT) >= min(e - s, KNOWN_BY) for s, e in spans)]


def encoded(windows: list[str]) -> np.ndarray:
    """Character classes: ASCII by itself, all else as one."""
    codes = np.array(windows, f"U{WIDTH}").view(np.uint32).reshape(-1, WIDTH)
    return np.where(codes < 127, codes, 127).astype(np.int64)


class Network(NamedTuple):
    embedding: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def _layers(self, codes: np.ndarray):
        e = self.embedding[codes]
        patches = np.lib.stride_tricks.sliding_window_view(e, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(codes), WIDTH - KERNEL + 1, -1)
        conv = np.maximum(patches @ self.kernel + self.bias, 0)
        best = conv.argmax(axis=1)
        pooled = np.take_along_axis(conv, best[:, None], axis=1)[:, 0]
        return patches, best, pooled, pooled @ self.out[:-1] + self.out[-1]

    def logits(self, windows: list[str]) -> np.ndarray:
        if not windows:
            return np.zeros(0)
        return np.concatenate([self._layers(encoded(windows[i : i + 1024]))[3] for i in range(0, len(windows), 1024)])

    def probability(self, windows: list[str]) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(windows) + b, -30, 30)))


def made_findings(rng: np.random.Generator, n: int) -> tuple[list[str], np.ndarray]:
    """Labelled windows of made-up secrets (1) and of harmless strings of the same lengths (0).

    Besides ``n`` windows of short findings, all windows of long harmless runs, half of them with a secret at the end.
    """
    letters = string.ascii_lowercase
    pick = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    word = lambda: pick(letters, int(rng.integers(2, 9)))
    base62, base64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    size = lambda: int(rng.integers(16, 44))
    secret = [
        lambda: pick(base62, size()), lambda: pick(base64, size()) + "=", lambda: pick("0123456789abcdef", size()),
        lambda: f"{pick(letters, 3)}_{pick(base62, size())}", lambda: f"sk-{pick(base62, size())}",
        lambda: f"AKIA{pick(string.ascii_uppercase + string.digits, 16)}", lambda: ".".join(pick(base62 + "-_", 18) for _ in range(3)),
    ]
    harmless = [
        lambda: f"www.{word()}.{word()}.com/{word()}/{rng.integers(1, 9999)}", lambda: f"{word()}-{word()}-{word()}-{word()}-{rng.integers(1, 99)}",
        lambda: f"{word()}.{word()}.{rng.integers(1, 999)}.example.com", lambda: f"{rng.integers(1990, 2030)}-0{rng.integers(1, 9)}-{rng.integers(10, 28)}T10.30.00",
        lambda: f"{word()}/{word()}/{word()}_{word()}{rng.integers(0, 99)}.txt", lambda: f"{word()}{word()}{word()}{rng.integers(0, 9)}",
        lambda: f"{word()}{rng.integers(1, 99)}.{word()}.{('com', 'org', 'net', 'example.com')[rng.integers(4)]}",
        lambda: f"{word()}={rng.integers(1, 99)}-{word()}={rng.integers(1, 99)}", lambda: f"{word()}_{word()}_{word()}_v{rng.integers(1, 9)}",
    ]
    before = ["key: ", "auth ", 'credential = "', "Bearer ", "export KEY=", "private "]
    windows, labels = [], []
    for i in range(n):
        y = i % 2
        kinds = secret if y else harmless
        text = kinds[rng.integers(len(kinds))]()
        if y:
            lead = before[rng.integers(len(before))] if rng.random() < 0.5 else ""
        else:  # the host of a mail address, of a link, or text in brackets
            lead = (f"{word()}@", f"{word()}.{word()}{rng.integers(1, 99)}@", "https://", "(", "<", '"')[rng.integers(6)] if rng.random() < 0.5 else ""
        left = f"{word()} {word()} {lead}"
        windows.append(window(f"{left}{text} {word()} {word()} {word()} {word()} {word()}", len(left)))
        labels.append(y)
    for i in range(n // 10):
        y, left = i % 2, f"{word()} {word()} "
        run = "/".join(harmless[rng.integers(len(harmless))]() for _ in range(rng.integers(3, 12)))
        tail = "/=."[rng.integers(3)] + secret[rng.integers(len(secret))]() if y else ""
        text, start, end = f"{left}{run}{tail} {word()} {word()} {word()}", len(left), len(left) + len(run) + len(tail)
        at, span = places(start, end), (end - len(tail) + 1, end)
        with_secret = holding(at, [span]) if y else []
        at = [p for p in at if p in with_secret or not y or p + WIDTH - LEFT <= span[0]]
        windows += [window(text, p) for p in at]
        labels += [int(p in with_secret) for p in at]
    return windows, np.array(labels, float)


class Training:
    """Weights of the network under Adam, and its moments."""

    def __init__(self, rng: np.random.Generator):
        self.net = Network(rng.normal(0, 0.3, (128, EMBED)), rng.normal(0, 0.2, (KERNEL * EMBED, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, FILTERS + 1))
        self.weights = [self.net.embedding, self.net.kernel, self.net.bias, self.net.out]
        self.first, self.second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        self.steps = 0

    def epoch(self, codes: np.ndarray, labels: np.ndarray, order: np.ndarray, batch: int = 64, rate: float = 0.01) -> None:
        net = self.net
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            patches, best, pooled, logit = net._layers(codes[part])
            wrong = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[part]) / len(part)
            to_pool = wrong[:, None] * net.out[None, :-1] * (pooled > 0)
            chosen = np.take_along_axis(patches, best[:, :, None], axis=1)  # (rows, filters, kernel * embed)
            to_kernel = np.einsum("nf,nfk->kf", to_pool, chosen)
            to_embed = np.zeros_like(net.embedding)
            back = (to_pool[:, :, None] * net.kernel.T[None]).reshape(len(part), FILTERS, KERNEL, EMBED)
            at_codes = codes[part][np.arange(len(part))[:, None, None], best[:, :, None] + np.arange(KERNEL)]
            np.add.at(to_embed, at_codes.ravel(), back.reshape(-1, EMBED))
            self.steps += 1
            for w, g, m, v in zip(self.weights, (to_embed, to_kernel, to_pool.sum(0), np.append(wrong @ pooled, wrong.sum())), self.first, self.second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)

    def flat(self) -> np.ndarray:
        return np.concatenate([*(x.ravel() for x in (*self.weights, *self.first, *self.second)), [self.steps]])

    def put(self, flat: np.ndarray) -> None:
        at = 0
        for x in (*self.weights, *self.first, *self.second):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        for v in self.second:
            np.maximum(v, 0, out=v)
        self.steps = round(flat[at])


def calibrated(net: Network, logit: np.ndarray, y: np.ndarray, of: np.ndarray, n: np.ndarray, weight: np.ndarray, step: float = 0.0) -> Network:
    """Platt scaling, and the threshold that holds the recall in each origin (``of``).

    A logit stands for ``n`` findings between it and ``step`` more; they have a ``weight`` in the scaling.
    """
    a, b, share = 1.0, 0.0, weight / max(weight.sum(), 1e-9)
    for _ in range(200):  # gradient steps
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        a, b = a - 0.05 * float(((p - y) * logit * share).sum()), b - 0.05 * float(((p - y) * share).sum())
    p = np.minimum(*(1 / (1 + np.exp(-np.clip(a * x + b, -30, 30))) for x in (logit, logit + step)))
    limits = []
    for x in np.unique(of[y == 1]):
        mine = np.flatnonzero((y == 1) & (of == x))
        mine = mine[np.argsort(p[mine], kind="stable")]
        upto = np.cumsum(n[mine])
        limits.append(float(p[mine[np.searchsorted(upto, int((1 - RECALL) * upto[-1]), "right")]]))
    return net._replace(scale=(a, b), threshold=min(limits, default=0.5))


def trained(windows: list[str], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01) -> Network:
    """Adam on three quarters of the findings; calibration and threshold on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    cut = len(order) // 4
    check, learn = order[:cut], order[cut:]
    codes, training = encoded(windows), Training(rng)
    for _ in range(epochs):
        rng.shuffle(learn)
        training.epoch(codes, labels, learn, batch, rate)
    one = np.ones(cut)
    return calibrated(training.net, training.net.logits([windows[i] for i in check]), labels[check], 0 * one, one, one)


def corpus_findings(docs: DataFrame, text_col: str) -> DataFrame:
    """window: the different windows of all candidates that the patterns know as secrets."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for piece in text_pieces(batches, text_col):
            windows = set()
            for text in piece.column(text_col).to_pylist():
                if base := base_spans(text or ""):
                    spans = [(s, e) for s, _, e in base]
                    windows.update(window(text, p) for a, b in candidates(text) for p in holding(places(a, b), [(s, e) for s, e in spans if s < b and a < e]))
            yield pa.RecordBatch.from_arrays([pa.array(sorted(windows), pa.string())], names=["window"])

    return docs.select(text_col).mapInArrow(run, "window string").distinct()


def averaged_epoch(learn: DataFrame, n: int, training: Training, windows: list[str], labels: np.ndarray, seed: int) -> None:
    """One epoch of ``training``, averaged over the parts of ``learn`` (``n`` windows), each with the made findings."""
    shipped = ship(learn.sparkSession, (training, windows, labels))

    def run(table: pa.Table) -> pa.Table:
        own, made, made_labels = shipped()
        part = table.column("part")[0].as_py()
        found = sorted(table.column("window").to_pylist())
        own.epoch(encoded(made + found), np.append(made_labels, np.ones(len(found))), np.random.default_rng([seed, own.steps, part]).permutation(len(made) + len(found)))
        value = np.rint(own.flat() * (len(found) / n) * FIXED).astype(np.int64)
        return pa.table([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value)], names=["place", "value"])

    sums = learn.groupBy("part").applyInArrow(run, "place int, value long").groupBy("place").agg(F.sum("value").alias("value"))
    training.put(np.array([r.value for r in sums.orderBy("place").collect()]) / FIXED)


def held_logits(held: DataFrame, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """The logits of the windows, in steps, and how many have each."""
    shipped = ship(held.sparkSession, net)

    def run(batches):
        own = shipped()
        for batch in batches:
            at = np.floor(np.clip(own.logits(batch.column("window").to_pylist()), -MOST_LOGIT, MOST_LOGIT) * LOGIT_STEPS)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], names=["at"])

    counts = held.select("window").mapInArrow(run, "at long").groupBy("at").count().orderBy("at").collect()
    return np.array([r.at for r in counts], float) / LOGIT_STEPS, np.array([r["count"] for r in counts], float)


def learn_network(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> Network:
    windows, labels = made_findings(np.random.default_rng(seed), MADE)
    found = stage(corpus_findings(docs, text_col), "secret-windows")
    n = found.count()
    if not n:
        return trained(windows, labels, seed)
    parts = -(-n // PART_WINDOWS)
    turn = F.xxhash64(F.lit(seed), "window")
    found = found.withColumns({"held": F.pmod(turn, F.lit(4)) == 0, "part": F.pmod(F.shiftright(turn, 8), F.lit(parts))})
    learn, n_learn = found.filter(~F.col("held")), found.filter(~F.col("held")).count()
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(labels))
    check, mine = order[: len(order) // 4], order[len(order) // 4 :]
    training = Training(rng)
    for _ in range(EPOCHS):
        if n_learn:
            averaged_epoch(learn, n_learn, training, [windows[i] for i in mine], labels[mine], seed)
        else:  # the few windows that there are happen to be held out
            training.epoch(encoded(windows), labels, rng.permutation(mine))
    logit, count = held_logits(found.filter("held"), training.net)
    made = training.net.logits([windows[i] for i in check])
    one = np.ones(len(check))
    return calibrated(
        training.net, np.append(made, logit), np.append(labels[check], np.ones(len(logit))), np.append(0 * one, np.ones(len(logit))), np.append(one, count),
        np.append(one, count * min(1.0, PART_WINDOWS / n)), 1 / LOGIT_STEPS)


def found_spans(texts: list[str | None], net: Network) -> list[list[dict]]:
    """The spans of each text: the patterns', then the candidates beside them that the network takes."""
    spans, rows, windows, firsts = [], [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text) if text else []
        spans.append(base)
        for a, b in candidates(text) if text else []:
            if not any(s < b and a < e for s, _, e in base):
                rows.append((i, a, b))
                firsts.append(len(windows))
                windows += [window(text, p) for p in places(a, b)]
    scores = np.maximum.reduceat(net.probability(windows), firsts) if rows else []
    for (i, a, b), p in zip(rows, scores):
        if p >= net.threshold:
            spans[i].append((a, 3, b))
    return [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(s)] for s in spans]


def with_secrets(docs: DataFrame, network: Network, out: str = "spans", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans (kind, start, end) of base and model findings, by start, then kind."""
    shipped = ship(docs.sparkSession, network)

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(found_spans(texts.to_pylist(), shipped()), ARROW_SPANS)]

    return with_text_columns(docs, text_col, [T.StructField(fresh(docs, out), SPANS)], compute)


def redacted(text: str | None, spans: list[dict], mark: str) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["end"] <= at:
            continue
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = s["end"]
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, network: Network, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding replaced by ``mark``; other texts stay as they are."""
    shipped, columns = ship(docs.sparkSession, network), docs.columns

    def run(batches):
        net = shipped()
        for piece in text_pieces(batches, text_col):
            texts = piece.column(text_col).to_pylist()
            found = found_spans(texts, net)
            new = pa.array([redacted(t, s, mark) for t, s in zip(texts, found)], piece.column(text_col).type) if any(found) else piece.column(text_col)
            yield pa.RecordBatch.from_arrays([new if c == text_col else piece.column(c) for c in columns], names=columns)

    return docs.mapInArrow(run, docs.schema)
