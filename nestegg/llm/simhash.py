"""SimHash near-dedup: fingerprints, BK-trees over shards of them, connected components.

Fingerprint: a text is lower-cased (A-Z) and split into words at ASCII space; the XXH64 (seed 42)
of each run of ``shingle`` words votes for 64 bits.

Search: fingerprints that differ in at most r bits agree on all but r of any m blocks of the 64
bits, so each fingerprint goes to C(m, r) shards, keyed by the bits of m - r blocks. With m = 8
and r = 2, the fingerprints of a shard share 48 bits, thus a shard holds at most 65536 different
ones however many documents fall into it: no shard needs a cap. A task builds the BK-tree of a
shard (children keyed by the integer Hamming distance to the parent), follows only edges within
the radius, and returns a spanning forest of the shard's links instead of all pairs. Trees travel
to the tasks by the shuffle, as broadcasting them would bring all fingerprints to the driver.

Components: large-star / small-star rounds over the links, each staged in the shared folder.
A round that changes nothing ends them.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; fewer words
than a shingle form one shingle; equal fingerprints are one node, so exact copies cost nothing;
rows that repeat a doc_id stay rows; null ids are never representatives unless a whole component
has no other. One row of each component is kept, however many components share their smallest id
(or have none).
"""

from __future__ import annotations

from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestegg.llm.common import as_bytes, fresh, shuffle_partitions, stage, with_text_columns

SHINGLE, RADIUS, BLOCKS, SEED = 3, 2, 8, 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
HASHES_AT_ONCE = 1 << 17


def majority(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes set each bit, highest bit first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, shingle: int) -> int:
    words = text.translate(LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[:n].tolist(), ends[len(words) - n :].tolist())
    hashes = (digest(joined[a:b], SEED) for a, b in pairs)
    votes = np.zeros(64, np.int64)
    while len(some := np.fromiter(islice(hashes, HASHES_AT_ONCE), np.uint64)):
        votes += majority(some)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint as a long (the same 64 bits)."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        prints = np.fromiter(map(fingerprint, as_bytes(texts), repeat(shingle)), np.uint64, len(texts))
        return [pa.array(prints.view(np.int64))]

    return with_text_columns(docs, text_col, [T.StructField(out, T.LongType())], compute)


class BKTree:
    """Each node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        node = 0
        if self.values:
            while True:
                d = (self.values[node] ^ value).bit_count()
                if d not in self.children[node]:
                    self.children[node][d] = len(self.values)
                    break
                node = self.children[node][d]
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            children = self.children[node]
            todo += [children[k] for k in range(max(0, d - radius), d + radius + 1) if k in children]
        return found


def spanning_links(prints: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what the shard's tree finds connected: at most one fewer than fingerprints."""
    tree, root, links = BKTree(), list(range(len(prints))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, value in enumerate(prints):
        unsigned = value & 0xFFFFFFFFFFFFFFFF
        for j in tree.within(unsigned, radius):
            if (a := find(i)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
                links.append((value, prints[j]))
        tree.add(unsigned)
    return links


def shard_masks(radius: int, blocks: int) -> list[int]:
    width = 64 // blocks
    masks = [sum(((1 << width) - 1) << (width * b) for b in kept) for kept in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): a spanning set of the links between the distinct fingerprints of column ``fp``."""
    masks = F.array(*[F.struct(F.lit(i).cast("byte").alias("table"), F.lit(m).alias("mask")) for i, m in enumerate(shard_masks(radius, blocks))])
    shards = (
        prints.select("fp").repartition(shuffle_partitions(prints.sparkSession), "fp").distinct()
        .select("fp", F.explode(masks).alias("m"))
        .groupBy(F.col("m.table").alias("table"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("key"))
        .agg(F.collect_list("fp").alias("prints"))
        .filter(F.size("prints") > 1)
        .select("prints")
    )

    def run(batches):
        for batch in batches:
            links = [x for prints in batch.column("prints").to_pylist() for x in spanning_links(sorted(prints), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return shards.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links; root is the least node of its component.

    Large-star then small-star: each round links the neighbours of a node to the least of them.
    Groups pre-aggregate to one minimum; a node with many neighbours stands on one side of a join
    that Spark may split.
    """
    a, b = F.col("a"), F.col("b")

    def edges(df: DataFrame) -> DataFrame:
        return df.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()

    def large_star(df: DataFrame) -> DataFrame:
        both = df.union(df.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        return edges(both.filter(b > a).join(least, "a").select(b.alias("a"), F.col("least").alias("b")))

    def small_star(df: DataFrame) -> DataFrame:
        least = df.groupBy("a").agg(F.min("b").alias("least"))
        pulled = df.join(least, "a").select(b.alias("a"), F.col("least").alias("b"))
        return edges(pulled.union(least.select("a", F.col("least").alias("b"))))

    now = stage(edges(links), "links")
    while True:
        new = stage(small_star(large_star(now)), "links")
        # The same number of links, and each of the old ones among the new: nothing changed.
        if new.count() == now.count() and now.join(new, ["a", "b"], "left_anti").isEmpty():
            return new.select(a.alias("node"), b.alias("root"))
        now = new


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS, keep_columns: bool = False) -> DataFrame:
    """One row for each document: uid, ``id_col``, fingerprint (long), component id (its smallest document id), root.

    The root is the component's least fingerprint: unlike the component id, it is never null, and no
    two components share it. ``keep_columns`` stages and returns the other columns of the documents too.
    """
    rows = fingerprinted(docs if keep_columns else docs.select(id_col, text_col), text_col, shingle, keep_columns)
    return with_components(rows, docs, id_col, radius)


def fingerprinted(docs: DataFrame, text_col: str, shingle: int, keep_text: bool) -> DataFrame:
    """``docs`` with fingerprint and uid, staged."""
    rows = with_fingerprint(docs, text_col, fresh(docs, "fp"), shingle)
    return stage((rows if keep_text else rows.drop(text_col)).withColumn(fresh(docs, "uid"), F.monotonically_increasing_id()), "simhash")


def with_components(rows: DataFrame, docs: DataFrame, id_col: str, radius: int) -> DataFrame:
    """The fingerprinted ``rows`` with component id and root."""
    fp, comp, root = (fresh(docs, n) for n in ("fp", "component_id", "component_root"))
    nodes = stage(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("least_id")), "simhash-nodes")
    found = components(fingerprint_links(nodes, radius)).withColumnRenamed("node", "fp")
    nodes = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = nodes.groupBy("root").agg(F.min("least_id").alias(comp))
    member = nodes.select("root", F.col("fp").alias("node_fp")).join(least, "root").withColumnRenamed("root", root)
    return rows.join(member, F.col(fp) == F.col("node_fp")).drop("node_fp")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One document of each component: the one with its smallest id (of rows that repeat it, one).

    What goes is found on the ids and fingerprints alone; the texts meet the uids that go in one anti join.
    """
    fp, uid, comp, root = (fresh(docs, n) for n in ("fp", "uid", "component_id", "component_root"))
    rows = fingerprinted(docs, text_col, shingle, keep_text=True)
    found = with_components(rows.select(id_col, fp, uid), docs, id_col, radius)
    first = found.filter(F.col(id_col).eqNullSafe(F.col(comp))).groupBy(root).agg(F.min(uid).alias("kept_uid"))
    first = first.withColumnRenamed(root, "kept_root")
    gone = found.join(first, F.col(root) == F.col("kept_root")).filter(F.col(uid) != F.col("kept_uid")).select(uid)
    return rows.join(stage(gone, "simhash-gone"), uid, "left_anti").select(*docs.columns)
