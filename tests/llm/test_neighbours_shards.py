"""The hash-prefix forest on clustered vectors, and queries that come by the shuffle."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from nestegg.llm import neighbours as nb


def vectors(spark, folder, x, ids=None):
    ids = np.arange(len(x)) if ids is None else ids
    flat = pa.array(x.astype(np.float32).ravel())
    table = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), flat)})
    pq.write_table(table, folder / "vectors.parquet", row_group_size=20_000)
    return spark.read.parquet(str(folder / "vectors.parquet"))


def found(df, step, k=20):
    got = defaultdict(list)
    for r in nb.nearest_neighbours(df, F.col("vec_id") % step == 0, k).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.id)
    return got


def recall(got, x, step, k=20):
    x, hits = x.astype(np.float32).astype(np.float64), 0
    for q in range(0, len(x), step):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(got[q]) & set(np.argpartition(-score, k)[:k].tolist()))
    return hits / (k * len(range(0, len(x), step)))


def test_recall_on_many_clustered_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(400, 32))
    x = centres[rng.integers(0, 400, 100_000)] + 0.25 * rng.normal(size=(100_000, 32))
    got = found(vectors(spark, tmp_path, x), 500)
    assert len(got) == 200 and recall(got, x, 500) >= 0.95


def test_clustered_vectors_need_a_small_share():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 32))[rng.integers(0, 100, 4000)] + 0.1 * rng.normal(size=(4000, 32))
    assert nb.smallest_share(np.arange(4000), x, nb.Plan(nb.projections_of(32, 42), 1.0), 20) <= 0.1


def test_hot_id_and_hot_vector_are_dealt_over_the_shards(spark, tmp_path):
    rng = np.random.default_rng(5)
    x, ids = rng.normal(size=(3000, 8)), np.arange(3000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)  # so that nothing is nearer than the same vector
    x[1000:2000], ids[1000:2000] = x[0], 40
    df = vectors(spark, tmp_path, x, ids)
    got = found(df, 20)
    assert got[0] == [40] * 20  # repeated rows of an id are candidates each
    assert 40 not in got[40] and len(got[40]) == 20  # and one query, without its own rows


def test_plan_has_no_broadcast(spark, tmp_path):
    df = vectors(spark, tmp_path, np.random.default_rng(6).normal(size=(200, 8)))
    plan = nb.nearest_neighbours(df, F.col("vec_id") % 20 == 0, 5)._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan
