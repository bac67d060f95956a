"""Task sizes follow the input."""

import pytest

from nestegg import session
from nestegg.plans.queries import Context


@pytest.fixture
def conf(spark):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    old = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.unset(k)
    yield lambda i: spark.conf.get(keys[i], None)
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_shuffles_and_splits_follow_the_input(spark, conf, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "SHUFFLE_ROWS", 10)
    spark.range(3000).withColumnRenamed("id", "l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    Context(spark, str(tmp_path))._bound_tasks()
    assert conf(0) == str(session.SPLIT_BYTES) and conf(1) == "300"
    session.bound_tasks(spark, 50)  # a smaller table keeps the larger number
    assert conf(1) == "300"


def test_a_session_keeps_its_own_split_size(spark, conf):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    session.bound_tasks(spark, 1)
    assert conf(0) == "4m" and conf(1) is None
