"""Streams of conversations and prompts give the batch results, also when restarted, doubled or replayed."""

import os
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from nestegg.operators.text import conversation_state
from nestegg.streaming import conversations as C

SF = "/root/testdata/sf0.001"
START = datetime(2026, 1, 1, 12)
DDL = "conv_id long, turn long, role string, text string, event_time timestamp"


def rows_of(n_conv, n_turns):
    """Turns of a conversation are hours apart, so that conversations cross several spans of a day."""
    return [(c, t, "assistant" if t % 2 else "user", f"text {c} {t}" if t % 5 else None, START + timedelta(hours=5 * t, minutes=c)) for t in range(n_turns) for c in range(n_conv)]


def folders():
    scratch = tempfile.mkdtemp(prefix="nestegg-conv-")
    return [os.path.join(scratch, x) for x in ("in", "out", "ckpt")]


def run(spark, src, out, ckpt):
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(src)
    query = C.run_states(stream, out, ckpt)
    query.awaitTermination(180)
    assert query.exception() is None


def batch_of(spark, rows):
    return sorted(map(tuple, conversation_state(spark.createDataFrame(rows, DDL)).collect()))


def test_restarted_stream_equals_batch_with_doubled_and_late_turns(spark):
    src, out, ckpt = folders()
    rows = rows_of(6, 12)
    half = len(rows) // 2
    put = lambda some: spark.createDataFrame(some, DDL).coalesce(1).write.mode("append").parquet(src)
    put(rows[:half])
    run(spark, src, out, ckpt)
    assert sorted(map(tuple, C.current_states(spark, out).collect())) == batch_of(spark, rows[:half])
    # Restart from the same checkpoint: some turns arrive again, others are a little out of order.
    put(rows[half - 6 :])
    put(rows[-6:])
    run(spark, src, out, ckpt)
    columns = conversation_state(spark.createDataFrame(rows, DDL)).columns
    got = C.current_states(spark, out)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect())) == batch_of(spark, rows)
    # A turn far behind the watermark is left out, one within it counts.
    late = (0, 99, "user", "far too late", START - timedelta(days=9))
    near = (1, 99, "user", "just in time", rows[-1][4] - timedelta(minutes=30))
    put([late, near])
    run(spark, src, out, ckpt)
    assert sorted(map(tuple, C.current_states(spark, out).collect())) == batch_of(spark, [*rows, near])


def test_suggestions_end_with_the_next_user_turn(spark):
    src, out, ckpt = folders()
    turns = [(1, t, r, "x", START + timedelta(minutes=t)) for t, r in enumerate(["user", "assistant", "user"])]
    valid = []
    for row in turns:
        spark.createDataFrame([row], DDL).coalesce(1).write.mode("append").parquet(src)
        run(spark, src, out, ckpt)
        valid.append(C.current_states(spark, out).first().suggestions_valid)
    assert valid == [False, True, False]


def test_replayed_batch_adds_no_row(spark):
    _, out, _ = folders()
    write = C.replace_batch(out)
    states = C.span_states(spark.createDataFrame(rows_of(3, 4), DDL))
    write(states, 7)
    first = sorted(map(str, C.batches(spark, out, C.STATES).collect()))
    write(states, 7)
    assert sorted(map(str, C.batches(spark, out, C.STATES).collect())) == first


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_prompt_stream_equals_batch_and_meets_the_current_portfolio(spark):
    from nestegg.plans.queries import Context, vectors_of
    from nestegg.operators.chat import chat_prompts

    ctx, (src, out, ckpt) = Context(spark, SF), folders()
    turns = ctx.fx("fx_turns")
    turns.where("turn <= 1").coalesce(1).write.parquet(src)
    calls = []

    def portfolio(session):
        calls.append(session)
        return ctx.chat_portfolio

    def once():
        stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(src)
        query = C.run_prompts(stream, portfolio, ctx.vector_documents, vectors_of(ctx), out, ckpt)
        query.awaitTermination(240)
        assert query.exception() is None

    once()
    again = turns.where("turn > 1").coalesce(1)
    again.unionByName(again.limit(5)).coalesce(1).write.mode("append").parquet(src)  # doubled turns
    once()
    want = chat_prompts(turns, ctx.chat_portfolio, ctx.vector_documents, vectors_of(ctx))
    got = C.batches(spark, out, want.schema)
    assert len(calls) == 2 and got.select("batch_id").distinct().count() == 2
    key = lambda df: sorted(map(str, df.select(*want.columns).collect()))
    assert key(got) == key(want)
    # The last batch again, as after a failure between the write and the commit.
    folder = max(os.listdir(out))
    same = spark.createDataFrame(spark.read.schema(want.schema).parquet(f"{out}/{folder}").collect(), want.schema)
    C.replace_batch(out)(same, int(folder.split("=")[1]))
    assert key(C.batches(spark, out, want.schema)) == key(want)
