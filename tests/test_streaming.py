"""Stateless profile and turn streams give the batch results."""

import os
import tempfile
import uuid

from conftest import SURVEY_DDL, survey_row

from nestegg.operators.survey import build_profiles
from nestegg.streaming.profiles import profile_stream, survey_stream, turn_stream, write_stream


def test_profile_stream_equals_batch(spark):
    scratch = tempfile.mkdtemp(prefix="nestegg-stream-")
    src, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    rows = [survey_row(i, age=20 + i, period=i % 12, loss_level=1 + i % 4) for i in range(30)]
    batch = spark.createDataFrame(rows, SURVEY_DDL)
    batch.limit(15).write.parquet(src, mode="append")
    batch.subtract(batch.limit(15)).write.parquet(src, mode="append")
    q = write_stream(profile_stream(survey_stream(spark, src, max_files=1)), out, os.path.join(scratch, f"ckpt-{uuid.uuid4().hex}"))
    q.awaitTermination(120)
    got = {r.user_id: (r.risk_score, r.risk_preference, r.is_silver) for r in spark.read.parquet(out).collect()}
    exp = {r.user_id: (r.risk_score, r.risk_preference, r.is_silver) for r in build_profiles(batch).collect()}
    assert got == exp


def test_turn_stream(spark):
    scratch = tempfile.mkdtemp(prefix="nestegg-turns-")
    src, out = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    spark.createDataFrame([(1, 0, "user", " 추천 "), (1, 1, "assistant", "질문 하나입니다\nshort\n질문 둘입니다")],
                          "conv_id long, turn long, role string, text string").write.parquet(src)
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(src)
    q = write_stream(turn_stream(stream), out, os.path.join(scratch, f"ckpt-{uuid.uuid4().hex}"))
    q.awaitTermination(120)
    got = {r.turn: r for r in spark.read.parquet(out).collect()}
    assert got[0].intent == "recommend" and got[0].is_recommendation is True
    assert list(got[1].questions) == ["질문 하나입니다", "질문 둘입니다"]
