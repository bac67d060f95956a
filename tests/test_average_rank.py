"""F8 helper: the bucketed exact average rank equals pandas rank(method='average') under skew and ties."""

import numpy as np
import pandas as pd

from nestegg.operators.candidates import average_rank


def test_average_rank_hot_key_with_ties(spark):
    rng = np.random.default_rng(1)
    rows = []
    # One hot set with most rows and heavy ties (including a single value repeated many times),
    # a few small sets, NULLs sprinkled in.
    for i in range(6000):
        v = float(rng.choice([0.0, 0.0, 0.0, 5.0])) if i % 3 == 0 else float(rng.integers(0, 400))
        rows.append(("hot", f"p{i}", None if i % 97 == 0 else v))
    for s in range(5):
        for i in range(rng.integers(1, 30)):
            rows.append((f"s{s}", f"q{s}_{i}", float(rng.integers(0, 5))))
    df = spark.createDataFrame(rows, "cand_key string, product_id string, v double")
    for buckets in (2, 16, 128):
        got = average_rank(df, ["cand_key"], "v", buckets=buckets, out="r").toPandas()
        pdf = pd.DataFrame(rows, columns=["cand_key", "product_id", "v"])
        pdf["exp"] = pdf.groupby("cand_key")["v"].rank(method="average")
        m = pdf.merge(got, on=["cand_key", "product_id"])
        assert len(m) == len(rows)
        both_null = m["exp"].isna() & m["r"].isna()
        assert (both_null | (m["exp"] - m["r"]).abs().lt(1e-9)).all(), buckets
