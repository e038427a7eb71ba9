"""Pools of vectors by a key, summed inside tasks."""

import numpy as np
import pytest

from prefrank.operators import features as E


@pytest.mark.parametrize("held", [1 << 22, 12])
def test_same_pools_as_the_aggregation(spark, monkeypatch, held):
    monkeypatch.setattr(E, "HELD", held)
    rng = np.random.default_rng(3)
    rows = [(None if i % 11 == 0 else f"k{i % 7}", None if i % 13 == 0 else rng.normal(size=3).astype("f4").tolist(), float(rng.uniform(.1, 2))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, vec array<float>, w double").repartition(5)
    for how, weight in (("mean", None), ("mean", "w"), ("max", None), ("sum", None)):
        want = {r["k"]: r["vec"] for r in E.pooled(df, ["k"], "vec", how, weight).collect()}
        got = {r["k"]: r["vec"] for r in E.pooled_in_tasks(df, "k", "vec", how, weight).collect()}
        assert set(got) == set(want) and len(got) == 8
        for k, v in got.items():
            np.testing.assert_allclose(v, want[k], rtol=1e-12, atol=1e-14)
    assert E.pooled_in_tasks(df.limit(0), "k", "vec").count() == 0


def test_rows_of_vectors_are_not_shuffled(spark):
    """The aggregation reads the tasks' pools: at most one for each task and key, not the rows."""
    df = spark.range(4000, numPartitions=4).selectExpr("concat('k', id % 200) AS k", "array(cast(id AS float), 1f) AS vec")
    plan = E.pooled_in_tasks(df, "k", "vec")._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("MapInArrow") > plan.rindex("Exchange") > 0
