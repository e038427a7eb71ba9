"""Medians of resamples of more rows than a task may hold."""

import numpy as np

from prefrank.operators import draws, resample as B


def no_rows(*_, **__):
    raise AssertionError("drawn row by row")


def test_medians_of_many_rows_are_not_drawn_row_by_row(spark, tiny_groups, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i * 3, None if i % 17 == 5 else float(rng.integers(0, 90)) / 4) for i in range(400)]
    df = spark.createDataFrame(rows, "item long, v double").repartition(3)
    spark.conf.set("spark.prefrank.groupRows", "1000")
    want = dict(map(tuple, B.bootstrap_median(df, "item", "v", 60, 3).collect()))
    spark.conf.set("spark.prefrank.groupRows", "40")
    monkeypatch.setattr(B, "bootstrap_weights", no_rows)
    assert dict(map(tuple, B.bootstrap_median(df, "item", "v", 60, 3).collect())) == want


def test_medians_outside_the_coded_part_widen_it(spark, tiny_groups, monkeypatch):
    rows = [(i, float(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "item long, v double")
    want = {r: float(np.median(np.repeat(np.arange(300), w.astype(int)))) for r, w in enumerate(draws.drawn(3, range(0, 40), None, 300))}
    seen, plain = [], draws.middle_codes
    monkeypatch.setattr(B, "REACH", 0.05)
    monkeypatch.setattr(draws, "middle_codes", lambda *a: seen.append(a[-1]) or plain(*a))
    assert dict(map(tuple, B.bootstrap_median(df, "item", "v", 40, 3).collect())) == want
    assert len(seen) > 1
