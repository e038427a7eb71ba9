"""Listed draws are made inside tasks, and are the ones made row by row."""

import pytest

from prefrank.operators import resample as B


@pytest.mark.parametrize("strata", [["category"], ["category", "part"], []])
def test_same_draws_as_row_by_row(spark, monkeypatch, strata):
    rows = [(["a", "b", "", None][i % 4], i % 3 if i % 5 else None, f"u{i}") for i in range(240)]
    d = spark.createDataFrame(rows, "category string, part int, item string").repartition(3)
    read = lambda: sorted(map(str, B.bootstrap_weights(d, strata, "item", 7, 9).collect()))
    spark.conf.set("spark.prefrank.groupRows", "3")
    try:
        want = read()
    finally:
        spark.conf.unset("spark.prefrank.groupRows")

    def no_rows(*_):
        raise AssertionError("a row for each draw")

    monkeypatch.setattr(B, "replicate_index", no_rows)
    assert read() == want
