"""Orders of raters by hashes made together, and curves whose sizes have orders of their own, against brute force."""

import hashlib

import numpy as np
import pytest

from prefrank.operators import draws, panel as H, panel_draws as D
from tests.test_panel_draws import credit, make, mean

KS, ITERATIONS, SEED = [1, 3, 8], 4, 5


def test_hashes_of_names_of_all_lengths():
    names = [*range(0, 200_000, 7), "", "a" * 60, "émile"]
    heads = [b"9:12:", b"9:7:", b"9:13:"]
    want = [[int(hashlib.md5(head + str(n).encode()).hexdigest()[:8], 16) for n in names] for head in heads]
    held = draws.Names(names)
    assert held.hashes(heads).tolist() == want
    assert min(map(len, [rows for rows, _ in held.blocks])) < draws.FEW <= max(len(rows) for rows, _ in held.blocks)
    order = [np.lexsort((np.arange(len(w)), w)) for w in want]
    for top in (40, len(names)):
        assert D.first_raters([h.decode() for h in heads], held, top).tolist() == [o[:top].tolist() for o in order]


@pytest.mark.parametrize("limit", [None, "8"])
def test_sizes_with_orders_of_their_own(spark, monkeypatch, limit):
    rows = make()
    d = spark.createDataFrame(rows, "category string, block_id int, respondent long, item long, similarity double").repartition(3)
    want = {}
    truth = {(c, i): mean([r[4] for r in rows if (r[0], r[3]) == (c, i)]) for c, _, _, i, _ in rows}
    for c, b in {r[:2] for r in rows}:
        mine = [r for r in rows if r[:2] == (c, b)]
        raters, items = {r[2] for r in mine}, {r[3] for r in mine}
        for k in KS:
            for it in range(ITERATIONS if len(raters) > k else 0):
                who = sorted(raters, key=lambda r: (hashlib.md5(f"{SEED}:{k}:{it}:{r}".encode()).hexdigest()[:8], r))[:k]
                one = credit({i: truth[c, i] for i in items}, {i: mean([r[4] for r in mine if r[2] in who and r[3] == i]) for i in items})
                old = want.get((k, it), (0, 0))
                want[k, it] = (old[0] + one[0], old[1] + one[1])
    if limit:
        spark.conf.set("spark.prefrank.groupRows", limit)
    else:
        def windows(*_):
            raise AssertionError("a row for each rater, size and iteration")
        monkeypatch.setattr(H, "_window_parts", windows)
    try:
        got = {(r["k"], r["iteration"]): r["pairwise_accuracy"] for r in H.group_size_curve(d, d, KS, ITERATIONS, SEED).collect()}
    finally:
        spark.conf.unset("spark.prefrank.groupRows")
    assert {k: round(v, 9) for k, v in got.items() if v is not None} == {k: round(c / p, 9) for k, (c, p) in want.items() if p}
