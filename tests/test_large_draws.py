"""Resamples of large strata: block digests, grid sums of credits."""

from hashlib import md5

import numpy as np
import pytest

from prefrank.operators import draws


def no_rows(*_, **__):
    raise AssertionError("drawn row by row")


@pytest.mark.parametrize("stratum", [None, "Brand#12", "é\U0001F600b", "x" * 48])
def test_block_digests_are_those_of_single_ones(stratum):
    n, name = 12_345, "" if stratum is None else f"{stratum}:"
    want = np.zeros((3, n))
    for r in (9, 10, 11):
        for p in range(n):
            h = md5(f"7:{r // 2}:{name}{p}".encode()).hexdigest()
            want[r - 9, int(h[16 * (r % 2):16 * (r % 2) + 15], 16) % n] += 1
    assert (draws.drawn(7, range(9, 12), stratum, n) == want).all()


def test_grid_sums_need_no_merge_of_all_columns(monkeypatch):
    rng = np.random.default_rng(2)
    n = 3000
    w = rng.integers(0, 4, (5, n)).astype(float)
    cases = [(rng.integers(0, 50, n) / 2, rng.random(n)), (rng.random(n), rng.random(n)), (np.zeros(n), rng.random(n)),
             (rng.integers(0, 900, n) * 6e-11 + rng.integers(0, 40, n), rng.integers(0, 700, n) * 1.0)]
    want = [draws.pair_sums(x, y, w)[0] if draws.value_blocks(x, 1e-10) is None else
            np.array([(np.einsum("i,ij,j", v, draws.credit_matrix(x, y, 1e-10), v) - v @ np.diag(draws.credit_matrix(x, y, 1e-10))) / 2 for v in w]) for x, y in cases]
    monkeypatch.setattr(draws, "near_partners", no_rows)
    for (x, y), c in zip(cases, want):
        assert (draws.pair_sums(x, y, w)[0] == c).all()


def test_few_values_of_one_score_need_no_grid(monkeypatch):
    rng = np.random.default_rng(4)
    n = 2600
    rows = rng.integers(0, 50, n) / 2
    cases = [(rows, rng.random(n)), (rng.random(n), rows), (rows + rng.integers(0, 2, n) * 3e-11, rng.integers(0, 900, n) * 1.0),
             (np.full(n, 3.0), rng.integers(0, 1500, n) * 1.0)]
    w = rng.integers(0, 4, (5, n)).astype(float)
    want = [draws.pair_sums(x, y, w)[0] for x, y in cases]
    for held in (1 << 26, 0):
        monkeypatch.setattr(draws, "HELD", held)
        for (x, y), c in zip(cases, want):
            steps = draws.Steps.of(x, y, 1e-10)
            assert (steps.sums(w[:, steps.order].astype("f4")) == c).all()
    assert (draws.Steps.of(*cases[0], 1e-10).sums(2000 * w[:, draws.Steps.of(*cases[0], 1e-10).order].astype("f4"))
            == draws.pair_sums(*cases[0], 2000 * w)[0]).all()
    assert draws.Steps.of(rng.random(n), rng.random(n), 1e-10) is None and draws.Steps.of(np.where(rows == 1, np.nan, rows), rows, 1e-10) is None


def test_short_blocks_are_hashed_for_many_pairs_together(monkeypatch):
    calls, one = [], draws.digests
    monkeypatch.setattr(draws, "digests", lambda heads, *rest: calls.append(len(heads)) or one(heads, *rest))
    got = draws.drawn(7, range(190, 230), "a", 3000)
    assert max(calls) > 10 and (got == np.vstack([draws.drawn(7, range(r, r + 1), "a", 3000) for r in range(190, 230)])).all()
