"""Curves over group sizes and split halves against brute force, in a task and by windows."""

import hashlib
import random

import pytest

from prefrank.operators import panel_draws as D

SEED, ITERATIONS, LARGEST = 3, 6, 7


def make():
    rnd = random.Random(4)
    rows = []
    for category, block, raters, items in (("a", 0, 9, 5), ("a", 1, 4, 3), ("b", 0, 1, 4), (None, 0, 12, 3), ("c", 0, 3, 2)):
        for r in range(raters):
            for i in range(items):
                if rnd.random() < 0.8:
                    rows.append((category, block, 100 * block + r, 10 * block + i, rnd.choice([1.0, 2.0, 3.0, 3.0 + 0.5e-10, 4.0, None])))
    return rows


def order(raters, it):
    return sorted(raters, key=lambda r: (hashlib.md5(f"{SEED}:{it}:{r}".encode()).hexdigest()[:8], r))


def mean(values):
    known = [v for v in values if v is not None]
    return sum(known) / len(known) if known else None


def credit(a, b):
    """(correct, pairs) of two dictionaries of scores by item."""
    both = [i for i in a if a[i] is not None and b.get(i) is not None]
    correct = pairs = 0
    for n, i in enumerate(both):
        for j in both[:n]:
            dx, dy = a[i] - a[j], b[i] - b[j]
            correct += 0.5 if abs(dx) < 1e-10 or abs(dy) < 1e-10 else float(dx * dy > 0)
            pairs += 1
    return correct, pairs


def brute(rows):
    curve, half = {}, {}
    truth = {(c, i): mean([r[4] for r in rows if (r[0], r[3]) == (c, i)]) for c, _, _, i, _ in rows}
    for c, b in {r[:2] for r in rows}:
        mine = [r for r in rows if r[:2] == (c, b)]
        raters, items = sorted({r[2] for r in mine}), {r[3] for r in mine}
        means = lambda who: {i: mean([r[4] for r in mine if r[2] in who and r[3] == i]) for i in items}
        for it in range(ITERATIONS):
            who = order(raters, it)
            parts = [(curve, (k, it), credit({i: truth[c, i] for i in items}, means(who[:k]))) for k in range(1, min(LARGEST, len(raters) - 1) + 1)]
            if len(raters) >= 4:
                parts.append((half, it, credit(means(who[:len(raters) // 2]), means(who[len(raters) // 2:]))))
            for table, key, (correct, pairs) in parts:
                old = table.get(key, (0, 0))
                table[key] = (old[0] + correct, old[1] + pairs)
    return tuple({k: round(c / p, 9) for k, (c, p) in t.items() if p} for t in (curve, half))


@pytest.mark.parametrize("limit", [None, "20", "8"])
def test_curve_and_halves(spark, limit):
    """All blocks in tasks, some by windows, and most by windows whose groups are cut as well."""
    rows = make()
    d = spark.createDataFrame(rows, "category string, block_id int, respondent long, item long, similarity double").repartition(3)
    curve, half = brute(rows)
    if limit:
        spark.conf.set("spark.prefrank.groupRows", limit)
    try:
        got = {(r["k"], r["iteration"]): round(r["pairwise_accuracy"], 9) for r in D.prefix_curve(d, d, LARGEST, ITERATIONS, SEED, per_task=4).collect()}
        assert got == curve
        got = {r["iteration"]: round(r["pairwise_accuracy"], 9) for r in D.split_half_draws(d, ITERATIONS, SEED, per_task=4).collect()}
        assert got == half
    finally:
        spark.conf.unset("spark.prefrank.groupRows")
    assert D.prefix_curve(d.limit(0), d.limit(0), LARGEST, 2, SEED).count() == 0 and D.split_half_draws(d.limit(0), 2, SEED).count() == 0
