"""Spelling variants, whitening and MinHash near-duplicates against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefrank.llm import minhash, spelling, whitening
from tests.llm.test_pairs import UP, near_copies, roots


def pair_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[i:i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def expected_components(rows):
    sets = [(i, pair_shingles(t)) for i, t in rows]
    edges = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if None not in (i, j) and a and b and 100 * len(a & b) >= 80 * len(a | b)]
    root = roots([i for i, _ in rows if i is not None], edges)
    return Counter((i, len(s), None if i is None else root[i] if s else i, None if i is None else not s or root[i] == i) for i, s in sets)


@pytest.mark.parametrize("chunk", [1024, 4])
def test_near_duplicates(spark, chunk):
    texts = near_copies(11, 40)
    rows = list(enumerate(texts, start=5)) + [(5, texts[0]), (6, texts[9]), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, component_id int, node string").repartition(5)
    got = Counter(map(tuple, minhash.near_duplicates(docs, chunk_docs=chunk).collect()))
    assert got == expected_components(rows)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_one_family(spark):
    """A family of many chunks in which some members link only through others."""
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(120):
        own = list(base)
        for p in rnd.sample(range(150), rnd.choice([2, 6, 9, 12, 16])):
            own[p] = f"e{k}x{p}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = expected_components(rows)
    assert 1 < len({w[2] for w in want}) < 100
    for chunk in (7, 2000):
        assert Counter(map(tuple, minhash.near_duplicates(docs, chunk_docs=chunk).collect())) == want


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    signer = minhash.Signer()
    a = rng.integers(0, 2**64, 500, "u8")
    for share in (100, 250, 400, 475):
        b = np.concatenate([a[:share], rng.integers(0, 2**64, 500 - share, "u8")])
        true = share / (1000 - share)
        same = (signer.signature(a) == signer.signature(b)).mean()
        assert abs(same - true) < 5 * (true * (1 - true) / 512) ** 0.5
    # the rule keeps a pair at the threshold and drops one far below it at the first batch
    least = minhash.fewest_agreements(64, 80, 1e-6)
    assert 25 < least < 40 and minhash.fewest_agreements(512, 80, 1e-6) > 360


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def expected_variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_error(w, v)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 10 * n[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("chunk", [4096, 5])
def test_spelling_variants(spark, chunk, monkeypatch):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcé") for _ in range(rnd.choice([6, 7, 8, 9]))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "Äpfelmus", "äpfelmus", "straße×÷", "x" * 5000, "x" * 5001]
    def edited(w):
        k, c = rnd.randrange(len(w)), rnd.choice("abcdé")
        return rnd.choice([w[:k] + c + w[k + 1:], w[:k] + w[k + 1:], w[:k] + c + w[k:], w.upper()])
    rows = []
    for i in range(120):
        text = []
        for w in rnd.choices(words[:12], k=60) + rnd.choices(words, k=20):
            text.append(edited(w) if rnd.random() < 0.1 else w)
        rows.append((i, rnd.choice([" ", "1", "-", "\n"]).join(text)))
    rows += [(None, rows[0][1]), (3, rows[3][1]), (4, None), (5, ""), (6, " . ")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int").repartition(4)
    original = spelling.near_words
    monkeypatch.setattr(spelling, "near_words", lambda w: original(w, chunk_words=chunk))
    got = spelling.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = list(map(tuple, got.collect()))
    want = expected_variants(rows)
    assert len(got) == len(set(got)) and set(got) == want and any(w[1] for w in want)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_spelling_roots_follow_chains(spark):
    ways = [(f"w{i}", f"w{i + 1}") for i in range(18)] + [("a", "w3"), ("b", "a")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(ways, "word string, form string")).collect()))
    assert got == {w: "w18" for w, _ in ways}


def test_bit_slices():
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.choice([3, 4, 5]))) for _ in range(40)})
    index = spelling.BitSlices(words)
    for w in words + ["", "a", "zzzz", "abababab"]:
        found = {v for k, v in enumerate(words) if index.near(w) >> k & 1}
        assert found == {v for v in words if one_error(w, v)}


@pytest.mark.parametrize("case", ["random", "clustered", "multiple", "low rank", "one", "zero"])
def test_feast(case):
    rng = np.random.default_rng(4)
    d = {"one": 1}.get(case, 30)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    values = {"random": rng.random(d) * 50, "clustered": 100 + rng.random(d) * 1e-3, "multiple": np.repeat([9.0, 5.0, 1.0], 10), "low rank": np.r_[7.0, 3.0, np.zeros(28)], "one": np.array([3.0]), "zero": np.zeros(d)}[case]
    v = q * values @ q.T
    v = (v + v.T) / 2
    k = min(4, d)
    e, x = whitening.feast(v, k)
    want = np.sort(values)[::-1][:k]
    assert np.allclose(e, want, rtol=1e-12, atol=1e-11)
    assert np.abs(x.T @ x - np.eye(k)).max() < 1e-12 and np.abs(v @ x - x * e).max() < 1e-10
    for shift in (-1.0, 0.5, 4.0, 100.0005):
        assert whitening.above(v, shift) == (values > shift).sum()


def test_whitening(spark):
    rng = np.random.default_rng(9)
    vectors = (rng.normal(size=(300, 12)) * np.array([9, 7, 5, 3] + [1] * 8) + 2).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (400, None), (401, []), (402, [float("nan")] * 12), (403, [float("inf")] + [0.0] * 11), (404, [None] * 12), (405, [1.0, 2.0]), (406, (vectors[5] + 1e-6).tolist())]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, component string").repartition(4)
    model = whitening.train(df)
    got = whitening.whiten(df, model).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)")).collect()
    usable = [(i, np.floor(256 * np.array(v, "f4").astype("f8")).astype("i8")) for i, v in rows if v and len(v) == 12 and None not in v and np.isfinite(v).all()]
    fit = np.unique([x for _, x in usable], axis=0)
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    sign = np.sign((u * model.axes).sum(0))
    want = {}
    for i, x in usable:
        for c in range(4):
            want[i, c + 1] = (n, int(((n * x - s) ** 2).sum()), float((x - s / n) @ u[:, c] / np.sqrt(e[c]) * sign[c]), e[c] / (y.T @ y / n).trace())
    assert len(got) == 4 * len(usable)
    for r in got:
        a, b, w, x = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (a, b) and r["whitened"] == pytest.approx(w, abs=1e-9) and r["explained"] == pytest.approx(x, rel=1e-9) and r["identity_error"] < 1e-9
    assert whitening.whiten(df, whitening.train(df.limit(0))).count() == 0


def test_whitening_of_large_and_equal_vectors(spark):
    rows = [(i, [1e15 * i, float(i % 3), 1.0]) for i in range(20)] + [(99, [1e300, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df, whitening.train(df)).collect()
    assert {r["vec_id"] for r in got} == {*range(20), 99}
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.train(same).n == 1 and whitening.whiten(same, whitening.train(same)).count() == 0
