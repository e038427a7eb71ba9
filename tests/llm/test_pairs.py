"""Similarity join, components, nearest neighbours and repeated bytes against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from prefrank.llm import components, jaccard, lines, neighbours, suffix

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(nodes, edges):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def near_copies(seed, n):
    """Families of edited copies with similarities around the threshold, plus odd texts."""
    rnd = random.Random(seed)
    texts = []
    for _ in range(n):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([1, 3, 5, 8, 30, 90, 200]))]
        for _ in range(rnd.choice([1, 2, 6, 12])):
            own = list(base)
            for _ in range(rnd.randrange(0, 1 + len(own) // 25)):
                own[rnd.randrange(len(own))] = f"e{rnd.randrange(10 ** 6)}"
            texts.append(" ".join(own))
    return texts + [None, "", " \t\n", "One", "one", "ONE two", "É a b c d", "é a b c d", "x " * 3000]


@pytest.mark.parametrize("chunk", [1024, 3])
def test_link_components(spark, chunk):
    texts = near_copies(7, 40)
    rows = list(enumerate(texts, start=5)) + [(5, texts[0]), (6, texts[9]), (None, texts[0])]
    sets = [(i, shingles(t)) for i, t in rows]
    edges = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if None not in (i, j) and a and b and 100 * len(a & b) >= 85 * len(a | b)]
    root = roots([i for i, _ in rows if i is not None], edges)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int").repartition(5)
    got = jaccard.link_components(docs, chunk_docs=chunk).collect()
    want = Counter((i, len(s), None if i is None else root[i] if s else i) for i, s in sets)
    assert Counter(map(tuple, got)) == want
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {None} | {i for i, s in sets if i is not None and (root[i] == i or not s)}
    assert jaccard.link_components(docs.limit(0)).count() == 0


def test_one_of_each_keeps_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (1, "b own text of one"), (1, "a own text of one"), (2, ""), (2, " \t"), (2, "only words of two here"), (3, long), (4, None), (4, long + " more"), (5, long), (6, " "), (None, long), (None, None)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, source int").repartition(4)
    got = {r["source"] for r in jaccard.one_of_each(docs).collect()}
    # 1 and 2 keep their first text with words; 4 and 5 lose theirs to 3; rows without words or id stay
    assert got == {0, 2, 3, 4, 5, 6, 7, 10, 11, 12}


def test_linked_sets_share_a_directory_key():
    rnd = random.Random(3)
    for _ in range(400):
        n = rnd.choice([1, 2, 6, 7, 15, 16, 31, 60, 127, 128, 500])
        a = {rnd.getrandbits(64) for _ in range(n)}
        b = set(a)
        while 100 * len(a & b) >= 85 * len(a | b):
            x, y = (np.array(sorted(s), "u8") for s in (a, b))
            assert set(jaccard.directory_keys(x)) & set(jaccard.directory_keys(y))
            b = set(b)
            if rnd.random() < 0.5 and b:
                b.discard(rnd.choice(sorted(b)))
            else:
                b.add(rnd.getrandbits(64))


def test_linked_sets_share_the_sure_number_of_keys():
    rnd = random.Random(5)
    for percent in (80, 85):
        for n in [1, 2, 3, 6, 7, 15, 16, 31, 60, 127, 128, 500, 511, 512]:
            a = {rnd.getrandbits(64) for _ in range(n)}
            b = set(a)
            while 100 * len(a & b) >= percent * len(a | b):
                x, y = (jaccard.directory_keys(np.array(sorted(s), "u8"), percent) for s in (a, b))
                level = max(len(a), len(b)).bit_length() - 1
                assert sum(int(k) % jaccard.LEVELS == level for k in set(x.tolist()) & set(y.tolist())) >= jaccard.sure(level)
                b = set(b)
                if rnd.random() < 0.5 and b:
                    b.discard(rnd.choice(sorted(b)))
                else:
                    b.add(rnd.getrandbits(64))


def test_common_passages_make_no_large_family(spark, monkeypatch):
    rnd = random.Random(11)
    passages = [[f"p{k} {i}" for i in range(15)] for k in range(8)]
    texts = [" ".join(w for p in rnd.sample(passages, 3) for w in [*p, *[f"o{rnd.randrange(10 ** 9)}" for _ in range(35)]]) for _ in range(500)]
    texts += [t + " end" for t in texts[:40]]
    largest, tiles = [], jaccard.tiles

    def seen(docs, families, *sizes):
        largest.append(max(r["count"] for r in families.groupBy("root").count().collect()))
        return tiles(docs, families, *sizes)

    monkeypatch.setattr(jaccard, "tiles", seen)
    got = jaccard.link_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), shingle=5, percent=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - 500 if i >= 500 else i for i in range(540)}
    # before, nearly all of them made one, whose chunks all met
    assert largest[0] < 50


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(200, 260)] + [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(300, i) for i in range(301, 340)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    want = roots({i for e in edges for i in e}, edges)
    assert got == {i: r for i, r in want.items() if any(i in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(5)
    vectors = np.round(rng.normal(size=(400, 12)), 1).astype("float32")
    vectors[50] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(0, vectors[0].tolist()), (500, None), (600, [0.0] * 12), (700, [float("nan")] * 12), (800, [1.0, None]), (None, [1.0] * 12), (900, [1.0, 2.0]), (901, [1.0, 3.0]), (902, []), (903, [1e30] * 12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in neighbours.nearest(df.where("vec_id % 100 = 0 OR vec_id > 900"), df, k=5, query_rows=3, block_rows=32).collect()}
    usable = {i: np.array(v, "f4").astype("f8") for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    want = {}
    for q in [i for i in usable if i % 100 == 0 or i > 900]:
        near = sorted((float(np.sqrt(sum((x - y) ** 2 for x, y in zip(usable[q], v)))), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:5]
        want |= {(q, r): (i, d) for r, (d, i) in enumerate(near, 1)}
    assert got == want
    assert neighbours.nearest(df.limit(0), df).count() == 0 and neighbours.nearest(df, df.limit(0)).count() == 0


def test_nearest_counts_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(np.round(rng.normal(size=(60, 6)), 1))]
    rows += [(7, rows[7][1])] * 12 + [(0, rows[0][1])] * 3
    # one id with many vectors near the query, and a query with several vectors
    rows += [(8, [x + 0.01 * (1 + j) for x in rows[0][1]]) for j in range(15)] + [(50, (-np.array(rows[50][1]) * s).tolist()) for s in (1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    near = {}
    for q, a in rows:
        for c, b in rows:
            if q % 50 == 0 and c != q:
                near[q, c] = min(near.get((q, c), np.inf), float(np.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))))
    want = {(q, r, c) for q in (0, 50) for r, (_, c) in enumerate(sorted((d, c) for (p, c), d in near.items() if p == q)[:5], 1)}
    for rows_in_block in (16, 2048):
        got = neighbours.nearest(df.where("vec_id % 50 = 0"), df, k=5, block_rows=rows_in_block).collect()
        assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == want
        assert all(r["score"] == pytest.approx(near[r["query_id"], r["vec_id"]]) for r in got)


@pytest.mark.parametrize("largest", [512, 1])
def test_repeated_bytes(spark, largest):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdé ") for _ in range(60))
    shared = [word() for _ in range(4)]
    texts = [word() + rnd.choice(shared) + word() + rnd.choice(shared) for _ in range(30)] + [None, "", "short", "x" * 500, "ab" * 300, "ab" * 300, word() * 5]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (4, "other " * 40)]
    depth = 40
    count = Counter()
    for _, t in rows:
        d = (t or "").encode()
        count.update(d[i:i + depth] for i in range(len(d) - depth + 1))
    want = Counter()
    for i, t in rows:
        d = (t or "").encode()
        hit = np.zeros(len(d), bool)
        for s in range(len(d) - depth + 1):
            if count[d[s:s + depth]] > 1:
                hit[s:s + depth] = True
        want[i, len(d), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(d, "u1")[~hit].tobytes()).hexdigest()] += 1
    docs = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, kept binary")
    got = suffix.without_repeats(docs, depth=depth, gram=16, largest=largest)
    assert Counter(tuple(r)[:5] for r in got.collect()) == want
    assert suffix.without_repeats(docs.limit(0)).count() == 0


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 300)
    rnd = random.Random(4)
    data = bytes(rnd.randrange(97, 123) for _ in range(2000))
    covered = [s + i for s, n, _, _ in suffix.runs(data, 100, 32) for i in range(n)]
    assert covered == list(range(len(data) - 99))


def test_line_chunks(spark):
    block = "\n".join(f"license line {i}" for i in range(12))
    texts = [f"own {i}\nmore {i}\n{block}\nend {i}" for i in range(6)] + [None, "", "\n", "one line", block, block, "é\n" * 400]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, block, "x"), (None, texts[1], "x")], "doc_id long, text string, kept string")
    rows = {(r["doc_id"], r["text"]): r for r in lines.without_repeated_chunks(docs).collect()}
    assert len(rows) == docs.count()
    first = rows[None, block]
    assert first["n_removed"] == 0 and first["kept"] == block
    assert rows[10, block]["n_removed"] > 5 and rows[6, None]["kept"] is None and rows[7, ""]["n_lines"] == 0
    for (i, text), r in rows.items():
        left = (r["kept"] or "").split("\n") if r["kept"] else []
        assert len(left) == r["n_lines"] - r["n_removed"] or (r["kept"] or "") == "" or r["n_chunks"] == 0
        if i is not None and i < 6 and i != 1:
            assert f"own {i}" in r["kept"] and f"end {i}" in r["kept"]
    assert lines.without_repeated_chunks(docs.limit(0)).count() == 0


def test_line_chunks_take_copies_and_grow(spark):
    """At least 98 % of the lines of exact copies go, and passages go nearly whole; every removed line stays somewhere."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts, seen, copies = {}, set(), []
    for r in docs.orderBy("doc_id").collect():
        texts[r["doc_id"]] = r["text"]
        if r["text"] in seen and r["text"].count("\n"):
            copies.append(r["doc_id"])
        seen.add(r["text"])
    got = {r["doc_id"]: r for r in lines.without_repeated_chunks(docs).collect()}
    assert len(copies) > 100
    assert sum(got[i]["n_removed"] for i in copies) >= 0.98 * sum(got[i]["n_lines"] for i in copies)
    left = {line for r in got.values() if r["kept"] for line in r["kept"].split("\n")}
    assert left >= {line for t in texts.values() if t for line in t.split("\n")} - {""}

    passage = [f"passage {i} line {j}" for i in range(20) for j in range(12)]
    rows = [(i * 100 + n, "\n".join([f"own {n} {i} {j}" for j in range(5)] + passage[i * 12:i * 12 + 12] + [f"rest {n} {i} {j}" for j in range(5)])) for i in range(20) for n in range(3)]
    planted = {r["doc_id"]: r for r in lines.without_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        kept = planted[i]["kept"].split("\n")
        assert [x for x in text.split("\n") if not x.startswith("passage")] == [x for x in kept if not x.startswith("passage")]
    removed = sum(r["n_removed"] for i, r in planted.items() if i % 100)
    assert removed >= 0.9 * 40 * 12


def test_line_chunks_with_clashing_columns(spark):
    block = "\n".join(f"license line {i}" for i in range(9))
    docs = spark.createDataFrame([(i, block, "a", "b", 3, None) for i in range(3)], "doc_id long, text string, h string, id string, place int, chunk string")
    rows = lines.without_repeated_chunks(docs).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 9, 9] and all((r["h"], r["id"], r["place"]) == ("a", "b", 3) for r in rows)
