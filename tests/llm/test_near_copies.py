"""Classes of near copies and nearest vectors against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitframe.llm import ann, components, ngramjoin
from visitframe.llm.queries import QUERIES


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Per row: root (least place in the list) and number of links."""
    sets = [shingles(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))], links


def corpus():
    rng = random.Random(11)
    make = lambda n: [rng.choice("abcdefgh") + str(rng.randint(0, 300)) for _ in range(n)]
    texts = [None, "", "...", "one", "One!", "a b c d", "a b c d", "a b c e"]
    for n in (30, 120, 400):
        base = make(n)
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, max(1, n // 50))):
                w[rng.randrange(n)] = "new" + str(rng.random())
            texts.append(" ".join(w))
        texts += [" ".join(base)] * 6
        texts.append(" ".join(base).upper() + ".")
    shared = make(60)
    texts += [" ".join(make(100) + shared) for _ in range(15)]
    texts.append(" ".join(make(20_000)))
    rows = list(enumerate(texts)) + [(None, texts[20]), (20, "another text of the same id")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_classes_are_the_brute_force_ones(spark, block, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, class int").withColumn("key", F.lit("x"))
    got = ngramjoin.classes(docs).collect()
    root, links = brute(rows)
    assert len(got) == len(rows)
    have = sorted((str(r["doc_id"]), r["n_links"]) for r in got)
    assert have == sorted((str(d), n) for (d, _), n in zip(rows, links))
    groups = {}
    for r in got:
        groups.setdefault(r["class"], []).append(str(r["doc_id"]))
    want = {}
    for (d, t), x in zip(rows, root):
        # Texts without a word form a class only with exact copies.
        want.setdefault(x if shingles(t) else ("no word", t or ""), []).append(str(d))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    kept = ngramjoin.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(want)
    least = sorted(min(g, key=lambda d: (d == "None", int(d) if d != "None" else 0)) for g in want.values())
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == least


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngramjoin.classes(none).count() == 0 and ngramjoin.one_of_each(none).count() == 0


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "some words that are here twice", "a"), (1, "some words that are here twice", "b"), (2, "x", "c")], "doc_id long, text string, extra string")
    assert sorted(r["doc_id"] for r in ngramjoin.one_of_each(docs).collect()) == [1, 2]


def test_pruning_keeps_what_may_reach_the_threshold():
    least = ngramjoin.least_matches(0.8, 1e-4)
    assert list(least) == [32, 64, 96, 128]
    rng = np.random.default_rng(0)
    same = rng.random((20_000, 128)) < 0.8 + 0.2 / 256
    dropped = np.zeros(20_000, dtype=bool)
    for n, m in least.items():
        dropped |= same[:, :n].sum(axis=1) < m
    assert dropped.mean() < 5e-3
    far = rng.random((20_000, 128)) < 0.4
    assert ((far[:, :32].sum(axis=1)) < least[32]).mean() > 0.6


def test_intersections_and_components(spark):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(12)]
    got = ngramjoin._intersections(sets[:5], sets[5:], chunk=7)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]).all()
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}}


def nearest(x, ids, k=20, every=20):
    out = {}
    for q in range(len(x)):
        if ids[q] % every:
            continue
        score = np.zeros(len(x))
        for d in range(x.shape[1]):
            score += x[q, d] * x[:, d]
        rest = np.flatnonzero(ids != ids[q])
        order = rest[np.lexsort((ids[rest], -score[rest]))][:k]
        out[int(ids[q])] = [(int(ids[o]), float(score[o])) for o in order]
    return out


def test_recall_and_scores_on_embeddings(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    want = nearest(np.array([r["embedding"] for r in rows], dtype=np.float64), np.array([r["vec_id"] for r in rows]))
    got = {}
    for r in QUERIES["op7_nearest"](spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    exact = {(q, a): s for q in want for a, s in want[q]}
    assert all(s == exact[q, a] for q in got for a, s in got[q] if (q, a) in exact)
    assert all(v == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values())


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.normal(size=4)]) for i in range(60)]
    ties = [(i, [9.0, 9.0, 9.0, 9.0]) for i in range(100, 140)]
    odd = [(200, None), (220, []), (240, [0.0] * 4), (260, [1.0, None, 1.0, 1.0]), (280, [1.0, float("nan"), 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0, 1.0]), (320, [1.0, 2.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(good + ties + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("vector", F.lit("x"))
    kept = good + ties
    want = nearest(np.array([v for _, v in kept]), np.array([i for i, _ in kept]))
    got = {}
    for r in ann.search(df, block=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == want.keys()
    assert all(len(got[q]) == 20 for q in got)
    assert [a for a, _ in got[100]] == [a for a, _ in want[100]]
    few = ann.search(df.where("vec_id < 5")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2), (0, 3), (0, 4)]
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 240")).count() == 0
