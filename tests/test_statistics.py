"""Code statistics, distributions, series metrics and scores against brute force."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from visitframe.operators import clean, codestats, ngrams, scores, series, textsim


@pytest.fixture(scope="module")
def visits(spark):
    """One visit holds most codes; widths of 2 and 4 force many levels."""
    rng = random.Random(5)
    data = {(0, 0): [rng.choice("abcd") for _ in range(19)], (0, 1): list("ab"), (1, 0): list("aba"), (1, 1): []}
    rows = [(s, v, i, c) for (s, v), codes in data.items() for i, c in enumerate(codes)]
    codes = spark.createDataFrame(rows, "seq long, visit_idx int, pos long, code string")
    table = spark.createDataFrame(list(data), "seq long, visit_idx int")
    return data, codes, table


@pytest.mark.parametrize("width", [2, 64])
def test_pairs_and_triples(visits, width):
    data, codes, _ = visits
    for size, make, keys in (
        (2, codestats.code_pairs, codestats.PAIR), (3, codestats.code_triples, codestats.TRIPLE),
    ):
        got = make(codes, width=width).groupBy(*keys).agg(F.sum("n").alias("n")).collect()
        want = Counter(t for c in data.values() for t in itertools.combinations(c, size))
        assert {tuple(r[k] for k in keys): r["n"] for r in got} == dict(want)


def test_sequential_pairs_and_lengths(visits):
    data, codes, table = visits
    got = codestats.sequential_pairs(codes).groupBy(*codestats.PAIR).agg(F.sum("n").alias("n")).collect()
    want = Counter((a, b) for a in data[0, 0] for b in data[0, 1])
    assert {(r["first"], r["second"]): r["n"] for r in got} == dict(want)
    row = codestats.length_stats(codes, table).first()
    assert row["record_len_mean"] == 2 and row["visit_len_mean"] == 6
    p = {r["code"]: r["p"] for r in codestats.code_probs(codes, table, "record").collect()}
    assert p["a"] == 1.0 and p["d"] == 0.5


def distribution(spark, counts):
    total = sum(counts)
    return spark.createDataFrame([(i, c / total) for i, c in enumerate(counts)], "k int, p double")


def test_compare_distributions(spark):
    p = distribution(spark, range(1, 11))
    q = distribution(spark, [2, 1, 4, 3, 6, 5, 8, 7, 10, 9])
    row = ngrams.compare_distributions(p, q, ["k"]).first()
    want = {"kl": 0.025492, "js": 0.006305, "cosine": 0.987013, "euclidean": 0.057496, "pearson": 0.939394, "r2": 0.878788}
    for name, value in want.items():
        assert row[name] == pytest.approx(value, abs=1e-6)
    few = ngrams.compare_distributions(p.where("k < 9"), q, ["k"]).first()
    assert few["kl"] == 0 and few["common_pct"] == 0 and few["r2_log"] is None


def test_ngrams_drop_pads_and_cross_blocks(spark):
    toks = [1, 2, 0, 1, 2, 3, 0, 0]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(toks)], "seq long, pos long, token_id int")
    got = {(r["t1"], r["t2"]): r["n"] for r in ngrams.ngram_probs(df, 2, pad_id=0).collect()}
    assert got == {(1, 2): 2, (2, 1): 1, (2, 3): 1}
    dense = ngrams.drop_pads(df, 0)
    small = ngrams.grams(dense, 3, width=2).count()
    assert small == ngrams.grams(dense, 3).count() == 3


def test_scores(spark):
    rows = list(zip([1, 1, 0, 1, 0, 0], [0.9, 0.8, 0.8, 0.4, 0.4, 0.1]))
    df = spark.createDataFrame(rows, "truth int, score double")
    assert scores.auroc(df, "score", "truth").first()[0] == pytest.approx(0.777778, abs=1e-6)
    assert scores.average_precision(df, "score", "truth").first()[0] == pytest.approx(0.755556, abs=1e-6)
    pairs = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (2, 0, 0)], "id int, pred int, truth int")
    assert scores.f1(pairs, "pred", "truth").first()[0] == pytest.approx(2 / 3)
    assert scores.hamming_loss(pairs, "pred", "truth").first()[0] == pytest.approx(1 / 3)
    assert scores.jaccard(pairs, "id", "pred", "truth").first()[0] == pytest.approx(0.25)


def test_bands_and_zero_variance(spark):
    df = spark.createDataFrame([(-0.5,), (-0.2,), (0.2,), (0.5,), (None,)], "c double")
    got = [r[0] for r in df.select(series.corr_band("c")).collect()]
    assert got == ["medium-neg", "low", "medium-pos", "high-pos", "null"]
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert series.corr_matrix(flat, ["a", "b"], 1).first()["corr"] is None


def test_text_metrics(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat lay on a mat")], "pair_id int, pred string, ref string")
    got = {r["order"]: r["f"] for r in textsim.rouge_n(df).collect()}
    assert got[1] == pytest.approx(4 / 6) and got[2] == pytest.approx(1 / 5)
    assert textsim.rouge_l(df).first()[0] == pytest.approx(4 / 6)
    same = df.select("pair_id", F.split("ref", " ").alias("pred"), F.split("ref", " ").alias("ref"))
    assert textsim.bleu(same).first()[0] == pytest.approx(1.0)
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in "xy")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert textsim._lcs(a, b) == best[-1][-1]


def test_cleaning(spark):
    df = spark.createDataFrame(
        [("icd", "1", 1.0), ("icd", "1", float("inf")), ("icd", "2", None), ("proc", None, 3.0)], "sys string, code string, x double"
    )
    codes = clean.prefix_codes(df)
    assert clean.filter_rare(codes, min_count=1).count() == 2
    assert [tuple(r) for r in clean.top_codes(codes, 5).collect()] == [("icd_1", 2), ("icd_2", 1)]
    assert tuple(clean.audit_nulls(df, ["x"]).first()) == ("x", 1, 1)
    assert sorted(r["x"] for r in clean.fill_mean(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 3.0]
    noisy = clean.jitter(df.withColumn("id", F.monotonically_increasing_id()), ["x"], "id").where("x < 10")
    assert all(abs(r["x"] - round(r["x"])) < 1e-3 for r in noisy.collect())
    text = spark.createDataFrame([("nan", "7"), ("a", "b"), (None, "nan")], "c string, v string")
    got = [tuple(r) for r in clean.coerce_types(text, ["c"], ["v"]).collect()]
    assert got == [(None, 7.0), ("a", None), (None, None)]
