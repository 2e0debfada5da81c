"""Blocked operators equal the plain window, even when one key holds most rows."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitframe.functions import ordered
from visitframe.operators import sampling, series, tokens


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for key, n in ((0, 300), (1, 7), (2, 1), (3, 64)):
        rows += [(key, i, rng.choice([None, 1.5, 2.5, -1.0]), rng.random()) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, row_idx long, x double, y double")


def test_prefix_equals_window(skewed):
    w = Window.partitionBy("id").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.withColumn("s", F.coalesce(F.sum(F.coalesce("x", F.lit(0.0))).over(w), F.lit(0.0)))
    blocked = skewed.withColumn("_block", ordered.block_of("row_idx", 8))
    got = ordered.prefix_over_blocks(
        blocked, ["id"], ["_block"], ["row_idx"], {"s": F.coalesce("x", F.lit(0.0))}
    ).drop("_block")
    def pick(df):
        return sorted((r["id"], r["row_idx"], round(r["s"], 9)) for r in df.collect())

    assert pick(got) == pick(want)


def test_first_from_here_equals_window(skewed):
    pick = F.when(F.col("x") > 2, F.col("row_idx"))
    w = Window.partitionBy("id").orderBy("row_idx").rowsBetween(0, Window.unboundedFollowing)
    want = skewed.withColumn("m", F.min(pick).over(w)).select("id", "row_idx", "m")
    blocked = skewed.withColumn("_block", ordered.block_of("row_idx", 8))
    got = ordered.first_from_here(blocked, ["id"], ["_block"], ["row_idx"], {"m": pick})
    assert sorted(got.select("id", "row_idx", "m").collect(), key=str) == sorted(want.collect(), key=str)


@pytest.mark.parametrize("width", [3, 7, 1000])
def test_ffill_equals_pandas(skewed, width):
    got = series.ffill(skewed, "id", ["x"], width=width).toPandas()
    pdf = skewed.toPandas().sort_values(["id", "row_idx"])
    pdf["x"] = pdf.groupby("id")["x"].ffill(limit=6)
    merged = pdf.merge(got, on=["id", "row_idx"], suffixes=("_a", "_b"))
    assert len(merged) == len(pdf) == len(got)
    assert ((merged["x_a"] == merged["x_b"]) | (merged["x_a"].isna() & merged["x_b"].isna())).all()


def test_prefix_by_value_counts_smaller_rows(skewed):
    counts = ordered.value_counts(skewed.where("x is not null"), ["id"], "x")
    got = {(r["id"], r["x"]): r["before"] for r in ordered.prefix_by_value(counts, ["id"], "x", {"before": F.col("n")}).collect()}
    rows = [(r["id"], r["x"]) for r in skewed.where("x is not null").collect()]
    assert got == {(k, v): sum(1 for a, b in rows if a == k and b < v) for k, v in set(rows)}


def test_samples_ignore_partitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "key")
    a = {r["key"] for r in sampling.sample_n(df.repartition(3), "key", 250, 9).collect()}
    b = {r["key"] for r in sampling.sample_n(df.repartition(11), "key", 250, 9).collect()}
    assert a == b and len(a) == 250
    assert sampling.sample_n(df, "key", 9000).count() == 5000
    f = sampling.sample_frac(df, "key", 0.3).count()
    assert 1350 < f < 1650


def test_segments_and_counts_cross_blocks(spark):
    rng = random.Random(1)
    toks = [rng.randint(0, 3) for _ in range(50)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(toks)], "seq long, pos long, token_id int")
    seg = {r["pos"]: r["segment"] for r in tokens.segment_index(df, [0], width=4).collect()}
    assert seg == {i: toks[: i + 1].count(0) for i in range(50)}
    seen = {r["pos"]: r["seen"] for r in tokens.running_counts(df, width=4).collect()}
    assert seen == {i: toks[: i + 1].count(toks[i]) for i in range(50)}


def test_null_keys_and_orders_stay(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 0, 0, 0, 1]), rng.choice([None, *range(20)]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, o long, x long").withColumn("_block", ordered.block_of("o", 4))
    w = Window.partitionBy("k").orderBy("o", "x")
    want = df.select("x", (F.row_number().over(w) - 1).alias("p")).collect()
    got = ordered.position_in(df, ["k"], ["_block"], ["o", "x"], "p").select("x", "p").collect()
    assert sorted(got) == sorted(want) and len(got) == 200
    pick = F.when(F.col("x") % 7 == 0, F.struct("o", "x"))
    back = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    want = df.select("x", F.min(pick).over(back).alias("m")).collect()
    got = ordered.first_from_here(df, ["k"], ["_block"], ["o", "x"], {"m": pick}).select("x", "m").collect()
    assert sorted(got, key=str) == sorted(want, key=str)


def test_codes_without_a_sequence_number_stay(spark):
    from visitframe.operators.restructure import order_codes

    rows = [(1, "icd", 2, "b"), (1, "icd", None, "a"), (1, "icd", 1, "c"), (None, "icd", 1, "d")]
    codes = spark.createDataFrame(rows, "hadm_id long, sys string, seq_num long, code string")
    got = {(r["hadm_id"], r["code"]): r["code_pos"] for r in order_codes(codes).collect()}
    assert got == {(1, "a"): 0, (1, "c"): 1, (1, "b"): 2, (None, "d"): 0}


def test_auroc_of_a_null_group(spark):
    from visitframe.operators.scores import auroc

    rows = [(None, 1, 0.9), (None, 0, 0.1), ("g", 1, 0.2), ("g", 0, 0.8)]
    got = auroc(spark.createDataFrame(rows, "grp string, label int, score double"), "score", "label", ["grp"]).collect()
    assert {r["grp"]: r["auroc"] for r in got} == {None: 1.0, "g": 0.0}


def test_ranges_follow_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", 5)
    df = spark.range(3000).select((F.col("id") * 7 % 3000).alias("x"), F.lit(1).cast("long").alias("one"))
    blocks = ordered.value_blocks(df, [], "x").groupBy("_block").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("lo").collect()
    assert len(blocks) > 300 and max(b["n"] for b in blocks) < 60
    assert all(a["hi"] < b["lo"] and a["_block"] < b["_block"] for a, b in zip(blocks, blocks[1:]))
    got = ordered.prefix_by_value(df, [], "x", {"before": F.col("one")})
    assert got.where("before <> x").count() == 0
