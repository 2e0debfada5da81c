"""Goldens of the profile, trimming, edges, histogram and bin rules."""

import math

import pytest
from pyspark.sql import functions as F

from visitframe.functions.columns import (
    attention_mask, bin_index, clip_to, encode_flag, label_columns, pad_array, parse_stay,
)
from visitframe.operators import discretize, restructure, vocab
from visitframe.schema import FIXED_EDGES, SYNONYMS


def frame(spark, values, name="v"):
    return spark.createDataFrame([(float(x) if x is not None else None,) for x in values], f"{name} double")


def stats_of(spark, values, times=3.0):
    return vocab.series_stats(vocab.series_ranks(frame(spark, values), ["v"]), times)


def test_uniform_and_quantile_edges(spark):
    values = [1, 2, 3, 4, 100] + [5] * 5
    ranks = vocab.series_ranks(frame(spark, values), ["v"])
    stats = vocab.series_stats(ranks, 1e9).withColumn("n_bins", F.lit(4))
    assert vocab.uniform_edges(stats).first()["edges"] == pytest.approx([0.901, 25.75, 50.5, 75.25, 100])
    assert vocab.quantile_edges(ranks, stats).first()["edges"] == pytest.approx([1, 3.25, 5, 100])


def test_trim_long_upper_tail(spark):
    row = stats_of(spark, [*range(1, 100), 1000]).first()
    assert (row["q025"], row["q975"], row["median"]) == pytest.approx((3.475, 97.525, 50.5))
    assert row["max_2"] == 97 and row["min_2"] == 1
    plain = stats_of(spark, range(1, 101)).first()
    assert plain["max_2"] == 100 and plain["min_2"] == 1


def test_profile_counts_missing(spark):
    row = vocab.profile(vocab.series_ranks(frame(spark, [1, None, 1, 3]), ["v"])).first()
    assert row["missing_rate"] == 0.25 and row["n_unique"] == 2
    assert row["mean"] == pytest.approx(5 / 3) and row["std"] == pytest.approx(math.sqrt(4 / 3))


def test_n_bins(spark):
    df = spark.createDataFrame([(4,), (5,), (49,), (500,)], "n_unique int")
    assert [r["n_bins"] for r in vocab.n_bins(df).collect()] == [0, 1, 9, 10]


def test_histogram_is_left_closed(spark):
    ranks = vocab.series_ranks(frame(spark, [0, 1, 1, 2, 3]), ["v"])
    edges = vocab.edge_table(spark, {"v": [0, 1, 2, 3]})
    rows = {r["bin"]: r for r in vocab.bin_histogram(ranks.where("value is not null"), edges).collect()}
    assert [rows[i]["n"] for i in range(3)] == [1, 2, 2]
    assert rows[1]["center"] == 1.5 and rows[2]["label"] == "v_2"


def test_bin_index(spark):
    edges = [0, 0.5, 1.5, 2.5, 3.5, 6.5, 10.5]
    values = [-3.0, 0.5, 0.50001, 10.5, 99.0, float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["b"] for r in df.orderBy("i").select(bin_index(F.col("v"), edges).alias("b")).collect()]
    assert got == [0, 0, 1, 5, 5, 5, None]


def meta_for(spark, categories, variables):
    codes = spark.createDataFrame([(0, "icd", "icd_1", 9)], "code_id int, sys string, code string, n long")
    levels = spark.createDataFrame(categories, "var string, text string, value int")
    return vocab.Metadata(codes, levels, variables, ["a", "b", "c", "d"], 1)


def small_meta(spark):
    return meta_for(
        spark,
        [("c", "yes", 0), ("c", "no", 1)],
        [
            vocab.Variable("c", 0, "ts", 2),
            vocab.Variable("x", 1, "ts", 5, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]),
            vocab.Variable("Age", 2, "covar", 15, [float(e) for e in FIXED_EDGES["Age"]]),
            vocab.Variable("Gender", 3, "covar", 2),
            vocab.Variable("Hours", 4, "timestamp", 15, [float(e) for e in FIXED_EDGES["Hours"]]),
        ],
    )


def test_soft_labels(spark):
    meta = small_meta(spark)
    start = meta.starts()[("ts", 1)]
    rows = vocab.soft_labels(meta).where(F.col("token_id") == start + 3).orderBy("target_id").collect()
    assert [r["weight"] for r in rows] == pytest.approx([0.004708, 0.057357, 0.257058, 0.423818, 0.257058], abs=1e-6)
    totals = vocab.soft_labels(meta).groupBy("token_id").agg(F.sum("weight").alias("s")).collect()
    assert len(totals) == meta.vocab().count() and all(abs(r["s"] - 1) < 1e-9 for r in totals)


def test_vocab_is_contiguous(spark):
    meta = small_meta(spark)
    ids = sorted(r["token_id"] for r in meta.vocab().collect())
    assert ids == list(range(len(ids)))
    assert meta.begin_positions() == {"c": 0, "x": 2}
    assert meta.special_ids()["pad"] == meta.special_ids()["mask"] == meta.special("<pad>")


def test_code_vocab_order(spark):
    rows = [("proc", "proc_9")] * 5 + [("icd", "icd_b")] * 2 + [("icd", "icd_a")] * 2 + [("icd", "icd_z")] * 3
    got = vocab.code_vocab(spark.createDataFrame(rows, "sys string, code string")).orderBy("code_id").collect()
    assert [r["code"] for r in got] == ["icd_z", "icd_a", "icd_b", "proc_9"]


def test_metadata_round_trip_by_bin_type(spark, tmp_path):
    meta = small_meta(spark)
    vocab.save_metadata(meta, str(tmp_path))
    meta.bin_type = "quantile"
    vocab.save_metadata(meta, str(tmp_path))
    again = vocab.load_metadata(spark, str(tmp_path), "quantile")
    assert again.key() == meta.key() and again.bin_type == "quantile"
    assert again.starts() == meta.starts()
    assert vocab.load_metadata(spark, str(tmp_path), "uniform").key() != meta.key()


def test_category_map_synonyms_and_first_seen(spark):
    name = "Glascow coma scale eye opening"
    df = spark.createDataFrame([(2, "b"), (1, "z"), (3, "b"), (4, None)], "at int, w string").withColumn(name, F.lit("To Pain"))
    rows = vocab.category_map(df, [name, "w"], ["at"], SYNONYMS).collect()
    got = {(r["var"], r["text"]): r["value"] for r in rows}
    assert got[("w", "z")] == 0 and got[("w", "b")] == 1
    assert got[(name, "3 To speech")] == got[(name, "To Speech")] == 1


def test_discretize_drops_rows_but_not_time(spark):
    rows = [(1, 0, 0, 1.0, "yes", "2.5"), (1, 0, 1, 2.0, "maybe", "1.0"), (1, 0, 2, 4.0, "no", "bad")]
    df = spark.createDataFrame(rows, "sid long, stay_idx int, row_idx long, hours double, c string, x string")
    for width in (1, 2, 100):
        got = discretize.discretize_series(df, small_meta(spark), width).orderBy("row_idx").collect()
        assert [(r["row_idx"], r["gap"]) for r in got] == [(0, 1), (2, 2)]
        assert [tuple(c) for c in got[0]["cells"]] == [(0, 0), (1, 2)]
        assert [tuple(c) for c in got[1]["cells"]] == [(0, 1)]
    bad = {r["var"]: r["n_bad"] for r in discretize.bad_value_report(df, ["x"]).collect()}
    assert bad == {"x": 1}


def test_horizon_rows(spark):
    rows = [(1, 0, i, h) for i, h in enumerate([1.0, 11.0, 11.0, 30.0])]
    df = spark.createDataFrame(rows, "sid long, stay_idx int, row_idx long, hours double")
    got = {r["horizon"]: r["row_idx"] for r in discretize.horizon_rows(df, [1, 12, 36]).collect()}
    assert got == {1.0: -1, 12.0: 1, 36.0: 3}


def test_unknown_code_raises(spark):
    df = spark.createDataFrame([("x",)], "code string")
    known = spark.createDataFrame([("y", 1)], "code string, code_id int")
    with pytest.raises(Exception, match="unknown key"):
        restructure.lookup_tokens(df, known, ["code"]).collect()
    assert restructure.lookup_tokens(df, known, ["code"], "drop").count() == 0
    assert restructure.lookup_tokens(df, known, ["code"], "null").first()["code_id"] is None


def test_grid_pushes_rows_out(spark):
    df = spark.createDataFrame([(1, 0.5, 3.0), (1, 2.0, 9.0)], "id long, hours double, v double")
    grid = restructure.to_grid(df, "id", "hours", ["v"], 1.0, 3)
    got = [(r["value_v"], r["mask_v"]) for r in grid.orderBy("cell").collect()]
    assert got == [(0.0, -1), (5.0, 1), (0.0, -1)]
    image = restructure.grid_images(grid, "id", ["v"], 3).first()
    assert image["values"][1] == [5.0, 0.0, 0.0] and image["masks"][1] == [1.0, -1.0, -1.0]


def test_small_columns(spark):
    df = spark.createDataFrame([("10006_episode2_timeseries.csv", "M", [1, 0], None)], "s string, g string, l array<int>, x double")
    sid, order = parse_stay("s")
    row = df.select(
        sid.alias("sid"), order.alias("o"), encode_flag("g").alias("g"), *label_columns("l", 2),
        clip_to(F.col("x"), F.lit(0.0), F.lit(1.0)).alias("x"),
        pad_array(F.array(F.lit(7), F.lit(8)), 4, 0).alias("p"),
    ).withColumn("m", attention_mask("p", 0)).first()
    assert (row["sid"], row["o"], row["g"], row["label_phe_0"], row["label_phe_1"], row["x"]) == (10006, 1, 1, 1, 0, None)
    assert row["p"] == [7, 8, 0, 0] and row["m"] == [1, 1, 0, 0]
