"""Nested records and the regular grid for ids of any size."""

import datetime as dt
import random

from pyspark.sql import functions as F

from visitframe.operators import restructure
from visitframe.plans import proxy


def test_nested_records_keep_order_and_come_back(spark):
    rng = random.Random(2)
    stays, codes = [], []
    for sid in range(6):
        for i in range(rng.randint(1, 5) if sid else 60):  # sid 0 has a long history
            hadm = 1000 * sid + i
            stays.append((sid, i, hadm, [rng.randint(0, 1)], rng.randint(0, 1)))
            codes += [(hadm, p, f"c{rng.randrange(9)}") for p in range(rng.choice([0, 1, 3, 11]))]
    rng.shuffle(codes)
    s = spark.createDataFrame(stays, "sid long, stay_idx int, hadm_id long, label_phe array<int>, label_ihm int")
    c = spark.createDataFrame(codes, "hadm_id long, code_pos int, code string")
    nested = restructure.nest_records(s, c, 4)
    rows = nested.orderBy("sid", "part").collect()
    sizes = [sum(max(1, len(v["codes"])) for v in r["visits"]) for r in rows]
    assert max(sizes) <= 4 and sum(r["sid"] == 0 for r in rows) > 20
    for sid in range(6):
        seen = [(v["stay_idx"], code) for r in rows if r["sid"] == sid for v in r["visits"] for code in v["codes"]]
        stay_of = {h: i for q, i, h, *_ in stays if q == sid}
        assert seen == [(stay_of[h], code) for h, p, code in sorted(codes) if h in stay_of]
    flat_stays, flat_codes = restructure.flat_records(nested)
    assert sorted(map(tuple, flat_codes.collect())) == sorted(codes)
    assert sorted(map(str, map(tuple, flat_stays.select(*s.columns).collect()))) == sorted(map(str, stays))


def test_grid_limits_rows_before_the_shuffle(spark):
    series = spark.range(20_000).select(F.lit(1).alias("id"), (F.col("id") % 7).cast("double").alias("hours"), F.col("id").cast("double").alias("v"))
    grid = restructure.to_grid(series, "id", "hours", ["v"], 1.0, 4)
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
    got = [(r["cell"], r["value_v"], r["mask_v"]) for r in grid.orderBy("cell").collect()]
    assert got == [(0, -1.0, 1), (1, 13.0, 1), (2, 27.0, 1), (3, 41.0, 1)]
    late = spark.createDataFrame([(1, 99.0, 0.5), (1, None, 0.25)], "id int, hours double, v double")
    got = [(r["value_v"], r["mask_v"]) for r in restructure.to_grid(late, "id", "hours", ["v"], 1.0, 3).orderBy("cell").collect()]
    assert got == [(-0.5, 1), (0.0, -1), (0.0, -1)]


def test_series_group_their_events_once(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, 5)
    rows = [(i, start + dt.timedelta(minutes=25 * i), i % 2, ["click", "view"][i % 3 == 0], float(i), '{"k": 5}') for i in range(40)]
    rows += [(100, None, 0, "view", 1.0, None), (101, start, None, "view", 1.0, None)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    out = proxy.series(spark, str(tmp_path))
    # By hour, and the first hour of each stay straight from the events.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
    hours = {}
    for e, ts, user, *_ in rows[:40]:
        hours.setdefault(user, set()).add(int((ts - start).total_seconds() // 3600))
    want = {(u, i, float(h - min(hs))) for u, hs in hours.items() for i, h in enumerate(sorted(hs))}
    got = {(r["sid"], r["row_idx"], r["hours"]) for r in out.where("stay_idx = 0").collect()}
    assert got == want
