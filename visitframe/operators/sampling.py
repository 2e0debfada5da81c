"""Samples that do not depend on how the data is partitioned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitframe.functions.columns import hash_uniform
from visitframe.functions.ordered import position_in

BUCKETS = 1 << 14


def sample_n(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows without replacement (all rows if there are fewer).

    ``key`` identifies a row. Rows are ordered by a hash of it. Counts per hash
    range (a fixed number, summed map-side) tell the last range needed; only
    rows up to it are shuffled and ranked.
    """
    u = hash_uniform(seed, F.col(key))
    tagged = df.withColumns({"_u": u, "_bucket": F.floor(u * BUCKETS)})
    upto = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = tagged.groupBy("_bucket").agg(F.count("*").alias("_n"))
    full = counts.withColumn("_all", F.sum("_n").over(upto)).where(F.col("_all") >= n)
    last = full.agg(F.coalesce(F.min("_bucket"), F.lit(BUCKETS))).scalar()
    placed = position_in(tagged.where(F.col("_bucket") <= last), [], ["_bucket"], ["_u", key], "_rank")
    return placed.where(F.col("_rank") < n).drop("_u", "_bucket", "_rank")


def sample_frac(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Rows whose key hashes below ``fraction``; labels stay in their row."""
    return df.where(hash_uniform(seed, F.col(key)) < fraction)


def metric_table(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long table (metric, keys, value), ordered by metric and keys."""
    long = df.unpivot(keys, [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
    return long.orderBy("metric", *keys)
