"""The driver's star-schema tables seen as longitudinal records.

A customer is a subject, an order a stay, a line item a code, and an hour of
one user's events a series row. Market segments are the splits. All rows of
all tables take part.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitframe.functions.columns import encode_flag
from visitframe.functions.ordered import block_of, position_in
from visitframe.operators.clean import filter_rare, prefix_codes
from visitframe.operators.discretize import discretize
from visitframe.operators.restructure import number_stays, order_codes
from visitframe.operators.tokens import tokenize
from visitframe.operators.vocab import Metadata, learn_metadata
from visitframe.schema import HOURS_EDGES
from visitframe.session import durable

CONTINUOUS = ["click", "error", "purchase", "signup", "view"]
CATEGORICAL = ["k_band"]
SYNONYMS = {"k_band": {"0": 0, "1": 1, "2": 2}}
LABELS = ["filled", "urgent", "large"]
FIXED_HOURS = HOURS_EDGES
AGE_EDGES = [float(x) for x in range(-1000, 10001, 1000)]
MIN_CODE_COUNT = 5
TRIM_RATIO = 1.5
SPLIT_OF = {
    "AUTOMOBILE": "train", "BUILDING": "train", "FURNITURE": "val",
    "HOUSEHOLD": "test", "MACHINERY": "synthetic",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_column(segment: str = "c_mktsegment"):
    out = F.when(F.lit(False), F.lit(""))
    for value, split in SPLIT_OF.items():
        out = out.when(F.col(segment) == value, split)
    return out


def listed_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as listed stays with their labels."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("sid"),
        F.col("o_orderkey").alias("hadm_id"),
        F.col("o_orderkey").alias("list_pos"),
        F.array(
            (F.col("o_orderstatus") == "F").cast("int"),
            (F.col("o_orderpriority") == "1-URGENT").cast("int"),
            (F.col("o_totalprice") > 200000).cast("int"),
        ).alias("label_phe"),
        (F.col("o_orderstatus") == "P").cast("int").alias("label_ihm"),
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with split, age and gender text."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("sid"),
        split_column().alias("split"),
        F.col("c_acctbal").alias("age"),
        F.when(F.col("c_nationkey") < 13, "M").otherwise("F").alias("gender_text"),
    )


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stay table: one row per (sid, stay_idx)."""
    numbered = number_stays(listed_stays(spark, sf_dir))
    return numbered.join(subjects(spark, sf_dir), "sid").select(
        "sid", "stay_idx", "hadm_id", "list_pos", "split", "age",
        encode_flag("gender_text").alias("gender"), "label_phe", "label_ihm",
    )


def raw_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as prefixed codes, all of them."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("hadm_id"),
        F.when(F.col("l_returnflag") == "N", "proc").otherwise("icd").alias("sys"),
        F.col("l_linenumber").alias("seq_num"),
        F.col("l_partkey").cast("string").alias("code"),
    )
    return prefix_codes(lines)


def codes(spark: SparkSession, sf_dir: str, min_count: int = MIN_CODE_COUNT) -> DataFrame:
    """Frequent codes with their position in the stay."""
    return order_codes(durable(filter_rare(raw_codes(spark, sf_dir), min_count=min_count)))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series of each user; ten-day periods are stays 0, 1, 2."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sid"),
        F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10)).cast("int").alias("stay_idx"),
        F.floor(F.unix_timestamp("ts") / 3600).alias("_hour"),
        "event_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("_k"),
    )
    rows = events.groupBy("sid", "stay_idx", "_hour").agg(
        *[F.max(F.when(F.col("event_type") == v, F.col("value"))).alias(v) for v in CONTINUOUS],
        (F.max_by("_k", "event_id") % 4).cast("string").alias("k_band"),
    )
    starts = events.groupBy("sid", "stay_idx").agg(F.min("_hour").alias("_first"))
    dated = rows.join(starts, ["sid", "stay_idx"]).withColumn(
        "hours", (F.col("_hour") - F.col("_first")).cast("double")
    )
    blocked = dated.withColumn("_block", block_of("hours", 1024))
    stay = ["sid", "stay_idx"]
    out = position_in(blocked, stay, ["_block"], ["hours"], "row_idx", coarse=True, counted=events.select(*stay))
    return out.select("sid", "stay_idx", "row_idx", "hours", *CATEGORICAL, *CONTINUOUS)


COHORTS = {0: "real", 1: "test", 2: "synthetic"}


def cohort_series(frame: DataFrame, cohort: str) -> DataFrame:
    """One ten-day period of the series as a cohort keyed by ``id``."""
    period = next(k for k, v in COHORTS.items() if v == cohort)
    return frame.where(F.col("stay_idx") == period).withColumnRenamed("sid", "id")


class Records:
    """The processed dataset of one folder: each stage is written once, when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, bin_type: str = "uniform"):
        self.spark, self.sf_dir, self.bin_type = spark, sf_dir, bin_type

    @cached_property
    def stays(self) -> DataFrame:
        return durable(stays(self.spark, self.sf_dir))

    @cached_property
    def codes(self) -> DataFrame:
        return durable(codes(self.spark, self.sf_dir))

    @cached_property
    def stay_codes(self) -> DataFrame:
        """Codes keyed by (sid, stay_idx), with the split."""
        keys = self.stays.select("hadm_id", "sid", "stay_idx", "split")
        return keys.join(self.codes, "hadm_id")

    @cached_property
    def visit_codes(self) -> DataFrame:
        """``stay_codes`` for statistics that read them more than once: (sid, stay_idx, code_pos, code, split)."""
        return durable(self.stay_codes.select("sid", "stay_idx", "code_pos", "code", "split"))

    @cached_property
    def series(self) -> DataFrame:
        return durable(series(self.spark, self.sf_dir))

    @cached_property
    def stay_series(self) -> DataFrame:
        """Series rows of stays that exist."""
        keys = self.stays.select("sid", "stay_idx")
        return self.series.join(keys, ["sid", "stay_idx"], "left_semi")

    @cached_property
    def train_series(self) -> DataFrame:
        """Series rows of training stays: all that bins are learned from."""
        keys = self.stays.where(F.col("split") == "train").select("sid", "stay_idx")
        return self.series.join(keys, ["sid", "stay_idx"], "left_semi")

    @cached_property
    def meta(self) -> Metadata:
        return learn_metadata(
            self.codes,
            self.train_series,
            CATEGORICAL,
            CONTINUOUS,
            ["sid", "stay_idx", "row_idx"],
            bin_type=self.bin_type,
            synonyms=SYNONYMS,
            labels=LABELS,
            age_edges=AGE_EDGES,
            trim_ratio=TRIM_RATIO,
        )

    @cached_property
    def events(self) -> DataFrame:
        return durable(discretize(self.stays, self.stay_codes, self.stay_series, self.meta))

    @cached_property
    def tokens(self) -> DataFrame:
        return durable(self.dealt_tokens)

    @cached_property
    def split_tokens(self) -> DataFrame:
        """Tokens with the split of their subject."""
        return durable(self.dealt_split_tokens)

    @property
    def dealt_tokens(self) -> DataFrame:
        """``tokens`` for a single reader, not written: they lie dealt by sequence, so what it does by ``seq`` shuffles nothing."""
        return tokenize(self.events, self.stays, self.meta)

    @property
    def token_owners(self) -> DataFrame:
        """``seq`` in no fewer rows than it has tokens, for those that only count them: a stay has five closing
        tokens, a sequence two more."""
        marks = self.stays.select(F.col("sid").alias("seq"), F.explode(F.array_repeat(F.lit(0), 7))).select("seq")
        return self.events.select(F.col("sid").alias("seq")).unionByName(marks)

    @property
    def dealt_split_tokens(self) -> DataFrame:
        """``dealt_tokens`` with the split of their subject, joined where they lie."""
        found = subjects(self.spark, self.sf_dir).select(F.col("sid").alias("seq"), "split")
        return self.dealt_tokens.join(found, "seq")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as double vectors with a cohort by label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("label") <= 3, "real").when(F.col("label") <= 6, "synthetic").otherwise("test").alias("cohort"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
