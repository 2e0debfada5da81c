"""Sources and sinks: raw CSV tables, split lists, per-stay series, datasets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitframe.functions.columns import label_columns, parse_stay
from visitframe.functions.ordered import position_in
from visitframe.operators.clean import attach_static, clip_series, coerce_types, first_stay
from visitframe.schema import SPLITS


def read_table(spark: SparkSession, path: str, schema: Mapping[str, str]) -> DataFrame:
    """CSV with a header: the named columns, cast; unparsable cells are NULL."""
    raw = spark.read.csv(path, header=True)
    return raw.select(*[F.col(f"`{c}`").try_cast(t).alias(c) for c, t in schema.items()])


def read_codes(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Diagnosis (``icd``) or procedure (``proc``) codes as (hadm_id, sys, seq_num, code)."""
    if kind not in ("icd", "proc"):
        raise ValueError("kind must be 'icd' or 'proc'")
    raw = read_table(
        spark,
        path,
        {"SUBJECT_ID": "long", "HADM_ID": "long", "SEQ_NUM": "int", "ICD9_CODE": "string"},
    )
    return raw.select(
        F.col("SUBJECT_ID").alias("sid"),
        F.col("HADM_ID").alias("hadm_id"),
        F.lit(kind).alias("sys"),
        F.col("SEQ_NUM").alias("seq_num"),
        F.col("ICD9_CODE").alias("code"),
    )


def _file_order(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Dense row number in file order; file splits are the blocks."""
    tagged = df.withColumn("_at", F.monotonically_increasing_id())
    return position_in(tagged, keys, ["_split"], ["_at"], name).drop("_at", "_split")


def read_split_list(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Listed stays: every column after the first two is a label."""
    raw = spark.read.csv(path, header=True)
    labels = raw.columns[2:]
    sid, order = parse_stay("stay")
    # A list may be many files: their names lead the order.
    listed = raw.select(
        F.col("stay"),
        sid.alias("sid"),
        order.alias("episode"),
        F.array(*[F.col(f"`{c}`").cast("int") for c in labels]).alias("label_phe"),
        F.concat_ws(
            "#",
            F.col("_metadata.file_path"),
            F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"),
        ).alias("_split"),
    )
    out = _file_order(listed, [], "list_pos")
    return out.withColumn("split", F.lit(split)) if split else out


def label_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the labels of a split list, in order."""
    return spark.read.csv(path, header=True).columns[2:]


def read_series(spark: SparkSession, path: str, variables: Sequence[str]) -> DataFrame:
    """Per-stay CSV files as one table: stay, row_idx, hours and the variables."""
    raw = spark.read.csv(path, header=True)
    wanted = raw.select(
        F.col("_metadata.file_name").alias("stay"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.col("Hours").try_cast("double").alias("hours"),
        *[F.col(f"`{v}`") for v in variables],
    )
    return _file_order(wanted, ["stay"], "row_idx")


def split_sizes(df: DataFrame, keys: Sequence[str] = ("task", "split")) -> DataFrame:
    """Row count per task and split."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def save_split(df: DataFrame, path: str) -> None:
    """Write a dataset with one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Read one split; only its folder is scanned."""
    if split not in SPLITS:
        raise ValueError(f"split must be one of {list(SPLITS)}")
    return spark.read.parquet(path).where(F.col("split") == split)


def save_synthetic(df: DataFrame, path: str, name: str) -> None:
    """Save detokenized synthetic records; a token table is refused."""
    if "token_id" in df.columns:
        raise ValueError("detokenize the data before saving it")
    df.write.mode("overwrite").parquet(f"{path}/{name}")


def path_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished job wrote ``path``."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def cached(
    spark: SparkSession,
    build: Callable[[], DataFrame],
    path: str,
    key: str = "",
    redo: bool = False,
) -> DataFrame:
    """Reuse the table at ``path`` unless ``redo``; else build and write it.

    ``key`` names what the table depends on (see ``Metadata.key``), so a table
    made with other metadata is never picked up.
    """
    target = f"{path}/key={key}" if key else path
    if redo or not path_complete(spark, target):
        build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def flat_first_stay(
    series: DataFrame,
    stays: DataFrame,
    categorical: Sequence[str],
    continuous: Sequence[str],
    bounds: Mapping[str, tuple[float, float]],
    n_labels: int,
) -> DataFrame:
    """First-stay series rows with covariates and one column per label."""
    static = first_stay(stays).select(
        "sid", "age", "gender", "label_ihm", *label_columns("label_phe", n_labels)
    )
    rows = attach_static(first_stay(series), static, "sid")
    return clip_series(coerce_types(rows, categorical, continuous), bounds)


def export_series_csv(df: DataFrame, path: str) -> None:
    """Write a flat table as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
