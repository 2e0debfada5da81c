"""Projections, filters, type repair and imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.functions.columns import clip_to, hash_uniform


def prefix_codes(df: DataFrame) -> DataFrame:
    """Put the code system in front of the code: ``icd_4019``."""
    return df.withColumn("code", F.concat(F.col("sys"), F.lit("_"), F.col("code")))


def filter_rare(df: DataFrame, code: str = "code", min_count: int = 5) -> DataFrame:
    """Keep rows whose code occurs strictly more than ``min_count`` times."""
    frequent = df.groupBy(code).count().where(F.col("count") > min_count).select(code)
    # One row per code, so it is hashed and the rows are not sorted.
    return df.join(frequent.hint("shuffle_hash"), code, "left_semi")


def top_codes(df: DataFrame, n: int = 10, code: str = "code") -> DataFrame:
    """The ``n`` most frequent codes, name breaking ties."""
    return (
        df.where(F.col(code).isNotNull())
        .groupBy(code)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), code)
        .limit(n)
    )


def coerce_types(
    df: DataFrame, categorical: Sequence[str], continuous: Sequence[str]
) -> DataFrame:
    """Categorical to string with ``'nan'`` as NULL; continuous to double or NULL."""
    fixed = {c: F.nullif(F.col(c).cast("string"), F.lit("nan")) for c in categorical}
    for c in continuous:
        number = F.col(c).try_cast("double")
        fixed[c] = F.when(~F.isnan(number), number)
    return df.withColumns(fixed)


def clip_series(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Clip each variable to its bounds; NULL stays NULL."""
    return df.withColumns(
        {v: clip_to(F.col(v), F.lit(lo), F.lit(hi)) for v, (lo, hi) in bounds.items()}
    )


def first_stay(df: DataFrame) -> DataFrame:
    """Rows of each subject's first stay."""
    return df.where(F.col("stay_idx") == 0)


def attach_static(series: DataFrame, static: DataFrame, key: str = "id") -> DataFrame:
    """Put the static columns of ``key`` on each series row."""
    return series.join(static, key)


def select_vars(df: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Keys and the wanted variables only, so the scan reads nothing else."""
    return df.select(*keys, *variables)


def audit_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: how many NULL and how many infinite values."""
    counted = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(columns)],
        *[
            F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"_i{i}")
            for i, c in enumerate(columns)
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("var"),
                F.col(f"_n{i}").alias("n_null"),
                F.col(f"_i{i}").alias("n_inf"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return counted.select(F.inline(rows))


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinity to NULL, then NULL to the column mean (one scalar row)."""
    finite = df.withColumns(
        {c: F.when(F.abs(F.col(c)) != float("inf"), F.col(c)) for c in columns}
    )
    means = finite.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("m"))
    return (
        finite.withColumn("_m", means.scalar())
        .withColumns({c: F.coalesce(F.col(c), F.col("_m")[c]) for c in columns})
        .drop("_m")
    )


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL to 0."""
    return df.fillna(0, list(columns))


def jitter(
    df: DataFrame, columns: Sequence[str], key: str, sd: float = 1e-5, seed: int = 0
) -> DataFrame:
    """Add N(0, sd) noise, drawn from the row key (Box-Muller)."""

    def normal(i: int):
        u = 1 - hash_uniform(seed, F.lit(2 * i), F.col(key))
        v = hash_uniform(seed, F.lit(2 * i + 1), F.col(key))
        return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)

    return df.withColumns(
        {c: F.col(c) + F.lit(sd) * normal(i) for i, c in enumerate(columns)}
    )
