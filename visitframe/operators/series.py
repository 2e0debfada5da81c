"""Time-series fidelity: fill, correlations, bands, summary features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitframe.functions.columns import ratio
from visitframe.functions.ordered import union_all, with_halo
from visitframe.operators import moments
from visitframe.operators.restructure import intersect_ids
from visitframe.session import durable

BANDS = ["high-neg", "medium-neg", "low", "medium-pos", "high-pos"]
PAIR = ["var_a", "var_b"]


def ffill(
    df: DataFrame, key: str, variables: Sequence[str], order: str = "row_idx", limit: int = 6,
    width: int = 4096,
) -> DataFrame:
    """Carry the last value forward over at most ``limit`` rows of an id.

    ``order`` is a dense row number, so a block with ``limit`` rows before it
    sees all it needs.
    """
    near = with_halo(df, order, before=limit, width=width)
    w = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(-limit, 0)
    filled = near.withColumns({v: F.last(v, ignorenulls=True).over(w) for v in variables})
    return filled.where("_home").drop("_home", "_block")


def corr_matrix(df: DataFrame, variables: Sequence[str], min_pairs: int = 100) -> DataFrame:
    """Lower triangle (var_a, var_b, corr, n_pairs) over complete pairs.

    Fewer than ``min_pairs`` rows or a constant side give NULL.
    """
    found = moments.pair_moments(df, variables)
    return found.select(*PAIR, moments.corr_of(min_pairs).alias("corr"), F.col("n").alias("n_pairs"))


def corr_by_id(df: DataFrame, variables: Sequence[str], key: str = "id") -> DataFrame:
    """Correlation per id, NULL as 0, averaged over ids."""
    return moments.mean_corr_by_key(df, variables, key)


def correlation(
    df: DataFrame, variables: Sequence[str], method: str = "none", key: str = "id",
    min_pairs: int = 100,
) -> DataFrame:
    """Correlation matrix by method: ``none``, ``ffill`` or ``agg``."""
    if method == "none":
        return corr_matrix(df, variables, min_pairs)
    if method == "ffill":
        return corr_matrix(ffill(df, key, variables), variables, min_pairs)
    if method == "agg":
        return corr_by_id(ffill(df, key, variables), variables, key)
    raise ValueError("method must be 'none', 'ffill' or 'agg'")


def corr_threshold(m: DataFrame, th: float = 0.2) -> DataFrame:
    """Weak correlations to 0; the upper triangle is not stored."""
    return m.withColumn("corr", F.when(F.abs("corr") < th, 0.0).otherwise(F.col("corr")))


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select(*PAIR, F.col("corr").alias("_a"))
    return left.join(b.select(*PAIR, F.col("corr").alias("_b")), PAIR)


def corr_distance(a: DataFrame, b: DataFrame, th: float = 0.2) -> DataFrame:
    """Mean absolute difference of two thresholded matrices, NULL as 0."""
    pairs = _both(corr_threshold(a, th), corr_threshold(b, th))
    gap = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return pairs.agg((F.sum(gap) / F.count("*")).alias("corr_distance"))


def corr_diff(a: DataFrame, b: DataFrame, th: float = 0.2) -> DataFrame:
    """|b - a| by pair; 0 where a is weak, NULL where b is NULL or the gap is small."""
    gap = F.abs(F.col("_b") - F.col("_a"))
    shown = F.when(F.abs("_a") < th, 0.0).when(gap >= th, gap)
    return _both(a, b).select(*PAIR, shown.alias("diff"))


def corr_band(c: str | Column) -> Column:
    """Band of a correlation; a shared end belongs to the later band."""
    value = F.col(c) if isinstance(c, str) else c
    return (
        F.when(value >= 0.5, "high-pos")
        .when(value >= 0.2, "medium-pos")
        .when(value >= -0.2, "low")
        .when(value >= -0.5, "medium-neg")
        .when(value.isNotNull(), "high-neg")
        .otherwise("null")
    )


def band_confusion(a: DataFrame, b: DataFrame, with_null: bool = True) -> DataFrame:
    """(band_a, band_b, n) over the full class grid."""
    classes = [*BANDS, "null"] if with_null else BANDS
    cells = F.array(*[F.lit(x) for x in classes])
    spark = a.sparkSession
    grid = (
        spark.range(1)
        .select(F.explode(cells).alias("band_a"))
        .select("band_a", F.explode(cells).alias("band_b"))
    )
    seen = (
        _both(a, b)
        .groupBy(corr_band("_a").alias("band_a"), corr_band("_b").alias("band_b"))
        .agg(F.count("*").alias("n"))
    )
    return grid.join(seen, ["band_a", "band_b"], "left").fillna(0, ["n"])


def band_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per band: accuracy and F1 of ``b`` against ``a`` over the lower triangle."""
    pairs = _both(a, b).select(corr_band("_a").alias("_x"), corr_band("_b").alias("_y"))
    rows = pairs.select("_x", "_y", F.explode(F.array(*[F.lit(x) for x in BANDS])).alias("band"))
    in_a, in_b = F.col("_x") == F.col("band"), F.col("_y") == F.col("band")
    both = F.count_if(in_a & in_b)
    return rows.groupBy("band").agg(
        (F.count_if(in_a == in_b) / F.count("*")).alias("accuracy"),
        F.coalesce(ratio(2 * both, F.count_if(in_a) + F.count_if(in_b)), F.lit(0.0)).alias("f1"),
    )


def correlation_report(
    real: DataFrame,
    test: DataFrame,
    synthetic: DataFrame,
    variables: Sequence[str],
    method: str = "none",
    th: float = 0.2,
    key: str = "id",
) -> DataFrame:
    """(against, metric, value): real against test and against synthetic.

    ``corr_distance``; ``accuracy/band`` and ``f1/band``; the confusion of the
    six classes as ``confusion/band/band``; the masked difference of each pair
    of variables as ``difference/var/var`` (NULL where it is not shown).
    """
    base = durable(correlation(real, variables, method, key))
    parts = []
    for name, frame in (("test", test), ("synthetic", synthetic)):
        other = durable(correlation(frame, variables, method, key))
        scores = band_scores(base, other).unpivot(["band"], ["accuracy", "f1"], "metric", "value")
        found = [
            (F.lit("corr_distance"), corr_distance(base, other, th).withColumnRenamed("corr_distance", "value")),
            (F.concat_ws("/", "metric", "band"), scores),
            (F.concat_ws("/", F.lit("confusion"), "band_a", "band_b"), band_confusion(base, other).withColumnRenamed("n", "value")),
            (F.concat_ws("/", F.lit("difference"), *PAIR), corr_diff(base, other, th).withColumnRenamed("diff", "value")),
        ]
        parts += [
            t.select(F.lit(name).alias("against"), metric.alias("metric"), F.col("value").cast("double").alias("value"))
            for metric, t in found
        ]
    return union_all(parts)


# --- features --------------------------------------------------------------------

def _one(df: DataFrame, functions: dict, variables: Sequence[str]) -> Column:
    """All ``function(variable)`` of a frame as one scalar struct."""
    return df.agg(
        F.struct(*[f(v).alias(f"{n}_{v}") for n, f in functions.items() for v in variables])
    ).scalar()


def summary_features(
    df: DataFrame, variables: Sequence[str], base: DataFrame | None = None, key: str = "id"
) -> DataFrame:
    """Per id: min, max, mean and std of each standardised variable.

    NULL becomes the mean of this frame; mean and deviation of ``base`` scale.
    """
    tagged = df.select(key, *variables).withColumns(
        {
            "_own": _one(df, {"mean": F.avg}, variables),
            "_base": _one(base if base is not None else df, {"mean": F.avg, "std": F.stddev_samp}, variables),
        }
    )
    scaled = tagged.select(
        key,
        *[
            ratio(
                F.coalesce(F.col(v), F.col("_own")[f"mean_{v}"]) - F.col("_base")[f"mean_{v}"],
                F.col("_base")[f"std_{v}"],
            ).alias(v)
            for v in variables
        ],
    )
    stats = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}
    return scaled.groupBy(key).agg(
        *[f(v).alias(f"{v}_{n}") for v in variables for n, f in stats.items()]
    )


def feature_table(
    df: DataFrame,
    static: DataFrame,
    variables: Sequence[str],
    labels: Sequence[str],
    base: DataFrame | None = None,
    key: str = "id",
) -> DataFrame:
    """Features with their labels, joined by id; ids in both tables only."""
    features, kept = intersect_ids(
        summary_features(df, variables, base, key), static.select(key, *labels), key
    )
    return features.join(kept, key)


def missing_rate(df: DataFrame, variables: Sequence[str], key: str = "id") -> DataFrame:
    """Per id: NULL cells over the largest hour, by variable."""
    return df.groupBy(key).agg(
        *[
            ratio(F.count_if(F.col(v).isNull()), F.max("hours")).alias(f"mr_{v}")
            for v in variables
        ]
    )
