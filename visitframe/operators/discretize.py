"""Stays, codes and series to bins: the discretized event table.

Discretized events are rows ``(sid, stay_idx, section, a, b, kind, var_id,
value)``. ``section`` orders the parts of a stay, ``a`` the items of a part
(code position, series row) and ``b`` the cells of a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitframe.functions.columns import bin_index
from visitframe.functions.ordered import union_all, with_halo
from visitframe.operators.restructure import lookup_tokens
from visitframe.operators.vocab import Metadata
from visitframe.schema import HORIZON_HOURS

STAY = ["sid", "stay_idx"]
COVAR, LABEL, CODE, SERIES = 1, 3, 5, 7
GAP_CELL = 1_000_000
EVENT_COLUMNS = [*STAY, "section", "a", "b", "kind", "var_id", "value"]


def gap_bin(
    series: DataFrame,
    edges: Sequence[float],
    keys: Sequence[str] = STAY,
    width: int = 4096,
) -> DataFrame:
    """Bin of the hours since the previous row (since 0 for the first row).

    The previous row counts whether or not it survives discretization, so this
    comes before any row is dropped. Needs the dense ``row_idx``.
    """
    near = with_halo(series, "row_idx", before=1, width=width)
    w = Window.partitionBy(*keys, "_block").orderBy("row_idx")
    gap = F.col("hours") - F.lag("hours", 1, 0.0).over(w)
    return (
        near.withColumn("gap", gap)
        .where("_home")
        .drop("_home", "_block")
        .withColumn("gap", bin_index(F.col("gap"), edges))
    )


def map_categories(series: DataFrame, categories: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Add ``_v_{i}``: the level of each categorical cell, NULL if unmapped."""
    out = series
    for i, v in enumerate(variables):
        levels = categories.where(F.col("var") == v).select(
            F.col("text").alias(f"_t_{i}"), F.col("value").alias(f"_v_{i}")
        )
        out = out.join(levels, F.col(v).cast("string") == F.col(f"_t_{i}"), "left").drop(f"_t_{i}")
    return out


def discretize_series(series: DataFrame, meta: Metadata, width: int = 4096) -> DataFrame:
    """One row per surviving series row: ``gap`` and ``cells`` (var_id, value).

    NULL cells are skipped; an unmappable categorical drops the whole row; an
    unparsable number drops only itself; a row without cells drops.
    """
    variables = meta.series_variables()
    categorical = [v for v in variables if v.edges is None and v.n_tokens > 0]
    # A variable without tokens (no bins learned) is left out.
    continuous = [v for v in variables if v.edges is not None and len(v.edges) > 1]
    rows = gap_bin(series, meta.edges("Hours"), width=width)
    rows = map_categories(rows, meta.categories, [v.name for v in categorical])
    bad = F.lit(False)
    cells = []
    for i, v in enumerate(categorical):
        present = F.col(v.name).isNotNull()
        bad = bad | (present & F.col(f"_v_{i}").isNull())
        cells.append(
            F.when(present, F.struct(F.lit(v.var_id).alias("var_id"), F.col(f"_v_{i}").alias("value")))
        )
    for v in continuous:
        number = F.col(v.name).try_cast("double")
        value = bin_index(number, v.edges)
        cells.append(
            F.when(number.isNotNull(), F.struct(F.lit(v.var_id).alias("var_id"), value.alias("value")))
        )
    kept = rows.withColumn("cells", F.array_compact(F.array(*cells)))
    return kept.where(~bad & (F.size("cells") > 0)).select(
        *STAY, "row_idx", "hours", "gap", "cells"
    )


def series_events(rows: DataFrame, hours_id: int) -> DataFrame:
    """Cells and then the gap of each surviving row, as events."""
    gap = F.struct(F.lit(hours_id).alias("var_id"), F.col("gap").alias("value"))
    cells = rows.select(
        *STAY, F.col("row_idx").alias("a"), F.size("cells").alias("_n"),
        F.posexplode(F.array_append("cells", gap)).alias("_b", "_c"),
    )
    is_gap = F.col("_b") == F.col("_n")
    return cells.select(
        *STAY,
        F.lit(SERIES).alias("section"),
        F.col("a").cast("long").alias("a"),
        F.when(is_gap, F.lit(GAP_CELL)).otherwise(F.col("_b")).alias("b"),
        F.when(is_gap, F.lit("timestamp")).otherwise(F.lit("ts")).alias("kind"),
        F.col("_c.var_id").alias("var_id"),
        F.col("_c.value").alias("value"),
    )


def discretize_covars(stays: DataFrame, meta: Metadata) -> DataFrame:
    """Age by edges and gender by value, as events."""
    age = F.struct(
        F.lit(meta.var_id("Age")).alias("var_id"),
        bin_index(F.col("age"), meta.edges("Age")).alias("value"),
    )
    gender = F.struct(
        F.lit(meta.var_id("Gender")).alias("var_id"), F.col("gender").cast("int").alias("value")
    )
    return stays.select(*STAY, F.posexplode(F.array(age, gender)).alias("_p", "_c")).select(
        *STAY,
        F.lit(COVAR).alias("section"),
        F.lit(0).cast("long").alias("a"),
        F.col("_p").alias("b"),
        F.lit("covar").alias("kind"),
        F.col("_c.var_id").alias("var_id"),
        F.col("_c.value").alias("value"),
    )


def label_events(stays: DataFrame) -> DataFrame:
    """The mortality label, then the set phenotypes in rising order."""
    phe = F.transform(
        "label_phe",
        lambda x, i: F.when(x != 0, F.struct((i + 1).cast("int").alias("b"), F.lit("phe").alias("kind"), i.cast("int").alias("value"))),
    )
    ihm = F.struct(
        F.lit(0).alias("b"), F.lit("ihm").alias("kind"), F.col("label_ihm").cast("int").alias("value")
    )
    return stays.select(
        *STAY, F.explode(F.array_compact(F.array_prepend(phe, ihm))).alias("_c")
    ).select(
        *STAY,
        F.lit(LABEL).alias("section"),
        F.lit(0).cast("long").alias("a"),
        "_c.b",
        "_c.kind",
        F.lit(-1).alias("var_id"),
        "_c.value",
    )


def code_events(codes: DataFrame, meta: Metadata, on_unknown: str = "error") -> DataFrame:
    """Codes of stays as events; an unknown code raises."""
    ids = meta.codes.select("code", F.col("code_id").alias("value"))
    found = lookup_tokens(codes.where(F.col("code").isNotNull()), ids, ["code"], on_unknown)
    return found.select(
        *STAY,
        F.lit(CODE).alias("section"),
        F.col("code_pos").cast("long").alias("a"),
        F.lit(0).alias("b"),
        F.lit("code").alias("kind"),
        F.lit(-1).alias("var_id"),
        F.col("value").cast("int").alias("value"),
    )


def discretize(
    stays: DataFrame, codes: DataFrame, series: DataFrame, meta: Metadata
) -> DataFrame:
    """All discretized events of the given stays."""
    rows = discretize_series(series, meta)
    return union_all(
        [
            discretize_covars(stays, meta),
            label_events(stays),
            code_events(codes, meta),
            series_events(rows, meta.var_id("Hours")),
        ]
    )


def horizon_rows(series: DataFrame, hours: Sequence[float] = HORIZON_HOURS) -> DataFrame:
    """Per stay and horizon: the first original row at the largest hour below it.

    ``row_idx`` is -1 when no row is early enough. Both picks are one map-side
    aggregate: the largest hour, and the smallest row at that hour.
    """
    picks = [
        F.max(
            F.when(F.col("hours") < h, F.struct(F.col("hours"), (-F.col("row_idx")).alias("r")))
        ).alias(f"_h{i}")
        for i, h in enumerate(hours)
    ]
    found = series.groupBy(*STAY).agg(*picks)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(h)).alias("horizon"),
                F.coalesce(-F.col(f"_h{i}.r"), F.lit(-1)).cast("long").alias("row_idx"),
            )
            for i, h in enumerate(hours)
        ]
    )
    return found.select(*STAY, F.inline(rows))


def bad_value_report(series: DataFrame, continuous: Sequence[str]) -> DataFrame:
    """Per variable: cells that are present but not numbers."""
    counted = series.agg(
        *[
            F.count_if(F.col(v).isNotNull() & F.col(v).try_cast("double").isNull()).alias(f"_{i}")
            for i, v in enumerate(continuous)
        ]
    )
    rows = [F.struct(F.lit(v).alias("var"), F.col(f"_{i}").alias("n_bad")) for i, v in enumerate(continuous)]
    return counted.select(F.inline(F.array(*rows)))
