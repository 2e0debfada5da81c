"""Raw tables to stays, codes and patients; id joins; regular grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitframe.functions.columns import encode_flag
from visitframe.functions.ordered import block_of, position_in


def resolve_stays(
    listed: DataFrame, stays: DataFrame, block: Column, order: Sequence[str]
) -> DataFrame:
    """Listed stay to its admission: the n-th row of the subject's stay file.

    ``stays`` has sid, hadm_id, age, gender text and mortality. ``order`` is
    its row order within a subject, ``block`` a coarser value of it.
    """
    numbered = position_in(
        stays.withColumn("_block", block), ["sid"], ["_block"], order, "episode"
    ).drop("_block")
    return listed.join(numbered, ["sid", "episode"]).withColumn("gender", encode_flag("gender"))


def number_stays(stays: DataFrame, order: str = "list_pos", width: int = 4096) -> DataFrame:
    """Group stays into patients: ``stay_idx`` follows the list order."""
    blocked = stays.withColumn("_block", block_of(order, width))
    out = position_in(blocked, ["sid"], ["_block"], [order], "stay_idx", coarse=True).drop("_block")
    return out.withColumn("stay_idx", F.col("stay_idx").cast("int"))


def patients(stays: DataFrame) -> DataFrame:
    """One row per patient: split and number of stays."""
    return stays.groupBy("sid").agg(
        F.min("split").alias("split"),
        F.count("*").alias("n_stays"),
        F.min("list_pos").alias("first_list_pos"),
    )


#: Cells (codes, and visits without one) that a row of nested records holds at most.
RECORD_CELLS = 4096


def nest_records(stays: DataFrame, codes: DataFrame, cells: int = RECORD_CELLS) -> DataFrame:
    """Patients as nested rows (sid, part, visits): a patient's stays with their codes, in order.

    ``visits`` holds (stay_idx, hadm_id, label_phe, label_ihm, first_pos,
    codes). A row has ``cells`` codes at most, so a long history is several
    parts, and a stay may go on in the next part at ``first_pos``. ``codes``
    has (hadm_id, code_pos, code); a stay without codes keeps its place.
    """
    facts = ["hadm_id", "label_phe", "label_ihm"]
    rows = stays.select("sid", "stay_idx", *facts).join(codes.select("hadm_id", "code_pos", "code"), "hadm_id", "left")
    blocked = rows.withColumn("_block", block_of(F.coalesce("code_pos", F.lit(0))))
    placed = position_in(blocked, ["sid"], ["stay_idx", "_block"], ["code_pos"], "_place")
    parts = placed.withColumn("part", block_of("_place", cells))
    cell = F.when(F.col("code").isNotNull(), F.struct("code_pos", "code"))
    visits = parts.groupBy("sid", "part", "stay_idx").agg(
        *[F.any_value(c).alias(c) for c in facts],
        F.min("code_pos").alias("first_pos"),
        F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["code"]).alias("codes"),
    )
    visit = F.struct("stay_idx", *facts, "first_pos", "codes")
    return visits.groupBy("sid", "part").agg(F.array_sort(F.collect_list(visit)).alias("visits"))


def flat_records(nested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nested records back to (stays, codes), the parts of a stay joined again."""
    visits = nested.select("sid", F.inline("visits"))
    stays = visits.groupBy("sid", "stay_idx").agg(*[F.any_value(c).alias(c) for c in ("hadm_id", "label_phe", "label_ihm")])
    codes = visits.select("hadm_id", "first_pos", F.posexplode("codes").alias("_i", "code"))
    return stays, codes.select("hadm_id", (F.col("first_pos") + F.col("_i")).cast("int").alias("code_pos"), "code")


def order_codes(codes: DataFrame, tie: Sequence[str] = ("code",), width: int = 1024) -> DataFrame:
    """Add ``code_pos``: diagnoses before procedures, each by ``seq_num``."""
    blocked = codes.withColumns(
        {
            "_sys": F.when(F.col("sys") == "icd", 0).otherwise(1),
            "_block": block_of("seq_num", width),
        }
    )
    placed = position_in(
        blocked, ["hadm_id"], ["_sys", "_block"], ["seq_num", *tie], "code_pos"
    )
    return placed.drop("_sys", "_block").withColumn("code_pos", F.col("code_pos").cast("int"))


def attach_codes(stays: DataFrame, codes: DataFrame) -> DataFrame:
    """Stay to its ordered codes; a stay without codes keeps one NULL row."""
    return stays.join(codes.select("hadm_id", "code_pos", "sys", "code"), "hadm_id", "left")


def task_overlap(a: DataFrame, b: DataFrame, key: str = "stay") -> DataFrame:
    """Coverage of two lists: in both, only the first, only the second."""
    left = a.select(key, F.lit(1).alias("in_a"))
    right = b.select(key, F.lit(1).alias("in_b"))
    return left.join(right, key, "full_outer").select(
        key,
        F.coalesce("in_a", F.lit(0)).alias("in_a"),
        F.coalesce("in_b", F.lit(0)).alias("in_b"),
    )


def lookup_tokens(
    df: DataFrame, vocab: DataFrame, on: Sequence[str], on_unknown: str = "error"
) -> DataFrame:
    """Join ids of known keys. Unknown keys raise, drop, or stay NULL."""
    if on_unknown == "drop":
        return df.join(vocab, list(on))
    if on_unknown not in ("error", "null"):
        raise ValueError("on_unknown must be 'error', 'drop' or 'null'")
    found = [c for c in vocab.columns if c not in on]
    joined = df.join(vocab.withColumn("_known", F.lit(True)), list(on), "left")
    if on_unknown == "error":
        text = F.concat_ws(" ", F.lit("unknown key:"), *[F.col(c).cast("string") for c in on])
        known = F.when(F.col("_known"), F.col(found[0]))
        joined = joined.withColumn(found[0], known.otherwise(F.raise_error(text)))
    return joined.drop("_known")


def intersect_ids(a: DataFrame, b: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows of both frames whose id is in the other one."""
    return a.join(b.select(key), key, "left_semi"), b.join(a.select(key), key, "left_semi")


def common_keys(p: DataFrame, q: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of both tables with the two values ``p`` and ``q``."""
    left = p.select(*keys, F.col("p"))
    return left.join(q.select(*keys, F.col("p").alias("q")), list(keys))


def all_keys(p: DataFrame, q: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of either table; a missing value is 0."""
    left = p.select(*keys, F.col("p").alias("_p"))
    right = q.select(*keys, F.col("p").alias("_q"))
    return left.join(right, list(keys), "full_outer").select(
        *keys,
        F.coalesce("_p", F.lit(0.0)).alias("p"),
        F.coalesce("_q", F.lit(0.0)).alias("q"),
    )


def to_grid(
    series: DataFrame, key: str, time: str, variables: Sequence[str], step: float, n: int
) -> DataFrame:
    """First ``n`` rows per id of the regular grid merged with the observations.

    Off-grid times push grid rows out. Values are 0-filled, scaled to
    ``2x - 1`` and 0 where missing; ``mask_*`` is 1 / -1.

    Every id brings ``n`` grid rows, so no observation behind the last of them
    and none beyond the id's first ``n`` can matter. These are dropped by a
    group limit before anything is shuffled: what meets of an id, however many
    rows it has, is at most ``2 n`` rows.
    """
    ids = series.select(key).distinct()
    grid = ids.select(
        key,
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * F.lit(float(step)))).alias(
            time
        ),
    )
    at, last = F.col(time), float(step) * (n - 1)
    seen = series.select(key, at.cast("double").alias(time), *variables).where(at.isNull() | (at <= last))
    order = Window.partitionBy(key).orderBy(time, *variables)

    def first(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)

    merged = grid.join(first(seen).drop("_rank"), [key, time], "full_outer")
    cut = first(merged).withColumn("cell", F.col("_rank") - 1)
    return cut.select(
        key,
        "cell",
        *[
            F.when(F.col(v).isNull(), 0.0).otherwise(F.col(v) * 2 - 1).alias(f"value_{v}")
            for v in variables
        ],
        *[F.when(F.col(v).isNull(), -1).otherwise(1).alias(f"mask_{v}") for v in variables],
    )


def grid_images(grid: DataFrame, key: str, variables: Sequence[str], n: int) -> DataFrame:
    """One row per id: ``n x n`` value and mask arrays, columns padded."""
    pad = n - len(variables)

    def line(prefix: str, missing: float) -> Column:
        cells = [F.col(f"{prefix}_{v}").cast("double") for v in variables]
        return F.array(*cells, *[F.lit(missing)] * max(pad, 0))

    rows = grid.groupBy(key).agg(
        F.array_sort(
            F.collect_list(
                F.struct("cell", line("value", 0.0).alias("value"), line("mask", -1.0).alias("mask"))
            )
        ).alias("_rows")
    )
    return rows.select(
        key,
        F.transform("_rows", lambda r: r["value"]).alias("values"),
        F.transform("_rows", lambda r: r["mask"]).alias("masks"),
    )
