"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitframe.session import stage_folder

#: Text bytes that one step of a Python worker holds at a time.
STEP_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares."""
    folder = stage_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def process_cache(name: str) -> dict:
    """A dictionary that a Python worker keeps across its tasks.

    A worker serves one operator at a time. When another one asks, what the
    last one kept is dropped, so caches do not add up over the stages of a job.
    """
    held = sys.modules.setdefault("visitframe_worker_cache", types.ModuleType("visitframe_worker_cache")).__dict__
    if held.get("owner") != name:
        held["owner"], held["kept"] = name, {}
    return held["kept"]


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each has about ``most`` bytes of ``text``, a row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)


def bitmap_of(df: DataFrame, column: str, bits: int) -> Column:
    """A literal of ``bits`` / 64 longs in which each value of a long column sets a bit.

    Its size does not depend on the data; it only keeps rows from a shuffle,
    what it lets through is compared exactly afterwards.
    """
    place = F.pmod(F.col(column), F.lit(bits))
    words = df.groupBy(F.floor(place / 64).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("v")
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    for row in words.collect():
        out[row["w"]] = row["v"]
    return F.lit(out)


def in_bitmap(bitmap: Column, value: Column, bits: int) -> Column:
    """Whether the bit of ``value`` is set: always so for values that made the bitmap."""
    place = F.pmod(value, F.lit(bits).cast("long")).cast("int")
    shifted = F.call_function("shiftrightunsigned", bitmap[F.shiftright(place, 6)], place.bitwiseAND(F.lit(63)))
    return shifted.bitwiseAND(F.lit(1)) == 1


def lowest_hashes(df: DataFrame, column: str, most: int) -> DataFrame:
    """At most ``most`` rows: those of the lowest hash (modulo 2**40) in ``column``.

    A bound that leaves about four times as many rows is set first, so the
    ranking gathers a number of rows that does not grow with the data.
    """
    low = F.pmod(F.col(column), F.lit(1 << 40))
    share = min(1.0, 4 * most / max(1, df.count()))
    return df.where(low < int(share * (1 << 40))).orderBy(low, column).limit(most)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.transform(F.array(value), body)[0]
