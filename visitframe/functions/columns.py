"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_stay(stay: str | Column) -> tuple[Column, Column]:
    """Subject id and zero-based stay order of ``"{sid}_episode{n}_..."``."""
    pattern = r"^(\d+)_episode(\d+)"
    sid = F.regexp_extract(stay, pattern, 1).cast("long")
    order = (F.regexp_extract(stay, pattern, 2).cast("long") - 1).cast("int")
    return sid, order


def encode_flag(column: str | Column, positive: str = "M") -> Column:
    """1 where the value equals ``positive``, 0 elsewhere and for NULL."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(value == positive, 1).otherwise(0)


def clip_to(column: Column, low: Column, high: Column) -> Column:
    """Clip to ``[low, high]``; NULL stays NULL (least / greatest skip it)."""
    return F.when(column.isNotNull(), F.greatest(low, F.least(high, column)))


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """Bin of ``value``: first i with ``value <= edges[i + 1]``.

    Below the range gives 0; above it, and NaN, the last bin. NULL stays NULL.
    """
    last = len(edges) - 2
    out = F.when(value.isNull() | (len(edges) < 2), F.lit(None).cast("int"))
    for i in range(last):
        out = out.when(value <= F.lit(float(edges[i + 1])), F.lit(i))
    return out.otherwise(F.lit(max(last, 0)))


def hash_uniform(seed: int, *keys: str | Column) -> Column:
    """Uniform in [0, 1) from the MD5 of seed and keys: the same on any partitioning.

    The first 52 bits of ``md5("seed|key|...")``; NULL keys are left out.
    """
    parts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def pad_array(tokens: str | Column, length: int, pad_id: int) -> Column:
    """Cut or right-pad an array to ``length``."""
    column = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.slice(F.concat(column, F.array_repeat(F.lit(pad_id), length)), 1, length)


def attention_mask(tokens: str | Column, pad_id: int) -> Column:
    """1 for real tokens, 0 for padding (and so for masked positions too)."""
    return F.transform(tokens, lambda t: F.when(t != pad_id, 1).otherwise(0))


def label_columns(labels: str | Column, count: int, prefix: str = "label_phe_") -> list[Column]:
    """Fan a label array out to one column per label."""
    return [F.get(labels, F.lit(i)).alias(f"{prefix}{i}") for i in range(count)]


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives NULL for a zero divisor."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))
