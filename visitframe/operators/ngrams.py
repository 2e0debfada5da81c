"""n-gram shares of token sequences, and how two distributions differ."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitframe.functions.columns import ratio
from visitframe.functions.ordered import block_of, position_in, union_all, with_halo
from visitframe.operators.restructure import common_keys
from visitframe.session import durable

METRICS = ["kl", "js", "cosine", "euclidean", "pearson", "r2", "r2_log", "common_pct"]
MIN_COMMON = 10


def drop_pads(tokens: DataFrame, pad_id: int, by: Sequence[str] = ()) -> DataFrame:
    """Tokens without padding, renumbered so that positions stay dense."""
    kept = tokens.where(F.col("token_id") != pad_id).select(
        *by, "seq", F.col("pos").alias("_old"), "token_id"
    )
    blocked = kept.withColumn("_block", block_of("_old"))
    return position_in(blocked, [*by, "seq"], ["_block"], ["_old"], "pos").drop("_old", "_block")


def grams(tokens: DataFrame, n: int, width: int = 4096) -> DataFrame:
    """Every run of ``n`` tokens as columns ``t1..tn``; positions are dense.

    A block sees the ``n - 1`` tokens after it, so one shuffle is enough and a
    long sequence is spread over its blocks.
    """
    near = with_halo(tokens.select("seq", "pos", "token_id"), "pos", after=n - 1, width=width)
    w = Window.partitionBy("seq", "_block").orderBy("pos")
    runs = near.select(
        "seq",
        "_home",
        F.col("token_id").alias("t1"),
        *[F.lead("token_id", i).over(w).alias(f"t{i + 1}") for i in range(1, n)],
    )
    return runs.where(F.col("_home") & F.col(f"t{n}").isNotNull()).drop("_home")


def ngram_levels(tokens: DataFrame, longest: int, by: Sequence[str] = (), width: int = 4096) -> DataFrame:
    """(by, order, run, n): counts of the runs of 1 to ``longest`` tokens, tokens read once.

    The runs of full length, and the shorter ones that begin near the end of
    a sequence, are counted first. Every shorter order is the sum over the
    prefixes of the order above and the runs that end exactly there.
    """
    by = list(by)
    near = with_halo(tokens.select(*by, "seq", "pos", "token_id"), "pos", after=longest - 1, width=width)
    w = Window.partitionBy(*by, "seq", "_block").orderBy("pos")
    ahead = [F.col("token_id"), *[F.lead("token_id", i).over(w) for i in range(1, longest)]]
    runs = near.select(*by, "_home", F.array_compact(F.array(*ahead)).alias("run")).where("_home")
    counted = durable(runs.groupBy(*by, "run").agg(F.count("*").alias("n")))
    level = counted.where(F.size("run") == longest)
    levels = [level]
    for n in range(longest - 1, 0, -1):
        shorter = level.select(*by, F.slice("run", 1, n).alias("run"), "n").unionByName(counted.where(F.size("run") == n))
        level = durable(shorter.groupBy(*by, "run").agg(F.sum("n").alias("n")))
        levels.append(level)
    return union_all(levels).select(*by, F.size("run").alias("order"), "run", "n")


def ngram_probs(
    tokens: DataFrame,
    n: int,
    lo: float = 0.0,
    hi: float = 1.0,
    pad_id: int | None = None,
) -> DataFrame:
    """(t1..tn, n, p) of contiguous n-grams; ``lo <= p <= hi`` after normalising."""
    if pad_id is not None:
        tokens = drop_pads(tokens, pad_id)
    keys = [f"t{i + 1}" for i in range(n)]
    counts = grams(tokens, n).groupBy(*keys).agg(F.count("*").alias("n"))
    lengths = tokens.groupBy("seq").agg(F.count("*").alias("_len"))
    total = lengths.agg(F.sum(F.greatest(F.col("_len") - (n - 1), F.lit(0)))).scalar()
    share = counts.withColumn("p", F.col("n") / total)
    return share.where(F.col("p").between(lo, hi))


def compare_distributions(
    p: DataFrame, q: DataFrame, keys: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Distances of ``p`` and ``q`` over their common keys, renormalised.

    One row per ``by`` group. Fewer than ten common keys gives zeros and no log
    R2. ``p`` is the truth of both R2 scores.
    """
    by = list(by)
    joined = durable(common_keys(p, q, [*by, *keys]))
    sizes = p.groupBy(*by).agg(F.count("*").alias("_size"))
    sums = joined.groupBy(*by).agg(F.sum("p").alias("_sp"), F.sum("q").alias("_sq"))
    if by:
        # One row per compared group.
        scaled = joined.join(F.broadcast(sums), by)
    else:
        both = sums.select(F.struct("_sp", "_sq")).scalar()
        scaled = joined.withColumn("_s", both).select("*", "_s.*")
    x, y = F.col("x"), F.col("y")
    m = (x + y) / 2
    scaled = scaled.select(*by, (F.col("p") / F.col("_sp")).alias("x"), (F.col("q") / F.col("_sq")).alias("y"))

    def r2(a, b):
        return 1 - ratio(F.sum((a - b) * (a - b)), F.var_pop(a) * F.count("*"))

    found = scaled.groupBy(*by).agg(
        F.count("*").alias("n_common"),
        F.sum(x * F.log(x / y)).alias("kl"),
        (F.sum(x * F.log(x / m)) / 2 + F.sum(y * F.log(y / m)) / 2).alias("js"),
        ratio(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))).alias("cosine"),
        F.sqrt(F.sum((x - y) * (x - y))).alias("euclidean"),
        ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("pearson"),
        r2(x, y).alias("r2"),
        r2(F.log(x), F.log(y)).alias("r2_log"),
    )
    if by:
        out = sizes.join(found, by, "left")
    else:
        out = found.withColumn("_size", sizes.scalar())
    out = out.withColumn("common_pct", ratio(100 * F.col("n_common"), F.col("_size")))
    enough = F.coalesce("n_common", F.lit(0)) >= MIN_COMMON
    return out.select(
        *by,
        *[F.when(enough, F.col(c)).otherwise(None if c == "r2_log" else 0.0).alias(c) for c in METRICS],
    )


def ngram_report(
    cohorts: Mapping[str, DataFrame] | DataFrame,
    pairs: Sequence[tuple[str, str]],
    orders: Sequence[int] = (1, 2, 3, 4),
    pad_id: int | None = None,
) -> DataFrame:
    """Distances for every n-gram order and pair of cohorts, in one table.

    ``cohorts`` has the tokens of each cohort by name, or is one token table
    with a column ``cohort``, which is read once.
    """
    longest = max(orders)
    if isinstance(cohorts, DataFrame):
        used = [name for pair in pairs for name in pair]
        tagged_tokens = cohorts.where(F.col("cohort").isin(used))
        if pad_id is not None:
            tagged_tokens = drop_pads(tagged_tokens, pad_id, ["cohort"])
    else:
        tagged_tokens = union_all(
            [
                (drop_pads(tokens, pad_id) if pad_id is not None else tokens).select(F.lit(name).alias("cohort"), "seq", "pos", "token_id")
                for name, tokens in cohorts.items()
            ]
        )
    counts = ngram_levels(tagged_tokens, longest, ["cohort"])
    group = ["cohort", "order"]
    totals = counts.groupBy(*group).agg(F.sum("n").alias("_total"))
    keys = [f"t{i + 1}" for i in range(longest)]
    # One row per cohort and order. The levels lie written, their shares are not written again.
    shares = counts.where(F.col("order").isin(list(orders))).join(F.broadcast(totals), group).select(
        *group,
        *[F.coalesce(F.get("run", F.lit(i)), F.lit(-1)).alias(k) for i, k in enumerate(keys)],
        (F.col("n") / F.col("_total")).alias("p"),
    )

    def tagged(name: str, pair: str) -> DataFrame:
        return shares.where(F.col("cohort") == name).select(F.lit(pair).alias("pair"), "order", *keys, "p")

    left = union_all([tagged(a, f"{a}-{b}") for a, b in pairs])
    right = union_all([tagged(b, f"{a}-{b}") for a, b in pairs])
    return compare_distributions(left, right, keys, ["pair", "order"])
