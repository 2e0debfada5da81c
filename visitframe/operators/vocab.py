"""Vocabulary, variable profiles, bins and the metadata learned from a cohort."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitframe.functions.columns import ratio
from visitframe.functions.ordered import position_in, prefix_by_value, union_all, value_counts
from visitframe.schema import FIXED_EDGES, PHENOTYPES, SPECIAL_TOKENS
from visitframe.session import durable

VOCAB_SCHEMA = "token_id int, kind string, var_id int, value int, literal string"


# --- codes -----------------------------------------------------------------

def code_vocab(codes: DataFrame) -> DataFrame:
    """Code ids: diagnoses by falling count, then procedures; name breaks ties.

    Codes of equal count and equal first letters form the blocks, so the
    vocabulary is ranked without one task holding it.
    """
    counts = (
        codes.where(F.col("code").isNotNull())
        .groupBy("sys", "code")
        .agg(F.count("*").alias("n"))
        .withColumns(
            {
                "_sys": F.when(F.col("sys") == "icd", 0).otherwise(1),
                "_rare": -F.col("n"),
                "_letters": F.substring("code", 1, 8),
            }
        )
    )
    ranked = position_in(counts, [], ["_sys", "_rare", "_letters"], ["code"], "code_id")
    return ranked.select(F.col("code_id").cast("int").alias("code_id"), "sys", "code", "n")


# --- profiles and bins -----------------------------------------------------

def long_values(series: DataFrame, variables: Sequence[str], kind: str = "double") -> DataFrame:
    """(var, value) rows of a wide series, NULL cells included."""
    return series.select(*[F.col(v).cast(kind).alias(v) for v in variables]).unpivot(
        [], list(variables), "var", "value"
    )


def series_ranks(series: DataFrame, continuous: Sequence[str]) -> DataFrame:
    """(var, value, n, before) of every continuous variable, written once.

    ``n`` rows have the value and ``before`` rows of the variable a smaller
    one; NULL cells are one row with a NULL rank. All statistics below are
    sums over this table, so the series itself is read a single time.
    """
    counts = durable(value_counts(long_values(series, continuous), ["var"], "value"))
    present = counts.where(F.col("value").isNotNull())
    ranked = prefix_by_value(present, ["var"], "value", {"before": F.col("n")})
    nulls = counts.where(F.col("value").isNull()).withColumn("before", F.lit(None).cast("long"))
    return durable(ranked.unionByName(nulls))


# The quantiles of a profile.
SHARES = {"q025": 0.025, "median": 0.5, "q975": 0.975}


def _ranked_quantiles(shares: Mapping[str, Column], base: Column, last: Column) -> list[Column]:
    """Linear-interpolation quantiles as aggregates over a rank table.

    ``base`` is the rank of the first row in play, ``last`` the number of rows
    after it; both are constant within the group.
    """
    v, start = F.col("value"), F.col("before") - base
    end = start + F.col("n")

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= start) & (rank < end), v))

    out = []
    for name, share in shares.items():
        rank = share * last
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        out.append((low + (high - low) * (F.max(rank) - F.floor(F.max(rank)))).alias(name))
    return out


def _moments(ranks: DataFrame, suffix: str = "") -> DataFrame:
    v, n = F.col("value"), F.col("n")
    present = ranks.where(v.isNotNull())
    first = present.groupBy("var").agg(
        F.sum("n").alias("_n"),
        (F.sum(v * n) / F.sum("n")).alias("_mean"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
        F.min("before").alias("_base"),
    )
    # One row per variable, that is per column of the series frame.
    around = present.join(F.broadcast(first), "var")
    gap = v - F.col("_mean")
    shares = {q + suffix: F.lit(s) for q, s in SHARES.items()}
    return around.groupBy("var").agg(
        F.max("_mean").alias(f"mean{suffix}"),
        F.sqrt(ratio(F.sum(n * gap * gap), F.max("_n") - 1)).alias(f"std{suffix}"),
        F.max("_min").alias(f"min{suffix}"),
        F.max("_max").alias(f"max{suffix}"),
        *_ranked_quantiles(shares, F.col("_base"), F.col("_n") - 1),
    )


def missing_and_distinct(ranks: DataFrame) -> DataFrame:
    """Missing rate over all rows and number of distinct values, per variable."""
    missing = F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0))
    return ranks.groupBy("var").agg(
        (missing / F.sum("n")).alias("missing_rate"), F.count("value").alias("n_unique")
    )


def profile(ranks: DataFrame) -> DataFrame:
    """Missing rate, distinct values, moments and quantiles of each variable."""
    return missing_and_distinct(ranks).join(_moments(ranks), "var")


def trim_outliers(ranks: DataFrame, stats: DataFrame, times: float = 3.0) -> DataFrame:
    """Drop the far tail of a variable when it is ``times`` too long.

    Both tests use the statistics before trimming.
    """
    long_top = F.col("max") - F.col("q975") > times * (F.col("q975") - F.col("median"))
    long_low = F.col("q025") - F.col("min") > times * (F.col("median") - F.col("q025"))
    limits = stats.select(
        "var",
        F.when(long_top, F.col("q975")).alias("_hi"),
        F.when(long_low, F.col("q025")).alias("_lo"),
    )
    # One row per variable, that is per column of the series frame.
    kept = ranks.where(F.col("value").isNotNull()).join(F.broadcast(limits), "var")
    return kept.where(
        (F.col("_hi").isNull() | (F.col("value") <= F.col("_hi")))
        & (F.col("_lo").isNull() | (F.col("value") >= F.col("_lo")))
    ).select("var", "value", "n", "before")


def series_stats(ranks: DataFrame, times: float = 3.0) -> DataFrame:
    """Profile before (plain names) and after trimming (``*_2``), with bin counts."""
    before = durable(profile(ranks))
    kept = trim_outliers(ranks, before, times)
    return n_bins(before).join(_moments(kept, "_2"), "var")


def n_bins(stats: DataFrame) -> DataFrame:
    """Add the bin count of a variable: at most 10, one per five distinct values."""
    return stats.withColumn("n_bins", F.least(F.lit(10), F.floor(F.col("n_unique") / 5)).cast("int"))


def uniform_edges(stats: DataFrame) -> DataFrame:
    """Equal-width edges; the first is lowered by 0.1 % of the range."""
    lo, hi, n = F.col("min_2"), F.col("max_2"), F.col("n_bins")
    flat = lo == hi
    pad = F.when(lo == 0, F.lit(0.001)).otherwise(0.001 * F.abs(lo))
    start = F.when(flat, lo - pad).otherwise(lo)
    stop = F.when(flat, hi + pad).otherwise(hi)
    edges = F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.when(i == n, stop)
        .when((i == 0) & ~flat, start - 0.001 * (stop - start))
        .otherwise(start + i * ((stop - start) / n)),
    )
    return stats.where(n > 0).select("var", edges.alias("edges"))


def quantile_edges(ranks: DataFrame, stats: DataFrame) -> DataFrame:
    """Edges at equal shares of the trimmed values; duplicate edges are dropped."""
    sizes = ranks.groupBy("var").agg(F.sum("n").alias("_n"), F.min("before").alias("_base"))
    bins = sizes.join(stats.where(F.col("n_bins") > 0).select("var", "n_bins"), "var")
    # One row per variable and edge.
    asked = bins.select(
        "var", "_n", "_base", F.explode(F.sequence(F.lit(0), F.col("n_bins"))).alias("_i"), "n_bins"
    )
    share = {"edge": F.col("_i") / F.col("n_bins")}
    found = ranks.join(F.broadcast(asked), "var").groupBy("var", "_i").agg(
        *_ranked_quantiles(share, F.col("_base"), F.col("_n") - 1)
    )
    return found.groupBy("var").agg(F.array_sort(F.collect_set("edge")).alias("edges"))


def bin_histogram(counts: DataFrame, edges: DataFrame) -> DataFrame:
    """Count, share, center and label per bin, empty bins included.

    Bins are ``[a, b)`` with the last one closed.
    """
    # One row per variable, that is per column of the series frame.
    tagged = counts.join(F.broadcast(edges), "var")
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    tagged = tagged.withColumn(
        "bin", F.size(F.filter(inner, lambda e: e <= F.col("value")))
    ).where(
        (F.col("value") >= F.element_at("edges", 1)) & (F.col("value") <= F.element_at("edges", -1))
    )
    filled = tagged.groupBy("var", "bin").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("var").agg(F.sum("n").alias("_total"))
    grid = edges.select(
        "var", "edges", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin")
    )
    count = F.coalesce("n", F.lit(0))
    left, right = F.get("edges", F.col("bin")), F.get("edges", F.col("bin") + 1)
    return (
        grid.join(filled, ["var", "bin"], "left")
        .join(totals, "var")
        .select(
            "var",
            "bin",
            count.alias("n"),
            (count / F.col("_total")).alias("share"),
            ((left + right) / 2).alias("center"),
            F.concat_ws("_", "var", F.col("bin").cast("string")).alias("label"),
        )
    )


def category_map(
    series: DataFrame,
    categorical: Sequence[str],
    seen: Sequence[str],
    synonyms: Mapping[str, Mapping[str, int]] | None = None,
) -> DataFrame:
    """(var, text, value): fixed spellings, else levels in first-seen order.

    ``seen`` are the columns that order the rows.
    """
    spark = series.sparkSession
    synonyms = {v: m for v, m in (synonyms or {}).items() if v in categorical}
    parts = []
    if synonyms:
        parts.append(
            spark.createDataFrame(
                [(v, t, i) for v, m in synonyms.items() for t, i in m.items()],
                "var string, text string, value int",
            )
        )
    free = [v for v in categorical if v not in synonyms]
    if free:
        order = F.struct(*seen)
        texts = series.select(order.alias("_at"), *[F.col(v).cast("string").alias(v) for v in free])
        first = (
            texts.unpivot(["_at"], free, "var", "text")
            .where(F.col("text").isNotNull())
            .groupBy("var", "text")
            .agg(F.min("_at").alias("_at"))
        )
        # The window runs over distinct levels, not over rows.
        rank = F.row_number().over(Window.partitionBy("var").orderBy("_at", "text"))
        parts.append(first.select("var", "text", (rank - 1).alias("value")))
    return union_all(parts)


def edge_table(spark: SparkSession, edges: Mapping[str, Sequence[float]]) -> DataFrame:
    """(var, edges) table of given edges."""
    return spark.createDataFrame(
        [(v, [float(x) for x in e]) for v, e in edges.items()], "var string, edges array<double>"
    )


# --- metadata --------------------------------------------------------------

@dataclass
class Variable:
    """One tokenized variable; ``edges`` is None for categorical ones."""

    name: str
    var_id: int
    kind: str
    n_tokens: int
    edges: list[float] | None = None


@dataclass
class Metadata:
    """Everything learned from a training cohort.

    Only per-variable facts live on the driver (their number is the number of
    columns); code and category tables stay DataFrames.
    """

    codes: DataFrame
    categories: DataFrame
    variables: list[Variable]
    labels: list[str]
    n_codes: int
    bin_type: str = "uniform"
    n_ihm: int = field(default=2)

    def var_id(self, name: str) -> int:
        return next(v.var_id for v in self.variables if v.name == name)

    def edges(self, name: str) -> list[float]:
        return next(v.edges for v in self.variables if v.name == name) or []

    def series_variables(self) -> list[Variable]:
        return [v for v in self.variables if v.kind == "ts"]

    def sections(self) -> list[tuple[str, int, int, str]]:
        """(kind, var_id, tokens, name) of the sections after the codes, in id order."""
        by_kind = {k: [v for v in self.variables if v.kind == k] for k in ("ts", "covar", "timestamp")}
        out = [
            (v.kind, v.var_id, v.n_tokens, v.name)
            for k in ("ts", "covar", "timestamp")
            for v in by_kind[k]
        ]
        return out + [("phe", -1, len(self.labels), "phe"), ("ihm", -1, self.n_ihm, "ihm")]

    def starts(self) -> dict[tuple[str, int], int]:
        """First token id of each section."""
        at, out = self.n_codes, {}
        for kind, var_id, n, _ in self.sections():
            out[(kind, var_id)] = at
            at += n
        out[("special", -1)] = at
        return out

    def begin_positions(self) -> dict[str, int]:
        """Running token offset of each series variable."""
        starts = self.starts()
        return {v.name: starts[("ts", v.var_id)] - self.n_codes for v in self.series_variables()}

    def special(self, literal: str) -> int:
        return self.starts()[("special", -1)] + SPECIAL_TOKENS.index(literal)

    def special_ids(self) -> dict[str, int]:
        """Start, end, pad, mask and forecast token ids; masking uses the pad id."""
        names = {
            "start": "<s>", "end": "</s>", "pad": "<pad>", "mask": "<pad>",
            "history": "<history>", "forecast": "<forecast>", "forecast_end": "</forecast>",
        }
        return {n: self.special(t) for n, t in names.items()}

    def section_of(self, token_id: str) -> dict[str, Column]:
        """``kind``, ``var_id`` and ``value`` of token ids, as ``vocab`` has them, without a join; other ids raise."""
        token = F.col(token_id)
        unknown = F.raise_error(F.concat(F.lit("unknown token id "), F.coalesce(token.cast("string"), F.lit("NULL"))))
        found = unknown
        sections = [("code", -1, 0, self.n_codes)]
        starts = self.starts()
        sections += [(kind, var_id, starts[(kind, var_id)], n) for kind, var_id, n, _ in self.sections()]
        sections.append(("special", -1, starts[("special", -1)], len(SPECIAL_TOKENS)))
        for kind, var_id, first, n in sections:
            place = F.struct(F.lit(kind).alias("kind"), F.lit(var_id).alias("var_id"), (token - first).cast("int").alias("value"))
            found = F.when((token >= first) & (token < first + n), place).otherwise(found)
        return {name: found[name] for name in ("kind", "var_id", "value")}

    def vocab(self) -> DataFrame:
        """The whole vocabulary: token_id, kind, var_id, value, literal."""
        starts = self.starts()
        rows = [
            (starts[(kind, var_id)] + i, kind, var_id, i, f"{name}_{i}")
            for kind, var_id, n, name in self.sections()
            for i in range(n)
        ]
        first = starts[("special", -1)]
        rows += [(first + i, "special", -1, i, t) for i, t in enumerate(SPECIAL_TOKENS)]
        rest = self.codes.sparkSession.createDataFrame(rows, VOCAB_SCHEMA)
        codes = self.codes.select(
            F.col("code_id").alias("token_id"),
            F.lit("code").alias("kind"),
            F.lit(-1).alias("var_id"),
            F.col("code_id").alias("value"),
            F.col("code").alias("literal"),
        )
        return codes.unionByName(rest)

    def key(self) -> str:
        """Digest of all that discretized data depends on."""
        facts = self.codes.agg(F.sum(F.xxhash64("code", "code_id") % 1000003)).first()[0]
        levels = self.categories.agg(F.sum(F.xxhash64("var", "text", "value") % 1000003)).first()[0]
        layout = [(v.name, v.var_id, v.kind, v.n_tokens, v.edges) for v in self.variables]
        text = json.dumps([self.bin_type, self.n_codes, self.labels, facts, levels, layout])
        return hashlib.md5(text.encode()).hexdigest()[:16]


def learn_metadata(
    codes: DataFrame,
    train_series: DataFrame,
    categorical: Sequence[str],
    continuous: Sequence[str],
    seen: Sequence[str],
    bin_type: str = "uniform",
    synonyms: Mapping[str, Mapping[str, int]] | None = None,
    labels: Sequence[str] | None = None,
    age_edges: Sequence[float] | None = None,
    hours_edges: Sequence[float] | None = None,
    trim_ratio: float = 3.0,
) -> Metadata:
    """Learn vocabulary and bins: codes over all splits, bins on train only."""
    if bin_type not in ("uniform", "quantile"):
        raise ValueError("bin_type must be 'uniform' or 'quantile'")
    labels = list(labels) if labels else [str(i) for i in range(PHENOTYPES)]
    age = list(age_edges or FIXED_EDGES["Age"])
    hours = list(hours_edges or FIXED_EDGES["Hours"])
    code_table = durable(code_vocab(codes))
    levels = durable(category_map(train_series, categorical, seen, synonyms))
    sizes = dict(
        levels.groupBy("var").agg((F.max("value") + 1).alias("n")).collect()
    ) if categorical else {}
    ranks = series_ranks(train_series, continuous)
    stats = durable(series_stats(ranks, trim_ratio))
    bins = {r["var"]: r["n_bins"] for r in stats.select("var", "n_bins").collect()}
    if bin_type == "uniform":
        found = uniform_edges(stats)
    else:
        found = quantile_edges(trim_outliers(ranks, stats, trim_ratio), stats)
    edges = {r["var"]: list(r["edges"]) for r in found.collect()}
    variables = [
        Variable(v, i, "ts", int(sizes.get(v, 0))) for i, v in enumerate(categorical)
    ]
    variables += [
        Variable(v, len(categorical) + i, "ts", int(bins.get(v, 0)), edges.get(v))
        for i, v in enumerate(continuous)
    ]
    last = len(variables)
    variables += [
        Variable("Age", last, "covar", len(age) - 1, [float(x) for x in age]),
        Variable("Gender", last + 1, "covar", 2),
        Variable("Hours", last + 2, "timestamp", len(hours) - 1, [float(x) for x in hours]),
    ]
    return Metadata(code_table, levels, variables, labels, code_table.count(), bin_type)


def save_metadata(meta: Metadata, path: str) -> None:
    """Write the metadata tables; each bin type has its own folder."""
    spark = meta.codes.sparkSession
    target = f"{path}/bin_type={meta.bin_type}"
    rows = [(v.name, v.var_id, v.kind, v.n_tokens, v.edges) for v in meta.variables]
    variables = spark.createDataFrame(
        rows, "name string, var_id int, kind string, n_tokens int, edges array<double>"
    )
    labels = spark.createDataFrame(list(enumerate(meta.labels)), "label_id int, name string")
    tables = {
        "codes": meta.codes, "categories": meta.categories,
        "variables": variables, "labels": labels,
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{target}/{name}")


def load_metadata(spark: SparkSession, path: str, bin_type: str = "uniform") -> Metadata:
    """Read the metadata of one bin type."""
    source = f"{path}/bin_type={bin_type}"
    variables = [
        Variable(r["name"], r["var_id"], r["kind"], r["n_tokens"], r["edges"])
        for r in spark.read.parquet(f"{source}/variables").orderBy("var_id").collect()
    ]
    labels = [r["name"] for r in spark.read.parquet(f"{source}/labels").orderBy("label_id").collect()]
    codes = spark.read.parquet(f"{source}/codes")
    categories = spark.read.parquet(f"{source}/categories")
    return Metadata(codes, categories, variables, labels, codes.count(), bin_type)


# --- reports over the vocabulary --------------------------------------------

def vocab_sizes(meta: Metadata) -> DataFrame:
    """Token counts by group, and the total."""
    continuous = [v.var_id for v in meta.series_variables() if v.edges is not None]
    ts = F.col("kind") == "ts"
    is_cont = F.col("var_id").isin(continuous)
    group = (
        F.when(F.col("kind") == "code", "codes")
        .when(ts & is_cont, "lab_cont")
        .when(ts, "lab_cat")
        .when(F.col("kind") == "timestamp", "gap")
        .when(F.col("kind") == "covar", "covars")
        .when(F.col("kind") == "special", "special")
        .otherwise("labels")
    )
    groups = meta.vocab().groupBy(group.alias("part")).agg(F.count("*").alias("n"))
    total = groups.agg(F.lit("total").alias("part"), F.sum("n").alias("n"))
    return groups.unionByName(total)


def soft_labels(meta: Metadata, size: int = 7, sigma: float = 1.0) -> DataFrame:
    """Sparse (token_id, target_id, weight): a Gaussian over neighbouring bins.

    The kernel is cut at the ends of the variable and scaled back to 1; tokens
    that are not bins of a continuous variable keep weight 1 on themselves.
    """
    reach = (size - 1) // 2
    continuous = {v.var_id: v.n_tokens for v in meta.series_variables() if v.edges is not None}
    lengths = F.create_map(*[F.lit(x) for kv in continuous.items() for x in kv]) if continuous else None
    tokens = meta.vocab()
    smooth = (F.col("kind") == "ts") & F.col("var_id").isin(list(continuous))
    own = tokens.where(~smooth).select(
        "token_id", F.col("token_id").alias("target_id"), F.lit(1.0).alias("weight")
    )
    if not continuous:
        return own
    gap = F.col("_j") - F.col("value")
    near = (
        tokens.where(smooth)
        .withColumn("_n", lengths[F.col("var_id")])
        .withColumn(
            "_j",
            F.explode(
                F.sequence(
                    F.greatest(F.lit(0), F.col("value") - reach),
                    F.least(F.col("_n") - 1, F.col("value") + reach),
                )
            ),
        )
        .select(
            "token_id",
            (F.col("token_id") + gap).alias("target_id"),
            F.exp(-0.5 * gap * gap / (sigma * sigma)).alias("_w"),
        )
    )
    # At most ``size`` rows per token.
    total = F.sum("_w").over(Window.partitionBy("token_id"))
    return own.unionByName(
        near.select("token_id", "target_id", (F.col("_w") / total).alias("weight"))
    )


def variable_report(stats: DataFrame) -> DataFrame:
    """The columns a reader wants of ``series_stats``."""
    return stats.select(
        "var", "missing_rate", "min", "min_2", "q025", "median", "q975", "max", "max_2",
        F.col("n_bins").alias("n_tokens"),
    )
