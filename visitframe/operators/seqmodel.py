"""Count-based sequence model of any order: fit, next-token distribution, sampling, scoring.

Model rows are ``(order, context, next, n)``. ``context`` holds the ``order``
tokens before ``next``, nearest first, so the context to back off to, which
lacks the farthest token, is its prefix.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitframe.functions.columns import ratio
from visitframe.functions.ordered import attach, union_all, with_halo
from visitframe.session import durable, stage_path

CONTEXT = ["order", "context"]
#: Model rows that one sampling task holds (four bytes a column, 16 at order 2), and sequences that it carries on at
#: most; fewer than ``FEW_SEQUENCES`` are not worth a task and its copy of the rows.
BUCKET_ROWS, BUCKET_SEQUENCES, FEW_SEQUENCES = 40_000_000, 65_536, 128
#: Model rows that are packed into one row.
PACKED_ROWS = 65_536


def _contexts(tokens: DataFrame, order: int, by: Sequence[str] = (), width: int = 4096) -> DataFrame:
    """(by, context, next): each token after the first with up to ``order`` tokens before it."""
    near = with_halo(tokens.select(*by, "seq", "pos", "token_id"), "pos", before=max(1, order), width=width)
    w = Window.partitionBy(*by, "seq", "_block").orderBy("pos")
    before = F.array(*[F.lag("token_id", j).over(w) for j in range(1, order + 1)]) if order else F.array().cast("array<int>")
    rows = near.select(*by, "_home", "pos", F.col("token_id").alias("next"), before.alias("context"))
    return rows.where(F.col("_home") & (F.col("pos") > 0)).select(*by, F.array_compact("context").alias("context"), "next")


def context_counts(tokens: DataFrame, order: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, context, next, n): how often each token follows up to ``order`` tokens. Written.

    One pass over the tokens of all ``by`` groups, e.g. splits: fitting and
    scoring take a part of this table in place of the tokens. A table that is
    counted already stays as it is.
    """
    if "context" in tokens.columns:
        return tokens
    return durable(_contexts(tokens, order, by).groupBy(*by, "context", "next").agg(F.count("*").alias("n")))


def parent(context: str | Column = "context") -> Column:
    """The context without its farthest token."""
    return F.slice(context, F.lit(1), F.greatest(F.size(context) - 1, F.lit(0)))


def fit_sequence_model(tokens: DataFrame, order: int = 2) -> DataFrame:
    """(order, context, next, n): counts for every context of length 0 to ``order``.

    Tokens, or their ``context_counts`` of this order, are read once, at full
    length. Each shorter level is summed up from the counts of the level above
    and the few contexts that a sequence's start cuts short.
    """
    if order < 0:
        raise ValueError("order must not be negative")
    grams = context_counts(tokens, order).select("context", "next", "n")
    length = F.size("context")
    level = grams.where(length == order)
    levels = [level]
    for k in range(order - 1, -1, -1):
        shorter = level.select(parent().alias("context"), "next", "n").unionByName(grams.where(length == k))
        level = durable(shorter.groupBy("context", "next").agg(F.sum("n").alias("n")))
        levels.append(level)
    return union_all(levels).select(length.alias("order"), "context", "next", "n")


def next_token_dist(
    model: DataFrame,
    temperature: float = 1.0,
    top_k: int | None = None,
    top_p: float = 1.0,
    repetition_penalty: float = 1.0,
    seen: DataFrame | None = None,
) -> DataFrame:
    """(order, context, next, p): the sampling distribution of each context.

    Tokens in ``seen`` are penalised, then temperature, the ``top_k`` most
    likely, and the smallest head reaching ``top_p``. A context holds at most
    one row per vocabulary token, which bounds the windows.
    """
    context = Window.partitionBy(*CONTEXT)
    p = model.withColumn("p", F.col("n") / F.sum("n").over(context))
    if seen is not None and repetition_penalty != 1.0:
        marked = seen.select(F.col("token_id").alias("next"), F.lit(repetition_penalty).alias("_r"))
        p = p.join(marked.distinct(), "next", "left").withColumn(
            "p", F.pow("p", F.coalesce("_r", F.lit(1.0)))
        )
    if temperature != 1.0:
        p = p.withColumn("p", F.pow("p", F.lit(1.0 / temperature)))
    ranked = context.orderBy(F.desc("p"), "next")
    if top_k is not None:
        p = p.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= top_k)
    p = p.withColumn("p", F.col("p") / F.sum("p").over(context))
    if top_p < 1.0:
        before = F.sum("p").over(ranked.rowsBetween(Window.unboundedPreceding, -1))
        p = p.withColumn("_before", F.coalesce(before, F.lit(0.0))).where(F.col("_before") < top_p)
        p = p.withColumn("p", F.col("p") / F.sum("p").over(context))
    return p.select(*CONTEXT, "next", "p")


# --- sampling --------------------------------------------------------------------

def uniform(seed: int, seq: np.ndarray, step: np.ndarray | int) -> np.ndarray:
    """Uniform draw of (seed, seq, step): a 64-bit mix, the same everywhere."""
    with np.errstate(over="ignore"):
        x = np.asarray(seq).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = x + np.asarray(step).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        x = x + np.uint64(seed)
        for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def sampling_weights(
    nexts: np.ndarray, p: np.ndarray, seen: set[int], temperature: float, top_k: int | None, top_p: float, penalty: float
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (ascending) and weights of one context (tokens and shares), as ``next_token_dist`` filters them."""
    if penalty != 1.0 and seen:
        held = np.fromiter(seen, dtype=np.int64, count=len(seen))
        at = nexts.searchsorted(held.astype(nexts.dtype))
        at = np.minimum(at, len(nexts) - 1)
        at = at[nexts[at] == held]
        p = p.copy()
        p[at] **= penalty
    if temperature != 1.0:
        p = p ** (1.0 / temperature)
    if top_k is not None or top_p < 1.0:
        order = np.lexsort((nexts, -p))[:top_k]
        head = p[order] / p[order].sum()
        if top_p < 1.0:
            order = order[np.cumsum(head) - head < top_p]
        kept = np.sort(order)
        nexts, p = nexts[kept], p[kept]
    return nexts, p


class Sampler:
    """Walks sequences on the model rows of one bucket: sorted columns, a context is a run of rows.

    ``level`` tells where each order starts in rows that are sorted already.
    """

    def __init__(self, rows: Mapping[str, np.ndarray], order: int, options: tuple, n_ctx: int, level: list[int] | None = None):
        columns = ["order", *[f"t{j}" for j in range(1, order + 1)], "next"]
        if level is None:
            place = np.lexsort([np.asarray(rows[c]) for c in reversed(columns)])
            rows = {c: np.asarray(rows[c])[place] for c in [*columns, "n"]}
            level = np.searchsorted(rows["order"], np.arange(order + 2)).tolist()
        self.lag = [rows[c] for c in columns[1:-1]]
        self.nexts, self.n, self.level = rows["next"], rows["n"], level
        self.order, self.options = order, options
        _, top_k, _, penalty = options
        # The first ``top_k`` and as many as are seen hold the drawn ones: a penalty moves seen ones back only.
        self.top_k, self.n_ctx = (top_k, n_ctx) if top_k is not None and penalty >= 1.0 else (None, 0)
        self.heads: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def run(self, tokens: list[int], length: int) -> tuple[int, int]:
        """The rows of the last ``length`` tokens as a context."""
        first, end = self.level[length], self.level[length + 1]
        for j in range(length):
            if first == end:
                break
            part, token = self.lag[j][first:end], np.int32(tokens[-1 - j])
            first, end = first + int(part.searchsorted(token)), first + int(part.searchsorted(token, side="right"))
        return first, end

    def shares(self, first: int, end: int, seen: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (ascending) and shares of a run; of a long one those that can be drawn with ``seen`` tokens."""
        if self.top_k is None or end - first <= 2 * self.top_k:
            n = self.n[first:end].astype(float)
            return self.nexts[first:end], n / n.sum()
        if first not in self.heads:  # most frequent first
            nexts, n = self.nexts[first:end], self.n[first:end].astype(float)
            kept = np.lexsort((nexts, -n))[: self.top_k + self.n_ctx]
            self.heads[first] = nexts[kept], (n / n.sum())[kept]
        nexts, p = (x[: self.top_k + seen] for x in self.heads[first])
        order = nexts.argsort()
        return nexts[order], p[order]

    def table(self, tokens: list[int], seen: set[int]) -> tuple[np.ndarray, np.ndarray] | None:
        """Tokens and running weights for the longest known context."""
        for length in range(min(self.order, len(tokens)), -1, -1):
            first, end = self.run(tokens, length)
            if first == end:
                continue
            if end - first == 1:
                return self.nexts[first:end], np.ones(1)
            if first in self.tables:
                return self.tables[first]
            nexts, weights = sampling_weights(*self.shares(first, end, len(seen)), seen, *self.options)
            found = nexts, np.cumsum(weights)
            if self.options[-1] == 1.0:  # the same for every sequence
                self.tables[first] = found
            return found
        return None

    def step(self, tokens: list[int], seen: set[int], draw: float) -> bool:
        """Append a token; False if the model is empty."""
        found = self.table(tokens, seen)
        if found is None:
            return False
        nexts, cums = found
        at = int(np.searchsorted(cums, draw * cums[-1], side="right"))
        token = int(nexts[min(at, len(nexts) - 1)])
        tokens.append(token)
        seen.add(token)
        return True


def _packed(dealt: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """(bucket, part, k, levels, data): rows of a model in order, ``PACKED_ROWS`` at most in one. Written.

    ``data`` holds the columns of ``kinds`` one after the other, ``levels`` counts the rows of each order.
    """
    order = len(kinds) - 2

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k, held = TaskContext.get().partitionId(), 0, []

        def packed(rows: pd.DataFrame) -> Iterator[tuple]:
            for bucket, own in rows.groupby("bucket", sort=True):
                for at in range(0, len(own), PACKED_ROWS):
                    block = own.iloc[at : at + PACKED_ROWS]
                    levels = np.bincount(block["order"], minlength=order + 1).tolist()
                    data = b"".join(block[c].to_numpy().astype(kind).tobytes() for c, kind in kinds.items())
                    yield bucket, levels, zlib.compress(data, 1)

        def out(rows: list[tuple]) -> pd.DataFrame:
            nonlocal k
            k += len(rows)
            return pd.DataFrame([(b, part, k - len(rows) + i, *x) for i, (b, *x) in enumerate(rows)], columns=["bucket", "part", "k", "levels", "data"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 16 * PACKED_ROWS:
                yield out(list(packed(pd.concat(held))))
                held = []
        if held:
            yield out(list(packed(pd.concat(held))))

    place = ["bucket", "order", *[c for c in kinds if c != "n"]]
    rows = dealt.repartitionByRange(dealt.sparkSession.sparkContext.defaultParallelism, *place).sortWithinPartitions(*place)
    return durable(rows.mapInPandas(pack, "bucket int, part int, k int, levels array<long>, data binary"))


def _unpacked(blocks: list[tuple], kinds: Mapping[str, str]) -> tuple[dict[str, np.ndarray], list[int]]:
    """Sorted columns and where each order starts, from the packed blocks (part, k, levels, data) of a bucket; takes them out."""
    blocks.sort(key=lambda b: b[:2], reverse=True)
    levels = np.sum([np.zeros(len(kinds) - 1, dtype=np.int64), *[b[2] for b in blocks]], axis=0)
    rows = {c: np.empty(levels.sum(), dtype=kind) for c, kind in kinds.items()}
    at = 0
    while blocks:
        _, _, own, data = blocks.pop()
        data, n, byte = zlib.decompress(data), int(np.sum(own)), 0
        for c, kind in kinds.items():
            rows[c][at : at + n] = np.frombuffer(data, kind, n, byte)
            byte += n * np.dtype(kind).itemsize
        at += n
    return rows, [0, *np.cumsum(levels).tolist()]


def _bucket(c1: Column, sub: Column, buckets: int) -> Column:
    return F.pmod(c1.cast("long") * 7919 + sub * 104_729, F.lit(buckets)).cast("int")


def generate(
    model: DataFrame,
    prompts: DataFrame,
    n_ctx: int,
    end_id: int,
    seed: int = 0,
    temperature: float = 1.0,
    top_k: int | None = None,
    top_p: float = 1.0,
    repetition_penalty: float = 1.0,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Token table (seq, pos, token_id) sampled from prompts (seq, input_ids).

    One sequence per prompt, until ``end_id`` or ``n_ctx`` tokens; a prompt is
    cut at ``n_ctx``, and an empty one stays so. The longest known context is
    used, and tokens a sequence already holds are penalised. Draws hash (seed,
    seq, step), so partitioning does not matter.

    The model is dealt into buckets of about ``bucket_rows`` rows by the last
    token, of frequent tokens by the last two; shorter contexts lie in every
    bucket that may back off to them. A bucket is sorted and packed once, and
    a task gets its packed blocks. Sequences go to the bucket of their last
    tokens, a bounded number to a task, and walk on as long as they stay in
    it. Each round writes those; a model of one bucket takes one round, one of
    more buckets about one per step of the longest sequence.
    """
    order, total, most = model.agg(F.max("order"), F.count("*"), F.max("n")).first()
    order = order or 0
    buckets = max(1, -(-total // bucket_rows))
    last = F.try_element_at("context", F.lit(1))
    sizes = model.where("order > 0").groupBy(last.alias("c1")).agg(F.count("*").alias("m")).where(F.col("m") > bucket_rows)
    # At most one row per full bucket of the model.
    subs = {r["c1"]: -(-r["m"] // bucket_rows) for r in sizes.collect()}
    hot = F.create_map(*[F.lit(x) for c1, m in subs.items() for x in (int(c1), int(m))]) if subs else None

    def count_of(c1: Column) -> Column:
        return F.lit(1) if hot is None else F.coalesce(F.try_element_at(hot, c1), F.lit(1))

    row = ["order", *[f"t{j}" for j in range(1, order + 1)], "next", "n"]
    lags = [F.coalesce(F.try_element_at("context", F.lit(j)), F.lit(-1)).cast("int").alias(f"t{j}") for j in range(1, order + 1)]
    keyed = model.select("context", F.col("order").cast("int").alias("order"), *lags, F.col("next").cast("int").alias("next"), "n")
    longer = keyed.where("order > 0").withColumns({"c1": last, "c2": F.try_element_at("context", F.lit(2))})
    places = F.when(F.col("order") > 1, F.array(F.pmod(F.col("c2"), count_of(F.col("c1"))))).otherwise(
        F.sequence(F.lit(0), count_of(F.col("c1")) - 1)
    )
    longer = longer.withColumn("sub", F.explode(places)).select(_bucket(F.col("c1"), F.col("sub"), buckets).alias("bucket"), *row)
    # The zeroth level has a row per token of the vocabulary; every bucket holds it.
    zeroth = keyed.where("order = 0").select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), *row)
    dealt = longer.unionByName(zeroth)
    if buckets > 1:  # else no row lies in two places
        dealt = dealt.distinct()
    held = {f"t{j}": "int32" for j in range(1, order + 1)} | {"next": "int32", "n": "int32" if (most or 0) < 1 << 31 else "int64"}
    blocks = _packed(dealt, held)

    options = (temperature, top_k, top_p, repetition_penalty)

    def home(tokens: list[int]) -> int:
        sub = tokens[-2] % subs.get(tokens[-1], 1) if len(tokens) > 1 else 0
        return (tokens[-1] * 7919 + sub * 104_729) % buckets

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks, waiting = {}, {}
        for batch in batches:
            for task, part, k, levels, data, seq, ids in batch[["task", "part", "k", "levels", "data", "seq", "ids"]].itertuples(index=False):
                if data is None:
                    waiting.setdefault(task, []).append((seq, ids))
                else:
                    blocks.setdefault(task, []).append((part, k, levels, data))
        for task, sequences in waiting.items():
            columns, level = _unpacked(blocks.pop(task, []), held)
            sampler, rows = Sampler(columns, order, options, n_ctx, level), []
            for seq, ids in sequences:
                tokens = [int(t) for t in ids]
                seen, here, alive = set(tokens), home(tokens), True
                draws = uniform(seed, np.full(n_ctx, seq), np.arange(n_ctx))
                while alive and len(tokens) < n_ctx and tokens[-1] != end_id and (buckets == 1 or home(tokens) == here):
                    alive = sampler.step(tokens, seen, draws[len(tokens)])
                rows.append((seq, np.array(tokens, dtype=np.int32), not alive or len(tokens) >= n_ctx or tokens[-1] == end_id))
                if len(rows) == 4096:
                    yield pd.DataFrame(rows, columns=["seq", "ids", "done"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["seq", "ids", "done"])

    ids = F.slice("input_ids", 1, n_ctx).cast("array<int>")
    end = F.try_element_at("ids", F.lit(-1))
    spark, path, schema = model.sparkSession, stage_path(model.sparkSession, "walk"), "seq long, ids array<int>, done boolean"
    state = prompts.select(F.col("seq").cast("long").alias("seq"), ids.alias("ids"))
    state.withColumn("done", F.coalesce(end == end_id, F.lit(True)) | (F.size("ids") >= n_ctx)).write.parquet(f"{path}/round-0")
    tasks = -(-spark.sparkContext.defaultParallelism // buckets)
    for turn in itertools.count(1):  # a round writes the sequences that it carries on, ended ones stay where they are
        state = spark.read.schema(schema).parquet(f"{path}/round-{turn - 1}")
        before = F.coalesce(F.try_element_at("ids", F.lit(-2)), F.lit(0))
        live = state.where("NOT done").withColumn("bucket", _bucket(end, F.pmod(before, count_of(end)), buckets))
        count = F.count("*")
        many = F.greatest(F.ceil(count / BUCKET_SEQUENCES), F.least(F.ceil(count / FEW_SEQUENCES), F.lit(tasks)))
        salts = {r["bucket"]: r["salts"] for r in live.groupBy("bucket").agg(many.cast("int").alias("salts")).collect()}
        if not salts:
            break
        first = dict(zip(salts, np.cumsum([0, *salts.values()]).tolist()))
        places = spark.createDataFrame([(b, first[b], n) for b, n in salts.items()], "bucket int, first int, salts int")
        left = live.join(F.broadcast(places), "bucket").select(
            (F.col("first") + F.pmod(F.xxhash64("seq"), F.col("salts"))).cast("int").alias("task"), "seq", "ids",
            *[F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in ("levels", "data")], F.lit(0).alias("part"), F.lit(0).alias("k"),
        )
        right = blocks.join(F.broadcast(places), "bucket").select(
            F.explode(F.sequence(F.col("first"), F.col("first") + F.col("salts") - 1)).alias("task"),
            F.lit(0).cast("long").alias("seq"), F.lit(None).cast("array<int>").alias("ids"), "levels", "data", "part", "k",
        )
        # Few bytes but long walks: each task is a partition, or Spark would merge them.
        both = left.unionByName(right).repartitionById(sum(salts.values()), "task")
        both.mapInPandas(walk, schema).write.parquet(f"{path}/round-{turn}")
    ended = spark.read.schema(schema).parquet(*[f"{path}/round-{i}" for i in range(turn)]).where("done")
    return ended.select("seq", F.posexplode("ids").alias("pos", "token_id")).select(
        "seq", F.col("pos").cast("long").alias("pos"), "token_id"
    )


# --- scoring ---------------------------------------------------------------------

def _log_probs(
    model: DataFrame, wanted: DataFrame, vocab_size: Column | int, alpha: float, asked: DataFrame | None = None
) -> DataFrame:
    """Add ``logp`` to rows (context, next): longest known context, add-alpha.

    ``asked`` has all contexts of ``wanted`` and is cheaper to read.
    """
    size = vocab_size if isinstance(vocab_size, Column) else F.lit(vocab_size)
    totals = model.groupBy("context").agg(F.sum("n").alias("_total"))
    cuts = F.transform(F.sequence(F.lit(0), F.size("context")), lambda k: F.slice("context", F.lit(1), k))
    asked = (wanted if asked is None else asked).select("context").distinct().select(F.col("context").alias("_whole"), F.explode(cuts).alias("context"))
    known = asked.join(totals, "context", "left").groupBy("_whole").agg(
        F.max(F.when(F.col("_total").isNotNull(), F.struct(F.size("context"), "context", "_total"))).alias("_k")
    )
    rows = wanted.withColumnRenamed("context", "_whole").join(known, "_whole")
    rows = rows.withColumns({"context": F.coalesce("_k.context", F.array().cast("array<int>")), "_total": F.coalesce("_k._total", F.lit(0))})
    rows = rows.join(model.select("context", "next", F.col("n").alias("_hits")), ["context", "next"], "left")
    p = (F.coalesce("_hits", F.lit(0)) + alpha) / (F.col("_total") + alpha * size)
    return rows.drop("_k").withColumn("logp", F.log(p))


def _order_of(model: DataFrame) -> int:
    return model.agg(F.max("order")).first()[0] or 0


def perplexity(
    model: DataFrame, tokens: DataFrame, vocab_size: Column | int, alpha: float = 1.0, by: Sequence[str] = ()
) -> DataFrame:
    """``exp`` of the mean negative log likelihood of all tokens after the first, per ``by`` group.

    Equal (context, token) rows are counted before the joins, so a frequent
    token is one row; ``tokens`` may be these ``context_counts``. All groups
    meet the model in one pass. Padding is left out by the caller.
    """
    wanted = context_counts(tokens, _order_of(model), by).withColumnRenamed("n", "m")
    scored = _log_probs(model, wanted, vocab_size, alpha)
    return scored.groupBy(*by).agg(
        F.sum("m").alias("n_tokens"),
        F.exp(-F.sum(F.col("m") * F.col("logp")) / F.sum("m")).alias("perplexity"),
    )


def soft_perplexity(
    model: DataFrame, tokens: DataFrame, soft: DataFrame, vocab_size: Column | int, alpha: float = 1.0, by: Sequence[str] = ()
) -> DataFrame:
    """Perplexity against soft targets, per ``by`` group: every true token spreads over ``soft``.

    ``tokens`` may be ``context_counts``.
    """
    counted = context_counts(tokens, _order_of(model), by)
    spread = counted.join(
        soft.select(F.col("token_id").alias("next"), "target_id", "weight"), "next"
    ).select(*by, "context", F.col("target_id").alias("next"), F.col("n").alias("m"), "weight")
    scored = _log_probs(model, spread, vocab_size, alpha, counted)
    mass = F.sum(F.col("m") * F.col("weight") * F.col("logp")) / F.sum(F.col("m") * F.col("weight"))
    return scored.groupBy(*by).agg(F.exp(-mass).alias("perplexity"))


def lookahead_model(tokens: DataFrame, n_next: int, width: int = 4096, by: Sequence[str] = ()) -> DataFrame:
    """(by, ahead, token_id, next, n, p): the token ``ahead`` places later."""
    near = with_halo(tokens.select(*by, "seq", "pos", "token_id"), "pos", after=n_next, width=width)
    w = Window.partitionBy(*by, "seq", "_block").orderBy("pos")
    heads = F.array(
        *[
            F.struct(F.lit(j).alias("ahead"), F.col(f"_a{j}").alias("next"))
            for j in range(1, n_next + 1)
        ]
    )
    rows = near.select(
        *by, "_home", "token_id", *[F.lead("token_id", j).over(w).alias(f"_a{j}") for j in range(1, n_next + 1)]
    ).where("_home").select(*by, "token_id", F.inline(heads)).where(F.col("next").isNotNull())
    counts = rows.groupBy(*by, "ahead", "token_id", "next").agg(F.count("*").alias("n"))
    # At most one row per vocabulary token in each window group.
    total = F.sum("n").over(Window.partitionBy(*by, "ahead", "token_id"))
    return counts.withColumn("p", F.col("n") / total)


def lookahead_perplexity(
    fitted: DataFrame, tokens: DataFrame, n_next: int, vocab_size: Column | int, alpha: float = 1.0, by: Sequence[str] = ()
) -> DataFrame:
    """Perplexity of each look-ahead head on other sequences, per ``by`` group.

    ``tokens`` may be their counts as ``lookahead_model`` gives them. The log
    of a share is that of its hits less that of its total: the hits join by
    pair, the totals by token, so no row is dealt for both.
    """
    size = vocab_size if isinstance(vocab_size, Column) else F.lit(vocab_size)
    counts = tokens if "ahead" in tokens.columns else durable(lookahead_model(tokens, n_next, by=by).drop("p"))
    wanted = counts.select(*by, "ahead", "token_id", "next", F.col("n").alias("m"))
    totals = fitted.groupBy("ahead", "token_id").agg(F.sum("n").alias("_total"))
    group = [*by, "ahead"]
    rows = wanted.join(fitted.select("ahead", "token_id", "next", "n"), ["ahead", "token_id", "next"], "left")
    hits = rows.groupBy(*group).agg(
        F.sum("m").alias("_m"), F.sum(F.col("m") * F.log(F.coalesce("n", F.lit(0)) + alpha)).alias("_hits")
    )
    asked = wanted.groupBy(*group, "token_id").agg(F.sum("m").alias("m")).join(totals, ["ahead", "token_id"], "left")
    bases = asked.groupBy(*group).agg(F.sum(F.col("m") * F.log(F.coalesce("_total", F.lit(0)) + alpha * size)).alias("_base"))
    return attach(hits, bases, group).select(*group, F.exp(-ratio(F.col("_hits") - F.col("_base"), F.col("_m"))).alias("perplexity"))
