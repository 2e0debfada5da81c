"""Discretized events to token sequences, training rows, prompts, and back.

A token table has one row per token: ``seq`` (or ``sid``), dense ``pos`` from
0, ``token_id``. Arrays appear only in rows of bounded length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitframe.functions.columns import attention_mask, hash_uniform, pad_array
from visitframe.functions.ordered import (
    BEFORE,
    block_of,
    by_size,
    first_from_here,
    position_in,
    prefix_over_blocks,
    union_all,
)
from visitframe.operators.discretize import CODE, COVAR, GAP_CELL, LABEL, SERIES
from visitframe.operators.vocab import Metadata
from visitframe.session import durable

START_STAY, END_STAY, ADM = -1, 2_147_483_647, 9
TOKEN = ["seq", "pos", "token_id"]


# --- tokenize ----------------------------------------------------------------

def _token_id(meta: Metadata) -> Column:
    """Token id of an event: first id of its section plus its value."""
    at = F.lit(None).cast("int")
    for (kind, var), first in meta.starts().items():
        if kind != "special":
            at = F.when((F.col("kind") == kind) & (F.col("var_id") == var), first).otherwise(at)
    known = F.when(F.col("kind") == "code", F.col("value")).otherwise(at + F.col("value"))
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown token of kind "), F.col("kind"))))


def _markers(stays: DataFrame, meta: Metadata, ignore_ts: bool) -> DataFrame:
    """Terminators of every stay, start and end of every sequence."""
    ends = [(COVAR, "</covar>"), (LABEL, "</label>"), (CODE, "</code>")]
    ends += [] if ignore_ts else [(SERIES, "</ts>")]
    ends += [(ADM - 1, "</adm>")]
    stay_rows = F.array(
        *[F.struct(F.lit(s + 1).alias("section"), F.lit(meta.special(t)).alias("token_id")) for s, t in ends]
    )
    inner = stays.select(F.col("sid").alias("seq"), "stay_idx", F.inline(stay_rows))
    edges = F.array(
        F.struct(F.lit(START_STAY).alias("stay_idx"), F.lit(0).alias("section"), F.lit(meta.special("<s>")).alias("token_id")),
        F.struct(F.lit(END_STAY).alias("stay_idx"), F.lit(0).alias("section"), F.lit(meta.special("</s>")).alias("token_id")),
    )
    outer = stays.select(F.col("sid").alias("seq")).distinct().select("seq", F.inline(edges))
    return inner.unionByName(outer).withColumns(
        {"a": F.lit(0).cast("long"), "b": F.lit(0), "row_idx": F.lit(None).cast("long")}
    )


def tokenize(
    events: DataFrame,
    stays: DataFrame,
    meta: Metadata,
    ignore_ts: bool = False,
    label_shuffle: bool = False,
    ts_shuffle: bool = False,
    seed: int = 0,
    width: int = 512,
) -> DataFrame:
    """Token table (seq, pos, token_id, stay_idx, row_idx), not yet truncated.

    ``row_idx`` marks the gap token of a series row. Should a history be too
    long for one task, its blocks are two per stay: what comes before
    ``</code>``, in ranges of ``width`` codes, and the series, in ranges of
    ``width`` rows. The closing tokens of a stay open the block of the next.
    """
    if ignore_ts:
        events = events.where(F.col("section") != SERIES)
    is_gap = F.col("kind") == "timestamp"
    order = F.col("b").cast("long")
    draw = F.floor(hash_uniform(seed, "sid", "stay_idx", "a", "kind", "var_id", "value") * float(1 << 40)).cast("long")
    if label_shuffle:
        order = F.when(F.col("kind") == "phe", draw + 1).otherwise(order)
    if ts_shuffle:
        order = (
            F.when(F.col("kind") == "ts", draw)
            .when(is_gap, F.lit((1 << 40) + GAP_CELL))
            .otherwise(order)
        )
    body = events.select(
        F.col("sid").alias("seq"),
        "stay_idx",
        "section",
        _token_id(meta).alias("token_id"),
        "a",
        order.alias("b"),
        F.when(is_gap, F.col("a")).alias("row_idx"),
    )
    rows = body.unionByName(_markers(stays, meta, ignore_ts))
    closing, is_late = F.col("section") > SERIES, F.col("section") > CODE
    part = block_of("a", width) + F.when(is_late, F.lit(1 << 40)).otherwise(F.lit(0))
    blocked = rows.withColumns(
        {
            "_stay": F.col("stay_idx").cast("long") + closing.cast("long"),
            "_part": F.when(closing | (F.col("section") < CODE), F.lit(0)).otherwise(part),
        }
    )
    placed = position_in(
        blocked, ["seq"], ["_stay", "_part"], ["stay_idx", "section", "a", "b", "token_id"], "pos", coarse=True
    )
    return placed.select(
        "seq", "pos", F.col("token_id").cast("int").alias("token_id"), "stay_idx", "row_idx"
    )


def token_horizons(tokens: DataFrame, horizons: DataFrame, aligned: bool = False) -> DataFrame:
    """Token length up to each horizon of the first stay; -1 if there is none.

    ``horizons`` counts original rows while the lookup counts surviving rows
    (kept as the default). ``aligned`` uses the last surviving row at or before
    the original one instead.
    """
    gaps = tokens.where((F.col("stay_idx") == 0) & F.col("row_idx").isNotNull())
    first = horizons.where(F.col("stay_idx") == 0).select(
        F.col("sid").alias("seq"), "horizon", F.col("row_idx").alias("_want")
    )
    if aligned:
        pairs = first.join(gaps.select("seq", "pos", "row_idx"), "seq", "left").where(
            F.col("row_idx").isNull() | (F.col("row_idx") <= F.col("_want"))
        )
        found = pairs.groupBy("seq", "horizon").agg(F.max("pos").alias("_pos"))
        found = first.join(found, ["seq", "horizon"], "left")
    else:
        ranked = position_in(
            gaps.withColumn("_block", block_of("row_idx")), ["seq"], ["_block"], ["row_idx"], "_want"
        )
        found = first.join(
            ranked.select("seq", "_want", F.col("pos").alias("_pos")), ["seq", "_want"], "left"
        )
    return found.select("seq", "horizon", F.coalesce(F.col("_pos") + 1, F.lit(-1)).alias("position"))


def truncate(tokens: DataFrame, n_ctx: int) -> DataFrame:
    """Keep the first ``n_ctx`` tokens of each sequence."""
    return tokens.where(F.col("pos") < n_ctx)


def chunk(tokens: DataFrame, n_ctx: int) -> DataFrame:
    """Split sequences into pieces of ``n_ctx``; the last one may be short."""
    return tokens.withColumns(
        {
            "chunk": F.floor(F.col("pos") / n_ctx).cast("int"),
            "chunk_pos": (F.col("pos") % n_ctx).cast("int"),
        }
    )


def token_report(tokens: DataFrame, n_ctx: int) -> DataFrame:
    """Records, kept tokens and tokens lost to truncation."""
    lengths = tokens.groupBy("seq").agg(F.count("*").alias("_n"))
    return lengths.agg(
        F.count("*").alias("n_records"),
        F.sum(F.least("_n", F.lit(n_ctx))).alias("n_tokens"),
        F.sum(F.greatest(F.col("_n") - n_ctx, F.lit(0))).alias("n_truncated"),
    )


def sequences(tokens: DataFrame, n_ctx: int, keys: Sequence[str] = ("seq",)) -> DataFrame:
    """Token arrays of at most ``n_ctx`` tokens, so no array grows with the data."""
    at = "chunk_pos" if "chunk" in keys else "pos"
    cut = tokens.where(F.col(at) < n_ctx)
    packed = cut.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(at).alias("p"), F.col("token_id").alias("t")))).alias("_x")
    )
    return packed.select(*keys, F.transform("_x", lambda x: x["t"]).alias("tokens"))


# --- training rows and prompts -----------------------------------------------

def mask(
    tokens: DataFrame, mask_id: int, probability: float = 0.15, seed: int = 0
) -> DataFrame:
    """Add ``masked``: 80 % of the picked tokens become the mask id."""
    picked = hash_uniform(seed, F.lit("pick"), "seq", "pos") < probability
    replaced = hash_uniform(seed, F.lit("replace"), "seq", "pos") < 0.8
    return tokens.withColumn(
        "masked", F.when(picked & replaced, F.lit(mask_id)).otherwise(F.col("token_id"))
    )


def training_rows(
    tokens: DataFrame, n_ctx: int, pad_id: int, probability: float = 0.0, seed: int = 0
) -> DataFrame:
    """Model rows: masked ``input_ids``, unmasked ``labels``, ``attention_mask``."""
    masked = mask(truncate(tokens, n_ctx), pad_id, probability, seed)
    packed = masked.groupBy("seq").agg(
        F.array_sort(F.collect_list(F.struct("pos", "masked", "token_id"))).alias("_x")
    )
    return packed.select(
        "seq",
        pad_array(F.transform("_x", lambda x: x["masked"]), n_ctx, pad_id).alias("input_ids"),
        pad_array(F.transform("_x", lambda x: x["token_id"]), n_ctx, pad_id).alias("labels"),
    ).withColumn("attention_mask", attention_mask("input_ids", pad_id))


def history_prompts(
    tokens: DataFrame, horizons: DataFrame, horizon: float, n_ctx: int, pad_id: int
) -> DataFrame:
    """Token prefix up to the horizon, left-padded to the longest prompt."""
    cut = horizons.where((F.col("horizon") == horizon) & (F.col("position") > 0)).select(
        "seq", F.least("position", F.lit(n_ctx)).alias("_end")
    )
    kept = tokens.join(cut, "seq").where(F.col("pos") < F.col("_end"))
    prompts = sequences(kept, n_ctx)
    longest = prompts.agg(F.max(F.size("tokens"))).scalar()
    padded = F.concat(
        F.array_repeat(F.lit(pad_id), longest - F.size("tokens")), F.col("tokens")
    )
    return prompts.select("seq", padded.alias("input_ids")).withColumn(
        "attention_mask", attention_mask("input_ids", pad_id)
    )


def start_prompts(spark, n: int, start_id: int) -> DataFrame:
    """``n`` prompts that hold only the start token."""
    return spark.range(n).select(F.col("id").alias("seq"), F.array(F.lit(start_id)).alias("input_ids"))


def render_text(tokens: DataFrame, vocab: DataFrame, n_ctx: int) -> DataFrame:
    """Sequences as text, e.g. ``<s> covar 41 3 </covar>``: a row per ``n_ctx`` tokens."""
    name = F.when(F.col("kind").isin("phe", "ihm"), F.lit("label")).otherwise(F.col("kind"))
    part = (
        F.when(F.col("kind") == "special", F.col("literal"))
        .when(F.col("kind") == "code", F.concat_ws(" ", name, F.col("value").cast("string")))
        .when(name == "label", F.concat_ws(" ", name, "kind", F.col("value").cast("string")))
        .otherwise(F.concat_ws(" ", name, F.col("var_id").cast("string"), F.col("value").cast("string")))
    )
    words = tokens.withColumn("chunk", block_of("pos", n_ctx)).join(vocab.select("token_id", part.alias("_w")), "token_id")
    packed = words.groupBy("seq", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "_w"))).alias("_x"))
    return packed.select("seq", "chunk", F.concat_ws(" ", F.transform("_x", lambda x: x["_w"])).alias("text"))


# --- per-position features -----------------------------------------------------

def segment_index(
    tokens: DataFrame, boundary_ids: Sequence[int], width: int = 4096, counted: DataFrame | None = None
) -> DataFrame:
    """Add ``segment``: boundary tokens seen so far, this one included.

    ``counted`` has each ``seq`` in no fewer rows than ``tokens`` and is cheaper to count.
    """
    hit = F.col("token_id").isin(list(boundary_ids)).cast("long")
    out = prefix_over_blocks(
        tokens.withColumn("_block", block_of("pos", width)), ["seq"], ["_block"], ["pos"], {"segment": hit}, coarse=True, counted=counted
    )
    return out.withColumn("segment", F.col("segment") + hit).drop("_block")


def running_counts(tokens: DataFrame, width: int = 4096) -> DataFrame:
    """Add ``seen``: how often this token has occurred up to here."""
    blocked = tokens.withColumn("_block", block_of("pos", width))
    out = position_in(blocked, ["seq", "token_id"], ["_block"], ["pos"], "seen", coarse=True)
    return out.withColumn("seen", F.col("seen") + 1).drop("_block")


def ancestor_groups(tokens: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Add ``group_id`` of each code token; one extra group holds all others."""
    return tokens.join(groups.select("token_id", "group_id"), "token_id", "left").withColumn(
        "group_id", F.coalesce("group_id", F.lit(n_groups))
    )


# --- detokenize ------------------------------------------------------------------

def completion_report(tokens: DataFrame, meta: Metadata) -> DataFrame:
    """How many sequences end with ``</s>`` and how many do not."""
    done = tokens.groupBy("seq").agg(
        F.max((F.col("token_id") == meta.special("</s>")).cast("int")).alias("_done")
    )
    return done.agg(F.sum("_done").alias("n_full"), F.sum(1 - F.col("_done")).alias("n_truncated"))


def detokenize(
    tokens: DataFrame, meta: Metadata, width: int = 4096, counted: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Token table to (stays, events).

    ``stays``: seq, stay_idx, label_ihm, complete. ``events`` are covars, phe
    labels, codes and series cells in the layout of ``discretize``; a closed
    series row carries its gap as the last cell. Every token belongs to the
    next terminator of its kind, and the stay of that terminator owns it.

    Tokens that lie dealt by ``seq`` are not shuffled, and read once if
    ``counted`` has each ``seq`` in no fewer rows.
    """
    placed = tokens.where("seq IS NOT NULL").select("seq", F.col("pos").cast("long").alias("pos"), "token_id").withColumns(
        meta.section_of("token_id")
    )

    def marks(text: str) -> Column:
        return F.col("token_id") == meta.special(text)

    closers = {
        "covar": marks("</covar>"),
        "label": marks("</label>"),
        "code": marks("</code>"),
        "series": F.col("kind") == "timestamp",
    }
    end = F.min(F.when(marks("</s>"), F.col("pos")))
    is_live = F.col("_end").isNull() | (F.col("pos") < F.col("_end"))

    def at(name: str) -> Column:
        last = F.lit(True) if name == "series" else F.col("pos") == F.col(f"_last_{name}")
        return F.when(closers[name], F.struct("pos", F.col("_stay").alias("stay"), last.alias("last")))

    lasts = {f"_last_{n}": F.max(F.when(c, F.col("pos"))) for n, c in closers.items() if n != "series"}
    picks = {f"_{n}": at(n) for n in closers}

    def owned(live: DataFrame) -> DataFrame:
        """What is kept of each stay, and the first row of each sequence with its number of stays."""
        owner = F.when(F.col("kind") == "covar", F.col("_covar"))
        owner = owner.when(F.col("kind").isin("phe", "ihm"), F.col("_label")).when(F.col("kind") == "code", F.col("_code"))
        owner = owner.when(F.col("kind").isin("ts", "timestamp"), F.col("_series"))
        stays = F.col("_n") + F.col("_end").isNull().cast("long")
        # A phe label counts under any closing mark of its stay, other tokens under the last one.
        kept = F.col("_t.stay").isNotNull() & ((F.col("kind") == "phe") | F.col("_t.last")) & (F.col("_t.stay") < stays)
        rows = live.withColumn("_t", owner).withColumn("kept", F.coalesce(kept, F.lit(False))).where("kept OR first")
        return rows.select(
            "seq", "pos", "kind", "var_id", "value", F.col("_t.pos").alias("close"), F.col("_t.stay").alias("stay"), "kept",
            F.when(F.col("first"), stays).alias("stays"), F.when(F.col("first"), F.col("_end").isNotNull()).alias("complete"),
        )

    def whole(rows: DataFrame) -> DataFrame:
        seq, before = Window.partitionBy("seq"), Window.partitionBy("seq").orderBy("pos").rowsBetween(*BEFORE)
        live = rows.withColumn("_end", end.over(seq)).where(is_live)
        live = live.withColumns({
            "_stay": F.coalesce(F.sum(marks("</adm>").cast("long")).over(before), F.lit(0)),
            "first": F.row_number().over(Window.partitionBy("seq").orderBy("pos")) == 1,
            "_n": F.count_if(marks("</adm>")).over(seq),
        })
        live = live.withColumns({n: c.over(Window.partitionBy("seq", "_stay")) for n, c in lasts.items()})
        later = Window.partitionBy("seq").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
        return owned(live.withColumns({n: F.min(c).over(later) for n, c in picks.items()}))

    def split(rows: DataFrame) -> DataFrame:
        # Each ordered pass reads its input twice, so the passes are written.
        rows = durable(rows)
        facts = rows.join(rows.groupBy("seq").agg(end.alias("_end")), "seq").where(is_live)
        facts = facts.groupBy("seq").agg(
            F.max("_end").alias("_end"), F.count_if(marks("</adm>")).alias("_n"), F.min("pos").alias("_first")
        )
        live = rows.join(durable(facts), "seq").where(is_live).withColumn("_block", block_of("pos", width))
        live = durable(
            prefix_over_blocks(live, ["seq"], ["_block"], ["pos"], {"_stay": marks("</adm>").cast("long")}, coarse=True)
        )
        live = live.join(live.groupBy("seq", "_stay").agg(*[c.alias(n) for n, c in lasts.items()]), ["seq", "_stay"])
        return owned(first_from_here(durable(live), ["seq"], ["_block"], ["pos"], picks).withColumn("first", F.col("pos") == F.col("_first")))

    found = durable(by_size(placed, ["seq"], whole, split, counted))
    # Stays: the closed ones, plus the open one of an unfinished sequence.
    stay_list = found.where("stays > 0").select(
        "seq", "complete", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stays") - 1)).alias("stay")
    )
    kept = found.where("kept").withColumn(
        "group",
        F.when(F.col("kind").isin("phe", "ihm"), "label").when(F.col("kind").isin("ts", "timestamp"), "series").otherwise(F.col("kind")),
    )
    is_phe, is_series = F.col("kind") == "phe", F.col("group") == "series"
    ihm = (
        kept.where(F.col("kind") == "ihm")
        .groupBy("seq", "stay")
        .agg(F.max_by("value", "pos").alias("_ihm"))
    )
    stays = stay_list.join(ihm, ["seq", "stay"], "left").select(
        "seq",
        F.col("stay").cast("int").alias("stay_idx"),
        F.coalesce("_ihm", F.lit(0)).alias("label_ihm"),
        "complete",
    )
    section = F.when(F.col("group") == "covar", COVAR).when(F.col("group") == "label", LABEL)
    section = section.when(F.col("group") == "code", CODE).otherwise(SERIES)
    events = kept.where(F.col("kind") != "ihm")
    phe = events.where(is_phe).groupBy("seq", "stay", "value").agg(F.min("pos").alias("pos"))
    rest = events.where(~is_phe).select(
        "seq", F.col("stay").cast("int").alias("stay_idx"), section.alias("section"),
        F.when(is_series, F.col("close")).otherwise(F.col("pos")).alias("a"),
        F.when(is_series, F.col("pos")).otherwise(F.lit(0)).alias("b"),
        "kind", "var_id", "value",
    )
    labels = phe.select(
        "seq", F.col("stay").cast("int").alias("stay_idx"), F.lit(LABEL).alias("section"),
        F.col("value").cast("long").alias("a"), F.lit(0).cast("long").alias("b"),
        F.lit("phe").alias("kind"), F.lit(-1).alias("var_id"), "value",
    )
    return stays, union_all([rest.withColumn("b", F.col("b").cast("long")), labels])


def events_as_input(stays: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detokenized tables as the (events, stays) pair ``tokenize`` takes."""
    ihm = stays.select(
        F.col("seq").alias("sid"), "stay_idx", F.lit(LABEL).alias("section"),
        F.lit(-1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"),
        F.lit("ihm").alias("kind"), F.lit(-1).alias("var_id"), F.col("label_ihm").alias("value"),
    )
    return (
        events.withColumnRenamed("seq", "sid").unionByName(ihm),
        stays.select(F.col("seq").alias("sid"), "stay_idx"),
    )
