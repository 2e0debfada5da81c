"""Benchmark decontamination by SimHash over item-sized windows.

1. Words (lower case, runs of letters and digits) give a 64-bit hash for each
   five in a row.
2. A fixed-size bitmap of all items' hashes leaves the documents that hold
   some. Windows have the size of an item; only those in which at least the
   threshold's share of hashes belongs to items of that size are fingerprinted.
   No window that reaches the threshold is lost by this: the similarity is at
   most that share.
3. The SimHash of a window: bit ``b`` is set if it is set in more than half of
   the window's hashes, each as often as it occurs.
4. Four 16-bit blocks of the fingerprint are keys. Fingerprints within
   ``RADIUS`` = 15 bits agree in one block up to 3 bits; the index holds all
   697 such neighbours of every item block, so all of them are found.
5. The weighted Jaccard similarity (sum of lesser counts over sum of greater
   counts of the hashes) of window and item decides.

Two texts of similarity 0.8 differ in about ten bits; a radius of 15 is two
standard deviations more, verbatim passages differ in none.

All on the JVM. The scan is one pass; only touched documents leave it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.llm.common import let, written

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 15
BLOCKS, BLOCK_BITS = 4, 16
FLIPS = RADIUS // BLOCKS
FILTER_BITS = 1 << 21


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """A hash for each ``size`` words in a row; empty for fewer words."""

    def hashed(words: Column) -> Column:
        count = F.greatest(F.size(words) - (size - 1), F.lit(0))
        return F.transform(
            F.slice(words, F.lit(1), count), lambda w, i: F.xxhash64(w, *[words[i + k] for k in range(1, size)])
        )

    return let(words_of(text), hashed)


def fingerprint(hashes: Column) -> Column:
    """64-bit SimHash of an array of hashes, each counted as often as it occurs.

    Bits are counted two at a time in the halves of 32 longs, so an array may
    have up to 2**31 elements.
    """
    mask = F.lit(0x0000000100000001)
    lanes = range(32)
    begin = F.struct(*[F.lit(0).cast("long").alias(f"b{j}") for j in lanes])
    low = F.lit(0xFFFFFFFF)

    def add(state: Column, h: Column) -> Column:
        return F.struct(*[(state[f"b{j}"] + F.shiftrightunsigned(h, j).bitwiseAND(mask)).alias(f"b{j}") for j in lanes])

    def close(state: Column) -> Column:
        out = F.lit(0).cast("long")
        half = F.size(hashes).cast("long")
        for j in lanes:
            for k, count in enumerate((state[f"b{j}"].bitwiseAND(low), F.shiftrightunsigned(state[f"b{j}"], 32))):
                bit = int(np.int64(np.uint64(1 << (j + 32 * k))))
                out = out.bitwiseOR(F.when(count * 2 > half, F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return F.aggregate(hashes, begin, add, close)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of lesser counts over sum of greater counts; NULL for two empty arrays."""
    simple = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    counted = F.aggregate(
        F.array_intersect(a, b), F.lit(0),
        lambda s, x: s + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))),
    )
    same = F.when(simple, F.size(F.array_intersect(a, b))).otherwise(counted)
    return let(same, lambda s: s / F.nullif(F.size(a) + F.size(b) - s, F.lit(0)))


def block_keys(value: Column) -> Column:
    """(block, key) of the four blocks of a fingerprint."""
    return F.array(
        *[
            F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(value, k * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("key"))
            for k in range(BLOCKS)
        ]
    )


def neighbours(key: Column) -> Column:
    """All keys of a block within FLIPS bits."""
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1)), lambda m: F.bit_count(m) <= FLIPS)
    return F.transform(masks, lambda m: key.bitwiseXOR(m.cast("long")))


def _filter_words(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of all item hashes: ``bits`` / 64 longs, whatever the items."""
    place = F.pmod("h", F.lit(bits))
    words = hashes.groupBy(F.floor(place / 64).cast("int").alias("w")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod(h, {bits}), 64) as int))")).alias("v")
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    for row in words.collect():
        out[row["w"]] = row["v"]
    return out


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """(id, _digest, item_id, start, n_words, similarity, distance): documents that hold an item.

    One row per row of ``docs`` and item found, for the item's most similar
    window (the first of them); ``start`` counts words from 0. ``_digest`` is
    the text's MD5, so rows with one id are told apart. Items of fewer than
    five words, and NULL or empty texts on either side, match nothing. Of
    items with one word sequence each is told. A document shorter than an item
    is one window.
    """
    kept = items.select(F.col(item_col).alias("item_id"), shingle_hashes(F.col(item_text)).alias("_item"))
    kept = written(kept.where(F.size("_item") > 0), "items")
    # No window needs fewer known hashes than the smallest item does.
    smallest = kept.agg(F.min(F.size("_item"))).first()[0] or 1
    fewest = max(1, int(np.ceil(smallest * threshold - 1e-9)))
    sizes = written(kept.select(F.explode("_item").alias("h"), F.size("_item").alias("n")).distinct(), "item-sizes")
    # One literal of a fixed size: the Java array goes along with the tasks.
    bitmap = F.lit(_filter_words(sizes.select("h").distinct(), filter_bits))

    def held(h: Column) -> Column:
        place = F.pmod(h, F.lit(filter_bits).cast("long")).cast("int")
        word = bitmap[F.shiftright(place, 6)]
        shifted = F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63)))
        return shifted.bitwiseAND(F.lit(1)) == 1

    def touched(hashes: Column) -> Column:
        places = F.filter(F.transform(hashes, lambda h, i: F.when(held(h), i)), lambda i: i.isNotNull())
        row = let(places, lambda p: F.when(F.size(p) >= fewest, F.array(F.struct(hashes.alias("hs"), p.alias("hits")))))
        return row

    base = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    scan = base.select("_row", "_id", F.md5("_text").alias("_digest"), F.inline(let(shingle_hashes(F.col("_text")), touched)))
    stage = written(scan, "touched")

    hits = stage.select("_row", F.size("hs").alias("_all"), F.explode("hits").alias("pos"), F.col("hs").alias("_hs"))
    hits = hits.select("_row", "_all", "pos", F.element_at("_hs", F.col("pos") + 1).alias("h"))
    known = hits.join(sizes, "h").groupBy("_row", "n").agg(F.first("_all").alias("_all"), F.array_sort(F.collect_list("pos")).alias("at"))

    # Of a window that begins at s, the first known hash is at[j] = s + k. It
    # holds ``need`` of them if at[j + need - 1] is inside as well.
    need = F.greatest(F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int"), F.lit(1))
    width = F.least("n", "_all")

    def starts(p: Column, j: Column) -> Column:
        last = F.get("at", j + need - 1)
        most = F.least(
            F.col("n") - need, F.when(j > 0, p - F.get("at", j - 1) - 1).otherwise(p), p + width - 1 - last
        )
        least = F.greatest(F.lit(0), p + width - F.col("_all"))
        return F.when(last.isNotNull() & (most >= least), F.transform(F.sequence(least, most), lambda k: p - k)).otherwise(
            F.array().cast("array<int>")
        )

    places = known.select("_row", "n", width.alias("width"), F.explode(F.flatten(F.transform("at", starts))).alias("start"))
    lists = places.groupBy("_row").agg(F.collect_list(F.struct("n", "width", "start")).alias("windows"))
    windows = stage.drop("hits").join(lists, "_row").select("_row", "_id", "_digest", "hs", F.inline("windows"))
    windows = windows.select("_row", "_id", "_digest", "start", "width", F.slice("hs", F.col("start") + 1, F.col("width")).alias("_window"))
    windows = written(windows.withColumn("fp", fingerprint(F.col("_window"))), "windows")

    prints = kept.withColumn("item_fp", fingerprint(F.col("_item")))
    index = prints.select("item_fp").distinct().select("item_fp", F.inline(block_keys(F.col("item_fp"))))
    index = index.select("item_fp", "block", F.explode(neighbours(F.col("key"))).alias("key"))
    keys = windows.select("fp").distinct().select("fp", F.inline(block_keys(F.col("fp"))))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = keys.join(index, ["block", "key"]).select("fp", "item_fp", distance.alias("distance")).where(F.col("distance") <= RADIUS).distinct()
    pairs = windows.join(near, "fp").join(prints, "item_fp")
    scored = pairs.select("_row", "_id", "_digest", "item_id", "start", (F.col("width") + SHINGLE - 1).alias("n_words"), "distance", weighted_jaccard(F.col("_window"), F.col("_item")).alias("similarity"))
    scored = scored.where(F.col("similarity") >= threshold - 1e-9)
    best = F.min_by(F.struct("start", "n_words", "similarity", "distance"), F.struct(-F.col("similarity"), F.col("start")))
    out = scored.groupBy("_row", "item_id").agg(F.first("_id").alias(id_col), F.first("_digest").alias("_digest"), best.alias("b"))
    return out.select(id_col, "_digest", "item_id", "b.start", "b.n_words", "b.similarity", "b.distance")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    found = contaminated(docs, items, id_col, text_col, **options).select(F.col(id_col).alias("_found_id"), F.col("_digest").alias("_found_digest")).distinct()
    same = docs[id_col].eqNullSafe(found["_found_id"]) & (F.md5(docs[text_col]) == found["_found_digest"])
    return docs.join(found, same, "left_anti")
