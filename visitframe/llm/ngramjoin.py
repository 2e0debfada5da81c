"""N-gram Jaccard join with Bayesian pruning of candidates.

1. Rows of one text count as one. Of each text are taken: its five-word shingles, 128 MinHash values, and from 125 of them 25 band keys.
   Pairs of similarity 0.8 share a band but for about one in 20,000.
2. Texts that share a band key are candidates. Buckets are cut into blocks by
   hash; a task compares two blocks. The MinHash values (their low bytes) are
   compared 32 at a time: given ``m`` agreements of ``n``, a pair is dropped
   once the posterior probability (uniform prior) that its similarity reaches
   the threshold is below ``TOLERANCE``. What stays is told as a spanning
   forest of the block pair, never as all pairs.
3. The connected components of these candidates are verified exactly: within
   each, again in blocks, all intersections of shingle sets come from products
   of incidence matrices over shared shingles. A task returns a number of links and
   a link to a smaller text for each text, so groups of thousands of near copies
   make rows in proportion to their size. Links that no band showed are found
   too if their texts are in one component.
4. The components of the verified links are the classes of documents.

Words are runs of letters and digits in lower case. A text of one to four
words has its word row as only shingle; a text without words has no links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.llm.common import bitmap_of, in_bitmap, process_cache, steps, written
from visitframe.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS, VALUES = 25, 5, 128
STEP = 32
TOLERANCE = 1e-4
#: Texts in a block of a bucket or component; shingles in a block of a component.
BLOCK, BLOCK_SHINGLES = 512, 400_000
FILTER_BITS = 1 << 22
#: Words that a Python worker keeps.
CACHED_WORDS = 150_000


def _constants(name: str, count: int) -> np.ndarray:
    """Odd 64-bit numbers from a digest of their name and place."""
    raw = b"".join(hashlib.blake2b(f"{name}{i}".encode(), digest_size=8).digest() for i in range(count))
    return np.frombuffer(raw, dtype="<u8") | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of all texts as hashes, row by row, and the number of each text's."""
    import re

    word = re.compile(r"[^\W_]+")
    known = process_cache("word_hashes")
    if len(known) > CACHED_WORDS:
        known.clear()
    rows = [word.findall(t.lower()) for t in texts]
    new = list(set().union(*rows).difference(known)) if rows else []
    raw = b"".join([hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in new])
    known.update(zip(new, np.frombuffer(raw, dtype="<u8").tolist()))
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.fromiter((known[w] for r in rows for w in r), dtype=np.uint64, count=int(lengths.sum()))
    weights = _constants("word", size)
    ends = np.cumsum(lengths)
    sums = np.zeros(len(flat), dtype=np.uint64)
    for k in range(min(size, len(flat))):
        sums[: len(flat) - k] += flat[k:] * weights[k]
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    at = np.arange(counts.sum()) + np.repeat(ends - lengths - np.cumsum(counts) + counts, counts)
    hashes = sums[at] if len(at) else np.empty(0, dtype=np.uint64)
    place = np.cumsum(counts) - counts
    for i in np.flatnonzero((lengths > 0) & (lengths < size)):
        own = flat[ends[i] - lengths[i] : ends[i]]
        hashes[place[i]] = (own * weights[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return _mixed(hashes), counts


def minhash(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, VALUES) 32-bit MinHash values; rows of empty texts are 0."""
    out = np.zeros((len(counts), VALUES), dtype=np.uint32)
    full = np.flatnonzero(counts > 0)
    if not len(full):
        return out
    starts = (np.cumsum(counts) - counts)[full]
    a, b = _constants("a", VALUES), _constants("b", VALUES)
    for k in range(VALUES):
        values = ((hashes * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
        out[full, k] = np.minimum.reduceat(values, starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys; the band's number is part of the key."""
    weights = _constants("band", BANDS * ROWS).reshape(BANDS, ROWS)
    rows = values[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS)
    return _mixed((rows * weights).sum(axis=2, dtype=np.uint64) + _constants("number", BANDS)).view(np.int64)


def least_matches(threshold: float, tolerance: float, step: int = STEP, values: int = VALUES) -> dict[int, int]:
    """For each n compared: the agreements below which a pair is dropped.

    Low bytes of different values agree once in 256, so an agreement has
    probability q = s + (1 - s) / 256 at similarity s.
    """
    s = (np.arange(100_000) + 0.5) / 100_000
    q = s + (1 - s) / 256
    out = {}
    for n in range(step, values + 1, step):
        for m in range(n + 1):
            density = m * np.log(q) + (n - m) * np.log1p(-q)
            density = np.exp(density - density.max())
            if density[s >= threshold].sum() >= tolerance * density.sum():
                out[n] = m
                break
    return out


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least vertex of each vertex's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "text"):
        # Copies in a step are read once.
        keys, first, place = np.unique(batch.column("key").to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
        hashes, counts = shingle_sets(batch.column("text").take(pa.array(first)).to_pylist())
        values = minhash(hashes, counts)
        bands = band_keys(values)[place]
        offsets = pa.array(np.arange(len(place) + 1) * BANDS, pa.int32())
        sig = pa.array([row.tobytes() for row in values.astype(np.uint8)[place]], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("key"), pa.array(counts[place], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(bands.ravel())), sig],
            ["id", "key", "size", "bands", "sig"],
        )


def _pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a, b), a before b, within consecutive groups of these sizes."""
    starts = np.cumsum(sizes) - sizes
    after = np.repeat(starts + sizes, sizes) - np.arange(sizes.sum()) - 1
    a = np.repeat(np.arange(sizes.sum()), after)
    b = np.arange(after.sum()) - np.repeat(np.cumsum(after) - after, after) + a + 1
    return a, b


def _prune(threshold: float, tolerance: float, most: int = 2_000_000):
    least = least_matches(threshold, tolerance)

    def survivors(frame) -> pa.RecordBatch:
        rid, slot = frame["rid"].to_numpy(), frame["slot"].to_numpy()
        sig = np.frombuffer(b"".join(frame["sig"]), dtype=np.uint8).reshape(-1, VALUES)
        key = frame[["bucket", "i", "j"]].to_numpy()
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[first, len(key)])
        # In a pair of different blocks only pairs across count.
        across = key[:, 1] != key[:, 2]
        edges_a, edges_b = [], []
        begin = 0
        loads = np.cumsum(sizes * (sizes - 1) // 2)
        while begin < len(sizes):
            done = loads[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(loads, done + most, side="right")))
            a, b = _pairs(sizes[begin:end])
            a, b = a + first[begin], b + first[begin]
            keep = ~across[a] | (slot[a] != slot[b])
            a, b = a[keep], b[keep]
            same = np.zeros(len(a), dtype=np.int16)
            for n, m in least.items():
                for lo in range(0, len(a), 200_000):
                    hi = lo + 200_000
                    same[lo:hi] += (sig[a[lo:hi], n - STEP : n] == sig[b[lo:hi], n - STEP : n]).sum(axis=1, dtype=np.int16)
                keep = same >= m
                a, b, same = a[keep], b[keep], same[keep]
            edges_a.append(a)
            edges_b.append(b)
            begin = end
        # A text may stand in several groups here: vertices are texts.
        texts, vertex = np.unique(rid, return_inverse=True)
        root = spanning(len(texts), vertex[np.concatenate(edges_a)], vertex[np.concatenate(edges_b)])
        moved = np.flatnonzero(root != np.arange(len(texts)))
        return pa.RecordBatch.from_arrays([pa.array(texts[moved]), pa.array(texts[root[moved]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        held = None
        for batch in batches:
            frame = batch.to_pandas()
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if len(held) < 4 * BLOCK:
                continue
            last = held[["bucket", "i", "j"]].iloc[-1]
            open_ = (held[["bucket", "i", "j"]] == last).all(axis=1).to_numpy()
            if not open_.all():
                yield survivors(held[~open_])
                held = held[open_].reset_index(drop=True)
        if held is not None and len(held):
            yield survivors(held)

    return run


def _intersections(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 8192) -> np.ndarray:
    """Sizes of all intersections of sorted sets, by products over shared elements."""
    a, b = np.concatenate(left), np.concatenate(right)
    row_a = np.repeat(np.arange(len(left)), [len(x) for x in left])
    row_b = np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not len(shared):
        return out.astype(np.int64)
    places = []
    for values, rows in ((a, row_a), (b, row_b)):
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[at] == values
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], rows[hit][order]))
    for begin in range(0, len(shared), chunk):
        parts = []
        for (at, rows), n in zip(places, (len(left), len(right))):
            lo, hi = np.searchsorted(at, [begin, begin + chunk])
            m = np.zeros((n, min(chunk, len(shared) - begin)), dtype=np.float32)
            m[rows[lo:hi], at[lo:hi] - begin] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _verify(threshold: float):
    def run(key, table):
        rid = table.column("rid").to_numpy()
        copies = table.column("copies").to_numpy()
        slot = table.column("slot").to_numpy()
        hashes, counts = shingle_sets(table.column("text").to_pylist())
        sets = [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]
        inner = key[1].as_py() == key[2].as_py()
        rows = np.arange(len(rid)) if inner else np.flatnonzero(slot == key[1].as_py())
        columns = rows if inner else np.flatnonzero(slot == key[2].as_py())
        links = np.zeros(len(rid), dtype=np.int64)
        root = np.arange(len(rid))
        if len(rows) and len(columns):
            sizes = np.array([len(s) for s in sets])
            common = _intersections([sets[i] for i in rows], [sets[i] for i in columns])
            union = sizes[rows][:, None] + sizes[columns][None, :] - common
            linked = common >= threshold * union - 1e-9
            if inner:
                np.fill_diagonal(linked, False)
                links = linked @ copies
            else:
                links[rows] = linked @ copies[columns]
                links[columns] = linked.T @ copies[rows]
            a, b = np.nonzero(linked)
            order = np.argsort(rid, kind="stable")
            place = np.argsort(order, kind="stable")
            root = order[spanning(len(rid), place[rows[a]], place[columns[b]])[place]]
        return pa.table({"rid": pa.array(rid), "links": pa.array(links.astype(np.int64)), "root": pa.array(rid[root])})

    return run


def _blocked(df: DataFrame, group: str, count: str) -> DataFrame:
    """One row for each block pair that the row takes part in: slot, i, j.

    ``count`` is the number of blocks of the group; a row lies in one of them
    by its hash.
    """
    slots = df.withColumn("slot", F.pmod(F.xxhash64("rid", group), F.col(count)).cast("int"))
    other = slots.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)))
    return other.select(*df.columns, "slot", F.least("slot", "_o").alias("i"), F.greatest("slot", "_o").alias("j"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(id, key, class, n_links) for each row of ``docs``.

    ``key`` is the MD5 of the text, ``class`` a number that rows of one class
    share, ``n_links`` the number of other rows whose text is equal or of at
    least ``threshold`` similarity. NULL texts are empty; empty texts, and those without
    a word, have no links and each is its own class by text. Repeated rows and NULL ids stay.
    Other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.md5(text).alias("key"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = written(rows.mapInArrow(_signatures, f"id {kind}, key string, size long, bands array<long>, sig binary"), "signatures")
    same = signed.groupBy("key").agg(F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("size", "bands", "sig")])
    reps = written(same.withColumn("rid", F.monotonically_increasing_id()), "texts")

    member = reps.where(F.col("size") > 0).select("rid", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    held = member.join(shared.select("bucket", F.ceil(F.col("n") / BLOCK).alias("n")), "bucket")
    held = written(held.select("rid", "bucket", "n"), "buckets").join(reps.select("rid", "sig"), "rid")
    dealt = _blocked(held.select("rid", "sig", "bucket", "n"), "bucket", "n")
    ordered = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").select("bucket", "i", "j", "slot", "rid", "sig")
    candidates = components(ordered.mapInArrow(_prune(threshold, tolerance), "u long, v long"))
    candidates = written(candidates, "candidates")

    load = reps.join(candidates.withColumnRenamed("node", "rid"), "rid").select("rid", "root", "key", "size", "copies")
    total = load.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("n"))
    load = written(load.join(total, "root"), "members")
    # Texts of other rows stay where they are, but for a few that share a bit.
    hashed = F.xxhash64("key")
    wanted = bitmap_of(load.select(hashed.alias("h")), "h", FILTER_BITS)
    texts = rows.where(in_bitmap(wanted, hashed, FILTER_BITS)).select("key", "text").join(load.select("key"), "key", "left_semi")
    texts = texts.groupBy("key").agg(F.any_value("text").alias("text"))
    work = _blocked(load.join(texts, "key").select("root", "rid", "copies", "n", "text"), "root", "n")
    checked = work.groupBy("root", "i", "j").applyInArrow(_verify(threshold), "rid long, links long, root long")
    checked = written(checked, "verified")
    links = checked.groupBy("rid").agg(F.sum("links").alias("links"))
    group = components(checked.select(F.col("rid").alias("u"), F.col("root").alias("v")))

    named = reps.select("rid", "key", "copies", "size").join(links, "rid", "left").join(group.withColumnRenamed("node", "rid"), "rid", "left")
    own = F.when(F.col("size") > 0, F.col("copies") - 1).otherwise(F.lit(0).cast("long"))
    named = named.select("key", F.coalesce("root", "rid").alias("class"), (own + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select(F.col("id").alias(id_col), "key").join(named, "key").select(id_col, "key", "class", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, of the least id in each class.

    NULL ids come last; of equal ids the text with the least MD5 stays, of
    equal rows one. Documents without a word all stay but for exact copies.
    """
    found = classes(docs, id_col, text_col, **options)
    rank = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.col("key").alias("key"))
    kept = found.groupBy("class").agg(F.min(rank).alias("r")).select(F.col("r.id").alias("_keep_id"), F.col("r.key").alias("_keep_key"))
    times = found.groupBy(F.col(id_col).alias("_id"), F.col("key").alias("_key")).agg(F.count("*").alias("_times"))
    kept = kept.join(times, kept["_keep_id"].eqNullSafe(times["_id"]) & (kept["_keep_key"] == times["_key"])).select("_keep_id", "_keep_key", "_times")
    kept = written(kept, "kept")
    key = F.md5(F.coalesce(docs[text_col], F.lit("")))
    once, more = kept.where(F.col("_times") == 1), kept.where(F.col("_times") > 1)
    single = docs.join(once, docs[id_col].eqNullSafe(once["_keep_id"]) & (key == once["_keep_key"]), "left_semi")
    # Equal id and text may still differ in other columns; which of them stays is open.
    repeated = docs.join(more, docs[id_col].eqNullSafe(more["_keep_id"]) & (key == more["_keep_key"]), "left_semi")
    return single.unionByName(repeated.dropDuplicates([id_col, text_col]))
