"""Token ids in directly addressable files.

Format. Documents are range-partitioned and sorted by id, so shard ``k`` holds
smaller ids than shard ``k + 1``. A shard is a run of *segments*, one record
each of a Parquet table that Spark's own committer writes (a retried task
replaces its files, and any store that Spark reaches can hold them):

====================  ======================================================
``shard, segment``    place in the order
``n_tokens``          ids in the segment
``doc_ids``           ids of the documents that begin (and end) in it
``doc_starts``        their first token, counted from the shard's first
``doc_tokens``        their number of tokens
``levels``            the ids: per level ``chunks``, ``more`` and ``rank``
====================  ======================================================

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of
every id, level 1 the second chunk of those ids that need one, and so on.
``more`` has one bit for each chunk of the level (little-endian bits): set if
the id goes on. ``rank`` has, for each 512 bits of ``more``, the number of set
bits before them as unsigned 32-bit little-endian integers. The token at ``i``
is therefore read with a byte, a bit, one rank and at most 64 bytes of popcount
per level; no block is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitframe.llm.bpe import byte_letters
from visitframe.llm.common import STEP_BYTES, process_cache, steps

BLOCK_BITS = 512
#: A segment is closed at the first end of a document beyond so many tokens.
SEGMENT_TOKENS = 1 << 18
#: Encoded words and pieces of words in a generation that a Python worker keeps; there are two.
CACHED_WORDS, CACHED_PIECES = 450_000, 250_000
#: Python splits on these four characters, the tokenizer does not.
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
MARK = "\x02"

LEVELS = "array<struct<chunks:binary,more:binary,rank:binary>>"
SCHEMA = (
    "shard int, segment int, n_tokens long, doc_ids array<long>, doc_starts array<long>, "
    f"doc_tokens array<long>, levels {LEVELS}"
)


def dac_encode(ids: np.ndarray) -> list[dict[str, bytes]]:
    """Levels of an array of non-negative ids below 2**32."""
    levels = []
    rest = np.asarray(ids, dtype=np.uint32)
    while True:
        high = rest >> np.uint32(8)
        more = high > 0
        padded = np.zeros(-(-len(more) // BLOCK_BITS) * BLOCK_BITS, dtype=bool)
        padded[: len(more)] = more
        counts = padded.reshape(-1, BLOCK_BITS).sum(axis=1)
        rank = np.cumsum(counts) - counts
        levels.append(
            {
                "chunks": (rest & np.uint32(255)).astype(np.uint8).tobytes(),
                "more": np.packbits(more, bitorder="little").tobytes(),
                "rank": rank.astype("<u4").tobytes(),
            }
        )
        if not more.any():
            return levels
        rest = high[more]


def dac_decode(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids, level by level."""
    out = np.frombuffer(levels[0]["chunks"], dtype=np.uint8).astype(np.uint32)
    at = np.arange(len(out))
    for k, level in enumerate(levels):
        if k:
            out[at] |= np.frombuffer(level["chunks"], dtype=np.uint8).astype(np.uint32) << np.uint32(8 * k)
        bits = np.unpackbits(np.frombuffer(level["more"], dtype=np.uint8), bitorder="little")
        at = at[bits[: len(at)].astype(bool)]
    return out


def dac_access(levels: list[dict[str, bytes]], i: int) -> int:
    """The id at position ``i``; reads one byte, bit and rank per level."""
    value = shift = 0
    for level in levels:
        value |= level["chunks"][i] << shift
        more = level["more"]
        if not more[i >> 3] >> (i & 7) & 1:
            break
        block = i // BLOCK_BITS
        before = int.from_bytes(more[block * BLOCK_BITS // 8 : (i >> 3) + 1], "little")
        before &= (1 << (i - block * BLOCK_BITS)) - 1
        i = int.from_bytes(level["rank"][4 * block : 4 * block + 4], "little") + before.bit_count()
        shift += 8
    return value


class Kept:
    """A dictionary of two generations: once the young one is full, it becomes the old one.

    What is asked for again comes back from the old generation, so common
    entries stay and rare ones go; at most twice ``most`` entries are held.
    """

    def __init__(self, most: int):
        self.most = most
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young

    def missing(self, keys: set[str]) -> list[str]:
        """Keys that are not known; those of the old generation come back into the young one."""
        old, new, again = self.old, [], {}
        for key in keys.difference(self.young):
            if key in old:
                again[key] = old[key]
            else:
                new.append(key)
        self.young.update(again)
        return new


class WordEncoder:
    """Encodes with the tokenizers library, each word and each piece of a word once.

    The tokenizer's pattern never spans white space and its normalizer works
    on each character or composed character alone, so a text's ids are those
    of its words in a row. A word of characters below U+0250 is cut into the
    pattern's pieces here (these characters are composed, and their lower case
    depends on no neighbour), and only new pieces go to the library's model.
    Other words, and those that may hold a special token, go through the whole
    tokenizer, as do texts for which Python's notion of white space is wider
    than the tokenizer's.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.words, self.pieces = Kept(CACHED_WORDS), Kept(CACHED_PIECES)
        self.letters = dict(enumerate(byte_letters()))
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        self.plain, self.latin = self._patterns(spec)

    @staticmethod
    def _patterns(spec: dict):
        """The tokenizer's own pattern, for ASCII and for Latin words; None if its steps are others."""
        import re

        import regex

        normal, before = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps_ = [n["type"] for n in normal.get("normalizers", [])]
        cuts = before.get("pretokenizers", [])
        if steps_ != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
            return None, None
        pattern = cuts[0]["pattern"].get("Regex")
        if not pattern or not cuts[0].get("invert") or cuts[1].get("add_prefix_space") or cuts[1].get("use_regex"):
            return None, None
        latin = regex.compile(pattern)
        ascii_only = pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", "a-z0-9")
        return re.compile(ascii_only) if r"\p" not in ascii_only else latin, latin

    @staticmethod
    def of(path: str) -> WordEncoder:
        cache = process_cache("word_encoder")
        if path not in cache:
            cache[path] = WordEncoder(path)
        return cache[path]

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4").tobytes()

    def _learn_pieces(self, pieces: list[str]) -> None:
        """Ids of new pieces by the library's model, many pieces in a row.

        The bare model cuts at spaces, which no piece holds, and tells for
        each id the piece it is from.
        """
        for begin in range(0, len(pieces), 4000):
            part = pieces[begin : begin + 4000]
            spelt = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.letters) for p in part]
            found = self.bare.encode(" ".join(spelt), add_special_tokens=False)
            ends = 4 * np.cumsum(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(part)))
            raw = np.array(found.ids, dtype="<u4").tobytes()
            self.pieces.young.update(zip(part, [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]))

    def _learn(self, words: list[str], special: bool) -> None:
        """Ids of new words: from their pieces, or from the whole tokenizer. ``special``: some may hold a special token."""
        if special:
            rest = [w for w in words if any(s in w for s in self.special)]
            words = set(words).difference(rest)
        else:
            rest = []
        plain = [w for w in words if w.isascii()] if self.plain else []
        latin = [w for w in words if not w.isascii() and max(w) < "\u0250"] if self.latin else []
        rest += set(words).difference(plain, latin)
        # A word of letters alone is one piece.
        alike = {w: p for w in chain(plain, latin) if (p := w.lower()).isalpha()}
        cut = {w: self.plain.findall(w.lower()) for w in plain if w not in alike}
        cut.update((w, self.latin.findall(w.lower())) for w in latin if w not in alike)
        self.pieces.turn()
        new = self.pieces.missing(set(alike.values()).union(*cut.values()))
        self._learn_pieces(new)
        known = self.pieces.young
        self.words.young.update(zip(alike, map(known.__getitem__, alike.values())))
        self.words.young.update((w, b"".join(map(known.__getitem__, row))) for w, row in cut.items())
        self._learn_whole(rest)

    def _learn_whole(self, words: list[str]) -> None:
        """Encode words in long rows with a mark between them.

        The mark stands between spaces, so it is a word of its own there and
        its id falls nowhere else.
        """
        known = self.words.young
        plain = [w for w in words if MARK not in w]
        known.update((w, self._whole(w)) for w in words if MARK in w)
        mark = self._whole(MARK)
        for begin in range(0, len(plain), 2000):
            part = plain[begin : begin + 2000]
            raw = self._whole(f" {MARK} ".join(part))
            ids = np.frombuffer(raw, dtype="<u4")
            cuts = np.flatnonzero(ids == np.frombuffer(mark, dtype="<u4")[0])
            if len(mark) != 4 or len(cuts) != len(part) - 1:  # a vocabulary without that mark
                known.update((w, self._whole(w)) for w in part)
                continue
            starts = [0, *(cuts + 1).tolist()]
            ends = [*cuts.tolist(), len(ids)]
            known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, starts, ends))

    def encode(self, texts: list[str], end_id: int | None) -> list[np.ndarray]:
        self.words.turn()
        words = [None if any(c in t for c in NOT_SPACE) else t.split() for t in texts]
        special = any(s in t for s in self.special for t in texts)
        self._learn(self.words.missing(set().union(*filter(None, words))), special)
        known = self.words.young
        end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        rows = [self._whole(t) if row is None else b"".join(map(known.__getitem__, row)) for t, row in zip(texts, words)]
        return [np.frombuffer(row + end, dtype="<u4") for row in rows]


def _segments(path: str, end_id: int | None, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        shard = TaskContext.get().partitionId()
        segment = start = held = 0
        doc_ids, arrays = [], []

        def close():
            sizes = np.array([len(a) for a in arrays], dtype=np.int64)
            starts = start + np.cumsum(sizes) - sizes
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "shard": shard, "segment": segment, "n_tokens": int(sizes.sum()), "doc_ids": doc_ids,
                        "doc_starts": starts.tolist(), "doc_tokens": sizes.tolist(),
                        "levels": dac_encode(np.concatenate(arrays)),
                    }
                ],
                schema=ARROW,
            )

        for batch in steps(batches, "text", 2 * STEP_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts, end_id)):
                doc_ids.append(doc)
                arrays.append(ids)
                held += len(ids)
                if held >= tokens:
                    yield close()
                    segment, start, held, doc_ids, arrays = segment + 1, start + held, 0, [], []
        if arrays:
            yield close()

    return run


ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())),
        ("levels", pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("rank", pa.binary())]))),
    ]
)


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_tokens: int = SEGMENT_TOKENS,
) -> None:
    """Encode every whole text and write the ids in ascending id order.

    A NULL text is an empty one and holds the end id alone. Rows with one id
    all stay, in the order of their text's hash; NULL ids come first. Columns
    besides the two are not looked at. An empty table gives an empty file.
    One shuffle carries the texts; a shard streams, so its size is no limit.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("_tie"))
    ordered = rows.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    ordered.drop("_tie").mapInArrow(_segments(tokenizer_path, end_id, segment_tokens), SCHEMA).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            r = batch.slice(row, 1).to_pylist()[0]
            raw = dac_decode(r["levels"]).astype("<u4").tobytes()
            first = r["doc_starts"][0]
            spans = [(4 * (s - first), 4 * (s - first + n)) for s, n in zip(r["doc_starts"], r["doc_tokens"])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r["shard"]] * len(spans), pa.int32()),
                    pa.array(r["doc_ids"], pa.int64()),
                    pa.array(r["doc_starts"], pa.int64()),
                    pa.array(r["doc_tokens"], pa.int64()),
                    pa.array([raw[a:b] for a, b in spans], pa.binary()),
                ],
                ["shard", "doc_id", "local_start", "n_tokens", "ids"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers.

    ``start`` counts the ids of all documents before. Only the totals of
    shards, one row each, meet in one task.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rows = files.mapInArrow(_documents, "shard int, doc_id long, local_start long, n_tokens long, ids binary")
    # One row per shard, so as many as tasks that wrote the file.
    return rows.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("_offset") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def _at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        wanted = batch.to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r["doc_id"] for r in wanted], pa.int64()),
                pa.array([r["k"] for r in wanted], pa.int64()),
                pa.array([dac_access(r["levels"], r["at"]) for r in wanted], pa.int64()),
            ],
            ["doc_id", "k", "token_id"],
        )


def tokens_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, k, token_id) for the wanted (doc_id, k): token ``k`` of a document.

    Positions outside a document give no row. The directories are joined
    first; only segments with a wanted token are read, and in them only the
    addressed bytes are looked at.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    directory = files.select(
        "shard", "segment", F.col("doc_starts")[0].alias("_first"),
        F.explode(F.arrays_zip("doc_ids", "doc_starts", "doc_tokens")).alias("_d"),
    ).select("shard", "segment", "_first", F.col("_d.doc_ids").alias("doc_id"), F.col("_d.doc_starts").alias("_s"), F.col("_d.doc_tokens").alias("_n"))
    places = wanted.select(F.col("doc_id").cast("long"), F.col("k").cast("long")).join(directory, "doc_id")
    places = places.where((F.col("k") >= 0) & (F.col("k") < F.col("_n"))).select(
        "shard", "segment", "doc_id", "k", (F.col("_s") - F.col("_first") + F.col("k")).alias("at")
    )
    joined = places.join(files.select("shard", "segment", "levels"), ["shard", "segment"])
    return joined.select("doc_id", "k", "at", "levels").mapInArrow(_at, "doc_id long, k long, token_id long")
