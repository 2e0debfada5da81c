"""Byte-level BPE with the tiktoken library and a local rank file.

A text goes to the library in parts of bounded size. A part ends only at a
*safe boundary*, a place that no match of the pre-splitting pattern spans
whatever follows it:

* white space after a character that is none: matches take white space at
  their front, never inside or at the end behind something else;
* a digit after a letter, or a letter after a digit: both are runs of one class.

So the parts have together exactly the ids of the whole text. A single match
is never cut, however long: a text without a safe boundary goes whole.

Ids are held as little-endian unsigned 32-bit integers in one binary value per
document, the form that token files use; ``as_arrays`` turns them into arrays.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.llm.common import process_cache, steps

#: A part is closed at the first safe boundary beyond so many characters.
PART_CHARS = 1 << 16
#: ASCII alone, so Python's and the library's notion of each class agree. The
#: character before white space must be none in either notion (\x1c-\x1f, \x85, no-break space ...).
BOUNDARY = re.compile(r"(?<=[!-~])(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def parts(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """Cut a text at the first safe boundary after each ``most`` characters."""
    begin = 0
    while len(text) - begin > most:
        found = BOUNDARY.search(text, begin + most)
        if found is None:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:]


class Codec:
    """The library's encoder for one rank file and pattern, and the bytes of each id."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        raw = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            raw[rank] = token
        sizes = np.array([len(b) for b in raw], dtype=np.int64)
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.size, self.start = sizes, np.cumsum(sizes) - sizes

    @staticmethod
    def of(path: str, pattern: str) -> Codec:
        cache = process_cache("tiktok")
        if (path, pattern) not in cache:
            cache[path, pattern] = Codec(path, pattern)
        return cache[path, pattern]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; strings that look like special tokens are ordinary text."""
        take = self.encoding.encode_to_numpy
        return b"".join(
            np.asarray(take(part, allowed_special=set(), disallowed_special=()), dtype="<u4").tobytes()
            for part in parts(text)
        )

    def decode(self, raw_ids: bytes) -> bytes:
        """The bytes of a row of ids, as they are: they need not be UTF-8. Unknown ids give none."""
        ids = np.frombuffer(raw_ids, dtype="<u4").astype(np.int64)
        ids = ids[ids < len(self.size)]
        sizes = self.size[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + sizes, sizes)
        return self.raw[at].tobytes()


def _encode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in steps(batches, "_text"):
            ids = [codec.encode(t or "") for t in batch.column("_text").to_pylist()]
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), counts, pa.array(ids, pa.binary())], ["_id", "n_tokens", "ids"]
            )

    return run


def _decode(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in steps(batches, "ids"):
            texts = [codec.decode(i or b"") for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_id", "n_tokens", "ids")), pa.array(texts, pa.binary())],
                ["_id", "n_tokens", "ids", "decoded"],
            )

    return run


def encode(
    docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_tokens, ids binary) of every row, without a shuffle.

    NULL and empty texts have no ids; repeated rows, NULL ids and equal ids all
    stay; an empty table gives none. Whole texts are read. Columns besides the
    two are not looked at, so their names cannot clash.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(_encode(rank_path, pattern), f"_id {kind}, n_tokens long, ids binary")
    return out.withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids, decoded binary): the raw bytes of every row of ids. NULL ids give no bytes."""
    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("_id"), "n_tokens", "ids")
    out = rows.mapInArrow(_decode(rank_path, pattern), f"_id {kind}, n_tokens long, ids binary, decoded binary")
    return out.withColumnRenamed("_id", id_col)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "ids"):
        rows = [i or b"" for i in batch.column("ids").to_pylist()]
        ends = np.cumsum([0] + [len(r) // 4 for r in rows]).astype(np.int32)
        values = np.frombuffer(b"".join(rows), dtype="<u4").astype(np.int64)
        ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), ids], ["_id", "ids"])


def as_arrays(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<long>) for users who want numbers; NULL gives an empty array."""
    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("_id"), "ids")
    return rows.mapInArrow(_unpack, f"_id {kind}, ids array<bigint>").withColumnRenamed("_id", id_col)
