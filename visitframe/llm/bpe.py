"""Byte-level BPE in batched numpy merge rounds, and its decoding.

The symbols of many words lie in one flat array. In each round every word
merges all places of its own lowest-rank pair; the ranks of all neighbouring
pairs come from one binary search over the sorted pair keys. Words whose pairs
have no rank any more leave the array. This gives the ids of the usual
one-pair-at-a-time algorithm because a pair with a merged symbol in it always
ranks after the merge that made the symbol.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitframe.llm.common import process_cache, steps

#: The pre-tokenizer's pattern and special token, fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a Python worker keeps.
CACHED_PIECES = 250_000
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable letter of each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Model:
    """Vocabulary, sorted pair keys and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        every = vocab | self.special
        self.size = max(every.values()) + 1
        self.byte_id = np.array([vocab[c] for c in letters], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        raw = [b""] * self.size
        for token, i in every.items():
            known = all(c in value for c in token)
            raw[i] = bytes(value[c] for c in token) if known else token.encode()
        sizes = np.array([len(b) for b in raw], dtype=np.int64)
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_size, self.raw_start = sizes, np.cumsum(sizes) - sizes
        self.words = regex.compile(PATTERN)
        self.head: dict[str, bytes] = {}
        self.tail: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> Model:
        cache = process_cache("bpe")
        if path not in cache:
            cache[path] = Model(path)
        return cache[path]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as 32-bit integers; all words go through the rounds together."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_word, done_symbols = [], []
        while len(symbols):
            ranks = np.full(len(symbols), NONE, dtype=np.int32)
            inside = np.flatnonzero(word[1:] == word[:-1])
            ranks[inside] = self.rank(symbols[inside], symbols[inside + 1])
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            counts = np.diff(np.r_[first, len(word)])
            lowest = np.repeat(np.minimum.reduceat(ranks, first), counts)
            over = lowest == NONE
            done_word.append(word[over])
            done_symbols.append(symbols[over])
            hit = (ranks == lowest) & ~over
            # In a run such as a a a every second pair is taken, from the left.
            at = np.flatnonzero(hit)
            run = np.cumsum(np.r_[True, np.diff(at) > 1]) if len(at) else at
            begin = at[np.r_[True, np.diff(run) > 0]] if len(at) else at
            at = at[(at - begin[run - 1]) % 2 == 0] if len(at) else at
            symbols[at] = self.merged[ranks[at]]
            keep = ~over
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        word, symbols = np.concatenate(done_word or [word]), np.concatenate(done_symbols or [symbols])
        order = np.argsort(word, kind="stable")
        ends = 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        raw = symbols[order].astype("<i4").tobytes()
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _learn(self, pieces: set[str], space: str, into: dict[str, bytes]) -> None:
        """Cut pieces into words and merge all words that are new together."""
        rows = [self.words.findall(space + p) for p in pieces]
        words = list(set().union(*rows))
        ids = dict(zip(words, self.merge([w.encode() for w in words])))
        into.update((p, b"".join([ids[w] for w in row])) for p, row in zip(pieces, rows))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text; strings of special tokens in it give their id.

        A space before a character that is no white space always begins a
        word, so texts are cut there and each distinct piece is merged once.
        """
        import re

        if len(self.head) + len(self.tail) > CACHED_PIECES:
            self.head.clear()
            self.tail.clear()
        odd = re.compile("[\x1c-\x1f]")  # white space for Python alone
        double = re.compile(r" (?:\s|$)")
        cut = re.compile(r" (?=\S)")
        special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        plans = []
        for text in texts:
            parts = special.split(text) if special and special.search(text) else [text]
            plan = []
            for k, part in enumerate(parts):
                if k % 2:
                    plan.append(self.special[part])
                elif odd.search(part):
                    plan.append([part])
                elif part:
                    plan.append(cut.split(part) if double.search(part) else part.split(" "))
            plans.append(plan)
        rows = [row for plan in plans for row in plan if isinstance(row, list)]
        self._learn({row[0] for row in rows if row[0] not in self.head}, "", self.head)
        self._learn(set().union(*[row[1:] for row in rows]).difference(self.tail), " ", self.tail)
        tail = self.tail.__getitem__
        out = []
        for plan in plans:
            parts = []
            for row in plan:
                if isinstance(row, list):
                    parts.append(self.head[row[0]])
                    parts += map(tail, row[1:])
                else:
                    parts.append(np.array([row], dtype="<i4").tobytes())
            out.append(np.frombuffer(b"".join(parts), dtype="<i4"))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a row of ids; ids outside the vocabulary give none."""
        ids = ids[(ids >= 0) & (ids < self.size)]
        sizes = self.raw_size[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.raw_start[ids] - ends + sizes, sizes)
        return self.raw[at].tobytes()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(path)
        for batch in steps(batches, "_text"):
            rows = model.encode([t or "" for t in batch.column("_text").to_pylist()])
            ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
            values = np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), ids], ["_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(path)
        for batch in batches:
            column = batch.column("ids")
            texts = []
            for i in range(batch.num_rows):
                row = column[i]
                ids = row.values.to_numpy(zero_copy_only=False) if row.is_valid else None
                if ids is not None and ids.dtype.kind == "f":  # it holds NULLs, which give no bytes
                    ids = ids[~np.isnan(ids)].astype(np.int64)
                texts.append("" if ids is None else model.decode(ids).decode("utf-8", "replace"))
                if len(texts) == 512 or i + 1 == batch.num_rows:
                    at = batch.slice(i + 1 - len(texts), len(texts))
                    yield pa.RecordBatch.from_arrays(
                        [at.column("_id"), at.column("ids"), pa.array(texts, pa.string())], ["_id", "ids", "decoded"]
                    )
                    texts = []

    return run


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for every row: no shuffle, a row for each row.

    NULL and empty texts give an empty array; repeated rows stay. Whole texts
    are read, a few megabytes at a time. Columns besides the two are not
    looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_encode(tokenizer_path), f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded): text of each row of ``ids``, special tokens as text.

    Bytes that are no UTF-8 become the replacement character. NULL arrays and
    NULL ids give no text.
    """
    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("_id"), "ids")
    out = rows.mapInArrow(_decode(tokenizer_path), f"_id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("_id", id_col)
