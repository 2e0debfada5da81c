"""Language identification by rank-order profiles.

A profile is a list of a language's most frequent character n-grams. A
document's own list is compared with each profile: the *out-of-place* distance
adds, for each n-gram of the document's list, how far its rank is from the
rank in the profile, or the profile's length if it is not in there.

Letters are lower-cased, other characters end a word, and words stand between
boundary marks, so ``a`` gives the n-grams ``_a`` and ``a_`` besides ``a``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitframe.llm.common import process_cache, steps

#: n-grams of one to ORDER characters; so many of them make a profile.
ORDER, LENGTH = 3, 300
#: Bound of the training sample: texts per language, those of the lowest hash.
SAMPLE = 500
BITS = 21  # of a code point
NO_LETTER = "und"


def lower_letters() -> np.ndarray:
    """For each code point its lower-case letter, 0 for all that is no letter."""
    cache = process_cache("lower_letters")
    if "table" in cache:
        return cache["table"]
    out = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    cache["table"] = out
    return out


def grams(text: str) -> np.ndarray:
    """All n-grams of a text as integers, in no order; 1 is the boundary."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = lower_letters()[points]
    letter = letters > 0
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    # One boundary between words, one at each end.
    keep = letter | np.r_[True, letter[:-1]]
    line = np.where(letter, letters, 1)[keep]
    line = np.r_[line[:1] if line[0] == 1 else [1, line[0]], line[1:]]
    line = line if line[-1] == 1 else np.r_[line, 1]
    out = [line[line > 1]]
    code = line
    for n in range(2, ORDER + 1):
        code = (code[:-1] << BITS) | line[n - 1 :]
        inner = np.ones(len(code), dtype=bool)  # a boundary only at the ends
        for k in range(1, n - 1):
            inner &= line[k : k + len(code)] > 1
        out.append(code[inner])
    return np.concatenate(out)


def profile(codes: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams, first the most frequent; ties by code."""
    values, counts = np.unique(codes, return_counts=True)
    if len(values) > length:
        cut = np.partition(counts, len(counts) - length)[len(counts) - length]
        values, counts = values[counts >= cut], counts[counts >= cut]
    return values[np.lexsort((values, -counts))][:length]


class Ranker:
    """The profiles as one sorted table of (n-gram, language, rank)."""

    def __init__(self, langs: list[str], profiles: list[np.ndarray], length: int):
        self.langs, self.length = langs, length
        self.known = np.unique(np.concatenate(profiles))
        self.ranks = np.full((len(self.known), len(langs)), -1, dtype=np.int64)
        for k, p in enumerate(profiles):
            self.ranks[np.searchsorted(self.known, p), k] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = profile(grams(text), self.length) if text else np.empty(0, dtype=np.int64)
        if not len(own):
            return NO_LETTER, 0.0
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        ranks = np.where((self.known[at] == own)[:, None], self.ranks[at], -1)
        places = np.arange(len(own))[:, None]
        distance = np.where(ranks < 0, self.length, np.abs(ranks - places)).sum(axis=0)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (self.length * len(own)))


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
    length: int = LENGTH,
) -> Ranker | None:
    """Profiles of the languages of ``docs``; None if there is no labelled text.

    Rows with a NULL label or a text without letters teach nothing. At most
    ``sample`` rows per language teach: those whose hash of id and text is
    lowest (modulo 2**40 below a bound, then by itself), so the choice does not depend on the
    order of rows. What comes to the driver is one profile of ``length``
    n-grams per language.
    """
    letters = F.col("_text").rlike(r"\p{L}")
    rows = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col).alias("_h"))
    rows = rows.where(F.col("lang").isNotNull() & letters)
    # Hashes below a bound that leaves about four times the sample of each language: one number
    # per language comes to the driver, and no task ranks more than those rows.
    totals = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not totals:
        return None
    bound = F.create_map(*[F.lit(v) for r in totals for v in (r["lang"], min(1.0, 4 * sample / r["n"]))])
    rows = rows.where(F.pmod("_h", F.lit(1 << 40)) / float(1 << 40) < bound[F.col("lang")])
    order = Window.partitionBy("lang").orderBy("_h", "_text")
    chosen = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= sample)

    def learn(key, frame):
        import pandas as pd

        code = np.concatenate([grams(t) for t in frame["_text"]])
        return pd.DataFrame({"lang": [key[0]], "grams": [profile(code, length).tolist()]})

    learned = chosen.groupBy("lang").applyInPandas(learn, "lang string, grams array<long>").collect()
    learned = sorted((r["lang"], np.array(r["grams"], dtype=np.int64)) for r in learned)
    return Ranker([k for k, _ in learned], [g for _, g in learned], length) if learned else None


def _predict(ranker: Ranker | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "_text"):
            texts = batch.column("_text").to_pylist()
            found = [ranker.predict(t) if ranker else (NO_LETTER, 0.0) for t in texts]
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*names, "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, ranker: Ranker | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``lang_pred`` and ``score`` for each row; no shuffle.

    The score is 1 at distance 0 and 0 if no n-gram is known. A NULL text, or
    one without a letter, is ``und`` with score 0; so is every text if nothing
    was learned. Equal distances go to the language first in the alphabet.
    """
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    kinds = ", ".join(f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = rows.mapInArrow(_predict(ranker), f"{kinds}{', ' if kinds else ''}lang_pred string, score double")
    return out.withColumnsRenamed({f"_k{i}": c for i, c in enumerate(keep)})
