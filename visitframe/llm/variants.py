"""Spelling variants: words one edit apart, by asymmetric chunks and grams.

Of two words the shorter (or, at one length, either) contributes two disjoint
*chunks*, its front and its back half, the other its positional *grams* of the
same lengths. One edit falls into one half, so the other half is found again in
the other word: the front half at its place, the back half shifted by the
difference of the lengths, which is none or one. Grams at other places can
join with no chunk and are not formed.

A half alone would gather large groups (all words in ``-ungen``). The edited
half is therefore cut in two once more: one edit leaves its front or its back
quarter as it was. A join key is an intact half with an intact quarter of the
other one, some three quarters of the word, and every pair one edit apart
shares at least one of four such keys:

=====  ==========================  ================
key    intact half                 and of the rest
=====  ==========================  ================
0      front                       its front
1      front                       its back
2      back                        its front
3      back                        its back
=====  ==========================  ================

Candidates of equal keys are verified by edit distance. A pair is taken at the
lowest of its keys alone, so no pair comes twice and nothing has to be removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitframe.llm.common import written

#: Runs of letters; only A-Z get a lower case.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The least word length. Both halves of a word have two code points at least, as the keys need.
MIN_LENGTH = 5
MIN_COUNT = 3
#: A form occurs so many times as often as its variant.
TIMES = 2


def lowered(run: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    ascii_only = F.octet_length(run) == F.char_length(run)
    return F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, run): every maximal run of letters of whole texts, in lower case. NULL texts have none."""
    found = docs.select(
        F.col(id_col).alias("doc"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run")
    )
    return found.select("doc", lowered(F.col("run")).alias("run"))


def misspelt(doc: Column, run: Column, one_in: int = 97) -> Column:
    """Drop one code point of every ``one_in``-th run, chosen by the checksum of ``doc:run``.

    A NULL document id counts as an empty one.
    """
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    less = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    return F.when(h % one_in == 0, less).otherwise(run)


def word_counts(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words (column ``word``) that are long and frequent enough; counted map-side."""
    long = words.where(F.char_length("word") >= min_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _keys(word: Column, length: Column) -> Column:
    """The four keys of ``word`` as a partner of chunk words of ``length``: its own length or one less.

    Front pieces are counted from the front of the word, back pieces from its
    end, so a word that is one longer gives its grams at the shifted places.
    """
    size = F.char_length(word)
    half = F.floor(length / 2).cast("int")
    back = length - half
    half_front, back_front = F.floor(half / 2).cast("int"), F.floor(back / 2).cast("int")
    half_back, back_back = half - half_front, back - back_front

    def piece(begin: Column, length: Column) -> Column:
        return F.substr(word, begin, length)

    one = F.lit(1)
    front, tail = piece(one, half), piece(size - back + 1, back)
    pairs = [
        (front, piece(half + 1, back_front)),
        (front, piece(size - back_back + 1, back_back)),
        (tail, piece(one, half_front)),
        (tail, piece(size - back - half_back + 1, half_back)),
    ]
    return F.array(*[F.xxhash64(F.lit(k), length, a, b) for k, (a, b) in enumerate(pairs)])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of words that one edit tells apart, once.

    ``words`` (word, n) are distinct and have ``MIN_LENGTH`` code points at
    least. Both sides are shuffled by key: four rows of a word as the chunk
    side, eight as the gram side (for words of its length and one less). Spark
    sizes them by the table before the explode and would broadcast them.
    """
    a, b = F.col("word"), F.col("other")
    la, lb = F.char_length(a), F.char_length(b)
    none = F.array().cast("array<bigint>")
    chunks = words.select("word", "n", F.posexplode(_keys(a, la)).alias("kind", "key"))
    sides = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    grams = sides.select("*", F.explode(F.concat(_keys(b, lb), F.when(lb > MIN_LENGTH, _keys(b, lb - 1)).otherwise(none))).alias("key"))
    once = (la < lb) | ((la == lb) & (a < b))
    near = once & (lb - la <= 1) & (F.levenshtein(a, b, 1) == 1)
    shared = F.zip_with(_keys(a, la), _keys(b, la), lambda x, y: x == y)
    lowest = F.array_position(shared, True) - 1
    return chunks.join(grams.hint("merge"), "key").where(near & (F.col("kind") == lowest)).select("word", "n", "other", "other_n")


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n) for every word; one shuffle of both tables.

    ``form`` is the near word of largest ``n`` (ties: the smallest in
    code-point order) if it occurs ``times`` times as often, else NULL.
    """
    other = F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))
    both = F.array(
        F.struct("word", "n", other.alias("o")),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.struct((-F.col("n")).alias("m"), F.col("word").alias("w")).alias("o")),
    )
    nothing = F.lit(None).cast("struct<m:bigint,w:string>")
    rows = words.select("word", "n", nothing.alias("o")).unionByName(pairs.select(F.inline(both)))
    found = rows.groupBy("word").agg(F.max("n").alias("n"), F.count("o").alias("n_near"), F.min("o").alias("o"))
    enough = -F.col("o.m") >= times * F.col("n")
    return found.select(
        "word", "n", "n_near", F.when(enough, F.col("o.w")).alias("form"), F.when(enough, -F.col("o.m")).alias("form_n")
    )


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: the last word when forms are followed.

    Jumps double in length each round, and a form occurs at least twice as
    often as its word, so a chain has no cycle and some six rounds reach any
    end. Each round is written; one count comes to the driver.
    """
    jumps = written(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "jumps")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = jumps.join(ahead.hint("merge"), "root", "left")  # written words are larger than their files
        jumps = written(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jumps")
        if jumps.where("moved").isEmpty():
            return jumps.select("word", "root")
        jumps = jumps.select("word", "root")


def group(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct words.

    Words with NULL or of fewer than ``MIN_LENGTH`` code points take no part;
    repeated words are added up first, so the table may hold partial counts.
    Further columns are not looked at. Equal counts are told apart by the
    word in code-point order. An empty table gives none.
    """
    whole = counts.where(F.char_length("word") >= MIN_LENGTH).groupBy("word").agg(F.sum("n").alias("n"))
    words = written(whole, "words")
    found = written(forms(words, near_pairs(words), times), "forms")
    last = roots(found)
    out = found.join(last.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
