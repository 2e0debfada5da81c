"""Words one edit apart against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from visitframe.llm import variants
from visitframe.llm.queries import QUERIES

LOWER = str.maketrans(variants.UPPER, variants.LOWER)


def edits(word, letters):
    """Every string one edit away."""
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
            if i < len(word) and c != word[i]:
                yield word[:i] + c + word[i + 1 :]
        if i < len(word):
            yield word[:i] + word[i + 1 :]


def plain(counts):
    """{word: (form, root, n, n_near, form_n)} by trying every edit."""
    letters = sorted({c for w in counts for c in w})
    near = {w: {e for e in edits(w, letters) if e in counts} - {w} for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def collected(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("letters", ["ab", "abc", "aé中🙂"])
def test_groups_are_those_of_brute_force(spark, letters):
    rng = random.Random(4)
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(5, 9))): rng.choice([3, 4, 6, 12, 50, 400]) for _ in range(300)}
    rows = [(w, n, "x", 1) for w, n in counts.items()]
    words = spark.createDataFrame(rows, "word string, n long, root string, key int").repartition(3)
    assert collected(variants.group(words)) == plain(counts)


def test_pairs_come_once(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 8))) for _ in range(200)}
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = [frozenset((r["word"], r["other"])) for r in variants.near_pairs(table).collect()]
    want = {frozenset((w, e)) for w in words for e in edits(w, "ab") if e in words and e != w}
    assert len(got) == len(set(got)) and set(got) == want


def test_tables_of_words_are_not_broadcast(spark):
    table = variants.written(spark.createDataFrame([("abcde", 3), ("abcdf", 9)], "word string, n long"))
    pairs = variants.near_pairs(table)
    assert pairs.count() == 1
    out = variants.group(table)
    assert out.count() == 2
    for df in (pairs, out):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_chains_and_partial_counts(spark):
    chain = ["".join("b" if j < k else "a" for j in range(40)) for k in range(40)]
    rows = [(w, 2**k, None) for k, w in enumerate(chain)] + [(chain[39], 2**39, None), (None, 4, None), ("abc", 9, None), ("", 2, None)]
    got = collected(variants.group(spark.createDataFrame(rows, "word string, n long, other string")))
    assert {w: r[1] for w, r in got.items()} == dict.fromkeys(chain, chain[39])
    assert got[chain[39]][2] == 2**40 and got[chain[5]][0] == chain[6]


def test_ties_go_to_the_smallest_word(spark):
    rows = [("abcde", 3), ("abcdé", 9), ("abcdf", 9), ("xbcde", 5)]
    got = collected(variants.group(spark.createDataFrame(rows, "word string, n long")))
    assert got["abcde"][0] == "abcdf" and got["xbcde"][0] is None


def test_empty_tables(spark):
    assert variants.group(spark.createDataFrame([], "word string, n long")).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "1 2 3")], "doc_id long, text string")
    assert variants.word_counts(variants.runs(docs).select(F_run())).count() == 0


def F_run():
    from pyspark.sql import functions as F

    return F.col("run").alias("word")


def by_hand(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert collected(QUERIES["op11_spelling_variants"](spark, folder)) == plain(by_hand(docs))


def test_odd_texts(spark):
    from pyspark.sql import functions as F

    docs = [(None, "ÀÉÎ straße STRASSE ×÷ Größe größe GRÖSSE 中文 naïve Ünder Ünder" * 3), (5, "WORD " * 50_000), (5, "Words"), (6, None), (7, "İstanbul K"), (8, "ÀBCDE àBCDE ÀBCDE ÀBCDE")]
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, run string")
    words = variants.runs(table).select(variants.misspelt(F.col("doc"), F.col("run")).alias("word"))
    assert {r["word"]: r["n"] for r in variants.word_counts(words).collect()} == by_hand(docs)
