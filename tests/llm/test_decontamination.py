"""Benchmark items in documents against a plain search of all windows."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from visitframe.llm import decontam
from visitframe.llm.queries import QUERIES


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def best(doc, item):
    """(similarity, start) of the best item-sized window."""
    d, want = words(doc), shingles(words(item))
    n = min(len(words(item)), len(d))
    found = (0.0, 0)
    for s in range(max(1, len(d) - n + 1)):
        own = shingles(d[s : s + n])
        low, high = sum((own & want).values()), sum((own | want).values())
        if high and low / high > found[0] + 1e-12:
            found = (low / high, s)
    return found


def prose(rng, n):
    return " ".join(rng.choice("abcdefghij") + rng.choice("klmno") + str(rng.randint(0, 99)) for _ in range(n))


def cases():
    rng = random.Random(7)
    items = [prose(rng, n) for n in (14, 20, 36, 59, 59)] + ["too short here", "", None, "ab ab ab ab ab ab ab ab ab ab ab ab"]
    items.append(items[1])  # a copy of an item
    docs = [None, "", "short", prose(rng, 500)]
    for item in items[:5]:
        w = item.split(" ")
        edits = [w, w[1:], w[:-1], w[: len(w) // 2], [*w[:2], "new", *w[3:]], [*w[:-2], *w[-1:]], [x.upper() + "," for x in w], w[: len(w) // 2] + ["new"] + w[len(w) // 2 :]]
        for e in edits:
            docs.append(f"{prose(rng, rng.randint(0, 40))} {' '.join(e)} {prose(rng, rng.randint(0, 40))}")
        docs.append(item)
        docs.append(" ".join(w[:-1]))
    docs.append(" ".join(items[:5]))
    docs.append("x " + items[8] + " ab ab y")
    docs.append(prose(rng, 40_000) + " " + items[2])
    return docs, items


def test_all_items_are_found_and_nothing_else(spark):
    docs, items = cases()
    d = spark.createDataFrame(list(enumerate(docs)) + [(4, docs[3]), (None, items[0])], "doc_id long, text string").withColumn("item_id", F.lit("x"))
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = {}
    for r in decontam.contaminated(d, i).collect():
        got[r["doc_id"], r["item_id"]] = (round(r["similarity"], 9), r["start"])
    want = {}
    for a, doc in [*enumerate(docs), (None, items[0])]:
        for b, item in enumerate(items):
            s, start = best(doc, item)
            if s >= 0.8 - 1e-9:
                want[a, b] = (round(s, 9), start)
    assert got == want
    kept = decontam.decontaminate(d, i)
    assert kept.columns == d.columns
    hit = {a for a, _ in want}
    left = [r["doc_id"] for r in kept.collect()]
    assert sorted(left, key=str) == sorted([a for a in range(len(docs)) if a not in hit] + [4], key=str)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, prose(random.Random(0), 20))], "item_id long, text string")
    docs = items.withColumnRenamed("item_id", "doc_id")
    assert decontam.contaminated(none, items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.decontaminate(docs, items.limit(0)).count() == 1


def test_fingerprint_is_the_majority_of_bits(spark):
    rng = random.Random(9)
    rows = [([rng.randrange(-(2**63), 2**63) for _ in range(n)],) for n in (1, 2, 3, 40)]
    for r in spark.createDataFrame(rows, "h array<long>").select("h", decontam.fingerprint(F.col("h")).alias("f")).collect():
        want = sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in r["h"]) > len(r["h"]))
        assert r["f"] % 2**64 == want


def test_every_key_within_three_bits_is_a_neighbour(spark):
    row = spark.range(1).select(decontam.neighbours(F.lit(12345).cast("long")).alias("n")).first()["n"]
    assert set(row) == {k for k in range(1 << 16) if (k ^ 12345).bit_count() <= 3}


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op6_decontamination"](spark, folder).collect()}
    want = set()
    for b, item in items.items():
        known = set(shingles(words(item)))
        for a, doc in docs.items():
            if len(known & set(shingles(words(doc)))) >= 0.8 * len(known) and best(doc, item)[0] >= 0.8:
                want.add((a, b))
    assert got == want
