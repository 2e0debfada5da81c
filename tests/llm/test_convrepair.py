"""Conversation repair against an exhaustive dynamic program over whole conversations."""

import hashlib
import random
import re
import zlib

import pytest

from visitframe.llm import convrepair as cr
from visitframe.llm.queries import QUERIES

LEAST = {"K": 0, "R": 2, "D": 3, "I": 2}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        if not bare:
            out.append(1)
        elif (role, text) in seen:
            out.append(2)
        else:
            out.append(0 if bare[-1] in ".!?" else 3)
            seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, repaired) by trying all edits row by row, best string per state kept.

    Kept prefixes are compared by (cost, audit); no cheapest audit is a prefix
    of another one, so the least prefix of a state is part of the least whole.
    """
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    add = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, rows_) in list(best.items()):
                to = add[state]
                new = (cost + 2, audit + "I", rows_ + [(name[to], "")])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = inserted({"": (0, "", [])})
    for (role, text), fault in zip(rows, faults(rows)):
        after = {}
        for state, (cost, audit, done) in best.items():
            options = [(state, (cost + 3, audit + "D", done))]
            if fault not in (1, 2):
                extra = fault == 3
                kept = step[state].get(role[:1])
                if kept:
                    options.append((kept, (cost + extra, audit + "K", done + [(role, text)])))
                to = add[state]
                options.append((to, (cost + 2 + extra, audit + "R", done + [(name[to], text)])))
            for to, new in options:
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        best = inserted(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])


def expected(rows):
    """All facts of one conversation's rows (turn, role, text), in order."""
    plain = [(r, t) for _, r, t in rows]
    cost, audit, repaired = cheapest(plain)
    turns = {t for t, _, _ in rows if t is not None}
    told = faults(plain)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return (gaps, told.count(1), told.count(2), told.count(3), illegal, cost, audit, digest)


def random_rows(rng, n, letters=("user", "assistant", "system", "tool", "", "u")):
    texts = ["", " \t", "Yes.", "no", "What?", "a. b", "Hm! \n", ".", "\x0b", "\x1c", "x" * 50]
    out, turn = [], 0
    for _ in range(n):
        turn += rng.choice([1, 1, 1, 2])
        role = rng.choice(letters[:2]) if rng.random() < 0.8 else rng.choice(letters)
        text = rng.choice(texts) if rng.random() < 0.4 else f"line {rng.randrange(2 * n)}" + rng.choice([".", "!", ""])
        out.append((turn, role, text))
    return out


def test_auction_on_small_lattices():
    rng = random.Random(1)
    for _ in range(600):
        rows = random_rows(rng, rng.randint(1, 9))
        plain = [(r, t) for _, r, t in rows]
        codes = bytes(4 * ("sua".find(r[0]) % 4 if r else 3) + f for (r, _), f in zip(plain, faults(plain)))
        prices = cr.auction(codes, list(cr.END))
        pieces, state = cr.trace(codes, prices, 0)
        cr.finish(pieces, state)
        cost, audit, _ = cheapest(plain)
        assert (prices[0][0], re.sub("[ua]", "", "".join(pieces))) == (cost, audit)


def summary(spark, tables, partitions):
    rows = [(c, *r, "x") for c, rs in tables.items() for r in rs]
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = cr.summary(cr.repair(frame), frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


@pytest.mark.parametrize(("block", "batch"), [(1, 10_000), (3, 2), (64, 7), (64, 10_000)])
def test_conversations_over_blocks_partitions_and_batches(spark, block, batch, monkeypatch):
    monkeypatch.setattr(cr, "BLOCK_ROWS", block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rng = random.Random(block)
    tables = {c: random_rows(rng, rng.choice([1, 2, 5, 8, 20])) for c in range(40)} | {99: random_rows(rng, 300), None: random_rows(rng, 7)}
    try:
        got = summary(spark, tables, 7)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {c: expected(rows) for c, rows in tables.items()}


def test_one_hot_conversation_of_equal_rows(spark):
    tables = {1: [(None, "user", "same.")] * 500 + [(0, "assistant", "Same."), (0, "assistant", "Same.")], 2: [(1, "user", "hi.")]}
    assert summary(spark, tables, 6) == {c: expected(rows) for c, rows in tables.items()}


def test_rows_of_the_repair(spark):
    rows = [(1, 1, "assistant", "Hello.", 9), (1, 2, "user", "and", 9), (1, 4, "user", "and", 9), (2, None, None, None, 9)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, k int")
    got = [(r["conv"], r["edit"], r["fault"], r["role"], r["text"]) for r in cr.repair(frame).orderBy("conv", "part", "at", "k").collect()]
    # Keeping the truncated row and answering it costs 8 as well, but its audit is IKKDI.
    assert got == [
        (1, "I", None, "user", ""), (1, "K", 0, "assistant", "Hello."), (1, "D", 3, None, None), (1, "D", 2, None, None),
        (2, "D", 1, None, None),
    ]


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.summary(cr.repair(cr.damaged(none)), none).count() == 0


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [(turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query(spark, folder):
    path = f"/root/testdata/{folder}"
    by_conv = {}
    for r in spark.read.parquet(f"{path}/conversations.parquet").collect():
        by_conv.setdefault(r["conv_id"], []).append(tuple(r))
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, path).collect()}
    assert got == {c: expected(damaged(rows)) for c, rows in by_conv.items()}


def test_damage_of_nulls(spark):
    rows = [(c, t, r, x) for c in (None, 1, 5) for t in (None, 1, 2, 3) for r in (None, "user") for x in (None, "a.b!")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(str, ((r["turn"], r["role"], r["text"]) for r in cr.damaged(frame).collect())))
    assert got == sorted(map(str, damaged(rows)))
