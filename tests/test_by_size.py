"""Keys of bounded size go whole, larger ones by blocks; both give the same and the first is cheap."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitframe.functions import ordered
from visitframe.operators import codestats, ngrams, records, seqmodel, textsim


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def codes(spark):
    rng = random.Random(5)
    rows = [(s, v, p, rng.choice("abcd") if p else None) for s in (0, 1, 2, None) for v in (0, 1, 2, 4, None) for p in range(rng.randint(1, 5))]
    return spark.createDataFrame(rows, "seq long, visit_idx int, pos int, code string").cache()


def every(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("rows", [0, 40, 1000])
def test_prefix_of_mixed_keys(spark, monkeypatch, rows):
    monkeypatch.setattr(ordered, "WHOLE_ROWS", rows)
    sizes = {0: 100, 1: 41, 2: 3, None: 60}
    df = spark.createDataFrame([(k, i if i else None) for k, n in sizes.items() for i in range(n)], "k long, o long")
    blocked = df.withColumn("_block", ordered.block_of("o", 8))
    pick = F.when(F.col("o") % 7 == 0, F.col("o"))
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("k", "o", (F.row_number().over(w) - 1).alias("p"), F.min(pick).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("m"))
    for coarse in (True, False):
        got = ordered.position_in(blocked, ["k"], ["_block"], ["o"], "p", coarse)
        got = ordered.first_from_here(got, ["k"], ["_block"], ["o"], {"m": pick})
        assert every(got.select("k", "o", "p", "m")) == every(want)


def test_small_keys_take_one_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("k"), F.col("id").alias("o")).withColumn("_block", ordered.block_of("o", 8))
    got = ordered.position_in(df, ["k"], ["_block"], ["o"], "p")
    assert exchanges(got) == 1
    assert exchanges(got.groupBy("k", "_block").agg(F.max("p"))) == 1


def test_following_visits(spark, codes, monkeypatch):
    got = codestats.sequential_pairs(codes)
    # The records of a pair are counted where the pairs are made.
    assert exchanges(codestats.counted(got, codestats.PAIR)) == 2
    small = every(codestats.counted(got, codestats.PAIR))
    monkeypatch.setattr(ordered, "WHOLE_ROWS", 0)
    assert small == every(codestats.counted(codestats.sequential_pairs(codes), codestats.PAIR))
    a, b = codes.alias("a"), codes.alias("b")
    met = a.join(b, (F.col("a.seq") == F.col("b.seq")) & (F.col("a.visit_idx") + 1 == F.col("b.visit_idx")))
    want = met.groupBy(F.col("a.code").alias("first"), F.col("b.code").alias("second")).agg(F.count("*").alias("n"), F.count_distinct("a.seq").alias("records"))
    assert small == every(want)


def test_families_share_a_count(spark, codes):
    known = codes.where("code IS NOT NULL")
    visits = codes.select("seq", "visit_idx").distinct()
    together = every(codestats.code_statistics(known, visits, min_count=1))
    alone = [r for f in codestats.FAMILIES for r in every(codestats.code_statistics(known, visits, [f], min_count=1))]
    assert together == sorted(alone, key=str)


def test_families_compare_as_counted(spark, codes):
    known = codes.where("code IS NOT NULL")
    visits = codes.select("seq", "visit_idx").distinct()
    sides = [codestats.code_statistics(t.where(c), v.where(c)) for t, v, c in ((known, visits, "seq < 2"), (known, visits, "seq > 0"))]
    want = codestats.compare_code_stats(*sides)
    got = codestats.compare_code_stats(*sides, families=codestats.FAMILIES)
    def near(df):
        rounded = [F.round(c, 9).alias(c) for c in ("r2", "r2_rare")]
        return every(df.select("family", "n_keys", *rounded))

    assert near(got) == near(want)
    one = [codestats.code_statistics(known.where(c), visits.where(c), ["visit_pair", "record_pair"]) for c in ("seq < 2", "seq > 0")]
    by_family = codestats.compare_code_stats(*one, families=["visit_pair", "record_pair"])
    plan = by_family._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(family" in x and "k1" in x]


def test_texts_by_blocks(spark, monkeypatch):
    rng = random.Random(7)
    cohorts = {
        name: spark.createDataFrame([(s, p, rng.randint(8, 14)) for s in range(n) for p in range(rng.randint(2, 30))], "seq long, pos long, token_id int").cache()
        for name, n in (("a", 5), ("b", 4))
    }
    whole = textsim.SequenceTexts(cohorts, width=4)
    found = every(textsim.text_report(whole))
    counted = whole.hits
    monkeypatch.setattr(ordered, "WHOLE_ROWS", 0)
    split = textsim.SequenceTexts(cohorts, width=4)
    assert every(split.hits) == every(counted)
    assert [r[:2] for r in every(textsim.text_report(split))] == [r[:2] for r in found]


@pytest.fixture(scope="module")
def split_tokens(spark):
    rng = random.Random(11)
    rows = [(s, p, rng.randint(1, 6), rng.choice("tvs")) for s in range(60) for p in range(rng.randint(1, 12))]
    split = {s: x for s, p, _, x in rows if p == 0}
    return spark.createDataFrame([(s, p, t, split[s]) for s, p, t, _ in rows], "seq long, pos long, token_id int, split string").cache()


def test_splits_are_scored_in_one_pass(spark, split_tokens):
    rest = split_tokens.where("split <> 't'")
    train = split_tokens.where("split = 't'")
    model = seqmodel.fit_sequence_model(train)
    soft = spark.createDataFrame([(t, t + d, w) for t in range(1, 6) for d, w in ((0, 0.7), (1, 0.3))], "token_id int, target_id int, weight double")
    fitted = seqmodel.lookahead_model(train, 2)
    scored = {
        "perplexity": lambda rows, **by: seqmodel.perplexity(model, rows, 6, **by),
        "soft": lambda rows, **by: seqmodel.soft_perplexity(model, rows, soft, 6, **by),
        "ahead": lambda rows, **by: seqmodel.lookahead_perplexity(fitted, rows, 2, 6, **by),
    }
    for score in scored.values():
        together = score(rest, by=["split"])
        rounded = [F.round(c, 9).alias(c) if c == "perplexity" else c for c in together.columns]
        alone = [score(rest.where(F.col("split") == s)).withColumn("split", F.lit(s)) for s in "vs"]
        assert every(together.select(rounded)) == every(alone[0].unionByName(alone[1]).select(rounded))
    counts = seqmodel.context_counts(split_tokens, 2, ["split"])
    assert every(seqmodel.fit_sequence_model(counts.where("split = 't'"))) == every(model)
    near = [F.round("perplexity", 9)]
    assert every(scored["perplexity"](counts.where("split = 'v'")).select(near)) == every(scored["perplexity"](rest.where("split = 'v'")).select(near))


def test_perplexity_of_lookahead(spark, split_tokens):
    """Log shares split into hits and totals give what a plain loop gives, unknown tokens included."""
    seqs = {}
    for s, _, t, x in sorted(map(tuple, split_tokens.collect())):
        seqs.setdefault((x, s), []).append(t if x == "t" else t + (s % 5 == 0))
    rows = [(s, p, t, x) for (x, s), ts in seqs.items() for p, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "seq long, pos long, token_id int, split string")
    fitted = seqmodel.lookahead_model(df.where("split = 't'"), 2)
    got = {(r["split"], r["ahead"]): r["perplexity"] for r in seqmodel.lookahead_perplexity(fitted, df, 2, 8, by=["split"]).collect()}
    pairs = [(x, j, ts[p], ts[p + j]) for (x, _), ts in seqs.items() for j in (1, 2) for p in range(len(ts) - j)]
    for x, j in got:
        known = [(a, b) for y, i, a, b in pairs if (y, i) == ("t", j)]
        logs = [math.log((known.count((a, b)) + 1) / (sum(c == a for c, _ in known) + 8)) for y, i, a, b in pairs if (y, i) == (x, j)]
        assert got[x, j] == pytest.approx(math.exp(-sum(logs) / len(logs)))
    assert len(got) == 6


@pytest.mark.parametrize("pad", [None, 3])
def test_cohorts_in_one_table(spark, split_tokens, pad):
    by_name = {s: split_tokens.where(F.col("split") == s) for s in "tvs"}
    want = ngrams.ngram_report(by_name, [("t", "v"), ("t", "s")], (1, 2, 3), pad)
    got = ngrams.ngram_report(split_tokens.withColumnRenamed("split", "cohort"), [("t", "v"), ("t", "s")], (1, 2, 3), pad)
    rounded = ["pair", "order", *[F.round(c, 9) for c in ngrams.METRICS]]
    assert every(got.select(rounded)) == every(want.select(rounded))


def test_dealt_tokens_are_not_dealt_again(spark, split_tokens):
    lie = split_tokens.repartition("seq")
    runs = ngrams.ngram_report(lie.withColumnRenamed("split", "cohort"), [("t", "v")], (1, 2))
    assert runs.count() == 2
    assert exchanges(seqmodel._contexts(lie, 2, ["split"])) == 1
    assert exchanges(seqmodel.lookahead_model(lie, 2, by=["split"]).drop("p")) == 2


def test_features_are_dealt_before_their_levels(spark, monkeypatch):
    monkeypatch.setattr(records, "SALT_ROWS", 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(3)
        cells = [("t", r, v, f"c{rng.randint(0, 9)}") for r in range(40) for v in range(rng.randint(1, 9)) for _ in range(2)]
        codes = spark.createDataFrame(cells, "part string, rid long, visit_idx int, code string")
        visits = codes.select("part", "rid", "visit_idx").distinct()
        labels = codes.select("part", "rid").distinct().withColumn("labels", F.array(F.lit(0)))
        s = records.record_set(codes, visits, labels)
        posted = records.postings(s, s, records.without_common(s, s, 100.0))
        def plan(df):
            return df._jdf.queryExecution().executedPlan().toString().splitlines()

        def dealt_by(df, *names):
            return [x for x in plan(df) if "Exchange hashpartitioning" in x and all(n in x.split("), ENSURE")[0] for n in names)]

        # Levels are told where the features of a record lie.
        assert not dealt_by(posted, "rec#", "level#")
        # Both sides of the candidates are dealt once, salted or not.
        assert len(dealt_by(records.candidates(s, posted), "visit_idx#", "level#")) == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
