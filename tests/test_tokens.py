"""Token goldens, the detokenizer's rules, and round trips."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visitframe.functions import ordered
from visitframe.operators import tokens, vocab
from visitframe.schema import FIXED_EDGES


@pytest.fixture(scope="module")
def meta(spark):
    codes = spark.createDataFrame(
        [(i, "icd", f"icd_{i}", 9) for i in range(10)], "code_id int, sys string, code string, n long"
    )
    levels = spark.createDataFrame([("c", "yes", 0)], "var string, text string, value int")
    variables = [
        vocab.Variable("x", 0, "ts", 5, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]),
        vocab.Variable("Age", 1, "covar", 15, [float(e) for e in FIXED_EDGES["Age"]]),
        vocab.Variable("Gender", 2, "covar", 2),
        vocab.Variable("Hours", 3, "timestamp", 15, [float(e) for e in FIXED_EDGES["Hours"]]),
    ]
    return vocab.Metadata(codes, levels, variables, ["a", "b", "c", "d"], 10)


def ids(meta, words):
    starts = meta.starts()
    out = []
    for w in words.split():
        if w.startswith("<"):
            out.append(meta.special(w))
            continue
        kind, value = w[:-1], int(w[-1])
        first = {"code": 0, "ts": starts[("ts", 0)], "gap": starts[("timestamp", 3)], "age": starts[("covar", 1)],
                 "gender": starts[("covar", 2)], "phe": starts[("phe", -1)], "ihm": starts[("ihm", -1)]}[kind]
        out.append(first + value)
    return out


def table(spark, sequences):
    rows = [(s, p, t) for s, seq in enumerate(sequences) for p, t in enumerate(seq)]
    return spark.createDataFrame(rows, "seq long, pos long, token_id int")


def decode(spark, meta, words, width=4096):
    stays, events = tokens.detokenize(table(spark, [ids(meta, words)]), meta, width)
    s = {r["stay_idx"]: r for r in stays.collect()}
    out = {i: {"code": [], "phe": set(), "ts": [], "covar": [], "ihm": s[i]["label_ihm"]} for i in s}
    for e in events.orderBy("a", "b").collect():
        slot = out[e["stay_idx"]]
        if e["kind"] == "phe":
            slot["phe"].add(e["value"])
        else:
            slot["ts" if e["kind"] == "timestamp" else e["kind"]].append(e["value"])
    return [out[i] for i in sorted(out)]


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_detokenize_rules(spark, meta, width):
    def codes(words):
        return [s["code"] for s in decode(spark, meta, words, width)]

    assert codes("<s> code5 </code> </adm>") == [[5], []]
    assert codes("<s> code5 code6 </adm> code7 </code> </adm> </s>") == [[], [5, 6, 7]]
    assert codes("<s> code5 </code> code6 </code> </adm> </s>") == [[6]]
    assert codes("<s> code5 </code> </code> </adm> </s> code7 </code> </adm>") == [[]]
    got = decode(spark, meta, "<s> ihm1 </label> phe3 </label> </adm> </s>", width)
    assert got[0]["phe"] == {3} and got[0]["ihm"] == 0
    got = decode(spark, meta, "<s> ts1 </adm> ts2 gap4 ts3 </ts> </adm> </s>", width)
    assert [g["ts"] for g in got] == [[], [1, 2, 4]]


def test_unknown_token_raises(spark, meta):
    with pytest.raises(Exception, match="unknown token"):
        tokens.detokenize(table(spark, [[9999]]), meta)[1].collect()


def test_completion(spark, meta):
    df = table(spark, [ids(meta, "<s> </s>"), ids(meta, "<s> code1")])
    assert tuple(tokens.completion_report(df, meta).first()) == (1, 1)


stay = st.fixed_dictionaries(
    {
        "covars": st.tuples(st.integers(0, 9), st.integers(0, 1)),
        "ihm": st.integers(0, 1),
        "phe": st.sets(st.integers(0, 3)),
        "codes": st.lists(st.integers(0, 9), max_size=5),
        "rows": st.lists(st.tuples(st.lists(st.integers(0, 4), min_size=1, max_size=3), st.integers(0, 9)), max_size=4),
    }
)


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
@given(patients=st.lists(st.lists(stay, min_size=1, max_size=3), min_size=1, max_size=3))
def test_round_trip(spark, meta, patients):
    events, stays = [], []
    for sid, patient in enumerate(patients):
        for i, s in enumerate(patient):
            stays.append((sid, i))
            events += [(sid, i, 1, 0, 0, "covar", 1, s["covars"][0]), (sid, i, 1, 0, 1, "covar", 2, s["covars"][1])]
            events.append((sid, i, 3, 0, 0, "ihm", -1, s["ihm"]))
            events += [(sid, i, 3, 0, v + 1, "phe", -1, v) for v in s["phe"]]
            events += [(sid, i, 5, k, 0, "code", -1, c) for k, c in enumerate(s["codes"])]
            for k, (cells, gap) in enumerate(s["rows"]):
                events += [(sid, i, 7, k, b, "ts", 0, v) for b, v in enumerate(cells)]
                events.append((sid, i, 7, k, 1_000_000, "timestamp", 3, gap))
    ev = spark.createDataFrame(events, "sid long, stay_idx int, section int, a long, b int, kind string, var_id int, value int")
    ss = spark.createDataFrame(stays, "sid long, stay_idx int")
    first = tokens.tokenize(ev, ss, meta, width=2)
    back = tokens.events_as_input(*tokens.detokenize(first, meta, width=3))
    again = tokens.tokenize(*back, meta)
    def rows(df):
        return sorted(map(tuple, df.select("seq", "pos", "token_id").collect()))

    assert rows(first) == rows(again)
    shuffled = tokens.tokenize(ev, ss, meta, label_shuffle=True, ts_shuffle=True, seed=5)
    assert sorted(r[2] for r in rows(shuffled)) == sorted(r[2] for r in rows(first))


def test_mask_rate_and_targets(spark, meta):
    df = spark.range(20000).select(F.col("id").alias("seq"), F.lit(0).alias("pos"), F.lit(5).alias("token_id"))
    masked = tokens.mask(df, 99, 0.5, 1).where("masked = 99").count()
    assert 7600 < masked < 8400
    row = tokens.training_rows(table(spark, [[7, 8]]), 4, 0).first()
    assert row["labels"] == [7, 8, 0, 0] and row["attention_mask"] == [1, 1, 0, 0]


def test_render_and_start_prompts(spark, meta):
    df = table(spark, [ids(meta, "<s> age3 </covar>")])
    assert tokens.render_text(df, meta.vocab(), 10).first()["text"] == "<s> covar 1 3 </covar>"
    assert tokens.start_prompts(spark, 3, 7).where("input_ids = array(7)").count() == 3


def test_aligned_horizons(spark, meta):
    rows = [(1, 0, meta.special("<s>"), -1, None), (1, 1, 3, 0, 0), (1, 2, 3, 0, 2)]
    df = spark.createDataFrame(rows, "seq long, pos long, token_id int, stay_idx int, row_idx long")
    want = spark.createDataFrame([(1, 0, 12.0, 1), (1, 0, 24.0, 2)], "sid long, stay_idx int, horizon double, row_idx long")
    kept = {r["horizon"]: r["position"] for r in tokens.token_horizons(df, want).collect()}
    assert kept == {12.0: 3, 24.0: -1}
    aligned = {r["horizon"]: r["position"] for r in tokens.token_horizons(df, want, aligned=True).collect()}
    assert aligned == {12.0: 2, 24.0: 3}


def test_segments_compute_their_tokens_once(spark):
    rows = spark.createDataFrame([(s, p, p % 3) for s in range(4) for p in range(9)], "seq int, pos int, token_id int")
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    out = tokens.segment_index(rows.mapInPandas(passed, rows.schema), [0], counted=rows.select("seq")).collect()
    assert seen.value == 36
    assert {(r["seq"], r["pos"]): r["segment"] for r in out} == {(s, p): p // 3 + 1 for s in range(4) for p in range(9)}


def soup(meta, n=30):
    """Sequences of random tokens, closed and not, some with tokens behind the end or nothing before it."""
    rng = random.Random(6)
    first, marks = meta.starts()[("special", -1)], ["</covar>", "</label>", "</code>", "</adm>", "</adm>", "</s>"]
    out = [[meta.special("</s>"), 0], [meta.special("</adm>")]]
    for _ in range(n):
        out.append([rng.randrange(first) if rng.random() < 0.7 else meta.special(rng.choice(marks)) for _ in range(rng.randrange(1, 40))])
    return out


def test_detokenize_of_large_keys_is_the_same(spark, meta, monkeypatch):
    df = table(spark, soup(meta))

    def found():
        return [sorted(map(tuple, t.select(sorted(t.columns)).collect()), key=str) for t in tokens.detokenize(df, meta, 4)]

    whole = found()
    monkeypatch.setattr(ordered, "WHOLE_ROWS", 0)
    assert found() == whole and all(whole)


def test_detokenize_computes_its_tokens_once(spark, meta):
    df = table(spark, soup(meta))
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    stays, events = tokens.detokenize(df.mapInPandas(passed, df.schema), meta, counted=df.select("seq"))
    assert stays.count() and events.count() and seen.value == df.count()
