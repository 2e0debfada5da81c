"""Nearest neighbours against NumPy, record distances, sampling, sources."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from visitframe.operators import nearest, privacy, records, seqmodel
from visitframe.sources import io


def vectors(spark, x, start=0):
    rows = [(start + i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, vector array<double>")


def brute(a, b, k=1, same=False):
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    if same:
        np.fill_diagonal(d, np.inf)
    return np.sort(d, 1)[:, k - 1]


def by_row(x, found, index):
    """The found distance of each row of ``x``."""
    pairs = index.rows.select("vid", "vector").join(found, "vid").collect()
    table = {tuple(r["vector"]): r["dist"] for r in pairs}
    return np.array([table[tuple(map(float, r))] for r in x])


@pytest.mark.parametrize("rows", [8, 2048])
def test_nearest_with_copies(spark, rows):
    rng = np.random.default_rng(0)
    clusters = rng.normal(size=(4, 3)) * 20
    a = np.concatenate([clusters[rng.integers(0, 4, 40)] + rng.normal(size=(40, 3)), np.ones((20, 3))])
    b = clusters[rng.integers(0, 4, 30)] + rng.normal(size=(30, 3))
    index = nearest.vector_index({"a": vectors(spark, a), "b": vectors(spark, b)})
    for k in (1, 4):
        found = nearest.nearest_pairs(index, [("a", "a"), ("a", "b"), ("b", "b")], k, rows).cache()
        to_a, to_b = found.where("c = 0"), found.where("c = 1")
        assert np.allclose(by_row(a, to_a, index), brute(a, a, k, True), atol=1e-9)
        assert np.allclose(by_row(a, to_b, index), brute(a, b, k))
        assert np.allclose(by_row(b, to_b, index), brute(b, b, k, True))
    radius = brute(b, b, 2, True)
    balls = spark.createDataFrame([([float(v) for v in r], float(d)) for r, d in zip(b, radius)], "vector array<double>, radius double")
    ringed = index.rows.select("vid", "vector").join(balls, "vector").select("vid", "radius")
    inside = nearest.count_balls(index, "a", "b", ringed, rows).withColumnRenamed("inside", "dist")
    want = (np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)) < radius[None]).sum(1)
    assert (by_row(a, inside, index) == want).all()


def test_nearest_far_from_the_origin(spark):
    rng = np.random.default_rng(1)
    a = 1e6 + 1e-2 * rng.normal(size=(300, 8))
    sets = privacy.VectorSets({"a": vectors(spark, a), "b": vectors(spark, a)})
    want = brute(a, a, 1, True)
    assert np.allclose(by_row(a, sets.distance("a", "a"), sets.index), want, rtol=1e-12, atol=0)
    assert (by_row(a, sets.distance("a", "b"), sets.index) == 0).all()


def test_few_neighbours_and_empty_sets(spark):
    one, none = vectors(spark, np.ones((1, 2))), vectors(spark, np.ones((0, 2)))
    sets = privacy.VectorSets({"a": one, "b": none})
    assert [tuple(r) for r in sets.distance("a", "a").collect()] == [(sets.index.rows.first()["vid"], 1, None)]
    assert sets.distance("a", "b").first()["dist"] is None and sets.distance("b", "a").count() == 0
    assert privacy.VectorSets({"a": none, "b": none}).distance("a", "b").count() == 0


def test_clustered_vectors_visit_few_leaves(spark):
    """Copies of rows sent to leaves stay bounded at 100,000 vectors, for all pairs of cohorts."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(400, 8)) * 50
    x = centres[rng.integers(0, 400, 100_000)] + rng.normal(size=(100_000, 8)) * 0.05
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "vector": list(x)}), "id long, vector array<double>").repartition(8)
    index = nearest.vector_index({n: frame.where(F.col("id") % 2 == i) for i, n in enumerate(("a", "b"))})
    pairs = [(0, 0), (0, 1), (1, 0), (1, 1)]
    first = nearest.first_visits(index, pairs, 1)
    sample = first.where(F.col("vid") % 50 == 0)  # the attained distances of some rows are enough here
    found = nearest._blocks(sample, index.rows.select("vid", "vector", "weights", "leaf"), nearest._search_kernel(1), nearest.FOUND, 2048)
    best = found.groupBy("vid", "c").agg(F.min("dist").alias("dist"))
    bounds = best.groupBy("vid").agg(F.map_from_entries(F.collect_list(F.struct("c", "dist"))).alias("bounds"), F.map_from_arrays(F.array(), F.array()).cast("map<int,int>").alias("seen"))
    few = nearest.VectorIndex(index.names, index.rows.where(F.col("vid") % 50 == 0), index.pivots, index.radius, index.weight, index.count)
    rows = few.rows.count()
    assert first.count() <= 2 * 100_000
    sent = nearest.later_visits(few, pairs, bounds).count()
    assert sent <= 6 * rows, (sent, rows, len(index.pivots))


def test_equal_records_all_get_a_distance(spark):
    rows = [record(i, [0, 1, 0], [[1, 2], [3]]) for i in range(3)] + [record(9, [0, 0, 0], [[1]])]
    s = long_form(spark, {"a": rows})
    got = {r["rid"]: r["dist"] for r in records.each_record(s, records.nearest_records(s, s)).collect()}
    assert got == {r[0]: min([100] + [distance(r, y) for y in rows if y[0] != r[0]]) for r in rows}


def test_set_against_itself_is_indistinct(spark):
    x = np.random.default_rng(1).normal(size=(30, 4))
    v = vectors(spark, x)
    got = {r["metric"]: r["value"] for r in privacy.vector_nnaa(privacy.VectorSets({"real": v, "synthetic": v, "test": v})).collect()}
    assert got["aa_train_syn"] == 0 and got["nnaa"] == 0


def record(rid, labels, visits):
    return rid, labels, [len(v) for v in visits], sorted({f"{i}:{c}" for i, v in enumerate(visits) for c in v})


def distance(a, b):
    d = int(len(a[2]) != len(b[2])) + sum(x != y for x, y in zip(a[1], b[1]))
    d += sum(a[2]) + sum(b[2][: len(a[2])])
    return d - 2 * len(set(a[3]) & set(b[3]))


def long_form(spark, parts):
    """The tables of records (rid, labels, sizes, features) by part."""
    codes, visits, labels = [], [], []
    for part, rows in parts.items():
        for rid, label, sizes, features in rows:
            labels.append((part, rid, label))
            for i, size in enumerate(sizes):
                visits.append((part, rid, i))
                own = [f.split(":")[1] for f in features if f.startswith(f"{i}:")]
                codes += [(part, rid, i, c) for c in own + own[:1] * (size - len(own))]
    return records.record_set(
        spark.createDataFrame(codes, "part string, rid long, visit_idx int, code string"),
        spark.createDataFrame(visits, "part string, rid long, visit_idx int"),
        spark.createDataFrame(labels, "part string, rid long, labels array<int>"),
    )


def test_record_distance(spark):
    a = record(1, [1, 0], [[1, 2, 3], [4]])
    b = record(2, [0, 0], [[2, 3, 5]])
    c, e = record(3, [0, 0], [[1, 1, 2]]), record(4, [0, 0], [[1, 2]])
    s = long_form(spark, {"x": [a, b, c, e]})
    ids = [(("x", 1), ("x", 2)), (("x", 2), ("x", 1)), (("x", 3), ("x", 4))]
    pairs = spark.createDataFrame(ids, "rec struct<part:string,rid:long>, rec_b struct<part:string,rid:long>")
    got = {r["rec"]["rid"]: r["dist"] for r in records.record_distance(s, s, pairs).collect()}
    assert got == {1: 5, 2: 4, 3: 1}


def some_records(rng, n, start, n_codes=6, longest=9, most=5):
    return [
        record(
            start + i, [int(x) for x in rng.integers(0, 2, 3)],
            [[int(c) for c in rng.integers(0, n_codes, rng.integers(0, most))] for _ in range(rng.integers(1, longest))],
        )
        for i in range(n)
    ]


def check_nearest(spark, parts):
    s = long_form(spark, parts)
    found = records.each_record(s, records.nearest_records(s, s)).collect()
    got = {(r["part"], r["rid"], r["part_b"]): r["dist"] for r in found}
    want = {
        (p, x[0], q): min([100] * (p == q) + [distance(x, y) for y in other if p != q or y[0] != x[0]])
        for p, rows in parts.items() for x in rows for q, other in parts.items()
    }
    assert len(found) == len(got) and got == want


@pytest.mark.parametrize("salt", [1, 4096])
def test_nearest_records(spark, salt, monkeypatch):
    monkeypatch.setattr(records, "SALT_ROWS", salt)
    rng = np.random.default_rng(4)
    a, b = some_records(rng, 25, 0), some_records(rng, 20, 100)
    a += [(900 + i, *a[0][1:]) for i in range(5)]
    check_nearest(spark, {"a": a, "b": b})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_records_of_long_and_like_ones(spark, seed):
    rng = np.random.default_rng(seed)
    long = some_records(rng, 12, 0, n_codes=3, longest=20, most=9)
    cut = [record(500 + r[0], r[1], [[int(f.split(":")[1]) for f in r[3] if f.startswith(f"{i}:")] for i in range(len(r[2]) // 2 + 1)]) for r in long]
    check_nearest(spark, {"a": long + cut[:6], "b": cut[6:] + [record(i, *long[0][1:2], [[1], [2]]) for i in (900, 901)], "c": [record(77, [1, 1, 1], [[]])]})


def test_a_frequent_feature_makes_few_pairs(spark):
    """Every record has one code in common; it is never met under it."""
    rng = np.random.default_rng(0)
    n = 1500
    rows = [record(i, [0, 0, 0], [[0, *map(int, rng.integers(1, 50_000, 6))]]) for i in range(n - 1)] + [record(n, [0, 0, 0], [[]])]
    s = long_form(spark, {"a": rows})
    bounds = records.without_common(s, s, 100.0)
    met = records.candidates(s, records.postings(s, s, bounds)).agg(F.sum("seen").alias("n")).first()["n"] or 0
    assert met <= n, met
    found = {r["rid"]: r["dist"] for r in records.each_record(s, records.nearest_records(s, s)).collect()}
    few = rows[:60]
    assert all(found[x[0]] == min(distance(x, y) for y in rows if y[0] != x[0]) for x in few)


def test_kde(spark):
    d = spark.createDataFrame([(1.0, 1), (2.0, 1), (4.0, 1)], "dist double, weight long")
    density = privacy.distance_kde(d, F.lit(4.0), 3)
    got = spark.range(1).select(density.alias("y")).first()["y"]
    assert got[0] == pytest.approx(0.106977, abs=1e-6) and got[1] == pytest.approx(0.214895, abs=1e-6)


def test_density_of_equal_and_of_far_distances(spark):
    equal = spark.createDataFrame([(1.5, 2), (1.5, 1)], "dist double, weight long")
    got = spark.range(1).select(privacy.distance_kde(equal, F.lit(4.0), 3).alias("y")).first()["y"]
    assert all(math.isnan(y) for y in got)
    # A density of the least double is halved to 0; the other one has none there.
    far = spark.createDataFrame([([5e-324, 4.0, 1.0], [0.0, 4.0, 3.0])], "p array<double>, q array<double>")
    got = privacy.density_divergence(far).first()
    p, q = (0.8, 0.2), (4 / 7, 3 / 7)
    m = [8 / 12, 4 / 12]  # of the sums
    want = sum(x * math.log(x / z) + y * math.log(y / z) for x, y, z in zip(p, q, m)) / 2
    assert got["jsd"] == pytest.approx(want) and got["wasserstein"] == pytest.approx(2 / 3)
    unknown = spark.createDataFrame([([None, None], [None, None])], "p array<double>, q array<double>")
    assert privacy.density_divergence(unknown).first()["jsd"] is None


def toy_tokens(spark, n=40):
    rng = np.random.default_rng(7)
    rows = [(s, p, int(t)) for s in range(n) for p, t in enumerate([1, *rng.integers(2, 6, rng.integers(1, 9)), 9])]
    return rows, spark.createDataFrame(rows, "seq long, pos long, token_id int")


@pytest.mark.parametrize("order", [0, 1, 3, 5])
def test_model_of_any_order(spark, order):
    rows, toks = toy_tokens(spark)
    seqs, want = {}, {}
    for s, _, t in rows:
        seqs.setdefault(s, []).append(t)
    for tokens in seqs.values():
        for p in range(1, len(tokens)):
            for k in range(min(order, p) + 1):
                key = (k, tuple(tokens[p - 1 : p - 1 - k if p > k else None : -1]) if k else (), tokens[p])
                want[key] = want.get(key, 0) + 1
    got = {(r["order"], tuple(r["context"]), r["next"]): r["n"] for r in seqmodel.fit_sequence_model(toks, order).collect()}
    assert got == want


def sampled_plainly(model, prompt, seq, n_ctx, end, seed, top_k, top_p, penalty, temperature):
    """One sequence, context by context."""
    tokens = list(prompt)
    while tokens and len(tokens) < n_ctx and tokens[-1] != end:
        known = max((c for k, c in {(len(c), c) for c, _ in model} if k <= len(tokens) and c == tuple(tokens[::-1][:k])), key=len)
        p = {t: n for (c, t), n in model.items() if c == known}
        total = sum(p.values())
        p = {t: ((n / total) ** (penalty if t in tokens else 1.0)) ** (1 / temperature) for t, n in p.items()}
        ranked = sorted(p, key=lambda t: (-p[t], t))[:top_k]
        mass, head = sum(p[t] for t in ranked), []
        for t in ranked:
            if sum(p[h] for h in head) / mass < top_p:
                head.append(t)
        head.sort()
        u, run = float(seqmodel.uniform(seed, seq, len(tokens))) * sum(p[t] for t in head), 0.0
        for t in head:
            run += p[t]
            if u < run:
                break
        tokens.append(t)
    return tokens


@pytest.mark.parametrize("bucket_rows", [7, 60, 10**6])
@pytest.mark.parametrize("options", [dict(top_k=3), dict(repetition_penalty=1.7, temperature=0.9, top_p=0.8)])
def test_sampling_is_that_of_a_plain_loop(spark, bucket_rows, options, monkeypatch):
    monkeypatch.setattr(seqmodel, "BUCKET_SEQUENCES", 5)
    _, toks = toy_tokens(spark)
    fitted = seqmodel.fit_sequence_model(toks, 3)
    model = {(tuple(r["context"]), r["next"]): r["n"] for r in fitted.collect()}
    prompts = [(s, [1] if s % 3 else [1, 2, 4]) for s in range(12)] + [(90, []), (91, [9]), (92, [1] * 9), (93, [77])]
    frame = spark.createDataFrame(prompts, "seq long, input_ids array<int>").repartition(3)
    got = {}
    for r in seqmodel.generate(fitted, frame, 7, 9, 3, bucket_rows=bucket_rows, **options).orderBy("seq", "pos").collect():
        got.setdefault(r["seq"], []).append(r["token_id"])
    o = dict(top_k=None, top_p=1.0, repetition_penalty=1.0, temperature=1.0) | options
    for seq, prompt in prompts:
        want = sampled_plainly(model, prompt[:7], seq, 7, 9, 3, o["top_k"], o["top_p"], o["repetition_penalty"], o["temperature"])
        assert got.get(seq, []) == want, seq


def test_a_round_of_sampling_writes_what_it_carries_on(spark, monkeypatch, tmp_path):
    """Ended sequences are not written again, and the model lies packed in order."""
    monkeypatch.setattr(seqmodel, "stage_path", lambda _, name: str(tmp_path / name))
    monkeypatch.setattr(seqmodel, "PACKED_ROWS", 10)
    packed = []
    pack = seqmodel._packed
    monkeypatch.setattr(seqmodel, "_packed", lambda *a: packed.append((pack(*a), a[1])) or packed[0][0])
    _, toks = toy_tokens(spark)
    fitted = seqmodel.fit_sequence_model(toks, 2)
    prompts = spark.range(30).selectExpr("id + 9007199254740992 AS seq", "array(1) AS input_ids")
    out = seqmodel.generate(fitted, prompts, 7, 9, 3, bucket_rows=60)
    assert out.select("seq").distinct().count() == 30
    rounds = [spark.read.parquet(str(p)) for p in sorted((tmp_path / "walk").iterdir(), key=lambda p: int(p.name.split("-")[1]))]
    assert len(rounds) > 2
    for one, later in zip(rounds, rounds[1:]):
        assert {r["seq"] for r in one.where("NOT done").collect()} == {r["seq"] for r in later.collect()}
    table, held = packed[0]
    rows = [tuple(r) for r in table.where("bucket = 0").select("part", "k", "levels", "data").collect()]
    columns, level = seqmodel._unpacked(rows, held)
    keys = [(o, *x) for o in range(3) for x in zip(*(columns[c][level[o] : level[o + 1]].tolist() for c in ("t1", "t2", "next")))]
    assert len(keys) > 10 and keys == sorted(set(keys))


def test_distribution_of_a_model(spark):
    _, toks = toy_tokens(spark)
    dist = seqmodel.next_token_dist(seqmodel.fit_sequence_model(toks), top_k=3)
    sums = dist.groupBy(*seqmodel.CONTEXT).agg(F.sum("p").alias("s"), F.count("*").alias("n")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 and r["n"] <= 3 for r in sums)


def test_repetition_penalty(spark):
    model = spark.createDataFrame([(0, [], 1, 5), (0, [], 2, 5)], "order int, context array<int>, next int, n long")
    seen = spark.createDataFrame([(1,)], "token_id int")
    p = {r["next"]: r["p"] for r in seqmodel.next_token_dist(model, repetition_penalty=2.0, seen=seen).collect()}
    assert p[1] == pytest.approx(0.25 / 0.75) and p[2] == pytest.approx(0.5 / 0.75)


def test_sources(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("ROW_ID,SUBJECT_ID,HADM_ID,SEQ_NUM,ICD9_CODE\n1,7,70,2,0389\n2,7,70,1,4019\n3,7,71,x,\n")
    got = io.read_codes(spark, str(tmp_path / "codes.csv"), "icd").collect()
    assert [(r["code"], r["seq_num"]) for r in got] == [("0389", 2), ("4019", 1), (None, None)]
    (tmp_path / "list.csv").write_text("stay,period,a,b\n9_episode2_timeseries.csv,1,0,1\n8_episode1_timeseries.csv,1,1,1\n")
    rows = io.read_split_list(spark, str(tmp_path / "list.csv"), "train").orderBy("list_pos").collect()
    assert [(r["sid"], r["episode"], r["label_phe"], r["list_pos"]) for r in rows] == [(9, 1, [0, 1], 0), (8, 0, [1, 1], 1)]
    assert io.label_names(spark, str(tmp_path / "list.csv")) == ["a", "b"]
    folder = tmp_path / "series"
    folder.mkdir()
    (folder / "9_episode2_timeseries.csv").write_text("Hours,x y,z\n0.5,1,a\n2,,b\n")
    (folder / "8_episode1_timeseries.csv").write_text("Hours,x y,z\n1,3,c\n")
    s = {(r["stay"], r["row_idx"]): (r["hours"], r["x y"]) for r in io.read_series(spark, str(folder), ["x y"]).collect()}
    assert s["9_episode2_timeseries.csv", 1] == (2.0, None) and s["8_episode1_timeseries.csv", 0] == (1.0, "3")


def test_cache_and_save(spark, tmp_path):
    path = str(tmp_path / "cache")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    assert io.cached(spark, build, path, "k1").count() == 3
    io.cached(spark, build, path, "k1")
    assert len(calls) == 1
    io.cached(spark, build, path, "k2")
    io.cached(spark, build, path, "k1", redo=True)
    assert len(calls) == 3
    with pytest.raises(ValueError):
        io.save_synthetic(spark.range(1).withColumnRenamed("id", "token_id"), path, "x")
    with pytest.raises(ValueError):
        io.load_split(spark, path, "holdout")


def test_unstructured_vectors_are_copied_once_per_group(spark):
    """Without structure every leaf is reached: rows are copied per group of leaves, not per leaf."""
    x = np.random.default_rng(5).normal(size=(2000, 24))
    frame = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "vector": list(x)}), "id long, vector array<double>")
    index = nearest.vector_index({"a": frame.where("id % 3 > 0"), "b": frame.where("id % 3 = 0")})
    unlimited = spark.createDataFrame([], "vid long, bounds map<int,double>, seen map<int,int>")
    sent = nearest.later_visits(index, [(0, 0), (0, 1)], unlimited, 100)
    assert sent.count() <= 2000 * len(set(index.groups(100))) < 2000 * len(index.pivots) / 2
    a, b = x[np.arange(2000) % 3 > 0], x[np.arange(2000) % 3 == 0]
    for k in (1, 5):
        found = nearest.nearest_pairs(index, [("a", "a"), ("a", "b")], k, 100).cache()
        assert np.allclose(by_row(a, found.where("c = 0"), index), brute(a, a, k, True))
        assert np.allclose(by_row(a, found.where("c = 1"), index), brute(a, b, k))


@pytest.mark.parametrize("penalty", [1.0, 1.3])
def test_a_long_context_is_cut_to_what_can_be_drawn(penalty):
    """The sampler looks at the most frequent tokens of a long context alone, and draws the same."""
    rng = np.random.default_rng(2)
    n, nexts = rng.integers(1, 40, 500), np.arange(500, dtype=np.int32)
    rows = pd.DataFrame({"order": 0, "next": nexts, "n": n}).sample(frac=1, random_state=1)
    options = (0.9, 5, 0.95, penalty)
    sampler = seqmodel.Sampler(rows, 0, options, n_ctx=20)
    for seen in (set(), set(np.argsort(-n)[:20].tolist())):
        sampler.tables.clear()
        got, cums = sampler.table([1], seen)
        want, weights = seqmodel.sampling_weights(nexts, n / n.sum(), seen, *options)
        assert got.tolist() == want.tolist() and np.allclose(cums, np.cumsum(weights))
        assert len(sampler.shares(0, 500, len(seen))[0]) == 5 + len(seen)


def test_rings_of_all_sets_are_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sets = {
        name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 3)))], "id int, vector array<double>")
        for name in ("real", "test", "synthetic")
    }
    passes, search = [], nearest.nearest_pairs
    monkeypatch.setattr(nearest, "nearest_pairs", lambda index, pairs, k=1: passes.append(k) or search(index, pairs, k))
    found = privacy.VectorSets(sets)
    for other in ("test", "synthetic"):
        assert privacy.prdc(found, other).count() == 4
    assert sorted(passes) == [1, 5]


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_few_candidates_are_taken_exactly(shift, monkeypatch):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(50, 8)) + shift, rng.normal(size=(4000, 8)) + shift
    true = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    met, exact = [], nearest._exact
    monkeypatch.setattr(nearest, "_exact", lambda x, y, row, col: met.append(len(row)) or exact(x, y, row, col))
    none = (np.array([], dtype=int), np.array([], dtype=int))
    # Bounds that a tenth of the cells are within, as those of a first look into one leaf.
    bound = np.quantile(true, 0.1, axis=1)
    row, dist, _ = nearest._k_nearest(x, y, none, np.ones(4000, dtype=int), 5, bound, [])
    assert np.allclose(dist.reshape(50, 5), np.sort(true, axis=1)[:, :5], rtol=1e-12)
    assert (row == np.repeat(np.arange(50), 5)).all()
    assert met[0] < 50 * 60
