"""Pairwise correlations against NumPy."""

import time

import numpy as np
import pandas as pd
import pytest

from visitframe.operators import moments, series


def plain(x):
    """Correlations of complete pairs, NaN where a side is constant."""
    v = x.shape[1]
    out, n = np.full((v, v), np.nan), np.zeros((v, v), dtype=int)
    for a in range(v):
        for b in range(a):
            both = ~np.isnan(x[:, a]) & ~np.isnan(x[:, b])
            n[a, b] = both.sum()
            p, q = x[both, a], x[both, b]
            if both.any() and np.ptp(p) > 0 and np.ptp(q) > 0:
                out[a, b] = np.corrcoef(p, q)[0, 1]
    return out, n


def frame(spark, x, ids=None):
    names = [f"v{i}" for i in range(x.shape[1])]
    table = pd.DataFrame(x, columns=names).astype(object).where(~np.isnan(x), None)
    table.insert(0, "id", range(len(x)) if ids is None else ids)
    schema = "id long, " + ", ".join(f"{v} double" for v in names)
    return names, spark.createDataFrame(table, schema)


def matrix(rows, names):
    out, n = np.full((len(names),) * 2, np.nan), np.zeros((len(names),) * 2, dtype=int)
    for r in rows:
        at = names.index(r["var_a"]), names.index(r["var_b"])
        out[at], n[at] = np.nan if r["corr"] is None else r["corr"], r["n_pairs"]
    return out, n


def data(seed, rows, v):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, v)) @ rng.normal(size=(v, v)) + 1e6
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 0] = 0.1  # constant
    x[: rows - 1, 1] = np.nan  # a single value
    return x


@pytest.mark.parametrize("parts", [1, 7])
def test_matrix(spark, parts):
    x = data(0, 500, 6)
    names, df = frame(spark, x)
    got, n = matrix(series.corr_matrix(df.repartition(parts), names, 2).collect(), names)
    want, count = plain(x)
    assert (n == count).all() and np.allclose(got, np.where(count >= 2, want, np.nan), atol=1e-9, equal_nan=True)
    none, n = matrix(series.corr_matrix(df.limit(0), names, 1).collect(), names)
    assert np.isnan(none).all() and (n == 0).all()


@pytest.mark.parametrize("hot", [False, True])
def test_mean_by_key(spark, hot):
    x = data(1, 400, 4)
    ids = np.where(np.arange(400) < 250, 5, np.arange(400) % 23) if hot else np.arange(400) % 31
    names, df = frame(spark, x, ids)
    got, n = matrix(series.corr_by_id(df.repartition(9), names).collect(), names)
    each = [plain(x[ids == i]) for i in np.unique(ids)]
    want = np.mean([np.nan_to_num(c) for c, _ in each], axis=0)
    low = np.tril_indices(4, -1)
    assert np.allclose(got[low], want[low], atol=1e-8) and (n == sum(c for _, c in each)).all()


def test_wide_tables_need_no_expression_per_pair(spark):
    rng = np.random.default_rng(2)
    names = [f"v{i}" for i in range(36)]
    x = rng.normal(size=(100_000, 36))
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(8).cache()
    df.count()
    start = time.time()
    got, _ = matrix(series.corr_matrix(df, names).collect(), names)
    assert time.time() - start < 60
    low = np.tril_indices(36, -1)
    assert np.allclose(got[low], np.corrcoef(x.T)[low], atol=1e-9)


def test_merge_of_empty_and_constant_parts():
    x = np.array([[1.0, 2.0], [1.0, 5.0]])
    there = np.ones((2, 2), dtype=bool)
    m = moments.Moments(x, ~there).merge(moments.Moments(x, there)).merge(moments.Moments(x + [[0.0, 4.0]], there))
    assert m.n[0, 1] == 4 and m.square[0, 1] == 0 and m.square[1, 0] == pytest.approx(np.var([2, 5, 6, 9]) * 4)
