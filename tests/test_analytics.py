from __future__ import annotations

import numpy as np
import pytest
from oracle import SMALL, assert_same

from batchloom.errors import Refusal
from batchloom.operators import diagnostics, explore, models, profiles, response
from batchloom.operators.longform import exact_quantile, unpivoted


def cells(spark, values: dict):
    return spark.createDataFrame([(f"b{i}", v, x) for v, xs in values.items() for i, x in enumerate(xs)], "batch string, variable string, value double")


def test_exact_quantile(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=501).tolist(), "b": rng.integers(0, 3, 500).astype(float).tolist(), "c": [1.0, 2.0], "d": [7.0], "e": [None, 4.0, 9.0, None]}
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = {r.variable: r.quantile for r in exact_quantile(cells(spark, values), q).collect()}
        for v, xs in values.items():
            assert got[v] == pytest.approx(np.quantile([x for x in xs if x is not None], q)), (v, q)


def test_weibull_recovers_parameters():
    t = np.tile([0.25, 0.5, 1, 2, 4, 6, 8, 12, np.nan], (3, 1))
    y = 100 * (1 - np.exp(-((t / np.array([[3.0], [5.0], [1.0]])) ** np.array([[1.0], [2.2], [0.8]]))))
    td, beta, r2 = profiles.weibull_batch(t, y)
    assert np.allclose(td, [3, 5, 1], rtol=1e-4) and np.allclose(beta, [1, 2.2, 0.8], rtol=1e-4) and (r2 > 0.999999).all()
    assert np.isnan(profiles.weibull_batch(np.array([[1.0, 2.0]]), np.array([[5.0, 9.0]]))[0]).all()


def test_similarity_of_a_curve_with_itself(spark):
    pts = spark.createDataFrame([("r", "m", 1, i, 10.0 * i, i / 60) for i in range(1, 6)] + [("s", "m", 1, i, 10.0 * i + 10, i / 60) for i in range(1, 6)], "batch string, medium string, run_no int, time_min int, y double, t double")
    got = {r.batch: r for r in profiles.similarity(pts, "r").collect()}
    assert got["r"].f2 == pytest.approx(100) and got["r"].f1 == 0
    assert got["s"].f2 == pytest.approx(50 * np.log10(100 / np.sqrt(101)))


def test_refusals(spark):
    c = cells(spark, {"x": [1.0, 2.0]})
    with pytest.raises(Refusal):
        explore.what_changed(c, "b0", "b0")
    with pytest.raises(Refusal):
        explore.compare(c, spark.createDataFrame([("x", "PROCESS")], "variable string, family string"), ["b0", "zz"])
    with pytest.raises(ValueError):
        explore.imputed(c, "guess")
    with pytest.raises(Refusal):
        diagnostics.inflation(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), ["a", "b"])


def test_q_values_and_p(spark):
    rows = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "variable string, p double")
    got = {r.variable: r.q for r in response.with_q_values(rows).collect()}
    assert got["a"] == pytest.approx(0.03) and got["b"] == pytest.approx(0.04) and got["c"] == pytest.approx(0.04) and got["d"] is None
    from pyspark.sql import functions as F

    p = spark.range(1).select(response.two_sided_p(F.lit(0.4264), F.lit(20)).alias("p")).first().p
    assert p == pytest.approx(0.0608215, abs=2e-5)


def sums(x, y, folds=4):
    z = np.column_stack([np.ones(len(x)), x, y])
    return models.Sums([f"c{i}" for i in range(x.shape[1])], np.array([z[k::folds].T @ z[k::folds] for k in range(folds)]))


def test_solvers_meet_their_conditions():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)) * [1, 2, 3, 4, 5] + 7
    y = x @ [1.0, 0, -0.5, 0, 0] + rng.normal(size=200)
    m = models.centred(sums(x, y).total)
    for ratio in (0.1, 0.5, 1.0):
        for alpha, b in zip(models.ENET_ALPHAS, models.elastic_net_path(m, ratio), strict=True):
            grad = m.c - m.s @ b - alpha * (1 - ratio) * b
            active = b != 0
            assert np.allclose(grad[active], alpha * ratio * np.sign(b[active]), atol=1e-6) and (np.abs(grad[~active]) <= alpha * ratio + 1e-6).all()
    coef, intercept = models.ridge(sums(x, y).total, 0.0)
    want = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert np.allclose(np.r_[intercept, coef], want)
    assert np.allclose(models.pls(m, 5), np.linalg.solve(m.s, m.c))
    groups = [[0, 1], [2, 3, 4]]
    assert not models.group_lasso(m, groups, models.group_lasso_limit(m, groups) * 1.001).any()
    lam = models.group_lasso_limit(m, groups) * 0.5
    t, places = models.orthonormal_blocks(m, groups)
    b = np.linalg.lstsq(t, models.group_lasso(m, groups, lam), rcond=None)[0]
    grad = t.T @ m.c - t.T @ m.s @ t @ b
    for g in places:  # the subgradient of each block
        size = np.linalg.norm(b[g])
        assert np.allclose(grad[g], lam * np.sqrt(len(g)) * b[g] / size, atol=1e-6) if size else np.linalg.norm(grad[g]) <= lam * np.sqrt(len(g)) + 1e-9
    assert np.allclose(models.group_lasso(m, groups, 1e-9), np.linalg.solve(m.s, m.c), atol=1e-4)


def test_noise_is_not_supported_and_signal_is():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    assert models.cross_validate("ridge", sums(x, rng.normal(size=120)))["q2"] < 0.15
    assert models.cross_validate("elastic_net", sums(x, x[:, 0] * 3 + rng.normal(size=120)))["q2"] > 0.7
    with pytest.raises(Refusal):
        models.cross_validate("ridge", sums(x, np.ones(120)))
    assert models.verdict(0.5, 0.01, 2) == "supported" and models.verdict(0.5, 0.2, 2) == "not_supported" and models.verdict(0.2, 0.01, 2) == "weak"


def test_held_out_error_from_sums_equals_rows():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(90, 3)), rng.normal(size=90)
    s = sums(x, y, 3)
    error = 0.0
    for k in range(3):
        test = np.arange(90) % 3 == k
        train = np.column_stack([np.ones(60), x[~test]])
        b = np.linalg.lstsq(train, y[~test], rcond=None)[0]
        error += ((y[test] - np.column_stack([np.ones(30), x[test]]) @ b) ** 2).sum()
    assert models.cross_validate("ols", s)["q2"] == pytest.approx(1 - error / ((y - y.mean()) ** 2).sum())


def test_permutation_keeps_totals(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(f"b{i}", i % 10, i % 5, *map(float, rng.normal(size=2)), float(rng.normal())) for i in range(100)], "batch string, formulation long, fold int, x0 double, x1 double, y double")
    s = models.fold_sums(rows, ["a", "b"])
    null = models.permutation_null(rows, s, "ols", 20)
    q2 = [r.q2 for r in null.collect()]
    assert len(q2) == 20 and max(q2) < 0.5 and len(set(q2)) > 10
    p = models.permutation_summary(null, 0.9).first()
    assert p.p_value == pytest.approx(1 / 21)


def test_constant_sum_and_dependency(spark):
    rng = np.random.default_rng(6)
    a, b = rng.uniform(10, 20, 50), rng.uniform(5, 9, 50)
    wide = spark.createDataFrame([(float(x), float(y), float(100 - x - y), float(rng.normal())) for x, y in zip(a, b, strict=True)], "a double, b double, c double, d double")
    names, sd = diagnostics.constant_sums(wide, ["a", "b", "c", "d"])
    assert sorted(names) == ["a", "b", "c"] and sd < 1e-6
    assert any(set(d) == {"a", "b", "c"} for d in diagnostics.dependencies(wide, ["a", "b", "c"]))


def test_correlation_with_gaps_and_constants(spark):
    wide = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, float("nan"), 5.0), (3.0, 6.5, 5.0), (4.0, 7.0, 5.0), (None, 1.0, 5.0)], "a double, b double, k double")
    got = {(r.a, r.b): (r.r, r.n) for r in diagnostics.correlations(wide, ["a", "b", "k"]).collect()}
    assert got["a", "b"][0] == pytest.approx(np.corrcoef([1, 3, 4], [2, 6.5, 7])[0, 1]) and got["a", "b"][1] == 3
    assert got["a", "k"] == (None, 4)


def test_summaries_of_nothing(spark):
    empty = unpivoted(spark.createDataFrame([], "batch string, x double"))
    for f in (explore.describe, explore.missingness, explore.column_issues, exact_quantile):
        assert f(empty).count() == 0


def test_similarity_response_without_a_curve_of_the_control(spark, tmp_path):
    """Tables without the control batch, or without the medium, have no rows, as in SQL."""
    import duckdb

    from batchloom.plans import reference
    from batchloom.session import table

    readings = table(spark, SMALL, "dissolution")
    for name, kept in (("control", "upper(replace(batch, ' ', '')) <> 'B00000001'"), ("medium", "medium like 'pH%4.5%'")):
        folder = str(tmp_path / name)
        readings.where(kept).write.parquet(f"{folder}/dissolution.parquet")
        con = duckdb.connect()
        con.sql(f"create view dissolution as from '{folder}/dissolution.parquet/*.parquet'")
        for query in ("response_from_similarity", "response_from_profile"):
            assert_same(spark, con, reference.QUERIES[query], reference.SQL[query], folder)
