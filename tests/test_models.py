from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from batchloom.errors import Refusal
from batchloom.operators import diagnostics, models, variables

ROWS = "batch string, formulation long, x0 double, x1 double, x2 double, y double"


def made(spark, n=160, seed=8, effect=2.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = effect * x[:, 0] + rng.normal(size=n)
    form = rng.integers(0, 23, n)
    return spark.createDataFrame([(f"B{i:08d}", int(f), *map(float, v), float(w)) for i, (f, v, w) in enumerate(zip(form, x, y, strict=True))], ROWS)


def test_folds_are_whole_and_of_like_size(spark):
    rows = models.with_folds(made(spark)).toPandas()
    assert rows.groupby("formulation")["fold"].nunique().max() == 1 and set(rows["fold"]) == set(range(5))
    sizes = rows.groupby("fold").size()
    assert sizes.max() - sizes.min() <= rows.groupby("formulation").size().max()


@pytest.mark.parametrize("scheme", models.SCHEMES)
def test_held_out_line_equals_refits(spark, scheme):
    rows = models.split(models.with_folds(made(spark)), scheme)
    got = models.held_out_line(rows).toPandas()
    assert len(got) == 160
    for fold, part in list(got.groupby("fold"))[:7]:
        rest = got[got["fold"] != fold]
        slope, at = np.polyfit(rest["x0"], rest["y"], 1)
        assert np.allclose(part["prediction"], at + slope * part["x0"])


def test_splits_refuse(spark):
    one = made(spark).withColumn("formulation", F.lit(1).cast("long"))
    with pytest.raises(Refusal):
        models.split(one, "leave_one_formulation_out")
    with pytest.raises(ValueError):
        models.split(one, "none such")


def test_many_problems_at_once_equal_each_alone():
    rng = np.random.default_rng(1)
    g = []
    for _ in range(4):
        z = np.column_stack([np.ones(80), rng.normal(size=(80, 5)), rng.normal(size=80)])
        g.append([z[k::4].T @ z[k::4] for k in range(4)])
    g = np.array(g)
    for model in ("elastic_net", "ridge", "ols", "pls"):
        names, coef, intercept = models.tuned_many(model, g)
        for r in range(4):
            name, c, i = models.tuned(model, g[r])
            assert name == names[r] and np.allclose(c, coef[r], atol=1e-6) and i == pytest.approx(intercept[r], abs=1e-6)


def test_no_more_columns_than_batches_can_carry():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 12))
    y = x @ rng.normal(size=12) * 3 + rng.normal(size=20) * 0.1
    z = np.column_stack([np.ones(20), x, y])
    _, coef, _ = models.tuned("elastic_net", np.array([z[k::4].T @ z[k::4] for k in range(4)]))
    assert (coef != 0).sum() <= models.cap_of(20) == 4
    assert models.densest({"a": 0.1, "b": -3.0, "c": 1.0}, {"a": 100.0}, 10) == ["a", "b"]


def test_verdicts(spark):
    rows = models.with_folds(made(spark)).withColumnRenamed("none", "none")
    got = models.validated(rows, ["a", "b", "c"], permutations=40, replicates=40).first()
    assert got.verdict == "supported" and got.stable[0] == "a" and got.p_value == pytest.approx(1 / 41)
    nothing = models.validated(models.with_folds(made(spark, effect=0.0)), ["a", "b", "c"], permutations=40, replicates=20).first()
    assert nothing.verdict == "not_supported"


def test_blocked_and_whole_permutations_agree(spark):
    """The null of permutations within blocks has the same middle and upper end as that over all rows."""
    rows = models.with_folds(made(spark, 600))
    sums = models.fold_sums(rows, ["a", "b", "c"])
    a, b = (models.permutation_summary(models.permutation_null(rows, sums, "ridge", 300, block=size), 0.5).first() for size in (100, 10**6))
    assert abs(a.null_median - b.null_median) < 0.01 and abs(a.null_p95 - b.null_p95) < 0.02


def test_refits_are_spread(spark):
    rows = models.with_folds(made(spark))
    null = models.permutation_null(rows, models.fold_sums(rows, ["a", "b", "c"]), "ols", 64)
    assert null.withColumn("p", F.spark_partition_id()).select("p").distinct().count() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("scheme", ["formulation", "batch"])
def test_stable_features(spark, scheme):
    got = {r.feature: r for r in models.stability(models.with_folds(made(spark)), ["a", "b", "c"], replicates=60, scheme=scheme).collect()}
    assert got["a"].frequency == 1 and got["a"].label == "stable" and got["a"].coef_low > 1 and got["b"].frequency < 1


def test_clusters_enter_as_one(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=60)
    rows = [(f"b{i}", float(a[i]), float(-2 * a[i] + 0.01 * rng.normal()) if i else None, float(rng.normal()), 1.0) for i in range(60)]
    wide = spark.createDataFrame(rows, "batch string, a double, b double, c double, k double")
    plan = diagnostics.plan_of(diagnostics.clusters(diagnostics.correlations(wide, ["a", "b", "c"])), ["a", "b", "c"])
    assert plan == {"cluster[a+1]": ["a", "b"], "c": ["c"]}
    got = {r.batch: r["cluster[a+1]"] for r in diagnostics.cluster_features(wide, plan).collect()}
    z = (a - a.mean()) / a.std()
    assert got["b0"] == pytest.approx(z[0]) and got["b5"] == pytest.approx(z[5], abs=0.05)
    effects = {r.variable: r for r in models.per_unit(wide, plan, {"cluster[a+1]": 2.0, "c": 1.0}).collect()}
    assert effects["a"].per_unit == pytest.approx(1 / a.std()) and effects["b"].per_unit < 0 and effects["c"].per_unit == 1


def test_mixtures(spark):
    rng = np.random.default_rng(6)
    p = rng.dirichlet([2, 2, 2], 90)
    y = p @ [4.0, 1.0, 2.0] + 3 * p[:, 0] * p[:, 1]
    rows = models.with_folds(spark.createDataFrame([(f"b{i}", i % 9, *map(float, 50 * q), float(v)) for i, (q, v) in enumerate(zip(p, y, strict=True))], ROWS))
    terms, coef = models.mixture_fit_quadratic(rows, ["a", "b", "c"])
    assert terms == ["a", "b", "c", "a x b", "a x c", "b x c"] and np.allclose(coef, [4, 1, 2, 3, 0, 0], atol=1e-3)
    linear = rows.withColumn("y", 4 * F.col("x0") / 50 + F.col("x1") / 50 + 2 * F.col("x2") / 50)
    assert models.contrasts(["a", "b", "c"], models.mixture_fit(linear, ["a", "b", "c"]))[0] == ("a", "b", pytest.approx(3, abs=1e-4))
    with pytest.raises(Refusal):
        models.mixture_fit(rows, ["a"])
    assert diagnostics.safe_of_mixtures(rows, ["x0", "x1", "x2"], ["x0", "x1", "x2"]) and not diagnostics.safe_of_mixtures(rows, ["x0"], [])


def test_dictionary_and_names(spark):
    families = spark.createDataFrame([("a", "RESPONSE"), ("a", "PROCESS"), ("b_ww", "FORMULATION"), (None, "PROCESS")], "variable string, family string")
    assert {tuple(r) for r in variables.families_for(spark.createDataFrame([("a",), ("z",), (None,)], "variable string"), families).collect()} == {("a", "PROCESS"), ("z", "PROCESS")}
    assert [tuple(r) for r in variables.dual_role(families).collect()] == [("a", 2)]
    assert variables.dictionary(families, ["FORMULATION"]).count() == 1 and variables.profile_metrics(spark).count() == 9
    got = spark.createDataFrame([("x_pct",), ("B_WW",), ("wwx",)], "n string").select(variables.looks_like_percent(F.col("n")).alias("p")).collect()
    assert [r.p for r in got] == [True, True, False]


def test_causal_language(spark):
    texts = spark.createDataFrame([(1, "The rise is due to heat."), (2, "This cannot establish causation, and leads to nothing"), (3, None), (4, ""), (5, "because the")], "k long, text string")
    got = variables.causal_language(texts, "k").collect()
    assert [(r.k, r.pattern) for r in got] == [(1, r"\bdue to\b")] and "due to heat" in got[0].fragment


def test_sql_functions(spark):
    variables.register_functions(spark)
    r = spark.sql("select f2(array(20D,40D,60D), array(20D,40D,60D)) a, f2(array(1D), array(1D)) b, t_to_pct(array(1D,2D,4D), array(20D,60D,90D), 50D) c, mdt(array(1D,2D), array(50D,100D)) d, causal_hits('it causes, due to') e").first()
    assert r.a == pytest.approx(100) and r.b is None and r.c == pytest.approx(1.75) and r.d == pytest.approx(1.0) and r.e == 2
