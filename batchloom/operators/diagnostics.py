"""What cannot be told apart in a batch table: correlation, aliasing, inflation, mixtures, and components of variance.

Second-order statistics of all columns come from one pass that multiplies rows
inside the tasks and adds up matrices of the size of the schema; what follows
from them (components, inflation, mixtures) is small and done on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.errors import Refusal
from batchloom.operators.longform import safe_corr
from batchloom.session import durable

CLUSTER_R, ALIAS_R2, VIF_FLAG, MIXTURE_SD = 0.90, 0.95, 10.0, 0.5


@dataclass(frozen=True)
class Pairs:
    """Pairwise-complete sums over rows: ``n``, ``x`` and ``xx`` [i, j] are of column i where both i and j are known."""

    names: list[str]
    n: np.ndarray
    x: np.ndarray
    xx: np.ndarray
    xy: np.ndarray

    def corr(self) -> np.ndarray:
        n = np.maximum(self.n, 1)
        mx, my = self.x / n, self.x.T / n
        cov = self.xy / n - mx * my
        vx, vy = self.xx / n - mx**2, self.xx.T / n - my**2
        varies = (vx > 1e-12 * np.maximum(self.xx / n, 1e-300)) & (vy > 1e-12 * np.maximum(self.xx.T / n, 1e-300)) & (self.n >= 3)
        r = np.where(varies, cov / np.sqrt(np.where(varies, vx * vy, 1)), np.nan)
        np.fill_diagonal(r, 1.0)
        return np.clip(r, -1, 1)


def pair_sums(wide: DataFrame, columns: Sequence[str]) -> Pairs:
    """One pass over ``wide``; NULL, NaN and infinite cells are missing. Columns are centred on their means first."""
    columns = list(columns)
    p = len(columns)
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)
    means = wide.agg(*[F.avg(finite(F.col(f"`{c}`").cast("double"))) for c in columns]).first() if columns else []
    centre = np.array([0.0 if m is None else m for m in means])

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, p, p))
        for pdf in frames:
            v = pdf.to_numpy(dtype=float) - centre
            k = np.isfinite(v)
            v = np.where(k, v, 0.0)
            k = k.astype(float)
            total += [k.T @ k, v.T @ k, (v * v).T @ k, v.T @ v]
        i, j = np.nonzero(np.ones((p, p)))
        yield pd.DataFrame({"i": i, "j": j, **{c: t.ravel() for c, t in zip(("n", "x", "xx", "xy"), total, strict=True)}})

    parts = wide.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInPandas(sums, "i long, j long, n double, x double, xx double, xy double")
    got = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "xx", "xy")]).toPandas()
    out = {c: np.zeros((p, p)) for c in ("n", "x", "xx", "xy")}
    for c, m in out.items():
        m[got["i"].to_numpy(dtype=int), got["j"].to_numpy(dtype=int)] = got[c]
    return Pairs(columns, **out)


def correlations(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r, n) of all pairs a < b of columns, pairwise complete."""
    pairs = pair_sums(wide, columns)
    r = pairs.corr()
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [(columns[i], columns[j], None if np.isnan(r[i, j]) else float(r[i, j]), int(pairs.n[i, j])) for a, i in enumerate(order) for j in order[a + 1 :]]
    return wide.sparkSession.createDataFrame(rows, "a string, b string, r double, n long")


def clusters(edges: DataFrame, threshold: float = CLUSTER_R) -> DataFrame:
    """(variable, cluster_id, size): connected components of the pairs (a, b, r) at least ``threshold`` correlated.

    Labels spread along the edges and jump over one another until nothing
    changes; the id is the alphabetically first member.
    """
    near = edges.where(F.abs("r") >= threshold).select("a", "b")
    both = durable(near.union(near.select("b", "a")).distinct())
    label = both.select(F.col("a").alias("v")).distinct().withColumn("c", F.col("v"))
    while True:
        spread = both.join(label.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        new = label.join(spread, "v").select("v", F.least("c", "m").alias("n"), "c")
        up = label.select(F.col("v").alias("n"), F.col("c").alias("up"))
        new = durable(new.join(up, "n", "left").select("v", F.least("n", "up").alias("n"), "c"))
        done = new.where("n <> c").isEmpty()
        label = new.select("v", F.col("n").alias("c"))
        if done:
            break
    sizes = label.groupBy("c").agg(F.count("*").alias("size"))
    return label.join(sizes, "c").select(F.col("v").alias("variable"), F.col("c").alias("cluster_id"), "size")


def _per_formulation(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(variable, formulation, n, m, v, lo, hi, mean): the values of each formulation, and the mean of the column's; one pass over the cells."""
    rows = cells.where("value is not null").join(labels.where("formulation is not null").select("batch", "formulation"), "batch")
    per = durable(rows.groupBy("variable", "formulation").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.min("value").alias("lo"), F.max("value").alias("hi")))
    total = per.groupBy("variable").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    return per.join(F.broadcast(total), "variable")  # one row per column


def eta_squared(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(variable, n_groups, eta2): share of a variable's variance that lies between formulations; NULL if it does not vary.

    Two steps, so that a hot formulation is summed up where its rows are.
    """
    between = F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2)
    share = F.try_divide(between, between + F.sum(F.col("n") * F.col("v")))
    varies = F.min("lo") < F.max("hi")
    return _per_formulation(cells, labels).groupBy("variable").agg(F.count("*").alias("n_groups"), F.when(varies, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).alias("eta2"))


def time_r2(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(variable, n, r2): squared correlation with the manufacturing date; NULL below three dated values or without variation."""
    # Seconds since a day in the middle of the data, for precision.
    seconds = F.unix_timestamp(F.col("manufacturing_date").cast("timestamp")).cast("double") - 1.7e9
    rows = cells.join(labels.where("manufacturing_date is not null").select("batch", seconds.alias("at")), "batch").where("value is not null")
    return rows.groupBy("variable").agg(F.count("*").alias("n"), F.pow(safe_corr(F.col("at"), F.col("value")), F.lit(2.0)).alias("r2"))


def variance_components(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """Per variable: mean squares between and within formulations, F, and the share of variance between them."""
    sums = _per_formulation(cells, labels).groupBy("variable").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("ssb"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
    )
    sums = sums.withColumn("sd_total", F.sqrt(F.try_divide(F.col("ssb") + F.col("ssw"), F.col("n") - 1)))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    out = sums.where("n >= 3 and k >= 2").withColumns({"msb": F.try_divide(F.col("ssb"), k - 1), "msw": F.try_divide(F.col("ssw"), n - k), "n0": F.try_divide(n - F.col("nn") / n, k - 1)})
    between = F.greatest(F.try_divide(F.col("msb") - F.col("msw"), F.col("n0")), F.lit(0.0))
    return out.select(
        "variable", "n", F.col("k").alias("n_groups"), "sd_total", "msb", "msw",
        F.when(F.col("msw") != 0, F.try_divide(F.col("msb"), F.col("msw"))).alias("f"),
        F.try_divide(between, between + F.col("msw")).alias("icc"),
        F.sqrt("msw").alias("sd_within"),
        F.sqrt(between).alias("sd_between"),
    )


def inflation(wide: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, r2, vif) over the rows complete in ``columns``; refused without more rows than columns and one.

    Each column is regressed on the others from the correlation matrix. A
    perfect fit is held at 1 - 1e-12, as a finite flag.
    """
    columns = list(columns)
    if len(columns) < 2:
        raise Refusal("inflation needs at least two columns")
    pairs = pair_sums(wide.dropna(subset=columns), columns)
    if pairs.n[0, 0] <= len(columns) + 1:
        raise Refusal("too few complete rows for that many columns", {"n": int(pairs.n[0, 0])})
    r = pairs.corr()
    rows = []
    for i, c in enumerate(columns):
        rest = [j for j in range(len(columns)) if j != i and not np.isnan(r[i, j])]
        if np.isnan(r[i]).sum() == len(columns) - 1:
            rows.append((c, None, None))
            continue
        b, *_ = np.linalg.lstsq(r[np.ix_(rest, rest)], r[rest, i], rcond=1e-12)
        fit = float(min(max(b @ r[rest, i], 0.0), 1 - 1e-12))
        rows.append((c, fit, 1 / (1 - fit)))
    return wide.sparkSession.createDataFrame(rows, "variable string, r2 double, vif double")


def constant_sums(wide: DataFrame, columns: Sequence[str], tolerance: float = MIXTURE_SD) -> tuple[list[str], float]:
    """(components, sd of their sum): columns left after greedily removing those whose removal steadies the row sum most.

    Empty if the sum never gets steadier than ``tolerance`` with at least two
    columns. Only the covariance matrix is needed, from one pass.
    """
    left = list(columns)
    pairs = pair_sums(wide.dropna(subset=left), left)
    n = max(pairs.n[0, 0], 1) if left else 1
    mean = np.diag(pairs.x) / n if left else np.zeros(0)
    cov = pairs.xy / n - np.outer(mean, mean) if left else np.zeros((0, 0))
    at = list(range(len(left)))
    sd = lambda s: float(np.sqrt(max(cov[np.ix_(s, s)].sum(), 0.0)))
    now = sd(at)
    while len(at) > 2 and now > tolerance:
        best = min(at, key=lambda i: (sd([j for j in at if j != i]), left[i]))
        new = sd([j for j in at if j != best])
        if new >= now:
            break
        at.remove(best)
        now = new
    return ([left[i] for i in at], now) if len(at) >= 2 and now <= tolerance else ([], now)


def dependencies(wide: DataFrame, columns: Sequence[str], tolerance: float = 1e-13) -> list[dict[str, float]]:
    """Exact linear dependencies among ``columns``: coefficients, largest first, of each direction without variance."""
    columns = list(columns)
    pairs = pair_sums(wide.dropna(subset=columns), columns)
    n = max(pairs.n[0, 0], 1)
    mean = np.diag(pairs.x) / n
    cov = pairs.xy / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    out = []
    for v, d in zip(values, vectors.T, strict=True):
        if v <= tolerance * max(values[-1], 1e-300) * len(columns):
            members = sorted(((c, float(x / s)) for c, x, s in zip(columns, d, scale, strict=True) if abs(x) > 1e-6), key=lambda m: -abs(m[1]))
            out.append(dict(members))
    return out


def effective_size(wide: DataFrame, labels: DataFrame, predictors: int) -> DataFrame:
    """One row: batches, formulations, predictors, and whether these are more than a third of the batches, or as many as they or more."""
    n = wide.select("batch").distinct().join(labels.select("batch", "formulation"), "batch", "left").groupBy("formulation").agg(F.count("*").alias("n"))
    out = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_batches"), F.count("formulation").alias("n_formulations"))
    return out.withColumns({"n_predictors": F.lit(predictors), "above_a_third": F.lit(predictors) > F.col("n_batches") / 3, "no_fewer_than_batches": F.lit(predictors) >= F.col("n_batches")})


def aliases(eta: DataFrame, time: DataFrame, limit: float = ALIAS_R2) -> DataFrame:
    """(variable, alias_of, strength) of the variables that hardly differ within a formulation, or follow the date of manufacture.

    ``eta`` is (variable, eta2), ``time`` (variable, r2).
    """
    one = eta.where(F.col("eta2") > limit).select("variable", F.lit("formulation").alias("alias_of"), F.col("eta2").alias("strength"))
    return one.unionByName(time.where(F.col("r2") > limit).select("variable", F.lit("manufacturing_date").alias("alias_of"), F.col("r2").alias("strength")))


def cluster_examples(edges: DataFrame, threshold: float = CLUSTER_R) -> DataFrame:
    """(cluster_id, name, size, a, b, r): each cluster, named after its first member, with its most correlated pair; ties go to the first in the alphabet."""
    members = clusters(edges, threshold)
    near = edges.where(F.abs("r") >= threshold).join(members.select(F.col("variable").alias("a"), "cluster_id", "size"), "a")
    order = F.struct(F.round(-F.abs("r"), 9).alias("k"), "a", "b", "r")
    best = near.groupBy("cluster_id", "size").agg(F.min(order).alias("m"))
    name = F.concat(F.lit("cluster["), "cluster_id", F.lit("+"), (F.col("size") - 1).cast("string"), F.lit("]"))
    return best.select("cluster_id", name.alias("name"), "size", "m.a", "m.b", "m.r")


def confounds(edges: DataFrame, alias: DataFrame, threshold: float = CLUSTER_R) -> DataFrame:
    """(variable, confounded_with): what each variable cannot be told apart from: members of its cluster, the formulation, the date."""
    members = clusters(edges, threshold)
    other = members.select(F.col("variable").alias("confounded_with"), "cluster_id")
    pairs = members.join(other, "cluster_id").where(F.col("variable") != F.col("confounded_with")).select("variable", "confounded_with")  # as many as columns in a cluster
    return pairs.unionByName(alias.select("variable", F.col("alias_of").alias("confounded_with")))


def safe_of_mixtures(wide: DataFrame, predictors: Sequence[str], mixture: Sequence[str], dependent: Sequence[dict[str, float]] = ()) -> dict[str, str]:
    """(column: reason) of the columns to leave out: of a mixture the component that varies most, of each further dependency its smallest member."""
    out: dict[str, str] = {}
    if mixture:
        pairs = pair_sums(wide, list(mixture))
        n = np.maximum(np.diag(pairs.n), 1)
        sd = np.sqrt(np.maximum(np.diag(pairs.xx) / n - (np.diag(pairs.x) / n) ** 2, 0))
        out[mixture[int(np.argmax(np.round(sd, 12)))]] = "remainder of a mixture"
    for d in dependent:
        left = [c for c in d if c not in out]
        if left and len(left) == len(d):
            out[left[-1]] = "follows from others"
    return {c: r for c, r in out.items() if c in predictors}


def plan_of(members: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Features and the columns each stands for: a cluster (variable, cluster_id) enters as one, what is in none by itself."""
    got: dict[str, list[str]] = {}
    for r in members.where(F.col("variable").isin(list(columns))).orderBy("cluster_id", "variable").collect():
        got.setdefault(r.cluster_id, []).append(r.variable)
    out = {m[0] if len(m) == 1 else f"cluster[{m[0]}+{len(m) - 1}]": m for m in got.values()}
    seen = {c for m in out.values() for c in m}
    return out | {c: [c] for c in columns if c not in seen}


def cluster_features(wide: DataFrame, plan: dict[str, list[str]]) -> DataFrame:
    """``wide`` with a column per feature of ``plan``: a column as it is, of a cluster the mean of its members' known z values.

    Members that run against the first of their cluster are turned round.
    """
    many = {f: m for f, m in plan.items() if len(m) > 1}
    columns = sorted({c for m in many.values() for c in m})
    out = [F.col(f"`{m[0]}`").cast("double").alias(f) for f, m in plan.items() if len(m) == 1]
    if columns:
        pairs = pair_sums(wide, columns)
        at = {c: i for i, c in enumerate(columns)}
        r = pairs.corr()
        stats = wide.agg(*[F.avg(c_).alias(f"m{i}") for i, c_ in enumerate(_known(columns))], *[F.stddev_pop(c_).alias(f"s{i}") for i, c_ in enumerate(_known(columns))]).first()
        for f, m in many.items():
            zs = []
            for c in m:
                i = at[c]
                if not stats[f"s{i}"]:
                    continue
                turn = -1.0 if pairs.n[at[m[0]], i] > 2 and r[at[m[0]], i] < 0 else 1.0
                zs.append((_known([c])[0] - F.lit(stats[f"m{i}"])) * F.lit(turn / stats[f"s{i}"]))
            known = F.filter(F.array(*zs), lambda z: z.isNotNull())
            mean = F.aggregate(known, F.lit(0.0), lambda a, z: a + z) / F.size(known)
            out.append(F.when(F.size(known) > 0, mean).alias(f))
    keys = [c for c in wide.columns if c == "batch"]
    return wide.select(*keys, *out)


def _known(columns: Sequence[str]) -> list:
    return [F.when(~F.isnan(F.col(f"`{c}`").cast("double")) & (F.abs(F.col(f"`{c}`").cast("double")) < float("inf")), F.col(f"`{c}`").cast("double")) for c in columns]
