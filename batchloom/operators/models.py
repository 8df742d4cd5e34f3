"""Linear models of a response, their grouped validation, permutation null and stability.

Everything a linear fit needs is in the sums of [1, X, y] products, kept per
fold, where all batches of one formulation are in one fold. One pass over the
rows adds them up inside the tasks; training sums are total less held-out sums,
and held-out errors follow from the sums as well, so cross-validation with
tuning never reads the rows again. Permutations change only the products with
the response and are drawn within hashed blocks of rows; bootstrap weights are
a function of the formulation or batch, so their sums need no shuffle. The
refits of many replicates are solved together, as stacked arrays, and spread
over all cores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from batchloom.errors import Refusal
from batchloom.operators.diagnostics import pair_sums
from batchloom.session import durable

SEED = 20240101
L1_RATIOS = (0.1, 0.5, 0.9)
ENET_ALPHAS = np.logspace(1.5, -3, 25)
RIDGE_ALPHAS = np.logspace(3, -2, 25)
GROUP_LAMBDAS = np.logspace(0, -3, 14)  # parts of the penalty at which every group stays out
PERMUTATION_BLOCK = 4096
REFITS = 16  # replicates solved together
STABLE = 0.6  # share of replicates that keep a feature for it to count as stable

@dataclass(frozen=True)
class Sums:
    """Per fold the matrix of products of [1, X, y]."""

    columns: list[str]
    by_fold: np.ndarray  # folds, p + 2, p + 2

    @property
    def total(self) -> np.ndarray:
        return self.by_fold.sum(0)


def with_folds(rows: DataFrame, folds: int = 5) -> DataFrame:
    """Adds ``fold``: whole formulations are dealt to the folds in turn, those of most rows first, so that folds are of like size.

    Ranks come from counts per size and ranks within it, so that the
    formulations are never sorted in one task unless all are of one size.
    """
    sizes = durable(rows.groupBy("formulation").agg(F.count("*").alias("n")))
    before = sizes.groupBy("n").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.orderBy(F.desc("n"))) - F.col("k"))  # one row per size
    rank = F.row_number().over(Window.partitionBy("n").orderBy("formulation"))
    dealt = sizes.withColumn("r", rank).join(before, "n").select("formulation", F.pmod(F.col("before") + F.col("r") - 1, F.lit(folds)).cast("int").alias("fold"))
    return rows.join(dealt, "formulation")


def model_rows(wide: DataFrame, labels: DataFrame, columns: Sequence[str], response: str, folds: int = 5, fill: bool = False) -> DataFrame:
    """(batch, formulation, fold, x0.., y) of the batches with a formulation and a response.

    Those incomplete in ``columns`` are left out, or, with ``fill``, have the
    column's mean in place of what is missing, which pulls no fit either way.
    """
    names = [f"x{i}" for i in range(len(columns))]
    chosen = wide.select("batch", *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names, strict=True)], F.col(f"`{response}`").cast("double").alias("y"))
    known = durable(chosen.dropna(subset=["y"] if fill else [*names, "y"]).join(labels.where("formulation is not null").select("batch", "formulation"), "batch"))
    if fill and names:
        means = known.agg(*[F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names]).first()
        known = known.fillna({n: means[n] for n in names})
    return with_folds(known, folds).select("batch", "formulation", "fold", *names, "y")


def _design(pdf: pd.DataFrame, p: int) -> np.ndarray:
    return np.column_stack([np.ones(len(pdf)), pdf[[f"x{i}" for i in range(p)]].to_numpy(dtype=float), pdf["y"].to_numpy(dtype=float)])


def summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``part`` (array<double>) of all rows of ``keys`` added up element by element, combined before the shuffle."""
    total = parts.select(*keys, array_to_vector("part").alias("v")).groupBy(*keys).agg(Summarizer.sum(F.col("v")).alias("v"))
    return total.select(*keys, vector_to_array("v").alias("part"))


def fold_sums(rows: DataFrame, columns: Sequence[str], folds: int = 5) -> Sums:
    p = len(columns)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((folds, p + 2, p + 2))
        for pdf in frames:
            z, fold = _design(pdf, p), pdf["fold"].to_numpy()
            for k in range(folds):
                part = z[fold == k]
                total[k] += part.T @ part
        yield pd.DataFrame({"fold": np.arange(folds), "part": [t.ravel() for t in total]})

    parts = rows.select("fold", *[f"x{i}" for i in range(p)], "y").mapInPandas(sums, "fold int, part array<double>")
    out = np.zeros((folds, p + 2, p + 2))
    for row in summed(parts, ["fold"]).collect():  # of the size of the model, not of the data
        out[row["fold"]] = np.asarray(row["part"]).reshape(p + 2, p + 2)
    return Sums(list(columns), out)


@dataclass(frozen=True)
class Centred:
    n: float
    mean: np.ndarray
    sd: np.ndarray
    y_mean: float
    s: np.ndarray  # correlation-like matrix of standardised X
    c: np.ndarray  # products of standardised X with centred y, over n
    yy: float


def centred(g: np.ndarray) -> Centred:
    n = g[0, 0]
    mean, y_mean = g[0, 1:-1] / n, g[0, -1] / n
    cov = g[1:-1, 1:-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd > 1e-12 * np.maximum(np.abs(mean), 1e-300), sd, np.inf)  # constant columns get no weight
    c = (g[1:-1, -1] / n - mean * y_mean) / sd
    return Centred(n, mean, sd, y_mean, cov / np.outer(sd, sd), c, g[-1, -1] / n - y_mean**2)


def _plain(m: Centred, b: np.ndarray) -> tuple[np.ndarray, float]:
    coef = b / m.sd
    return coef, float(m.y_mean - coef @ m.mean)


def ridge(g: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """The penalty is ``alpha`` times the squared norm, not divided by n."""
    m = centred(g)
    return _plain(m, np.linalg.solve(m.n * m.s + alpha * np.eye(len(m.c)), m.n * m.c))


def elastic_net_paths(s: np.ndarray, c: np.ndarray, ratio: np.ndarray, alphas: np.ndarray = ENET_ALPHAS) -> np.ndarray:
    """Standardised coefficients (problem, alpha, column) of many problems at once, for descending ``alphas``.

    Coordinate descent with warm starts; a column is moved in all problems together, and only while it matters in one.
    """
    n, p = c.shape
    b, r = np.zeros((n, p)), c.copy()
    diag = np.einsum("njj->nj", s)
    alive = diag > 0
    columns = np.ascontiguousarray(np.moveaxis(s, 1, 0))  # columns[j] are the rows j of all problems
    out = np.empty((n, len(alphas), p))
    fine = 1e-8 * max(1.0, float(np.abs(c).max(initial=0.0)))
    for a, alpha in enumerate(alphas):
        l1 = alpha * ratio
        scale = np.where(alive, diag + (alpha * (1 - ratio))[:, None], np.inf)
        for _ in range(2000):
            moved = 0.0
            for j in np.flatnonzero(((np.abs(r) > l1[:, None]) & alive).any(0) | (b != 0).any(0)):
                z = r[:, j] + diag[:, j] * b[:, j]
                step = np.sign(z) * np.maximum(np.abs(z) - l1, 0.0) / scale[:, j] - b[:, j]
                far = float(np.abs(step).max())
                if far:
                    r -= columns[j] * step[:, None]
                    b[:, j] += step
                    moved = max(moved, far)
            if moved < fine:
                break
        out[:, a] = b
    return out


def elastic_net_path(m: Centred, ratio: float, alphas: np.ndarray = ENET_ALPHAS) -> np.ndarray:
    return elastic_net_paths(m.s[None], m.c[None], np.array([ratio]), alphas)[0]


def orthonormal_blocks(m: Centred, groups: Sequence[Sequence[int]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Matrix that maps coefficients of orthonormal columns, as many per group as its rank, to those of the columns; and the places of each group."""
    parts, places, at = [], [], 0
    for group in groups:
        g = np.asarray(group)
        values, vectors = np.linalg.eigh(m.s[np.ix_(g, g)])
        kept = values > 1e-10 * max(values[-1], 1e-300)
        block = np.zeros((len(m.c), int(kept.sum())))
        block[g] = vectors[:, kept] / np.sqrt(values[kept])
        parts.append(block)
        places.append(np.arange(at, at + block.shape[1]))
        at += block.shape[1]
    return np.concatenate(parts, 1), places


def group_lasso(m: Centred, groups: Sequence[Sequence[int]], lam: float, sweeps: int = 1000, start: np.ndarray | None = None) -> np.ndarray:
    """Standardised coefficients; whole groups, made orthonormal, enter or stay out, weighted by the root of their rank."""
    t, places = orthonormal_blocks(m, groups)
    s, c = t.T @ m.s @ t, t.T @ m.c
    b = np.zeros(len(c))
    r = c.copy()
    for _ in range(sweeps):
        moved = 0.0
        for g in places:
            if not len(g):
                continue
            z = r[g] + b[g]
            size = np.linalg.norm(z)
            step = z * (max(0.0, 1 - lam * np.sqrt(len(g)) / size) if size > 0 else 0.0) - b[g]
            if (far := float(np.abs(step).max())) > 0:
                r -= s[:, g] @ step
                b[g] += step
                moved = max(moved, far)
        if moved < 1e-10 * max(1.0, float(np.abs(c).max(initial=0.0))):
            break
    return t @ b


def group_lasso_limit(m: Centred, groups: Sequence[Sequence[int]]) -> float:
    """The smallest penalty at which every group stays out."""
    t, places = orthonormal_blocks(m, groups)
    c = t.T @ m.c
    return max(float(np.linalg.norm(c[g]) / np.sqrt(len(g))) for g in places if len(g))


def pls(m: Centred, components: int) -> np.ndarray:
    """Standardised coefficients of partial least squares with one response."""
    s, c = m.s.copy(), m.c.copy()
    w_all, p_all, q_all = [], [], []
    for _ in range(components):
        size = np.linalg.norm(c)
        if size < 1e-12:
            break
        w = c / size
        d = w @ s @ w
        if d < 1e-12:
            break
        load, q = s @ w / d, c @ w / d
        s, c = s - d * np.outer(load, load), c - d * q * load
        w_all.append(w)
        p_all.append(load)
        q_all.append(q)
    if not w_all:
        return np.zeros(len(m.c))
    w, load = np.array(w_all).T, np.array(p_all).T
    return w @ np.linalg.solve(load.T @ w, np.array(q_all))


def scheffe(g: np.ndarray, alpha: float = 0.0) -> np.ndarray:
    """Canonical mixture coefficients: no intercept, on components that sum to one."""
    x = g[1:-1, 1:-1]
    return np.linalg.solve(x + alpha * np.eye(len(x)), g[1:-1, -1]) if alpha else np.linalg.lstsq(x, g[1:-1, -1], rcond=1e-12)[0]


def squared_error(g: np.ndarray, coef: np.ndarray, intercept: float) -> float:
    w = np.r_[-intercept, -coef, 1.0]
    return float(w @ g @ w)


def candidates(model: str, g: np.ndarray, groups: Sequence[Sequence[int]] | None = None) -> tuple[list[str], np.ndarray, np.ndarray, int]:
    """(settings, coefficients (problem, setting, column), intercepts, settings per path) of many problems ``g``, in each path the strongest penalty first."""
    ms = [centred(x) for x in g]
    p = len(ms[0].c)
    if model in ("elastic_net", "lasso"):
        ratios = (1.0,) if model == "lasso" else L1_RATIOS
        names = [f"alpha={a:.4g} l1={x:g}" for x in ratios for a in ENET_ALPHAS]
        s, c = (np.repeat(np.stack([getattr(m, k) for m in ms]), len(ratios), 0) for k in ("s", "c"))
        b = elastic_net_paths(s, c, np.tile(ratios, len(ms))).reshape(len(ms), len(names), p)
        path = len(ENET_ALPHAS)
    elif model == "ols":
        names, path = ["ols"], 1
        b = np.stack([np.linalg.lstsq(m.s, m.c, rcond=1e-10)[0] for m in ms])[:, None]
    elif model == "ridge":
        names, path = [f"alpha={a:.4g}" for a in RIDGE_ALPHAS], len(RIDGE_ALPHAS)
        b = []
        for m in ms:
            values, vectors = np.linalg.eigh(m.n * m.s)
            b.append((vectors @ ((vectors.T @ (m.n * m.c))[:, None] / (np.maximum(values, 0)[:, None] + RIDGE_ALPHAS))).T)
        b = np.stack(b)
    elif model == "pls":
        names, path = [f"components={k}" for k in range(1, min(10, p) + 1)], 1
        b = np.stack([[pls(m, k) for k in range(1, min(10, p) + 1)] for m in ms])
    elif model == "group_lasso":
        own = [[i] for i in range(p)] if groups is None else groups
        names, path = [f"lambda={x:.4g} of the limit" for x in GROUP_LAMBDAS], len(GROUP_LAMBDAS)
        b = np.stack([[group_lasso(m, own, group_lasso_limit(m, own) * x) for x in GROUP_LAMBDAS] for m in ms])
    else:
        raise ValueError(f"unknown model {model!r}")
    coef = b / np.stack([m.sd for m in ms])[:, None]
    return names, coef, np.array([m.y_mean for m in ms])[:, None] - np.einsum("ncp,np->nc", coef, np.stack([m.mean for m in ms])), path


def cap_of(n: float) -> int:
    """Predictors that ``n`` batches can carry: one per five, from 1 to 10."""
    return int(max(1, min(10, n // 5)))


def tuned_many(model: str, by_fold: np.ndarray, groups: Sequence[Sequence[int]] | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Per replicate (first axis) the setting with the least squared error over folds left out in turn, fitted to all of them.

    Ties go to the stronger penalty. A sparse model that keeps more columns (or
    groups) than its batches can carry is moved to stronger penalties until it
    does not.
    """
    n, k = by_fold.shape[:2]
    total = by_fold.sum(1)
    train = np.concatenate([total[:, None] - by_fold, total[:, None]], 1)
    # A fold without rows, or that leaves too few, tells nothing; its place is taken by the whole.
    told = (by_fold[:, :, 0, 0] > 0) & (train[:, :k, 0, 0] >= 3)
    train[:, :k][~told] = np.broadcast_to(total[:, None], train[:, :k].shape)[~told]
    names, coef, intercept, path = candidates(model, train.reshape(-1, *train.shape[2:]), groups)
    coef, intercept = coef.reshape(n, k + 1, *coef.shape[1:]), intercept.reshape(n, k + 1, -1)
    w = np.concatenate([-intercept[:, :k, :, None], -coef[:, :k], np.ones((*intercept[:, :k].shape, 1))], 3)
    errors = (np.einsum("nkcq,nkqr,nkcr->nkc", w, by_fold, w, optimize=True) * told[:, :, None]).sum(1)
    pick = np.argmin(np.round(errors, 12), 1)
    if model in ("elastic_net", "lasso", "group_lasso"):
        kept = coef[:, k] != 0
        own = [[i] for i in range(coef.shape[-1])] if groups is None or model != "group_lasso" else groups
        size = np.stack([kept[:, :, list(g)].any(2) for g in own], 2).sum(2)
        for r in range(n):
            while size[r, pick[r]] > cap_of(total[r, 0, 0]) and pick[r] % path:
                pick[r] -= 1
    rows = np.arange(n)
    return [names[i] for i in pick], coef[rows, k, pick], intercept[rows, k, pick]


def tuned(model: str, by_fold: np.ndarray, groups: Sequence[Sequence[int]] | None = None) -> tuple[str, np.ndarray, float]:
    """:func:`tuned_many` of one replicate."""
    names, coef, intercept = tuned_many(model, by_fold[None], groups)
    return names[0], coef[0], float(intercept[0])


def held_out(model: str, by_fold: np.ndarray, groups: Sequence[Sequence[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per replicate and fold: settings, coefficients and intercepts of the model tuned and fitted without the fold."""
    n, k = by_fold.shape[:2]
    rest = np.stack([by_fold[:, [j for j in range(k) if j != i]] for i in range(k)], 1)
    names, coef, intercept = tuned_many(model, rest.reshape(n * k, k - 1, *by_fold.shape[2:]), groups)
    return np.array(names, dtype=object).reshape(n, k), coef.reshape(n, k, -1), intercept.reshape(n, k)


def q2_many(model: str, by_fold: np.ndarray, groups: Sequence[Sequence[int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per replicate the held-out Q2, and the squared error, of a model tuned and fitted without each fold in turn."""
    _, coef, intercept = held_out(model, by_fold, groups)
    w = np.concatenate([-intercept[:, :, None], -coef, np.ones((*intercept.shape, 1))], 2)
    error = np.einsum("nkq,nkqr,nkr->n", w, by_fold, w, optimize=True)
    total = by_fold.sum(1)
    sst = total[:, -1, -1] - total[:, 0, -1] ** 2 / total[:, 0, 0]
    return 1 - error / sst, error


def cross_validate(model: str, sums: Sums, groups: Sequence[Sequence[int]] | None = None) -> dict:
    """Held-out Q2 and error, every fold being predicted by a model tuned and fitted without it."""
    used = sums.by_fold[sums.by_fold[:, 0, 0] > 0]
    total = sums.total
    n, y = total[0, 0], total[0, -1]
    if len(used) < 2:
        raise Refusal("fewer than two groups of formulations")
    if n < 4 or total[-1, -1] - y * y / n <= 0:
        raise Refusal("too few or constant responses")
    q2, error = q2_many(model, used[None], groups)
    return {"model": model, "q2": float(q2[0]), "rmse": float(np.sqrt(max(error[0], 0) / n)), "n": int(n), "settings": held_out(model, used[None], groups)[0][0].tolist() if model != "ols" else []}


def permutation_null(rows: DataFrame, sums: Sums, model: str, permutations: int = 500, seed: int = SEED, block: int = PERMUTATION_BLOCK) -> DataFrame:
    """(permutation, q2): Q2 of complete refits to permuted responses.

    Responses are permuted among the rows of one hashed block of about
    ``block``; each block is small, and only products with the response are
    summed per permutation and fold.
    """
    p, folds = len(sums.columns), len(sums.by_fold)
    blocks = max(1, -(-int(sums.total[0, 0]) // block))

    def permuted(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("batch").reset_index(drop=True)
        z, fold = _design(pdf, p), pdf["fold"].to_numpy()
        lots = np.random.default_rng([seed + 1, int(key[0])])
        out = np.zeros((permutations, folds, p + 2))
        ys = np.stack([z[lots.permutation(len(z)), -1] for _ in range(permutations)])
        for k in range(folds):
            mine = fold == k
            out[:, k, :-1] = ys[:, mine] @ z[mine, :-1]
            out[:, k, -1] = (ys[:, mine] ** 2).sum(1)
        return pd.DataFrame({"permutation": np.arange(permutations), "part": [x.ravel() for x in out]})

    blocked = rows.withColumn("block", F.pmod(F.xxhash64("batch"), F.lit(blocks)).cast("int"))
    parts = blocked.groupBy("block").applyInPandas(permuted, "permutation int, part array<double>")

    def refit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), REFITS):
                some = pdf.iloc[at : at + REFITS]
                g = np.repeat(sums.by_fold[None], len(some), 0)
                new = np.stack(some["part"].to_numpy()).reshape(len(some), folds, p + 2)
                g[:, :, -1, :], g[:, :, :, -1] = new, new
                yield pd.DataFrame({"permutation": some["permutation"], "q2": q2_many(model, g[:, g[0, :, 0, 0] > 0])[0]})

    return spread(summed(parts, ["permutation"]), permutations, "permutation").mapInPandas(refit, "permutation int, q2 double")


def spread(table: DataFrame, n: int, key: str) -> DataFrame:
    """``table`` of ``n`` small rows, each a long computation, over as many tasks as there are cores."""
    return table.repartition(max(1, min(n, 4 * table.sparkSession.sparkContext.defaultParallelism)), key)


def permutation_summary(null: DataFrame, observed: float) -> DataFrame:
    """p = (1 + number of at least as good permutations) / (permutations + 1), and the null's median and 95th percentile."""
    m, better = F.count("q2"), F.count(F.when(F.col("q2") >= observed, 1))
    return null.agg(((better + 1) / (m + 1)).alias("p_value"), F.percentile("q2", 0.95).alias("null_p95"), F.percentile("q2", 0.5).alias("null_median"), m.alias("n_permutations"))


def stability(rows: DataFrame, columns: Sequence[str], model: str = "elastic_net", replicates: int = 500, folds: int = 5, seed: int = SEED, scheme: str = "formulation") -> DataFrame:
    """(feature, frequency, coef_median, coef_low, coef_high, n_replicates, label): how often refits to resampled batches keep a feature.

    Whole formulations, or with ``scheme`` "batch" single batches, get Poisson
    weights that depend on them and the replicate alone, so replicates need no
    shuffle of rows. Replicates that leave fewer than two folds are skipped.
    """
    if scheme not in ("formulation", "batch"):
        raise ValueError(f"unknown scheme {scheme!r}; formulation or batch")
    p = len(columns)
    i, j = np.triu_indices(p + 2)

    def weighted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((folds, replicates, len(i)))
        for pdf in frames:
            z, fold = _design(pdf, p), pdf["fold"].to_numpy()
            own, names = pd.factorize(pdf["unit"])
            w = np.stack([np.random.default_rng([seed, u & (2**63 - 1)]).poisson(1.0, replicates) for u in names.tolist()], 1).astype(float) if len(names) else np.zeros((replicates, 0))
            for k in range(folds):
                mine = np.flatnonzero(fold == k)
                for some in np.array_split(mine, -(-len(mine) // 1024)) if len(mine) else ():
                    total[k] += w[:, own[some]] @ (z[some][:, i] * z[some][:, j])
        for r in range(replicates):
            yield pd.DataFrame({"replicate": [r], "part": [total[:, r].ravel()]})

    unit = F.col("formulation") if scheme == "formulation" else F.xxhash64("batch")
    parts = rows.select(unit.alias("unit"), "fold", *[f"x{n}" for n in range(p)], "y").mapInPandas(weighted, "replicate int, part array<double>")

    def refit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), REFITS):
                some = pdf.iloc[at : at + REFITS]
                half = np.stack(some["part"].to_numpy()).reshape(len(some), folds, len(i))
                g = np.zeros((len(some), folds, p + 2, p + 2))
                g[:, :, i, j], g[:, :, j, i] = half, half
                kept = (g[:, :, 0, 0] > 0).sum(1) >= 2
                if kept.any():
                    coef = tuned_many(model, g[kept])[1]
                    yield pd.DataFrame({"replicate": np.repeat(some["replicate"].to_numpy()[kept], p), "feature": np.tile(list(columns), kept.sum()), "coef": coef.ravel()})

    fits = spread(summed(parts, ["replicate"]), replicates, "replicate").mapInPandas(refit, "replicate int, feature string, coef double")
    kept = F.avg(F.when(F.abs("coef") > 1e-10, 1.0).otherwise(0.0))
    out = fits.groupBy("feature").agg(kept.alias("frequency"), F.percentile("coef", 0.5).alias("coef_median"), F.percentile("coef", 0.025).alias("coef_low"), F.percentile("coef", 0.975).alias("coef_high"), F.count("*").alias("n_replicates"))
    return out.withColumn("label", F.when(F.col("frequency") >= STABLE, "stable").otherwise("UNSTABLE"))


def verdict(q2: float, p_value: float, n_stable: int, alpha: float = 0.05) -> str:
    """What may be said: nothing unless held-out prediction beats the permutation null."""
    if not q2 > 0 or p_value > alpha:
        return "not_supported"
    return "supported" if q2 >= 0.4 and n_stable >= 1 else "weak"


def validated(rows: DataFrame, columns: Sequence[str], model: str = "elastic_net", permutations: int = 500, replicates: int = 500, seed: int = SEED) -> DataFrame:
    """One row: held-out Q2 over whole formulations, over random rows (for comparison, never as a result), the permutation null, stable features, and the verdict."""
    sums = fold_sums(rows, columns)
    got = cross_validate(model, sums)
    folds = len(sums.by_fold)
    random = cross_validate(model, fold_sums(rows.withColumn("fold", F.pmod(F.xxhash64("batch", F.lit(seed)), F.lit(folds)).cast("int")), columns))
    null = permutation_summary(durable(permutation_null(rows, sums, model, permutations, seed)), got["q2"]).first()
    stable = [r.feature for r in stability(rows, columns, model, replicates, folds, seed).where(F.col("label") == "stable").select("feature").orderBy("feature").collect()]
    said = verdict(got["q2"], null.p_value, len(stable))
    out = (model, got["n"], got["q2"], got["rmse"], random["q2"], null.p_value, null.null_p95, null.n_permutations, stable, said)
    return rows.sparkSession.createDataFrame([out], "model string, n long, q2 double, rmse double, q2_random_rows double, p_value double, null_p95 double, n_permutations long, stable array<string>, verdict string")


SCHEMES = ("leave_one_formulation_out", "grouped_kfold_formulation", "leave_one_batch_out")


def split(rows: DataFrame, scheme: str) -> DataFrame:
    """``rows`` with ``fold`` as the scheme has it: a formulation, the number of a fold of formulations, or a batch. Fewer than two folds are refused."""
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}; one of {', '.join(SCHEMES)}")
    out = rows if scheme == "grouped_kfold_formulation" else rows.withColumn("fold", F.col("formulation" if scheme == "leave_one_formulation_out" else "batch"))
    if out.select("fold").distinct().limit(2).count() < 2:
        raise Refusal("fewer than two folds")
    return out


def held_out_line(rows: DataFrame, x: str = "x0") -> DataFrame:
    """``rows`` with ``prediction``: of each fold by the least squares line through all others, however many folds there are.

    Training sums are the total less those of the fold, so this is one
    aggregation, and a join that leaves the rows of a hot fold where they are.
    """
    parts = {"n": F.count("*").cast("double"), "x": F.sum(x), "y": F.sum("y"), "xx": F.sum(F.col(x) * F.col(x)), "xy": F.sum(F.col(x) * F.col("y"))}
    per = rows.groupBy("fold").agg(*[e.alias(f"_{k}") for k, e in parts.items()])
    total = per.agg(*[F.sum(f"_{k}").alias(k) for k in parts]).first()
    n, sx, sy, xx, xy = (F.lit(float(total[k])) - F.col(f"_{k}") for k in parts)
    slope = F.try_divide(xy - sx * sy / n, xx - sx * sx / n)
    lines = per.where(n >= 2).select("fold", slope.alias("_slope"), F.try_divide(sy, n).alias("_my"), F.try_divide(sx, n).alias("_mx"))
    return rows.join(lines, "fold").withColumn("prediction", F.col("_my") + F.col("_slope") * (F.col(x) - F.col("_mx"))).drop("_slope", "_my", "_mx")


def mixture_terms(wide: DataFrame, components: Sequence[str], shown=lambda x: x) -> DataFrame:
    """(batch, share of each component, product of every two): what is missing counts nothing in the sum, and a sum of 0 gives NULL."""
    total = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in components[1:]), F.coalesce(F.col(f"`{components[0]}`"), F.lit(0.0)))
    share = {c: F.try_divide(F.col(f"`{c}`"), total) for c in components}
    pairs = [(a, b) for k, a in enumerate(components) for b in components[k + 1 :]]
    return wide.select("batch", *[shown(x).alias(c) for c, x in share.items()], *[shown(share[a] * share[b]).alias(f"{a} x {b}") for a, b in pairs])


def _shares(rows: DataFrame, p: int) -> DataFrame:
    total = sum((F.col(f"x{i}") for i in range(1, p)), F.col("x0"))
    return rows.withColumn("_t", total).where("_t > 0").withColumns({f"x{i}": F.col(f"x{i}") / F.col("_t") for i in range(p)})


def mixture_fit(rows: DataFrame, components: Sequence[str]) -> np.ndarray:
    """Coefficients of the linear mixture model, tuned over ridge penalties by held-out error; at least two components are needed."""
    if len(components) < 2:
        raise Refusal("a mixture needs two components")
    return _tuned_scheffe(fold_sums(_shares(rows, len(components)), components))


def mixture_fit_quadratic(rows: DataFrame, components: Sequence[str]) -> tuple[list[str], np.ndarray]:
    """(terms, coefficients) of the mixture model with the products of every two components."""
    p = len(components)
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
    wider = _shares(rows, p).withColumns({f"x{p + k}": F.col(f"x{i}") * F.col(f"x{j}") for k, (i, j) in enumerate(pairs)})
    terms = [*components, *[f"{components[i]} x {components[j]}" for i, j in pairs]]
    return terms, _tuned_scheffe(fold_sums(wider, terms))


SCHEFFE_ALPHAS = (0.0, 1e-6, 1e-4, 1e-2, 0.1, 1.0)


def _tuned_scheffe(sums: Sums) -> np.ndarray:
    total = sums.total
    if total[0, 0] < 3:
        raise Refusal("fewer than three complete batches")
    errors = []
    for alpha in SCHEFFE_ALPHAS:
        held = [g for g in sums.by_fold if g[0, 0] > 0 and total[0, 0] - g[0, 0] >= 3]
        errors.append(np.mean([squared_error(g, scheffe(total - g, alpha), 0.0) / g[0, 0] for g in held]) if held else 0.0)
    return scheffe(total, SCHEFFE_ALPHAS[int(np.argmin(np.round(errors, 9)))])


def contrasts(components: Sequence[str], coef: Sequence[float]) -> list[tuple[str, str, float]]:
    """(a, b, coefficient of a less that of b) of every two components, the largest differences first."""
    out = [(a, b, float(coef[i] - coef[k])) for i, a in enumerate(components) for k, b in enumerate(components) if i < k]
    return sorted(out, key=lambda x: -abs(x[2]))


def per_unit(wide: DataFrame, plan: dict[str, list[str]], coef: dict[str, float]) -> DataFrame:
    """(variable, feature, per_unit, per_sd): what one unit, or one spread, of each column changes in a prediction from features.

    A cluster is the mean of its k members' z values, so a member's share of its coefficient is divided by k and by its spread.
    """
    columns = [c for m in plan.values() for c in m]
    sd = wide.agg(*[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    spread_of = {c: sd[f"s{i}"] or 0.0 for i, c in enumerate(columns)}
    pairs = pair_sums(wide, columns)
    r, at = pairs.corr(), {c: i for i, c in enumerate(columns)}
    rows = []
    for f, m in plan.items():
        b = coef.get(f, 0.0)
        for c in m:
            s = spread_of[c]
            if len(m) == 1:
                rows.append((c, f, b, b * s))
            elif s:
                turn = -1.0 if r[at[m[0]], at[c]] < 0 else 1.0
                rows.append((c, f, turn * b / (len(m) * s), turn * b / len(m)))
    return wide.sparkSession.createDataFrame(rows, "variable string, feature string, per_unit double, per_sd double")


def densest(coef: dict[str, float], spread_of: dict[str, float], n: float) -> list[str]:
    """Of a model that keeps every column, those with the largest effects, as many as ``n`` batches can carry."""
    return sorted(coef, key=lambda c: (-abs(coef[c] * spread_of.get(c, 1.0)), c))[: cap_of(n)]


def with_prediction(rows: DataFrame, coef: Sequence[float], intercept: float) -> DataFrame:
    """Adds ``prediction`` and the array ``contributions`` (of standardised-free terms) as column expressions."""
    terms = [F.col(f"x{i}") * F.lit(float(c)) for i, c in enumerate(coef)]
    total = F.lit(float(intercept))
    for t in terms:
        total = total + t
    return rows.withColumn("prediction", total)


def trees(rows: DataFrame, columns: Sequence[str], kind: str = "random_forest", seed: int = SEED) -> dict:
    """Held-out Q2 of tree ensembles, one fold left out at a time, with Spark's own learners; importances from all rows."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    names = [f"x{i}" for i in range(len(columns))]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("fold", "features", "y").cache()
    if kind == "random_forest":
        learner = RandomForestRegressor(labelCol="y", numTrees=60, maxDepth=3, featureSubsetStrategy="all", seed=seed)
    elif kind == "gbm":
        learner = GBTRegressor(labelCol="y", maxIter=30, stepSize=0.1, maxDepth=3, seed=seed)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    error = 0.0
    for fold in sorted(r.fold for r in data.select("fold").distinct().collect()):
        fitted = learner.fit(data.where(F.col("fold") != fold))
        error += fitted.transform(data.where(F.col("fold") == fold)).agg(F.sum((F.col("y") - F.col("prediction")) ** 2)).first()[0]
    stats = data.agg(F.count("*").alias("n"), F.var_pop("y").alias("v")).first()
    importance = [float(x) for x in learner.fit(data).featureImportances.toArray()]
    data.unpersist()
    return {"model": kind, "q2": 1 - error / (stats.n * stats.v), "n": stats.n, "importance": dict(zip(columns, importance, strict=True))}


def contributions(rows: DataFrame, columns: Sequence[str], coef: Sequence[float], means: Sequence[float]) -> DataFrame:
    """(batch, feature, contribution): what each feature adds to a linear prediction over the mean batch; exact Shapley values."""
    terms = [F.struct(F.lit(c).alias("feature"), ((F.col(f"x{i}") - F.lit(float(means[i]))) * F.lit(float(coef[i]))).alias("contribution")) for i, c in enumerate(columns)]
    return rows.select("batch", F.explode(F.array(*terms)).alias("t")).select("batch", "t.feature", "t.contribution")


def partial_dependence(rows: DataFrame, columns: Sequence[str], feature: str, coef: Sequence[float], intercept: float, points: int = 20) -> DataFrame:
    """(value, prediction): mean prediction of a linear model with one feature set to each of ``points`` values between its 2nd and 98th percentile.

    The mean over all rows needs only the other features' means, from one aggregation.
    """
    at = list(columns).index(feature)
    stats = rows.agg(F.percentile_approx(f"x{at}", [0.02, 0.98], 10000).alias("q"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(columns))]).first()
    if stats.q is None:
        raise Refusal("no rows to average over")
    rest = float(intercept) + sum(float(coef[i]) * stats[f"m{i}"] for i in range(len(columns)) if i != at)
    grid = np.linspace(stats.q[0], stats.q[1], points)
    return rows.sparkSession.createDataFrame([(float(v), float(rest + coef[at] * v)) for v in grid], "value double, prediction double")


def factorial_design(ranges: DataFrame, factors: Sequence[str], centres: int = 2) -> DataFrame:
    """(run, one column per factor): every combination of low and high, then centre points, from (variable, low, high). At most three factors."""
    if not 1 <= len(factors) <= 3:
        raise Refusal("one to three factors can be varied at a time")
    got = {r.variable: (r.low, r.high) for r in ranges.where(F.col("variable").isin(list(factors))).collect()}
    if gone := [f for f in factors if f not in got or got[f][0] is None]:
        raise Refusal("no observed range for " + ", ".join(gone))
    ends = [(lo, hi) if lo < hi else (lo - 0.1 * abs(lo or 1), lo + 0.1 * abs(lo or 1)) for lo, hi in (got[f] for f in factors)]
    runs = [[ends[k][(n >> k) & 1] for k in range(len(ends))] for n in range(2 ** len(ends))] + [[(a + b) / 2 for a, b in ends]] * centres
    return ranges.sparkSession.createDataFrame([(i + 1, *map(float, r)) for i, r in enumerate(runs)], "run int, " + ", ".join(f"`{f}` double" for f in factors))
