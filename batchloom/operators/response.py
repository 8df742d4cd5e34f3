"""The response to be explained: its diagnostics, the screen of single predictors, and false-discovery control."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from batchloom.errors import Refusal
from batchloom.operators import profiles
from batchloom.operators.diagnostics import pair_sums
from batchloom.operators.longform import numeric_columns

LEAST_N, LEAST_RANGE_IN_SD = 3, 3.0


def diagnostics(cells: DataFrame, response: str, method_rsd_pct: float | None = None) -> DataFrame:
    """One row: observed, missing, extremes, spread, and whether the response can be modelled at all.

    It cannot with fewer than three values, a single value, or a range below
    three standard deviations of the measuring method.
    """
    v = F.col("value")
    out = cells.where(F.col("variable") == response).agg(
        F.count(v).alias("n_observed"),
        F.count(F.when(v.isNull(), 1)).alias("n_missing"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"),
    )
    span = F.col("max") - F.col("min")
    usable = (F.col("n_observed") >= LEAST_N) & (span > 0)
    if method_rsd_pct is not None:
        noise = F.lit(abs(method_rsd_pct) / 100) * F.abs("mean")
        usable = usable & ((noise == 0) | (span >= LEAST_RANGE_IN_SD * noise))
    return out.withColumn("range", span).withColumn("usable", F.coalesce(usable, F.lit(False)))


def two_sided_p(r: Column, n: Column) -> Column:
    """P value of a correlation by Student's t, through the incomplete beta function of the JVM's mathematics library."""
    x = F.greatest(F.lit(0.0), 1 - r * r)
    half = (n - 2) / F.lit(2.0)
    name, method = F.lit("org.apache.commons.math3.special.Beta"), F.lit("regularizedBeta")
    p = F.try_reflect(name, method, x.cast("double"), half.cast("double"), F.lit(0.5)).cast("double")
    return F.when(r.isNotNull() & (n > 2), F.when(x == 0, 0.0).otherwise(p))


def screen(wide: DataFrame, response: str) -> DataFrame:
    """(variable, n, r, t, p): correlation of every other numeric column of ``wide`` with the response, pairwise complete. A screen, not findings.

    All sums come from one pass that multiplies rows inside the tasks.
    """
    columns = numeric_columns(wide)
    pairs = pair_sums(wide, columns)
    corr, y = pairs.corr(), columns.index(response)
    rows = [(c, int(pairs.n[i, y]), None if np.isnan(corr[i, y]) else float(corr[i, y])) for i, c in enumerate(columns) if i != y and pairs.n[i, y]]
    out = wide.sparkSession.createDataFrame(rows, "variable string, n long, r double")
    t = F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2), F.sqrt(1 - F.col("r") * F.col("r")))
    return out.withColumns({"t": t, "p": two_sided_p(F.col("r"), F.col("n"))})


def with_q_values(tests: DataFrame) -> DataFrame:
    """Adds Benjamini-Hochberg ``q`` to (variable, p); a NULL p gets none and does not count. One row per test, so few."""
    everything = Window.partitionBy(F.lit(1))
    m = F.count("p").over(everything)
    rank = F.row_number().over(everything.orderBy(F.asc_nulls_last("p"), "variable"))
    ranked = tests.withColumns({"_m": m, "_k": rank})
    raw = F.when(F.col("p").isNotNull(), F.col("p") * F.col("_m") / F.col("_k"))
    back = everything.orderBy("_k").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return ranked.withColumn("_raw", raw).withColumn("q", F.when(F.col("p").isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(back)))).drop("_m", "_k", "_raw")


def nice_step(sd: Column) -> Column:
    """The smallest of 1, 2, 5 and 10 times a power of ten that is at least ``sd``; 1 where it is not positive."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(sd)))
    ratio = sd / base
    return F.when(sd.isNull() | (sd <= 0), 1.0).otherwise(base * F.when(ratio <= 1, 1.0).when(ratio <= 2, 2.0).when(ratio <= 5, 5.0).otherwise(10.0))


def complexity_cap(n: Column) -> Column:
    """Predictors that ``n`` batches can carry: one per five, from 1 to 10."""
    return F.greatest(F.lit(1), F.least(F.lit(10), F.floor(n / 5).cast("int")))


def from_profiles(points: DataFrame, metric: str, medium: str, reference: str | None = None, run_no: int = 1) -> DataFrame:
    """(batch, y): a metric of each batch's release curve in one medium; ``f1`` and ``f2`` are against the curve of ``reference``.

    Batches whose curve does not give the metric are left out, so without a
    curve in the medium, or a curve of the reference, there are no rows. An
    unknown metric, or one against a reference that is not named, is refused.
    """
    chosen = points.where((F.col("medium") == medium) & (F.col("run_no") == run_no))
    if metric in ("f1", "f2"):
        if reference is None:
            raise Refusal(f"{metric} needs a reference batch")
        out = profiles.similarity(chosen, reference)
    else:
        out = profiles.metrics(chosen)
    if metric not in out.columns:
        raise Refusal(f"unknown metric {metric!r}")
    return out.where(F.col(metric).isNotNull()).select("batch", F.col(metric).alias("y"))
