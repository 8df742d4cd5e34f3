"""Release profiles: curve metrics and similarity of curves.

A curve is (batch, medium, run_no); its points are (time_h, percent_released).
Missing values are left out. Curves have a handful of points, so windows and
groups over one curve stay small however many curves there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from batchloom.functions.domain import canonical_medium, finite, minute, squeezed

CURVE = ["batch", "medium", "run_no"]
FIRST_ORDER_TOP = 99.5  # percent from which a point says nothing on the rate
BOTH_ABOVE = 85.0


def points(dissolution: DataFrame) -> DataFrame:
    """One point per curve and time, spellings and inexact times brought together; where readings contradict one another there is none."""
    rows = dissolution.select(
        squeezed(F.col("batch")).alias("batch"),
        canonical_medium(F.col("medium")).alias("medium"),
        "run_no",
        minute(F.col("time_h")).alias("time_min"),
        (finite(F.col("percent_released")) + F.lit(0.0)).alias("y"),
    ).where("batch is not null and y is not null and time_min is not null")
    once = rows.groupBy(*CURVE, "time_min").agg(F.min("y").alias("y"), F.max("y").alias("_other")).where("y = _other")
    return once.drop("_other").withColumn("t", F.col("time_min") / 60.0)


def with_previous(pts: DataFrame) -> DataFrame:
    """Adds the point before, (0, 0) for the first."""
    order = Window.partitionBy(*CURVE).orderBy("t")
    return pts.withColumns({"t0": F.lag("t", 1, 0.0).over(order), "y0": F.lag("y", 1, 0.0).over(order), "at": F.row_number().over(order)})


def metrics(pts: DataFrame) -> DataFrame:
    """Per curve: points, mean dissolution time, dissolution efficiency, times to 50 and 80 percent, first-order rate.

    All come from one window and one aggregation over the same partitioning.
    A curve that never reaches a target has NULL there; nothing is extrapolated.
    """
    rows = with_previous(pts)
    rise = F.col("y") - F.col("y0")
    enough = F.count("*") >= 2

    def reached(target: float):
        slope = F.try_divide(F.lit(target) - F.col("y0"), rise)
        inner = F.when(rise == 0, F.col("t")).otherwise(F.col("t0") + slope * (F.col("t") - F.col("t0")))
        first = F.when(F.col("y") <= 0, F.col("t")).otherwise(F.col("t") * F.try_divide(F.lit(target), F.col("y")))
        crossing = F.when(F.col("at") == 1, first).otherwise(inner)
        return F.when(enough, F.min_by(F.when(F.col("y") >= target, crossing), F.when(F.col("y") >= target, F.col("at"))))

    fit = (F.col("y") > 0) & (F.col("y") < FIRST_ORDER_TOP)
    z = -F.ln(1 - F.col("y") / 100)
    mdt = F.try_divide(F.sum((F.col("t") + F.col("t0")) / 2 * rise), F.sum(rise))
    area = F.sum((F.col("y") + F.col("y0")) / 2 * (F.col("t") - F.col("t0")))
    return rows.groupBy(*CURVE).agg(
        F.count("*").alias("n_time_points"),
        F.when(enough & (F.sum(rise) > 0), mdt).alias("mdt"),
        F.when(enough & (F.max("t") > 0), F.try_divide(area, F.max("t"))).alias("dissolution_efficiency"),
        reached(50.0).alias("t50"),
        reached(80.0).alias("t80"),
        F.when(F.count(F.when(fit, 1)) >= 3, F.try_divide(F.sum(F.when(fit, F.col("t") * z)), F.sum(F.when(fit, F.col("t") * F.col("t"))))).alias("first_order_k"),
    )


def spread_across_media(table: DataFrame, metric: str = "mdt") -> DataFrame:
    """Per batch and run: largest less smallest value of a metric over at least two media."""
    known = table.where(F.col(metric).isNotNull())
    return known.groupBy("batch", "run_no").agg(F.count("*").alias("n_media"), (F.max(metric) - F.min(metric)).alias("spread")).where("n_media >= 2")


def similarity(pts: DataFrame, reference: str) -> DataFrame:
    """f2 and f1 of every curve against the curve of run 1 of batch ``reference`` in the same medium.

    The reference is one batch's first run, at most a grid of times per medium,
    so it is broadcast.
    """
    ref = pts.where((F.col("batch") == reference) & (F.col("run_no") == 1)).select("medium", "time_min", F.col("y").alias("r"))
    both = pts.join(F.broadcast(ref), ["medium", "time_min"])
    gap = F.col("r") - F.col("y")
    enough = F.count("*") >= 3
    f2 = 50 * F.log10(100 / F.sqrt(1 + F.avg(gap * gap)))
    return both.groupBy(*CURVE).agg(
        F.count("*").alias("n_points"),
        F.when(enough, f2).alias("f2"),
        F.when(enough & (F.sum("r") > 0), 100 * F.try_divide(F.sum(F.abs(gap)), F.sum("r"))).alias("f1"),
        F.count(F.when((F.col("r") > BOTH_ABOVE) & (F.col("y") > BOTH_ABOVE), 1)).alias("n_both_above_85"),
    )


def compared(pts: DataFrame, reference: str, test: str) -> DataFrame:
    """Point by point: two batches' first runs in the media and at the times they share."""
    pick = lambda batch, name: pts.where((F.col("batch") == batch) & (F.col("run_no") == 1)).select("medium", "time_min", F.col("y").alias(name))
    both = pick(reference, "reference").join(pick(test, "test"), ["medium", "time_min"])
    return both.withColumn("difference", F.col("test") - F.col("reference"))


def _released(t: np.ndarray, td: np.ndarray, beta: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 100 * (1 - np.exp(-((t / td[:, None]) ** beta[:, None])))


def weibull_batch(t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(td, beta, r2) of many curves at once, rows padded with NaN: damped least squares within bounds."""
    seen = np.isfinite(t) & np.isfinite(y)
    ts, ys = np.where(seen, t, 1.0), np.where(seen, y, 0.0)
    td = np.maximum(np.array([np.median(a[m]) if m.any() else 1.0 for a, m in zip(t, seen, strict=True)]), 1e-3)
    beta, damp = np.ones(len(t)), np.full(len(t), 1e-2)

    def loss(td: np.ndarray, beta: np.ndarray) -> np.ndarray:
        return np.where(seen, ys - _released(ts, td, beta), 0.0)

    res = loss(td, beta)
    sse = (res**2).sum(1)
    for _ in range(80):
        ratio = np.maximum(ts / td[:, None], 1e-12)
        power = ratio ** beta[:, None]
        decay = 100 * np.exp(-np.minimum(power, 700)) * power
        # In the logarithm of td and in beta, so that steps keep td positive.
        j1 = np.where(seen, -decay * beta[:, None], 0.0)
        j2 = np.where(seen, decay * np.log(ratio), 0.0)
        a, b, c = (j1 * j1).sum(1), (j1 * j2).sum(1), (j2 * j2).sum(1)
        g1, g2 = (j1 * res).sum(1), (j2 * res).sum(1)
        a, c = a * (1 + damp) + 1e-12, c * (1 + damp) + 1e-12
        det = np.maximum(a * c - b * b, 1e-300)
        new_td = np.clip(td * np.exp(np.clip((c * g1 - b * g2) / det, -1, 1)), 1e-4, 1e4)
        new_beta = np.clip(beta + np.clip((a * g2 - b * g1) / det, -0.5, 0.5), 0.05, 10)
        new_res = loss(new_td, new_beta)
        new_sse = (new_res**2).sum(1)
        better = new_sse < sse
        gain = np.where(better, sse - new_sse, 0)
        td, beta = np.where(better, new_td, td), np.where(better, new_beta, beta)
        res, sse = np.where(better[:, None], new_res, res), np.where(better, new_sse, sse)
        damp = np.where(better, damp / 5, np.minimum(damp * 4, 1e8))
        if (gain <= 1e-12 * (1 + sse)).all() and (damp > 1).all():
            break
    n = np.maximum(seen.sum(1), 1)
    mean = ys.sum(1) / n
    sst = np.where(seen, (ys - mean[:, None]) ** 2, 0).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = np.where(sst > 0, 1 - sse / sst, np.nan)
    usable = (seen.sum(1) >= 3) & (np.where(seen, y, -1).max(1, initial=-1) > 0)
    return np.where(usable, td, np.nan), np.where(usable, beta, np.nan), np.where(usable, r2, np.nan)


def weibull(pts: DataFrame) -> DataFrame:
    """Per curve: weibull_td, weibull_beta and weibull_r2; NULL with fewer than three points or nothing released."""
    kind = dict(pts.dtypes)["run_no"]
    packed = pts.groupBy(*CURVE).agg(F.sort_array(F.collect_list(F.struct("t", "y"))).alias("p"))
    packed = packed.select(*CURVE, F.transform("p", lambda x: x["t"]).alias("t"), F.transform("p", lambda x: x["y"]).alias("y"))

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            width = max(len(x) for x in pdf["t"])
            pad = lambda col: np.array([np.r_[np.asarray(x, dtype=float), np.full(width - len(x), np.nan)] for x in col])
            td, beta, r2 = weibull_batch(pad(pdf["t"]), pad(pdf["y"]))
            out = pdf[CURVE].copy()
            for name, v in (("weibull_td", td), ("weibull_beta", beta), ("weibull_r2", r2)):
                out[name] = pd.array(v, dtype="Float64")
                out.loc[~np.isfinite(v), name] = pd.NA
            yield out

    return packed.mapInPandas(fit, f"batch string, medium string, run_no {kind}, weibull_td double, weibull_beta double, weibull_r2 double")


def validation_issues(dissolution: DataFrame, batches: DataFrame) -> DataFrame:
    """(code, severity, n_rows): what is wrong with the readings, which are all kept.

    ``batches`` (batch) lists the known batches.
    """
    rows = dissolution.select(squeezed(F.col("batch")).alias("k"), finite(F.col("percent_released")).alias("y"))
    known = batches.select(squeezed(F.col("batch")).alias("k")).where("k is not null").distinct()
    absent = known.join(rows.select("k").distinct(), "k", "left_anti").agg(F.count("*").alias("n_rows"))
    per_batch = rows.groupBy("k").agg(F.count("*").alias("n"))
    unknown = per_batch.join(known, "k", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
    outside = rows.agg(F.count(F.when((F.col("y") < -1) | (F.col("y") > 130), 1)).alias("n_rows"))
    row = lambda df, code, severity: df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("n_rows").cast("long").alias("n_rows"))
    return row(unknown, "DISSOLUTION_UNKNOWN_BATCH", "WARNING").union(row(absent, "NO_DISSOLUTION_FOR_BATCH", "INFO")).union(row(outside, "DISSOLUTION_OUT_OF_RANGE", "WARNING"))
