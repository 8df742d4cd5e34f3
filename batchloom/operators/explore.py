"""Questions a batch table answers without a model: summaries, comparisons, trends and limits.

All work on the long form (batch, variable, value), so that p columns cost one
grouped aggregation, not p.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from batchloom.errors import Refusal
from batchloom.operators.longform import exact_quantile

TINY = 1e-12


def describe(cells: DataFrame) -> DataFrame:
    """Per variable with any value: n, mean, sd, relative sd in percent, min, max, range."""
    mean, sd = F.avg("value"), F.stddev_samp("value")
    return cells.where("value is not null").groupBy("variable").agg(
        F.count("*").alias("n"),
        mean.alias("mean"),
        sd.alias("sd"),
        F.when(F.abs(mean) > TINY, 100 * F.try_divide(sd, F.abs(mean))).alias("rsd_pct"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.max("value") - F.min("value")).alias("range"),
    )


def replication(cells: DataFrame) -> DataFrame:
    """Per variable: distinct values, extremes, spread and missing cells, and whether it varies at all.

    Distinct values are counted in two steps so that one variable's values are spread over all tasks.
    """
    per_value = cells.groupBy("variable", "value").agg(F.count("*").alias("c"))
    n = F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("c"))), F.lit(0))
    total = F.sum(F.col("c") * F.col("value"))
    mean = F.try_divide(total, n)
    out = per_value.groupBy("variable").agg(
        F.count("value").alias("n_distinct"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("c"))), F.lit(0)).alias("n_missing"),
    )
    spread = cells.groupBy("variable").agg(F.stddev_samp("value").alias("sd"), F.avg("value").alias("mean"))
    joined = out.join(spread, "variable")
    return joined.select("variable", "n_distinct", "min", "max", (F.col("max") - F.col("min")).alias("range"), "sd", F.when(F.col("mean") != 0, F.abs(F.try_divide(F.col("sd"), F.col("mean")))).alias("cv"), "n_missing", (F.col("n_distinct") > 1).alias("informative"))


def missingness(cells: DataFrame) -> DataFrame:
    """Per variable with missing cells: how many, and their fraction."""
    gone = F.count(F.when(F.col("value").isNull(), 1))
    return cells.groupBy("variable").agg(gone.alias("n_missing"), (gone / F.count("*")).alias("fraction")).where("n_missing > 0")


def column_issues(cells: DataFrame, high_missing: float = 0.40) -> DataFrame:
    """(variable, code): columns that are all missing, constant, or missing in more than ``high_missing`` of the batches."""
    per = cells.groupBy("variable").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("all"))
    codes = F.array_compact(F.array(
        F.when(F.col("n") == 0, "ALL_MISSING_COLUMN"),
        F.when((F.col("n") > 0) & (F.col("lo") == F.col("hi")), "CONSTANT_COLUMN"),
        F.when((F.col("n") > 0) & ((F.col("all") - F.col("n")) / F.col("all") > high_missing), "HIGH_MISSINGNESS"),
    ))
    return per.select("variable", F.explode(codes).alias("code"))


def imputed(cells: DataFrame, method: str) -> DataFrame:
    """Missing cells filled per variable with its ``median`` or ``mean``, and marked. Only on request; anything else is refused."""
    if method not in ("median", "mean"):
        raise ValueError(f"unknown method {method!r}; median or mean")
    fill = exact_quantile(cells).withColumnRenamed("quantile", "fill") if method == "median" else cells.groupBy("variable").agg(F.avg("value").alias("fill"))
    joined = cells.join(F.broadcast(fill), "variable", "left")  # one row per column
    return joined.select("batch", "variable", F.coalesce("value", "fill").alias("value"), (F.col("value").isNull() & F.col("fill").isNotNull()).alias("filled"))


def imputation_log(filled: DataFrame, method: str) -> DataFrame:
    """(column_name, method, fill_value, n_filled) of what :func:`imputed` did."""
    done = filled.where("filled").groupBy("variable").agg(F.min("value").alias("fill_value"), F.count("*").alias("n_filled"))
    return done.select(F.col("variable").alias("column_name"), F.lit(method).alias("method"), "fill_value", "n_filled")


def complete_batches(cells: DataFrame, variables: Sequence[str]) -> DataFrame:
    """The batches that have a value in every one of ``variables``."""
    chosen = cells.where(F.col("variable").isin(list(variables)) & F.col("value").isNotNull())
    return chosen.groupBy("batch").agg(F.count("*").alias("n")).where(F.col("n") == len(set(variables))).select("batch")


def compare(cells: DataFrame, families: DataFrame, batches: Sequence[str]) -> DataFrame:
    """One row per variable, one column per batch. A batch that does not exist is a :class:`Refusal`."""
    chosen = cells.where(F.col("batch").isin(list(batches)))
    known = {r.batch for r in chosen.select("batch").distinct().collect()}
    if gone := [b for b in batches if b not in known]:
        raise Refusal("not in the table: " + ", ".join(gone))
    rows = chosen.groupBy("variable").pivot("batch", list(batches)).agg(F.first("value"))
    return rows.join(F.broadcast(families.select("variable", "family")), "variable", "left").select("variable", "family", *batches)


def what_changed(cells: DataFrame, a: str, b: str, least_for_sd: int = 5, min_pct: float | None = None) -> DataFrame:
    """Per variable known in both batches: difference, percent, how many sds of all batches it is, and its place.

    Places go by the size of z, or, where that is unknown for all, of the
    percentage, then by name. With ``min_pct`` smaller or unknown percentages are left out.
    """
    if a == b:
        raise Refusal("a batch cannot be compared with itself")
    per = cells.groupBy("variable").agg(
        F.max(F.when(F.col("batch") == a, F.col("value"))).alias("a"),
        F.max(F.when(F.col("batch") == b, F.col("value"))).alias("b"),
        F.when(F.count("value") >= least_for_sd, F.stddev_samp("value")).alias("sd"),
    )
    both = per.where("a is not null and b is not null").withColumn("difference", F.col("b") - F.col("a"))
    percent = F.when(F.abs("a") > TINY, 100 * F.try_divide(F.col("difference"), F.abs("a")))
    z = F.when(F.col("sd") > TINY, F.try_divide(F.col("difference"), F.col("sd")))
    out = both.select("variable", "a", "b", "difference", percent.alias("percent"), z.alias("z"), (F.col("difference") != 0).alias("changed"))
    if min_pct is not None:
        out = out.where(F.abs("percent") >= min_pct)
    order = Window.orderBy(F.desc_nulls_last(F.round(F.abs("z"), 9)), F.desc_nulls_last(F.round(F.abs("percent"), 9)), "variable")  # one row per variable
    return out.withColumn("place", F.row_number().over(order))


def trend(cells: DataFrame, labels: DataFrame, variable: str, bucket_days: int = 30) -> DataFrame:
    """(batch, manufacturing_date, value, place): one variable in the order of manufacture, undated batches last.

    Places come from counts per period and ranks within it, so that the whole
    table is never sorted in one task; ties are in order of the batch id.
    """
    rows = cells.where((F.col("variable") == variable) & F.col("value").isNotNull()).select("batch", "value").join(labels.select("batch", "manufacturing_date"), "batch", "left")
    rows = rows.withColumn("_p", F.coalesce(F.floor(F.unix_date(F.to_date("manufacturing_date")) / bucket_days), F.lit(2**40)))
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")  # one row per period
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(F.asc_nulls_last("manufacturing_date"), "batch"))
    return rows.withColumn("_r", rank).join(F.broadcast(before), "_p").select("batch", "manufacturing_date", "value", (F.col("_b") + F.col("_r")).alias("place"))


def limit_status(value: Column, low: Column, high: Column) -> Column:
    """Bounds are inclusive, a NULL bound is none."""
    return F.when(value.isNull(), "no result").when(value < low, "BELOW limit").when(value > high, "ABOVE limit").otherwise("within limits")


def spec_check(cells: DataFrame, limits: DataFrame) -> DataFrame:
    """(variable, batch, value, status) of every cell against ``limits`` (variable, low, high), one row per variable."""
    bounds = F.broadcast(limits.select("variable", "low", "high"))
    return cells.join(bounds, "variable").select("variable", "batch", "value", limit_status(F.col("value"), F.col("low"), F.col("high")).alias("status"))
