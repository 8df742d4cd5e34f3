"""The long form of a batch table, (batch, variable, value), on which per-column work is one grouped aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from batchloom.functions.domain import finite, formulation_number, usable_word

PREDICTOR_FAMILIES = ("MATERIAL", "FORMULATION", "PROCESS", "IPQC_PHYSICAL")


def numeric_columns(wide: DataFrame, batch_col: str = "batch") -> list[str]:
    return [c for c, kind in wide.dtypes if c != batch_col and kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal")]


def unpivoted(wide: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(batch, variable, value): one row per cell, NULL where there is no finite number."""
    columns = list(numeric_columns(wide) if columns is None else columns)
    if not columns:
        return wide.select("batch", F.lit("").alias("variable"), F.lit(None).cast("double").alias("value")).where("false")
    entries = F.array(*[F.struct(F.lit(c).alias("variable"), finite(F.col(f"`{c}`").cast("double")).alias("value")) for c in columns])
    return wide.select("batch", F.explode(entries).alias("c")).select("batch", "c.variable", "c.value")


def clean_wide(wide: DataFrame, families: DataFrame) -> DataFrame:
    """One row per batch: of each measured column the smallest value within its bounds; out of bounds counts as missing.

    ``families`` (variable, low, high) has one row per column.
    """
    columns = numeric_columns(wide)
    bounds = {r.variable: (r.low, r.high) for r in families.where(F.col("variable").isin(columns)).collect()}

    def usable(c: str) -> Column:
        value = finite(F.col(f"`{c}`").cast("double"))
        low, high = bounds.get(c, (None, None))
        bad = F.lit(False)
        if low is not None and low == low:
            bad = bad | (value < low)
        if high is not None and high == high:
            bad = bad | (value > high)
        return F.when(~bad, value)

    return wide.where("batch is not null").groupBy("batch").agg(*[F.min(usable(c)).alias(c) for c in columns])


def batch_labels(metadata: DataFrame) -> DataFrame:
    """One row per batch: formulation number, train and manufacturing date, of several the smallest."""
    return metadata.where("batch is not null").groupBy("batch").agg(
        F.min(formulation_number(F.col("formulation"))).alias("formulation"),
        F.min(usable_word(F.col("equipment_train"))).alias("equipment_train"),
        F.min("manufacturing_date").alias("manufacturing_date"),
    )


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson's r of the rows where both are known, NULL below three of them or where one side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count(a)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    # A constant side leaves rounding dust; its extremes say so exactly.
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when((n >= 3) & varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _bracketed(cells: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """(keys, part, low, high): the values that enclose the quantile, ``part`` of the way between them, without gathering a group's values.

    A sketch brackets the quantile; only the values inside the bracket are
    counted exactly, each different value once.
    """
    keys = list(keys)
    known = cells.where("value is not null").select(*keys, "value")
    edges = [max(0.0, share - 0.002), min(1.0, share + 0.002)]
    near = known.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("value", edges, 10000).alias("e"))
    position = (F.col("n") - 1) * F.lit(share)
    near = near.select(*keys, F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"), F.floor(position).alias("k"), (position - F.floor(position)).alias("part"))
    marked = known.join(F.broadcast(near), keys)  # one row per column or hot group
    counted = marked.groupBy(*keys, "k", "part", F.when(F.col("value") < F.col("lo"), F.lit(None).cast("double")).otherwise(F.when(F.col("value") <= F.col("hi"), F.col("value")).otherwise(F.lit(float("inf")))).alias("value")).agg(F.count("*").alias("c"))
    # The bracket's neighbours are needed where few values leave one of the two ranks just outside it.
    beyond = marked.groupBy(*keys).agg(F.min(F.when(F.col("value") > F.col("hi"), F.col("value"))).alias("next"), F.max(F.when(F.col("value") < F.col("lo"), F.col("value"))).alias("prev"))
    inside = counted.where("value is null or value < double('inf')")
    running = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("value"))
    ranked = inside.withColumn("upto", F.sum("c").over(running)).join(F.broadcast(beyond), keys).withColumn("value", F.coalesce("value", "prev"))
    at = lambda k: F.min_by("value", F.when(F.col("upto") > k, F.col("upto")))
    return ranked.groupBy(*keys, "k", "part").agg(at(F.col("k")).alias("low"), F.coalesce(at(F.col("k") + 1), F.min("next"), at(F.col("k"))).alias("high"))


def exact_quantile(cells: DataFrame, share: float = 0.5) -> DataFrame:
    """(variable, quantile): exact quantile with linear interpolation."""
    out = _bracketed(cells, ["variable"], share)
    return out.select("variable", (F.col("low") + F.col("part") * (F.col("high") - F.col("low"))).alias("quantile"))


def exact_middles(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, low, high): the two values in the middle of each group's sorted ``value``, one and the same where their number is odd."""
    out = _bracketed(cells, keys, 0.5)
    return out.select(*keys, "low", F.when(F.col("part") > 0, F.col("high")).otherwise(F.col("low")).alias("high"))
