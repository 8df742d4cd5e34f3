"""Tables from files, pasted text and typed grids; blank tables to fill in; sinks."""

from __future__ import annotations

import csv
import importlib.util
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.errors import DataError

META_COLUMNS = ("formulation", "manufacturing_date", "scale", "equipment_train", "site", "operator_shift")
# The times at which a release profile is usually read, in hours.
PROFILE_TIMES = (0.25, 0.5, 1.0, 2.0, 4.0, 6.0, 8.0, 12.0)


def read_table(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A table by the suffix of its path, any case: .csv, .txt, .parquet, .json, or Excel where its reader is installed."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if suffix in ("csv", "txt"):
        return spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "json":
        return spark.read.json(path)
    if suffix in ("xlsx", "xlsm", "xls"):
        if importlib.util.find_spec("openpyxl") is None:
            raise DataError("Excel files need openpyxl, which is not installed; save the sheet as CSV")
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))
    raise ValueError(f"unsupported file type {suffix!r}")


def pasted(spark: SparkSession, text: str) -> DataFrame:
    """A small table pasted as text; tab, comma or semicolon is found from its first lines. All columns are inferred."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        raise DataError("nothing was pasted")
    try:
        mark = csv.Sniffer().sniff("\n".join(lines[:20]), delimiters="\t,;").delimiter
    except csv.Error:
        mark = ","
    rows = list(csv.reader(lines, delimiter=mark))
    width = len(rows[0])
    raw = spark.createDataFrame([(*r[:width], *[None] * (width - len(r))) for r in rows[1:]], T.StructType([T.StructField(c.strip(), T.StringType()) for c in rows[0]]))
    return raw.select(*[_inferred(raw, c) for c in raw.columns])


def _inferred(raw: DataFrame, name: str):
    text = F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
    bad = raw.select(text.alias("t")).where(F.col("t").isNotNull() & F.col("t").try_cast("double").isNull()).isEmpty()
    return (text.try_cast("double") if bad else text).alias(name)


def typed_grid(spark: SparkSession, rows: Sequence[Sequence], columns: Sequence[str]) -> DataFrame:
    """Hand-typed rows: ids and labels stay text, every other column is read as a number or left empty."""
    text = spark.createDataFrame([tuple(None if x is None else str(x) for x in r) for r in rows], T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    keep = {"batch", *META_COLUMNS}
    number = r"\A\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*\z"
    value = lambda c: F.when(F.col(f"`{c}`").rlike(number), F.trim(F.col(f"`{c}`")).try_cast("double"))
    return text.select(*[F.col(f"`{c}`") if c in keep else value(c).alias(c) for c in columns])


def blank_table(spark: SparkSession, variables: Iterable[str] = (), n_batches: int = 6, dates: bool = False) -> DataFrame:
    """An empty batch table: B001, B002 and so on, formulation, and the chosen variables not already there."""
    fixed = ["formulation", *(["manufacturing_date"] if dates else [])]
    names = [v for v in dict.fromkeys(variables) if v not in ("batch", *fixed)]
    ids = spark.range(n_batches).select(F.format_string("B%03d", F.col("id") + 1).alias("batch"))
    return ids.select("batch", *[F.lit(None).cast("string").alias(c) for c in fixed], *[F.lit(None).cast("double").alias(c) for c in names])


def blank_profiles(spark: SparkSession, batches: Sequence[str] = ("B001", "B002"), media: Sequence[str] = ("0.1N HCl",), times: Sequence[float] = PROFILE_TIMES) -> DataFrame:
    """An empty profile table: every batch in every medium at every time."""
    each = lambda xs: F.explode(F.array(*[F.lit(x) for x in xs]))
    rows = spark.range(1).select(each(batches).alias("batch")).select("batch", each(media).alias("medium"))
    return rows.select("batch", "medium", each([float(t) for t in times]).alias("time_h"), F.lit(None).cast("double").alias("percent_released"))


def split_single_table(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(measurements, metadata) of one combined table; it needs ``batch`` and ``formulation``."""
    for name in ("batch", "formulation"):
        if name not in df.columns:
            raise DataError(f"the table needs a column {name!r}; it has " + ", ".join(df.columns[:12]))
    meta = [c for c in META_COLUMNS if c in df.columns]
    return df.drop(*meta), df.select("batch", *meta)


def long_to_wide(rows: DataFrame, variables: Sequence[str], entity: str = "batch", variable: str = "variable", value: str = "value") -> DataFrame:
    """Long rows to one row per entity; a pair given more than once is an error, never aggregated."""
    if gone := [c for c in (entity, variable, value) if c not in rows.columns]:
        raise ValueError("missing columns: " + ", ".join(gone))
    twice = rows.groupBy(entity, variable).count().where("count > 1").orderBy(entity, variable).limit(10).collect()
    if twice:
        raise DataError("given more than once: " + ", ".join(f"{r[0]}/{r[1]}" for r in twice))
    return rows.groupBy(entity).pivot(variable, list(variables)).agg(F.first(value))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header; ``one_file`` only for tables that fit one task."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path) if by else df.write.mode("overwrite").parquet(path)
