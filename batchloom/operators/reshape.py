"""Attribute-value rows into one row per entity with typed columns.

The grid of entities by attributes is completed, values are left joined onto
it, collected in attribute order and projected to columns by position. Cells
whose readings contradict one another carry both through the same grid and
lists, are reported from there and left empty in the wide table, never merged.

Defined results for odd input: a NULL or NaN value is no reading, so an entity
with nothing else keeps its row with empty columns; rows without entity or
attribute are left out; equal readings count once; an attribute outside the
list gets no column but is still checked for contradictions; an empty table
gives empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.functions.domain import canonical_medium, finite, minute, squeezed
from batchloom.session import durable, setting


@dataclass(frozen=True)
class Reshaped:
    wide: DataFrame  # entity columns and one column per attribute
    contradictions: DataFrame  # entity columns, attribute, n_values


def to_wide(rows: DataFrame, entity: Sequence[str], attribute: str, value: Column, attributes: Sequence[tuple[object, str, str]]) -> Reshaped:
    """``attributes`` lists (attribute value, column name, column type) in column order.

    Repeated and contradicting cells are settled by one aggregation that is
    combined before the shuffle, so that a hot entity or a cell sent a million
    times costs no more than any other. Entities are whatever ``entity``
    names; an entity's list has one place per different attribute it has or
    is to have, so no collected array can grow with the number of rows.

    After that aggregation all is laid out by entity once: the grid, the join
    and the lists stay where they are. The finished lists are written to the
    shared folder, and both results read them.
    """
    entity = list(entity)
    spark = rows.sparkSession
    keyed = rows.where(F.expr(" and ".join(f"`{c}` is not null" for c in [*entity, attribute])))
    keyed = keyed.select(*entity, F.col(attribute).alias("_attribute"), value.alias("_value"))
    # Of a cell only its smallest and largest reading are kept: more than one reading means they differ.
    cells = keyed.groupBy(*entity, "_attribute").agg(F.min("_value").alias("_value"), F.max("_value").alias("_other")).repartition(*entity)
    kind = dict(rows.dtypes)[attribute]
    places = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(a).alias("name")) for i, (a, _, _) in enumerate(attributes)]).cast(f"array<struct<at:int,name:{kind}>>")
    grid = keyed.select(*entity).distinct().select(*entity, F.explode(places).alias("p")).select(*entity, F.col("p.name").alias("_attribute"), F.col("p.at").alias("_at"))
    # A contradicting cell keeps both readings as far as the list; a cell beyond the grid is kept where it contradicts itself.
    filled = grid.join(cells, [*entity, "_attribute"], "full").where("_at is not null or _value <> _other")
    with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        cell = F.struct(F.col("_at").isNull().alias("beyond"), "_at", "_attribute", "_value", "_other")
        lists = durable(filled.groupBy(*entity).agg(F.sort_array(F.collect_list(cell)).alias("_cells")))
    contradicting = lists.select(*entity, F.explode(F.filter("_cells", lambda c: c["_value"] != c["_other"])).alias("c")).select(*entity, F.col("c._attribute").alias(attribute))
    at = lambda i: F.get("_cells", F.lit(i))
    columns = [F.when(at(i)["_value"] == at(i)["_other"], at(i)["_value"].try_cast(to)).alias(name) for i, (_, name, to) in enumerate(attributes)]
    return Reshaped(lists.select(*entity, *columns), contradicting)


def readings(dissolution: DataFrame) -> DataFrame:
    """(batch_key, medium, run_no, time_min, reading) with spellings brought together; other columns are dropped."""
    return dissolution.select(
        squeezed(F.col("batch")).alias("batch_key"),
        canonical_medium(F.col("medium")).alias("medium"),
        "run_no",
        minute(F.col("time_h")).alias("time_min"),
        (finite(F.col("percent_released")) + F.lit(0.0)).alias("reading"),
    )


def named_as_listed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Replace ``batch_key`` by the batch as ``names`` (batch) writes it; a batch not listed keeps its key.

    Only keys that are not plain batch ids can be written differently from
    the key, so the rest of ``names`` is filtered out before the join.
    """
    listed = names.select("batch").where("batch is not null").withColumn("_key", squeezed(F.col("batch"))).where("batch <> _key")
    listed = listed.groupBy("_key").agg(F.min("batch").alias("_listed"))
    joined = rows.join(listed, F.col("batch_key") == F.col("_key"), "left")
    return joined.withColumn("batch_key", F.coalesce("_listed", "batch_key")).withColumnRenamed("batch_key", "batch").drop("_key", "_listed")


def curves_wide(dissolution: DataFrame, minutes: Sequence[int]) -> Reshaped:
    """One row per curve (batch_key, medium, run_no) with a double column ``t_<minute>`` per time point."""
    attributes = [(int(m), f"t_{m}", "double") for m in minutes]
    return to_wide(readings(dissolution), ["batch_key", "medium", "run_no"], "time_min", F.col("reading"), attributes)


def time_points(dissolution: DataFrame) -> list[int]:
    """The minutes at which curves are read, in order: every whole minute that a row is rounded to, however few there are."""
    return [r.m for r in dissolution.select(minute(F.col("time_h")).alias("m")).where("m is not null").distinct().orderBy("m").collect()]
