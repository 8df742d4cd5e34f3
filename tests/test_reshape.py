from __future__ import annotations

from pyspark.sql import functions as F

from batchloom.operators.reshape import curves_wide, named_as_listed, time_points, to_wide

ROWS = "batch string, medium string, run_no int, time_h double, percent_released double, instrument string, loaded_at timestamp, _value int, low int"


def dissolution(spark, rows):
    return spark.createDataFrame([(*r, None, None, 1, 2) for r in rows], ROWS)


def test_curves(spark):
    rows = [
        ("b0000 0001", "0.1 n HCL", 1, 0.2501, 5.0), ("B00000001", "0.1N HCl", 1, 0.25, 5.0),  # one cell twice, equal
        ("B00000001", "0.1N HCl", 1, 0.5, 9.0), ("B00000001", "0.1N HCl", 1, 0.4999, 9.5),  # contradicting
        ("B00000001", "0.1N HCl", 1, 1.0, float("nan")), ("B00000001", "0.1N HCl", 1, 1.0, 20.0), ("B00000002", "pH6.8phosphate", 2, 1.0, None),
        (None, "0.1N HCl", 1, 1.0, 3.0), ("B00000001", None, 1, 1.0, 3.0), ("B00000001", "0.1N HCl", 1, None, 3.0),
    ]
    got = curves_wide(dissolution(spark, rows), [15, 30, 60])
    wide = {(r.batch_key, r.medium, r.run_no): (r.t_15, r.t_30, r.t_60) for r in got.wide.collect()}
    assert wide == {("B00000001", "0.1N HCl", 1): (5.0, None, 20.0), ("B00000002", "pH 6.8 phosphate", 2): (None, None, None)}
    assert [tuple(r) for r in got.contradictions.collect()] == [("B00000001", "0.1N HCl", 1, 30)]


def test_time_points_and_empty(spark):
    assert time_points(dissolution(spark, [("B1", "m", 1, 0.5, 1.0), ("B1", "m", 1, 1.0, None)])) == [30, 60]
    empty = curves_wide(dissolution(spark, []), [15])
    assert empty.wide.count() == 0 and empty.contradictions.count() == 0 and time_points(dissolution(spark, [])) == []


def test_rare_time_points_are_kept(spark):
    many = spark.range(30_000).selectExpr("concat('B', id) as batch", "'0.1N HCl' as medium", "1 as run_no", "0.5D as time_h", "1D as percent_released")
    rare = spark.createDataFrame([("B1", "0.1N HCl", 1, 0.75, 5.0)], many.schema)
    rows = many.union(rare)
    assert time_points(rows) == [30, 45]
    assert curves_wide(rows, time_points(rows)).wide.where("batch_key = 'B1'").first().t_45 == 5.0


def test_types_are_tried(spark):
    rows = spark.createDataFrame([("e", "a", "1.5"), ("e", "b", "x"), ("f", "b", "7")], "e string, k string, v string")
    got = {r.e: (r.a, r.b) for r in to_wide(rows, ["e"], "k", F.col("v"), [("a", "a", "double"), ("b", "b", "int")]).wide.collect()}
    assert got == {"e": (1.5, None), "f": (None, 7)}


def test_names_as_listed(spark):
    rows = spark.createDataFrame([("B00000001-R1",), ("B00000002",), ("B00000003/1",)], "batch_key string")
    names = spark.createDataFrame([("B00000001-r1",), ("B00000002",), (None,), ("B00000001-r1",)], "batch string")
    assert {r.batch for r in named_as_listed(rows, names).collect()} == {"B00000001-r1", "B00000002", "B00000003/1"}
