from __future__ import annotations

import pytest

from batchloom.errors import DataError, Refusal
from batchloom.operators import models
from batchloom.operators.dataset import build_dataset, by_severity
from batchloom.sources import tables as S


def test_files(spark, tmp_path):
    (tmp_path / "a.CSV").write_text('batch,x,note\nB1,1.5,"a, ""b"""\nB2,,c\n')
    got = S.read_table(spark, str(tmp_path / "a.CSV"))
    assert dict(got.dtypes)["x"] == "double" and [tuple(r) for r in got.orderBy("batch").collect()] == [("B1", 1.5, 'a, "b"'), ("B2", None, "c")]
    S.write_parquet(got, str(tmp_path / "b.parquet"))
    assert S.read_table(spark, str(tmp_path / "b.parquet")).count() == 2
    S.write_csv(got, str(tmp_path / "c"), one_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    with pytest.raises(ValueError):
        S.read_table(spark, "table.doc")


@pytest.mark.parametrize("mark", ["\t", ",", ";"])
def test_pasted(spark, mark):
    text = "\n".join(mark.join(r) for r in (["batch", "formulation", "x"], ["B1", "F1", "2"], ["B2", "F2", ""]))
    assert [tuple(r) for r in S.pasted(spark, text).orderBy("batch").collect()] == [("B1", "F1", 2.0), ("B2", "F2", None)]
    with pytest.raises(DataError):
        S.pasted(spark, " \n")


def test_grids(spark):
    got = S.typed_grid(spark, [("B1", "F1", "1e2", "1.5d"), ("B2", "F1", None, " 7 ")], ["batch", "formulation", "x", "y"]).orderBy("batch").collect()
    assert [tuple(r) for r in got] == [("B1", "F1", 100.0, None), ("B2", "F1", None, 7.0)]
    blank = S.blank_table(spark, ["x", "x", "batch"], 3, dates=True)
    assert blank.columns == ["batch", "formulation", "manufacturing_date", "x"] and [r.batch for r in blank.collect()] == ["B001", "B002", "B003"]
    assert S.blank_profiles(spark, media=("a", "b")).count() == 2 * 2 * 8


def test_split_and_pivot(spark):
    one = spark.createDataFrame([("B1", "F1", 2.0, "lab")], "batch string, formulation string, x double, scale string")
    wide, meta = S.split_single_table(one)
    assert wide.columns == ["batch", "x"] and meta.columns == ["batch", "formulation", "scale"]
    with pytest.raises(DataError):
        S.split_single_table(wide)
    rows = spark.createDataFrame([("B1", "x", 1.0), ("B1", "y", 2.0), ("B2", "y", 3.0)], "batch string, variable string, value double")
    assert {tuple(r) for r in S.long_to_wide(rows, ["x", "y"]).collect()} == {("B1", 1.0, 2.0), ("B2", None, 3.0)}
    with pytest.raises(DataError):
        S.long_to_wide(rows.union(rows), ["x", "y"])
    with pytest.raises(ValueError):
        S.long_to_wide(rows.drop("value"), ["x"])


def test_dataset(spark):
    wide = spark.createDataFrame([("B1", 1.0, 5.0, "7", 1), ("B1", 2.0, 5.0, "x", 2), ("B2", 3.0, 5.0, None, 1), (None, 1.0, 5.0, None, 1)], "batch string, x double, k double, t string, extra int")
    meta = spark.createDataFrame([("B1", "F1"), ("B9", "F2")], "batch string, formulation string")
    got = build_dataset(wide, {"x": "PROCESS", "k": "MATERIAL", "t": "PROCESS"}, meta)
    codes = {r.code: (r.severity, r.n_rows) for r in by_severity(got.issues).collect()}
    assert codes == {
        "DUPLICATE_BATCH_ID": ("ERROR", 1), "BATCH_MISSING_METADATA": ("ERROR", 1), "METADATA_WITHOUT_BATCH": ("WARNING", 1), "UNTAGGED_COLUMNS": ("WARNING", 1),
        "NON_NUMERIC_IN_NUMERIC_COLUMN": ("ERROR", 1), "CONSTANT_COLUMN": ("WARNING", 1), "SHAPE": ("INFO", 2),
    }
    assert got.excluded == {"k": "one value only"} and got.predictors == ["x", "t"] and got.exclude("x", "said so").predictors == ["t"]
    assert {(r.batch, r.x) for r in got.wide.collect()} == {("B1", 1.0), ("B2", 3.0)}
    with pytest.raises(ValueError):
        build_dataset(wide, {"x": "NOVEL"}, meta)
    with pytest.raises(DataError):
        build_dataset(wide, {}, meta.drop("formulation"))


def test_design_and_dependence(spark):
    ranges = spark.createDataFrame([("a", 1.0, 3.0), ("b", 2.0, 2.0), ("c", None, None)], "variable string, low double, high double")
    runs = models.factorial_design(ranges, ["a", "b"]).collect()
    assert len(runs) == 6 and runs[-1].a == 2.0 and {r.b for r in runs} == {1.8, 2.0, 2.2}
    for bad in (["c"], [], ["a", "b", "c", "d"]):
        with pytest.raises(Refusal):
            models.factorial_design(ranges, bad)
    rows = spark.createDataFrame([(f"b{i}", float(i), 1.0) for i in range(101)], "batch string, x0 double, x1 double")
    got = models.partial_dependence(rows, ["a", "b"], "a", [2.0, 3.0], 1.0).collect()
    assert len(got) == 20 and all(r.prediction == pytest.approx(4 + 2 * r.value) for r in got)
