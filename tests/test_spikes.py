from __future__ import annotations

from datetime import datetime

import numpy as np
from oracle import SMALL
from pyspark.sql import functions as F

from batchloom.functions.domain import minute
from batchloom.operators import spikes as S
from batchloom.operators.fill import Rules, find_rules, group_middles, measured_columns
from batchloom.plans.problems import DERIVED
from batchloom.session import durable, setting, table

TIMES = (15, 30, 60, 120, 240, 360, 480, 720)
ROWS = "batch string, medium string, run_no int, time_h double, percent_released double, instrument string"


def made_curves(n=400, seed=4):
    rng = np.random.default_rng(seed)
    rows, planted = [], set()
    for k in range(n):
        source = f"D{k % 4}"
        sd = (0.3, 0.6, 1.0, 1.5)[k % 4]
        t = np.array(TIMES) / 60
        y = 100 * (1 - np.exp(-((t / rng.uniform(1.5, 4)) ** rng.uniform(0.85, 1.1)))) + rng.normal(0, sd, len(t))
        if k % 9 == 0:
            at = int(rng.integers(0, len(t)))
            y[at] += rng.choice([-1, 1]) * 14 * sd
            planted.add((f"B{k:08d}", TIMES[at]))
        if k % 31 == 0:
            y[2:6] = y[2]
            planted |= {(f"B{k:08d}", m) for m in TIMES[2:6]}
        rows += [(f"B{k:08d}", "0.1N HCl", 1, m / 60, float(round(v, 4)), source) for m, v in zip(TIMES, y, strict=True)]
    return rows, planted


def test_planted_spikes_and_stuck_values(spark):
    rows, planted = made_curves()
    rows += rows[:500]  # sent twice
    found = {(r.batch_key, r.time_min) for r in S.reading_flags(spark.createDataFrame(rows, ROWS)).collect()}
    assert planted <= found and len(found - planted) <= 3


def test_rare_time_point(spark):
    rows, _ = made_curves(3000)
    rows += [("B00000001", "0.1N HCl", 1, 1.5, 115.0, "D1"), ("B00000002", "0.1N HCl", 1, 0.0, 0.1, "D2")]  # one reading each at 90 and at 0 minutes
    found = {(r.batch_key, r.time_min, r.reason) for r in S.reading_flags(spark.createDataFrame(rows, ROWS)).collect()}
    assert ("B00000001", 90, "spike") in found


def test_fit_settles(spark, monkeypatch):
    rows, _ = made_curves()
    frame = spark.createDataFrame(rows, ROWS)
    packed = durable(S.packed(S.curves(frame), list(TIMES)))
    cells = durable(S.course_cells(packed))
    start, between = S.start_of_curves(cells, list(TIMES))
    fit = lambda: S.fit_course(cells, start, between)
    course = fit()
    seen = []
    moved = S.moved
    monkeypatch.setattr(S, "moved", lambda a, b: seen.append(moved(a, b)) or seen[-1])
    fit()
    assert seen[-1] < S.OWN_TOLERANCE and any(x < S.TOLERANCE for x in seen[:-1])
    assert moved(course, course) == 0


def test_settled_sources_are_left_alone(spark, monkeypatch):
    """A source that takes long doesn't keep those that have settled in the passes, and changes nothing for them."""
    rows, _ = made_curves()
    cells = durable(S.course_cells(S.packed(S.curves(spark.createDataFrame(rows, ROWS)), list(TIMES))))
    start, between = S.start_of_curves(cells, list(TIMES))
    courses = []
    monkeypatch.setattr(S, "moved_of", lambda k, a, b: float(k == "D3"))
    monkeypatch.setattr(S, "moved", lambda a, b: courses.append(b) or float(len([c for c in courses if c.own]) % 6 > 0 and bool(b.own)))
    S.fit_course(cells, start, between)
    own = [c.own for c in courses if c.own]
    still = {k: [np.array_equal(a[k], b[k]) for a, b in zip(own, own[1:], strict=False)] for k in own[0]}
    assert len(own) == 6 and not any(still["D3"])
    assert all(still[k] == [False, True, True, True, True] for k in ("D0", "D1", "D2"))
    assert all(c.scatter["D0"] == courses[-1].scatter["D0"] for c in courses[-4:])


def test_readings_of_a_curve_apart_and_spelt_otherwise(spark):
    """Lists of a curve made in different tasks and under different spellings are one curve, of which no reading counts twice."""
    rows = [(b, m, n, t / 60, float(t + shift), d) for b, m, d, shift in (("B1", "0.1N HCl", "x", 0), (" b1", "0.1n hcl", "y", 1), ("B1", "0.1N HCl", None, 0)) for n in (1, None) for t in TIMES]
    frame = spark.createDataFrame(rows, ROWS)
    got = {r.run_no: r for r in S.curves(frame.repartition(7)).collect()}
    assert got.keys() == {1, None}
    assert all(r.batch_key == "B1" and r.source == "y" and sorted(map(tuple, r.cells)) == sorted((t, float(t + k)) for t in TIMES for k in (0, 1)) for r in got.values())


def test_components_are_each_source_s_own(spark):
    """With many readings a source's components follow its own curves, with few they stay with those of all."""
    rows, _ = made_curves(900)
    rows = [(b, m, n, t, y + (0.4 * t if d == "D2" else 0.0), "D9" if b in ("B00000002", "B00000006") else d) for b, m, n, t, y, d in rows]
    packed = durable(S.packed(S.curves(spark.createDataFrame(rows, ROWS)), list(TIMES)))
    cells = durable(S.course_cells(packed))
    start, between = S.start_of_curves(cells, list(TIMES))
    course = S.fit_course(cells, start, between)
    assert set(course.own) == {"D0", "D1", "D2", "D3", "D9"}
    away = {k: np.abs(x - course.basis).max() for k, x in course.own.items()}
    assert away["D2"] > 1 and away["D9"] < 0.3 * away["D2"]


def test_both_values_of_a_cell_sent_twice_are_tested(spark):
    names = [f"x{i}" for i in range(6)]
    rng = np.random.default_rng(3)
    rows = [(f"B{k:08d}", *(50 + 2 * rng.normal(size=6)).tolist(), None) for k in range(400)]
    rows.append(("B00000007", 50.0, 95.0, *[50.0] * 4, None))
    wide = spark.createDataFrame(rows, "batch string, " + ", ".join(f"{c} double" for c in names) + ", loaded_at timestamp_ntz")
    meta = spark.createDataFrame([(f"B{k:08d}", f"F{k % 4}", f"T{k % 3}", None) for k in range(400)], "batch string, formulation string, equipment_train string, manufacturing_date timestamp_ntz")
    families = spark.createDataFrame([(c, "PROCESS", None, None) for c in names], "variable string, family string, low double, high double")
    record = spark.createDataFrame([], "column_name string, fill_value double")
    assert ("B00000007", "x1", "spike") in {tuple(r) for r in S.cell_flags(wide, meta, families, record).collect()}


def test_a_curve_sent_many_times_is_one_small_row(spark):
    one = spark.createDataFrame([("B1", "0.1N HCl", 1, t / 60, float(t), "x") for t in TIMES], ROWS)
    many = one.crossJoin(spark.range(20_000)).drop("id")
    got = S.curves(many).collect()
    assert len(got) == 1 and len(got[0].cells) == len(TIMES)


def test_stuck_with_gaps_and_two_readings():
    nan = np.nan
    low = np.array([[1, 1, nan, 1, 1, 2], [1, 1, 1, 2, 2, 2], [3, 5, 5, 4, 5, nan], [nan] * 6], dtype=float)
    high = low.copy()
    high[2, 3] = 5.0
    got = S.stuck(low, high)
    assert got.tolist() == [[True, True, False, True, True, False], [False] * 6, [False, True, True, True, True, False], [False] * 6]


def test_odd_readings(spark):
    rows = [("B1", "0.1N HCl", 1, 0.5, 200.0, None), ("B1", "0.1N HCl", 1, 1.0, None, None), ("B1", "0.1N HCl", 1, 2.0, float("nan"), "x"), (None, "m", 1, 1.0, 500.0, "x"), ("B1", "0.1N HCl", 1, None, -50.0, "x")]
    assert [tuple(r) for r in S.reading_flags(spark.createDataFrame(rows, ROWS)).collect()] == [("B1", "0.1N HCl", 1, 30, "range")]
    assert S.reading_flags(spark.createDataFrame([], ROWS)).count() == 0


def test_middles_of_groups():
    v = np.array([3.0, np.nan, 1.0, 2.0, 9.0, 7.0, np.nan])
    low, high, n = group_middles(v, np.array([1, 1, 1, 1, 2, 2, 3]))
    assert low.tolist()[:6] == [2, 2, 2, 2, 7, 7] and high.tolist()[:6] == [2, 2, 2, 2, 9, 9] and n.tolist() == [3, 3, 3, 3, 2, 2, 0]


def _batches(spark):
    wide, meta, families, record = (table(spark, "/root/testdata/sf0.01", n) for n in ("batch_wide", "batch_metadata", "variable_families", "imputation_record"))
    rules = find_rules(wide, families, record)
    columns = [c for c in measured_columns(wide) if c not in DERIVED]
    return durable(S._labelled_batches(wide, meta, rules, columns)), [rules.bounds.get(c, (None, None)) for c in columns]


def test_hot_formulations_and_chunks_change_nothing(spark):
    batches, bounds = _batches(spark)
    means, _ = S.column_facts(batches, bounds)
    as_rows = lambda hot: {r.batch: np.frombuffer(r.off, dtype=np.float32) for r in S.residuals(batches, bounds, means, hot).collect()}
    whole, hot = as_rows(10**6), as_rows(25)
    assert whole.keys() == hot.keys() and all(np.array_equal(whole[k], hot[k], equal_nan=True) for k in whole)
    varied = [True] * len(bounds)
    large, small = ({tuple(r) for r in S.stuck_cells(batches, varied, *a).collect()} for a in ((10**6, 64), (40, 5)))
    assert large == small and large


def test_cells_of_empty_tables(spark):
    names = ("batch_wide", "batch_metadata", "variable_families", "imputation_record")
    wide, meta, families, record = (table(spark, SMALL, n) for n in names)
    assert S.cell_flags(wide.limit(0), meta.limit(0), families, record).count() == 0
    alone = S.cell_flags(wide.withColumn("f", F.lit(1)).withColumn("place", F.lit("x")), meta.limit(0), families, record)
    assert {r.reason for r in alone.collect()} <= {"range"}


def test_a_pass_reads_small_blocks_in_one_task(spark):
    rows, _ = made_curves()
    cells = durable(S.course_cells(S.packed(S.curves(spark.createDataFrame(rows, ROWS)), list(TIMES))).repartition(7))
    start, between = S.start_of_curves(cells, list(TIMES))
    spark.sparkContext.setJobGroup("passes", "")
    try:
        S.fit_course(cells, start, between)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("passes") for s in tracker.getJobInfo(j).stageIds]
    assert len(stages) > S.PASSES and max(s.numTasks for s in stages if s.numCompletedTasks) == 1


def test_lists_in_small_batches_are_the_curves(spark):
    rows = [(b, m, n, t / 60, float(t + shift), d) for b, m, d, shift in (("B1", "0.1N HCl", "x", 0), (" b1", "0.1n hcl", "y", 1), ("B1", "0.1N HCl", None, 0), ("B2", None, None, 2)) for n in (1, None) for t in TIMES]
    rows += [("B2", None, 1, x, y, "z") for x, y in ((None, 1.0), (1.0, None), (float("nan"), 1.0), (2.0, float("inf")), (0.508333, -0.0))]
    frame = spark.createDataFrame(rows, ROWS).repartition(5)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "2"):
        got, whole = ([tuple(r) for r in S.packed(f(frame), [*TIMES[:1], 30, 31, *TIMES[2:]]).collect()] for f in (S.lists, S.curves))
    assert len(got) == 4 and sorted(map(repr, got)) == sorted(map(repr, whole))
    x = {r[:3]: (r[3], *(None if v is None else np.frombuffer(v).tolist() for v in r[4:])) for r in got}
    assert x["B1", "0.1N HCl", 1][0] == "y" and x["B1", "0.1N HCl", None][2][0] == 16.0
    assert x["B2", None, 1][0] == "z" and x["B2", None, None][2] is None
    assert str(x["B2", None, 1][1][:3]) == "[17.0, 0.0, nan]" and x["B2", None, 1][2][:2] == [17.0, 32.0]


def test_whole_minutes_are_those_of_the_expression(spark):
    hours = [0.0, -0.0, 0.49999999999999994 / 60, 0.5 / 60, 1.5 / 60, -0.5 / 60, -2.5 / 60, 0.008333333333333333, 0.175, 2.675, 1e6 / 7]
    hours += (np.random.default_rng(1).integers(0, 200_000, 500) / 120).tolist()
    want = [r.m for r in spark.createDataFrame([(h,) for h in hours], "h double").select(minute(F.col("h")).alias("m")).collect()]
    assert S.whole_minutes(np.array(hours)).tolist() == want


def test_batches_in_small_arrow_batches(spark):
    """Rows of a batch that come apart give its smallest and largest usable values and its labels, once."""
    day = datetime(2020, 1, 2)
    wide = spark.createDataFrame([("A", 1.0, 5.0), ("A", 3.0, None), ("A", 2.0, 5.0), ("B", float("nan"), 999.0), ("C", 7.0, -9.0), ("C", 7.0, -9.0), (None, 1.0, 1.0), ("D", 4.0, 8.0)], "batch string, x double, y double").repartition(4)
    meta = spark.createDataFrame([("A", "F-1", "T1", day), ("C", None, "T2", None), ("E", "F-2", "T1", day)], "batch string, formulation string, equipment_train string, manufacturing_date timestamp_ntz")
    rules = Rules({"x": (0.0, 10.0), "y": (0.0, 10.0)}, [999.0], {"x": [4.0]})
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):
        got = {r.batch: (r.v, r.high, r.formulation, r.equipment_train, r.manufacturing_date) for r in S._labelled_batches(wide, meta, rules, ["x", "y"]).collect()}
    assert got == {
        "A": ([1.0, 5.0], [3.0, 5.0], 1, "T1", day),
        "B": ([None, None], None, None, None, None),
        "C": ([7.0, -9.0], None, None, "T2", None),
        "D": ([None, 8.0], None, None, None, None),
    }
    usable = wide.where("batch is not null").select(rules.usable("x"), rules.usable("y")).collect()
    values = np.array([list(r) for r in wide.where("batch is not null").select("x", "y").collect()], dtype=float)
    assert repr(S.usable_values(values, rules, ["x", "y"]).tolist()) == repr([[float("nan") if v is None else v for v in r] for r in usable])


def test_usual_scatter_is_the_median_bin(spark):
    rng = np.random.default_rng(5)
    off = rng.normal(0, [1.0, 30.0, 0.0], (500, 3)).astype(np.float32)
    off[rng.random(off.shape) < 0.2] = np.nan
    off[::4, 1] = np.nan
    trains = [("T0", "T1", None, "T2")[k % 4] for k in range(500)]
    off[3::4] = np.nan  # T2 has no distance
    frame = spark.createDataFrame([(t, bytearray(x.tobytes())) for t, x in zip(trains, off, strict=True)], "equipment_train string, off binary").repartition(5)
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "7"):
        got = {r.equipment_train: r.usual for r in S.usual_scatter(frame, 3).collect()}
    assert got.keys() == {"T0", "T1"}
    for k, t in enumerate(("T0", "T1")):
        for f in (0, 1):
            x = np.sort(np.abs(off[k::4, f][~np.isnan(off[k::4, f])]).astype(float))
            if len(x):
                bin_of = np.floor(np.log(x[(len(x) - 1) // 2]) / S.BIN)
                assert abs(got[t][f] / (np.exp((bin_of + 0.5) * S.BIN) * 1.4826) - 1) < 1e-12
            else:
                assert got[t][f] is None
        assert got[t][2] is None
