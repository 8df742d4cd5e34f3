from __future__ import annotations

import itertools
import tracemalloc

import numpy as np
from oracle import SMALL
from pyspark.sql import functions as F

from batchloom.operators.fill import CATEGORIES, apply_fills, by_formulation, chow_liu, distances, fill_missing, find_rules, measured_columns, merged_batches, portions, posteriors
from batchloom.session import table

TABLES = ("batch_wide", "batch_metadata", "variable_families", "imputation_record")


def test_messages_equal_enumeration():
    rng = np.random.default_rng(3)
    sizes = [2, 3, 2, 4]
    codes = np.stack([rng.integers(0, s, 400) for s in sizes], 1)
    codes[:, 1] = np.where(rng.random(400) < 0.8, codes[:, 0], codes[:, 1])
    codes[:, 3] = np.where(rng.random(400) < 0.7, codes[:, 1], codes[:, 3])
    hot = np.concatenate([np.eye(s)[codes[:, f]] for f, s in enumerate(sizes)], 1)
    tree = chow_liu(hot.T @ hot, sizes)
    assert {frozenset((f, p)) for f, p in enumerate(tree.parent) if p >= 0} >= {frozenset((0, 1)), frozenset((1, 3))}
    asked = codes[:30].copy()
    asked[rng.random(asked.shape) < 0.5] = -1
    got = posteriors(tree, asked, sizes)

    def joint(x):
        p = 1.0
        for f in tree.order:
            q = tree.parent[f]
            p *= tree.prior[f][x[f]] if q < 0 else tree.tables[f][x[q], x[f]]
        return p

    for n, row in enumerate(asked):
        for f in np.flatnonzero(row < 0):
            want = np.zeros(sizes[f])
            for x in itertools.product(*(range(s) if row[k] < 0 else (row[k],) for k, s in enumerate(sizes))):
                want[x[f]] += joint(x)
            assert np.allclose(got[f][n], want / want.sum())


def test_all_filled_from_similar_batches(spark):
    cells = fill_missing(*(table(spark, SMALL, n) for n in TABLES)).cells.collect()
    assert cells and all((c.number is None) != (c.label is None) and c.taken_from in ("formulation", "time", "all") for c in cells)
    assert all((c.label is not None) == (c.field in CATEGORIES) for c in cells)


def test_table_is_complete_and_marked(spark):
    filled = fill_missing(*(table(spark, SMALL, n) for n in TABLES))
    marks = {(c.batch, c.field) for c in filled.cells.select("batch", "field").collect()}
    before = {r.batch: r for r in filled.batches.collect()}
    for row in apply_fills(filled).collect():
        old = before[row.batch]
        fields = [*filled.coding.numbers, *CATEGORIES]
        assert set(row.filled) == {f for f in fields if (row.batch, f) in marks}
        was = dict(zip(filled.coding.numbers, old.v, strict=True)) | {c: old[c] for c in CATEGORIES}
        assert all(row[f] == was[f] for f in fields if f not in row.filled)
        assert all(row[f] is not None for f in (filled.coding.numbers if old.in_wide else []) + (list(CATEGORIES) if old.in_metadata else []))


def test_held_out_labels_come_back(spark):
    wide, meta, families, record = (table(spark, "/root/testdata/sf0.01", n) for n in TABLES)
    hide = F.pmod(F.xxhash64("batch"), F.lit(20)) == 0
    hidden = fill_missing(wide, meta.withColumn("scale", F.when(~hide, F.col("scale"))), families, record)
    truth = {r.batch: r.scale for r in meta.where(hide).select("batch", "scale").collect()}
    got = [(truth[c.batch], c.label) for c in hidden.cells.where("field = 'scale'").collect() if truth.get(c.batch) in ("pilot", "lab", "commercial")]
    assert len(got) > 15 and np.mean([a == b for a, b in got]) > 0.85


def test_empty_and_odd_tables(spark):
    wide, meta, families, record = (table(spark, SMALL, n) for n in TABLES)
    none = fill_missing(wide.limit(0), meta.limit(0), families, record.limit(0))
    assert none.cells.count() == 0
    odd = wide.where("batch = 'B00000001'").select("batch", *[F.lit(float("nan")).alias(c) for c in measured_columns(wide)], F.lit(None).cast("timestamp_ntz").alias("loaded_at"), F.lit(1).alias("codes"), F.lit("x").alias("period"))
    cells = fill_missing(odd.union(odd), meta.limit(0), families, record).cells.collect()
    assert len(cells) == len(measured_columns(wide)) and all(c.number is None for c in cells)


def test_many_labels_take_little_memory(spark):
    """A thousand labels and a batch of 10,000 rows: posteriors of all rows at once take over 400 MB."""
    rng = np.random.default_rng(4)
    sizes = [9] * 40 + [1001]
    codes = np.stack([rng.integers(-1, s, 10_000) for s in sizes], 1)
    hot = np.eye(sum(sizes))
    tree = chow_liu(hot, sizes)
    tracemalloc.start()
    for at in portions(np.arange(len(codes)), sum(sizes)):
        some = posteriors(tree, codes[at], sizes)
        if at[0] == 0:
            assert all(np.allclose(a, b) for a, b in zip(some, posteriors(tree, codes[: len(at)], sizes), strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_rows_of_a_large_formulation_carry_no_levels(spark):
    wide, meta, families, record = (table(spark, "/root/testdata/sf0.01", n) for n in TABLES)
    batches = merged_batches(wide, meta, find_rules(wide, families, record)).cache()
    width = len(measured_columns(wide))
    placed, large = by_formulation(batches, F.col("value").isNotNull(), 20)
    assert set(placed.columns) == {*batches.columns, "bucket"} and len(large.formulations)
    # Formulations of a few large ones and all small ones in one bucket each give the same distances.
    as_rows = lambda hot: {r.batch: (r.dist, r.level, r.source) for r in distances(batches, width, hot).collect()}
    assert as_rows(20) == as_rows(10**6)
