"""Implausible readings, per source: spikes, stuck values and impossible values.

Both kinds of readings are matrices whose normal part is of low rank and whose
spikes are sparse: release curves (rows) over a common time grid, one matrix
per instrument, and batches (rows) over the measured columns, one matrix per
equipment train, as distances from the level of the formulation in units of
the train's usual scatter. Robust principal components separate the two: a few
components and the scatter of every source are fitted by expectation
maximisation, readings far off their own row's course being left out from one
pass to the next, until the fit changes by less than ``TOLERANCE``
(``MOST_PASSES`` at most); then each reading is held against what the other
readings of its row imply. What stands out in the batch table is checked
exactly against the level of the formulation. Runs of equal values and ranges
are tested separately.

Every source has components of its own. They are drawn to those of all sources
together by ``SHRINK`` readings' worth of weight in each column, since rare
time points have a handful of readings per instrument. A pass sends sums of
the size of the grid, per source, to the driver, never rows.

Defined results for odd input: NULL, NaN and infinite readings are no readings;
rows sent twice count once; of contradicting readings in one cell the smallest
and the largest are tested, each on its own, and neither enters the course; a
time point of fewer than ``FEW`` readings takes the course between its
neighbours; a row without source is held against the components of all, a curve
at their pooled scatter, a batch at the widest scatter of any train; curves of
fewer than four readings, batches without formulation and columns without
scatter are only tested for ranges and runs, batches without train or date not
for runs; NULL batches are left out; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from batchloom.functions.domain import canonical_medium, squeezed
from batchloom.operators.fill import Rules, by_formulation, find_rules, first_labels, measured_columns, middles_of
from batchloom.operators.reshape import time_points
from batchloom.session import durable, setting

LOWEST, HIGHEST = -1.0, 130.0  # bounds of a reading in percent
RANK, CELL_RANK = 4, 3  # components of curves and of batches
PASSES, MOST_PASSES = 7, 40  # the least and most passes that fit them
SHRINK = 40  # readings that the components of all sources count for in those of one
STANDS_OUT = 5.0  # scatters off its row's course from which a cell of the batch table is checked
TOLERANCE, OWN_TOLERANCE = 0.01, 0.05  # change from one pass to the next, see moved(), below which the fit of all sources, and of each, has settled
TIMES_SCATTER = 8.0
FEW = 20  # readings of a time point below which its course is read off the neighbouring ones
TASK_MB = 16  # of blocks that a task of a pass reads
RUN = 4  # successive equal values that count as stuck
BIN, EMPTY, SPAN = 0.04, -40_000, 80_000  # width of a bin of logarithms, the bin of zeros, and how many there may be
HOT = 20_000  # batches of a formulation whose middle one task finds; that of more is found by counting, with the same result
CHUNK, MARGIN = 5_000, 64  # batches of a train searched for runs at a time, and those of the neighbours looked at
FEW_VALUES = 12  # runs in columns with no more different values are settings, not stuck values


@dataclass
class Course:
    """Mean (last column) and components of all sources together and of each, rows per column of the matrix; and the scatters."""

    basis: np.ndarray
    pooled: float
    own: dict[str, np.ndarray]
    scatter: dict[str, float]

    def of(self, source: str) -> tuple[np.ndarray, float]:
        return self.own.get(source, self.basis), self.scatter.get(source, self.pooled)


def by_source(pdf: pd.DataFrame) -> Iterator[tuple[str, np.ndarray]]:
    """Sources of some rows, and the places of the rows of each."""
    yield from pdf.reset_index(drop=True).groupby("source").indices.items()


CURVE = ["batch_key", "medium", "run_no"]


def lists(dissolution: DataFrame) -> DataFrame:
    """batch_key, medium, run_no, source and the lists ``t`` and ``y`` of some readings of a curve, in order; the lists of one curve follow one another in one task."""
    rows = dissolution.select("batch", "medium", "run_no", "instrument", F.col("time_h").cast("double").alias("t"), F.col("percent_released").cast("double").alias("y"))
    kind = dict(rows.dtypes)["run_no"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ["batch", "medium", "run_no", "instrument"]
        for batch in batches:
            t, y = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("t", "y"))
            good = np.isfinite(t) & np.isfinite(y) & np.asarray(batch.column("batch").is_valid())
            if good.any():
                part = pa.Table.from_batches([batch]).select(own).filter(pa.array(good))
                part = part.append_column("t", pa.array(whole_minutes(t[good]))).append_column("y", pa.array(y[good] + 0.0))
                once = part.group_by([*own, "t", "y"], use_threads=False).aggregate([])
                # In order, so that rows sent again make an equal list.
                made = once.sort_by([("t", "ascending"), ("y", "ascending")]).group_by(own, use_threads=False).aggregate([("t", "list"), ("y", "list")])
                yield from made.select([*own, "t_list", "y_list"]).rename_columns([*own, "t", "y"]).to_batches()

    # Readings of a curve mostly follow one another: a task makes lists of them, and few are left to be put together.
    rows = rows.mapInArrow(gather, f"batch string, medium string, run_no {kind}, instrument string, t array<int>, y array<double>")
    rows = rows.select(squeezed(F.col("batch")).alias("batch_key"), canonical_medium(F.col("medium")).alias("medium"), "run_no", F.coalesce("instrument", F.lit("")).alias("source"), "t", "y")
    return rows.repartition(*CURVE).sortWithinPartitions(*CURVE)


def whole_minutes(hours: np.ndarray) -> np.ndarray:
    """What ``minute`` gives for finite hours: halves go away from zero."""
    x = hours * 60
    size = np.abs(x)
    down = np.floor(size)
    return np.copysign(down + (size - down >= 0.5), x).astype(np.int32)


def curves(dissolution: DataFrame) -> DataFrame:
    """One row per curve: batch_key, medium, run_no, source and its cells (t, y), each different reading of a cell once; also as the lists ``t`` and ``y``."""
    kind = dict(dissolution.dtypes)["run_no"]

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the curve that the next rows may go on with
        for pdf in frames:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            same = np.ones(len(pdf) - 1, dtype=bool)
            for c in CURVE:
                code = pd.factorize(pdf[c])[0]  # -1 for NULL
                same &= code[1:] == code[:-1]
            first = np.flatnonzero(np.r_[True, ~same])
            sizes = np.diff(np.r_[first, len(pdf)])
            out = pdf.iloc[first].reset_index(drop=True)
            some = np.flatnonzero(sizes > 1)
            if len(some):
                rows = np.flatnonzero(np.repeat(sizes > 1, sizes))
                own = np.repeat(np.repeat(np.arange(len(some)), sizes[some]), [len(x) for x in pdf["t"].to_numpy()[rows]])
                t, y = (np.concatenate(pdf[c].to_numpy()[rows]) for c in ("t", "y"))
                order = np.lexsort((y, t, own))
                own, t, y = own[order], t[order], y[order]
                new = np.ones(len(own), dtype=bool)
                new[1:] = (own[1:] != own[:-1]) | (t[1:] != t[:-1]) | (y[1:] != y[:-1])
                own, t, y = own[new], t[new], y[new]
                cut = np.searchsorted(own, np.arange(1, len(some)))
                source = pdf["source"].to_numpy()
                for c, parts in (("source", [max(source[k : k + n]) for k, n in zip(first[some], sizes[some], strict=True)]), ("t", np.split(t, cut)), ("y", np.split(y, cut))):
                    column = out[c].to_numpy(dtype=object, copy=True)
                    for k, part in zip(some, parts, strict=True):
                        column[k] = part
                    out[c] = column
            rest = out.iloc[-1:]
            yield out.iloc[:-1]
        if rest is not None:
            yield rest

    # However many lists a curve has, they pass one after another.
    return lists(dissolution).mapInPandas(merge, f"batch_key string, medium string, run_no {kind}, source string, t array<int>, y array<double>").withColumn("cells", F.arrays_zip("t", "y"))


def same_as_before(batch: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether each row but the first has the keys of the row before it, NULLs being alike."""
    same = np.ones(batch.num_rows - 1, dtype=bool)
    for c in keys:
        column = batch.column(c)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        code = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        same &= code[1:] == code[:-1]
    return same


def as_binary(x: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """The bytes of each row of ``x``, NULL where it is not ``there``."""
    there = np.ones(len(x), dtype=bool) if there is None else there
    ends = np.r_[0, np.cumsum(np.where(there, x.shape[1] * x.itemsize, 0))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(x), [pa.py_buffer(np.packbits(there, bitorder="little").tobytes()), pa.py_buffer(ends.tobytes()), pa.py_buffer(x[there].tobytes())])


def packed(table: DataFrame, times: list[int]) -> DataFrame:
    """Curves on the grid ``times``: ``low`` and ``high`` are the bytes of one double per time point, NaN where there is no reading.

    ``table`` are :func:`lists`, or curves put together. ``high`` is NULL where
    no cell has different readings.
    """
    kind = dict(table.dtypes)["run_no"]
    grid = np.asarray(times)
    width = len(grid)
    flat = table.select(*CURVE, "source", "t", "y")

    def rows_of(head: pa.Table, source: pa.Array, low: np.ndarray, high: np.ndarray) -> list[pa.RecordBatch]:
        low, high = (np.where(np.isinf(x), np.nan, x) for x in (low, high))
        differ = ((low != high) & ~np.isnan(low)).any(1)
        return pa.Table.from_arrays([*[head.column(c) for c in CURVE], source, as_binary(low), as_binary(high, differ)], [*CURVE, "source", "low", "high"]).to_batches()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the curve that the next rows may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.r_[True, ~same_as_before(batch, CURVE)]
            first = np.flatnonzero(new)
            cell = np.repeat(np.cumsum(new) - 1, batch.column("t").value_lengths().to_numpy(zero_copy_only=False))
            t, y = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("t", "y"))
            at = np.minimum(np.searchsorted(grid, t), width - 1)
            on = grid[at] == t
            cell = (cell * width + at)[on]
            low, high = np.full(len(first) * width, np.inf), np.full(len(first) * width, -np.inf)
            np.minimum.at(low, cell, y[on])
            np.maximum.at(high, cell, y[on])
            low, high = low.reshape(-1, width), high.reshape(-1, width)
            names = np.asarray(batch.column("source").to_pylist(), dtype=object)
            names = [max(names[k:n]) for k, n in zip(first, [*first[1:], len(names)], strict=True)]
            head = pa.Table.from_batches([batch]).select(CURVE).take(pa.array(first))
            if rest is not None:
                if rest[0].to_pylist() == head.slice(0, 1).to_pylist():
                    names[0] = max(names[0], rest[1])
                    low[0], high[0] = np.minimum(low[0], rest[2]), np.maximum(high[0], rest[3])
                else:
                    yield from rows_of(rest[0], pa.array([rest[1]], pa.string()), rest[2][None], rest[3][None])
            rest = (head.slice(len(first) - 1), names[-1], low[-1], high[-1])
            yield from rows_of(head.slice(0, len(first) - 1), pa.array(names[:-1], pa.string()), low[:-1], high[:-1])
        if rest is not None:
            yield from rows_of(rest[0], pa.array([rest[1]], pa.string()), rest[2][None], rest[3][None])

    return flat.mapInArrow(pack, f"batch_key string, medium string, run_no {kind}, source string, low binary, high binary")


def _matrices(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    low = np.frombuffer(b"".join(pdf["low"]), dtype=float).reshape(len(pdf), -1)
    high = low.copy()
    for n, x in enumerate(pdf["high"]):
        if x is not None:
            high[n] = np.frombuffer(x, dtype=float)
    return low, high


def stuck(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Cells in runs of at least ``RUN`` equal values along a row, missing ones left out.

    A cell with two readings takes the one its neighbour has.
    """
    n, width = low.shape
    out = np.zeros((n, width), dtype=bool)
    order = np.argsort(np.isnan(low), axis=1, kind="stable")
    a, b = np.take_along_axis(low, order, 1), np.take_along_axis(high, order, 1)
    v = a.copy()
    for j in range(width):
        before = v[:, j - 1] if j else np.full(n, np.nan)
        after_a, after_b = (a[:, j + 1], b[:, j + 1]) if j + 1 < width else (np.full(n, np.nan),) * 2
        take_b = (b[:, j] != a[:, j]) & ((b[:, j] == before) | ((a[:, j] != before) & ((b[:, j] == after_a) | (b[:, j] == after_b))))
        v[take_b, j] = b[take_b, j]
    same = v[:, 1:] == v[:, :-1]
    flag = np.zeros((n, width), dtype=bool)
    for j in range(width - RUN + 1):
        run = same[:, j : j + RUN - 1].all(1)
        flag[run, j : j + RUN] = True
    np.put_along_axis(out, order, flag, 1)
    return out


def _posterior(y: np.ndarray, seen: np.ndarray, basis: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the component scores of each row, given its seen readings."""
    b, mean = basis[:, :-1], basis[:, -1]
    r = b.shape[1]
    outer = (b[:, :, None] * b[:, None, :]).reshape(len(b), r * r)
    a = (seen @ outer).reshape(-1, r, r) / sigma**2 + np.eye(r)
    rest = np.where(seen, y - mean, 0.0)
    cov = np.linalg.inv(a)
    return np.einsum("nij,nj->ni", cov, (rest @ b) / sigma**2), cov


def _held_against(y: np.ndarray, seen: np.ndarray, basis: np.ndarray, sigma: float) -> list[np.ndarray]:
    """Of each row the mean and covariance of its scores; of each reading its distance from the course that the row's other readings imply, and the share of its variance left."""
    z, cov = _posterior(y, seen, basis, sigma)
    b = basis[:, :-1]
    leverage = (cov.reshape(len(cov), -1) @ (b[:, :, None] * b[:, None, :]).reshape(len(b), -1).T) / sigma**2
    left = np.where(seen, np.clip(1 - leverage, 0.02, 1.0), 1.0)
    return [z, cov, (y - basis[:, -1] - z @ b.T) / left, left]


def settle(y: np.ndarray, seen: np.ndarray, basis: np.ndarray, sigma: float, limit: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """``seen`` without the readings off their course, found one by one, the farthest of a row first, and what :func:`_held_against` gives for it.

    At least three readings of a row are kept, whatever they are.
    """
    seen = seen.copy()
    against = _held_against(y, seen, basis, sigma)
    active = np.arange(len(y))
    for _ in range(y.shape[1]):
        d, left = against[2][active], against[3][active]
        score = np.where(seen[active], np.abs(d) * np.sqrt(left), -1.0)
        worst = score.argmax(1)
        rows = np.arange(len(active))
        bad = (np.abs(d[rows, worst]) > limit * sigma) & (score[rows, worst] > limit * 0.6 * sigma) & (seen[active].sum(1) > 3)
        active, worst = active[bad], worst[bad]
        if not len(active):
            break
        seen[active, worst] = False
        for whole, part in zip(against, _held_against(y[active], seen[active], basis, sigma), strict=True):
            whole[active] = part
    return seen, against


def _usable(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(readings, cells fit for the course, stuck cells, largest readings) of gridded curves."""
    low, high = _matrices(pdf)
    held = stuck(low, high)
    fit = (low == high) & ~held & (low >= LOWEST) & (low <= HIGHEST)
    return np.where(np.isnan(low), 0.0, low), fit, held, high


def course_cells(table: DataFrame) -> DataFrame:
    """Blocks (source, cells) of the readings of the curves of ``table`` that are fit for the course, NaN where there is none, of those with at least four."""

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                y, fit, _, _ = _usable(pdf)
                yield in_blocks(pdf, np.where(fit, y, np.nan))

    return table.select("source", "low", "high").mapInPandas(pick, BLOCKS)


BLOCKS = "source string, rows int, cells binary"


def in_blocks(pdf: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
    """The rows of ``x`` with at least four readings, those of one source in one block of bytes."""
    many = np.isfinite(x).sum(1) >= 4
    x = x.astype(np.float32)
    out = [(s, len(own), x[own].tobytes()) for s, at in by_source(pdf) if len(own := at[many[at]])]
    return pd.DataFrame(out, columns=["source", "rows", "cells"])


def _cells_of(block: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(readings, 0 where there is none, and where there are some) of a block."""
    x = np.frombuffer(block, dtype=np.float32).reshape(rows, -1).astype(float)
    seen = np.isfinite(x)
    return np.where(seen, x, 0.0), seen


def _between(t: np.ndarray, v: np.ndarray, known: np.ndarray) -> np.ndarray:
    """``v`` with the rows not ``known`` read off between those that are, along the logarithm of time."""
    x = np.log(np.maximum(t, 1))
    out = v.copy()
    for k in range(v.shape[1]):
        out[~known, k] = np.interp(x[~known], x[known], v[known, k])
    return out


def moved_of(source: str, old: Course, new: Course) -> float:
    """Largest change of the course of one source: of its scatter relative to itself, of means to the scatter, of covariances to their largest entry."""
    (a, before), (b, sigma) = old.of(source), new.of(source)
    c, d = a[:, :-1] @ a[:, :-1].T, b[:, :-1] @ b[:, :-1].T
    scatter = abs(sigma / before - 1) if source in new.scatter else 0.0
    return float(max(scatter, np.abs(b[:, -1] - a[:, -1]).max() / sigma, np.abs(d - c).max() / max(np.abs(d).max(), 1e-12)))


def moved(old: Course, new: Course) -> float:
    """Largest change of a course, see :func:`moved_of`."""
    return max([abs(x / old.of(k)[1] - 1) for k, x in new.scatter.items()] + [moved_of(k, old, new) for k in ("", *new.own)])


@contextmanager
def few_tasks(spark: SparkSession) -> Iterator[None]:
    """Tables read inside are divided into tasks of ``TASK_MB``, however few: a pass is short, and a task costs as much as some thousand rows."""
    with setting(spark, "spark.sql.files.minPartitionNum", "1"), setting(spark, "spark.sql.files.maxPartitionBytes", f"{TASK_MB}m"), setting(spark, "spark.sql.files.openCostInBytes", "64k"):
        yield


def fit_course(table: DataFrame, start: Course, between: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Course:
    """Components and scatters of the rows in the blocks of ``table`` (source, rows, cells).

    First the components of all sources together are fitted until they settle,
    then, from there, those of each source; a source that has settled in two
    passes on end is left out of those that follow. ``between`` mends the components of
    columns with too few readings.
    """
    width, r = start.basis.shape[0], start.basis.shape[1] - 1
    size = (r + 1) ** 2
    names = [f"s{k}" for k in range(size + r + 2)]
    course, together = start, True
    total: dict[str, np.ndarray] = {}
    settled: dict[str, int] = {}  # passes on end in which the sources changed little
    for n_pass in range(MOST_PASSES):

        done = {k for k, n in settled.items() if n >= 2}

        def sums(frames: Iterator[pd.DataFrame], course: Course = course, done: set[str] = done, limit: float = 5.0 if n_pass else 6.0) -> Iterator[pd.DataFrame]:
            total: dict[str, np.ndarray] = {}
            for pdf in frames:
                for source, rows, block in zip(pdf["source"], pdf["rows"], pdf["cells"], strict=True):
                    if source in done:
                        continue
                    y, seen = _cells_of(block, rows)
                    seen, (z, cov, d, left) = settle(y, seen, *course.of(source), limit)
                    za = np.concatenate([z, np.ones((len(z), 1))], 1)
                    zz = za[:, :, None] * za[:, None, :]
                    zz[:, :r, :r] += cov
                    w = seen.astype(float)
                    part = np.concatenate([w.T @ zz.reshape(len(z), -1), np.where(seen, y, 0.0).T @ za, (w * d**2 * left).sum(0)[:, None]], 1)
                    total[source] = total.get(source, 0.0) + part
            rows = [(s, i, *row.tolist()) for s, part in total.items() for i, row in enumerate(part)]
            yield pd.DataFrame(rows, columns=["source", "i", *names])

        got = table.mapInPandas(sums, "source string, i int, " + ", ".join(f"{c} double" for c in names))
        added = got.groupBy("source", "i").agg(*[F.sum(c).alias(c) for c in names])
        total = {k: v for k, v in total.items() if k in done}
        with few_tasks(table.sparkSession):
            rows = added.collect()
        for row in rows:  # sources by columns, a few numbers each
            total.setdefault(row["source"], np.zeros((width, len(names))))[row["i"]] = row[2:]
        scatter = {k: max(float(np.sqrt(v[:, -1].sum() / v[:, size - 1].sum())), 1e-6) for k, v in total.items() if k and v[:, size - 1].sum() >= 20}
        pooled = float(np.median(list(scatter.values()))) if scatter else course.pooled
        weight = {k: course.of(k)[1] ** -2 for k in total}
        before = course
        square = sum((v[:, :size] * weight[k] for k, v in total.items()), np.zeros((width, size))).reshape(width, r + 1, r + 1)
        cross = sum((v[:, size:-1] * weight[k] for k, v in total.items()), np.zeros((width, r + 1)))
        known = square[:, r, r] > 0
        # What one reading tells of a column's components on average; of a column never read, nothing.
        each = np.where(known[:, None, None], square / np.where(known, square[:, r, r], 1.0)[:, None, None], np.eye(r + 1))
        if together:
            ridge = 1e-6 * np.trace(each, axis1=1, axis2=2)[:, None, None] / (r + 1) * np.eye(r + 1) * np.maximum(square[:, r, r], 1e-9)[:, None, None]
            basis = np.linalg.solve(square + ridge, (cross + np.einsum("tij,tj->ti", ridge, course.basis))[:, :, None])[:, :, 0]
            course = Course(between(np.where(known[:, None], basis, course.basis)), pooled, {}, scatter)
            together = n_pass + 1 < PASSES or moved(before, course) >= TOLERANCE
            continue
        own = {}
        prior = SHRINK * each
        for k, v in total.items():
            if k in done:
                own[k], scatter[k] = course.of(k)
            elif k:
                told = v[:, size:-1] + np.einsum("tij,tj->ti", prior, course.basis)
                own[k] = np.linalg.solve(v[:, :size].reshape(width, r + 1, r + 1) + prior + 1e-9 * np.eye(r + 1), told[:, :, None])[:, :, 0]
        course = Course(course.basis, pooled, own, scatter)
        settled |= {k: settled.get(k, 0) + 1 if moved_of(k, before, course) < OWN_TOLERANCE else 0 for k in own if k not in done}
        if moved(before, course) < OWN_TOLERANCE:
            break
    return course


def start_of_curves(table: DataFrame, times: list[int]) -> tuple[Course, Callable[[np.ndarray], np.ndarray]]:
    """A first course from the mean readings of the time points, and what reads the course of rare time points off their neighbours."""
    t = np.asarray(times, dtype=float)

    def middles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, len(times)))
        for pdf in frames:
            for rows, block in zip(pdf["rows"], pdf["cells"], strict=True):
                y, fit = _cells_of(block, rows)
                sums += [y.sum(0), fit.sum(0)]
        yield pd.DataFrame({"at": np.arange(len(times)), "y": sums[0], "n": sums[1]})

    got = table.select("rows", "cells").mapInPandas(middles, "at int, y double, n double").groupBy("at").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).collect()
    mean = np.full(len(t), np.nan)
    number = np.zeros(len(t))
    for x in got:
        if x["n"]:
            mean[x["at"]] = x["y"] / x["n"]
            number[x["at"]] = x["n"]
    many = number >= FEW
    known = many if many.any() else np.isfinite(mean)
    mean = np.interp(np.log(np.maximum(t, 1)), np.log(np.maximum(t[known], 1)), np.maximum.accumulate(mean[known])) if known.any() else np.full(len(t), 50.0)
    share = np.clip(mean / 100, 0.02, 0.98)
    slope = share * (1 - share)
    shape = np.log(share / (1 - share))
    basis = np.stack([*(60.0 / 3**k * slope * shape**k for k in range(RANK)), mean], 1)
    return Course(basis, 3.0, {}, {}), lambda x: _between(t, x, many) if many.any() else x


def reading_flags(dissolution: DataFrame) -> DataFrame:
    """(batch_key, medium, run_no, time_min, reason) of the implausible readings."""
    times = time_points(dissolution)
    schema = f"batch_key string, medium string, run_no {dict(dissolution.dtypes)['run_no']}, time_min int, reason string"
    if not times:
        return dissolution.sparkSession.createDataFrame([], schema)
    # Rows of one source together, so that each batch of rows holds few sources.
    table = durable(packed(lists(dissolution), times).sortWithinPartitions("source"))
    cells = durable(course_cells(table))
    start, between = start_of_curves(cells, times)
    course = fit_course(cells, start, between)

    def flag(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = np.asarray(times)
        for pdf in frames:
            if not len(pdf):
                continue
            y, fit, held, high = _usable(pdf)
            low = np.where(np.isnan(high), np.nan, y)
            spike = np.zeros(y.shape, dtype=bool)
            for source, rows in by_source(pdf):
                basis, sigma = course.of(source)
                # The course of the readings kept, against which all others are held.
                kept, (z, *_) = settle(y[rows], fit[rows], basis, sigma, TIMES_SCATTER)
                expected = basis[:, -1] + z @ basis[:, :-1].T
                far = (np.nan_to_num(np.abs(low[rows] - expected)) > TIMES_SCATTER * sigma) | (np.nan_to_num(np.abs(high[rows] - expected)) > TIMES_SCATTER * sigma)
                spike[rows] = (kept.sum(1) >= 3)[:, None] & ~kept & ~np.isnan(low[rows]) & ~held[rows] & far
            for name, mask in (("range", (low < LOWEST) | (high > HIGHEST)), ("stuck", held), ("spike", spike)):
                row, col = np.nonzero(mask)
                if len(row):
                    part = pdf[["batch_key", "medium", "run_no"]].iloc[row].copy()
                    part["time_min"], part["reason"] = at[col], name
                    yield part

    return table.select("batch_key", "medium", "run_no", "source", "low", "high").mapInPandas(flag, schema)


def usable_values(x: np.ndarray, rules: Rules, columns: list[str]) -> np.ndarray:
    """``x`` with what ``rules.usable`` does not take for a value as NaN."""
    low, high = _limits([rules.bounds.get(c, (None, None)) for c in columns])
    bad = ~np.isfinite(x) | (((x < low) | (x > high)) & np.isin(x, rules.codes))
    for f, c in enumerate(columns):
        if rules.fills.get(c):
            bad[:, f] |= np.isin(x[:, f], rules.fills[c])
    return np.where(bad, np.nan, x)


def _labelled_batches(wide: DataFrame, metadata: DataFrame, rules: Rules, columns: list[str]) -> DataFrame:
    """One row per batch: formulation, train, date, the array ``v`` of its smallest values, and ``high`` of its largest where they differ from these."""
    width = len(columns)
    facts = ["formulation", "equipment_train", "manufacturing_date"]
    labels = first_labels(metadata, ("equipment_train",)).select("batch", F.lit(None).cast("binary").alias("v"), *facts)
    kinds = [dict(labels.dtypes)[c] for c in facts]
    names = [f"c{i}" for i in range(width)]

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], 1) if width else np.zeros((batch.num_rows, 0))
                yield pa.RecordBatch.from_arrays([batch.column("batch"), as_binary(usable_values(x, rules, columns))], ["batch", "v"])

    values = wide.where("batch is not null").select("batch", *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names, strict=True)])
    values = values.mapInArrow(usable, "batch string, v binary").select("batch", "v", *[F.lit(None).cast(k).alias(c) for c, k in zip(facts, kinds, strict=True)])

    def rows_of(head: pa.Table, low: np.ndarray, high: np.ndarray, there: np.ndarray) -> list[pa.RecordBatch]:
        differ = ((low != high) & ~np.isnan(low)).any(1)
        ends = pa.array(np.arange(len(low) + 1, dtype=np.int32) * width)
        tops = pa.array(np.r_[0, np.cumsum(differ * width)].astype(np.int32), mask=np.r_[~differ, False])
        v, top = (pa.ListArray.from_arrays(e, pa.array(x.ravel(), from_pandas=True)) for e, x in ((ends, low), (tops, high[differ])))
        out = pa.Table.from_arrays([head.column("batch"), v, top, *[head.column(c) for c in facts]], ["batch", "v", "high", *facts])
        return out.filter(pa.array(there)).to_batches()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the batch that the next rows may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).combine_chunks()
            new = np.r_[True, ~same_as_before(rows, ["batch"])]
            first = np.flatnonzero(new)
            read = np.asarray(rows.column("v").is_valid())
            low = np.full((len(rows), width), np.nan)
            low[read] = np.frombuffer(b"".join(rows.column("v").drop_null().to_pylist()), dtype=float).reshape(-1, width)
            low, high = np.fmin.reduceat(low, first), np.fmax.reduceat(low, first)
            there = np.logical_or.reduceat(read, first)
            told = np.maximum.reduceat(np.where(read, -1, np.arange(len(rows))), first)  # the row with the labels
            told = pa.array(told, mask=told < 0)
            head = pa.Table.from_arrays([rows.column("batch").take(pa.array(first)), *[rows.column(c).take(told) for c in facts]], ["batch", *facts])
            if rest is not None:
                if rest[0]["batch"][0].as_py() == head["batch"][0].as_py():
                    low[0], high[0], there[0] = np.fmin(low[0], rest[1]), np.fmax(high[0], rest[2]), there[0] | rest[3]
                    if not told[0].is_valid:
                        head = pa.concat_tables([rest[0], head.slice(1)])
                else:
                    yield from rows_of(rest[0], rest[1][None], rest[2][None], np.array([rest[3]]))
            rest = (head.slice(len(first) - 1), low[-1], high[-1], there[-1])
            yield from rows_of(head.slice(0, len(first) - 1), low[:-1], high[:-1], there[:-1])
        if rest is not None:
            yield from rows_of(rest[0], rest[1][None], rest[2][None], np.array([rest[3]]))

    # However often a batch was sent, its rows pass one after another, its labels among them.
    rows = values.unionByName(labels).repartition("batch").sortWithinPartitions("batch")
    return rows.mapInArrow(merge, "batch string, v array<double>, high array<double>, " + ", ".join(f"{c} {k}" for c, k in zip(facts, kinds, strict=True)))


def column_facts(batches: DataFrame, bounds: list[tuple[float | None, float | None]]) -> tuple[list[float], list[bool]]:
    """Per column the mean of the values within bounds, and whether there are more than ``FEW_VALUES`` different values.

    Of each column a task sends its sum and as many different values as decide the question.
    """
    low, high = _limits(bounds)

    def facts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(len(bounds)), np.zeros(len(bounds))
        seen: list[set] = [set() for _ in bounds]
        for pdf in frames:
            if not len(pdf):
                continue
            v = np.stack(pdf["v"].to_numpy()).astype(float)
            for f, s in enumerate(seen):
                if len(s) <= FEW_VALUES:
                    s.update(np.unique(v[~np.isnan(v[:, f]), f])[: FEW_VALUES + 1].tolist())
            inside = (v >= low) & (v <= high)
            total += np.where(inside, v, 0).sum(0)
            n += inside.sum(0)
        rows = [(f, x, 0.0, 0.0) for f, s in enumerate(seen) for x in sorted(s)[: FEW_VALUES + 1]]
        rows += [(f, None, total[f], n[f]) for f in range(len(bounds))]
        yield pd.DataFrame(rows, columns=["f", "value", "total", "n"])

    got = batches.select("v").mapInPandas(facts, "f int, value double, total double, n double")
    each = got.groupBy("f", "value").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    rows = each.groupBy("f").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.count("value").alias("different")).collect()
    means, varied = [float("nan")] * len(bounds), [False] * len(bounds)
    for r in rows:
        means[r["f"]] = r["total"] / r["n"] if r["n"] else float("nan")
        varied[r["f"]] = r["different"] > FEW_VALUES
    return means, varied


def _limits(bounds: list[tuple[float | None, float | None]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([-np.inf if x is None else x for x, _ in bounds]), np.array([np.inf if x is None else x for _, x in bounds])


def residuals(batches: DataFrame, bounds: list[tuple[float | None, float | None]], middle: list[float], hot: int = HOT) -> DataFrame:
    """(batch, equipment_train, outside, off, off_high): places of values beyond their bounds, and distances from the formulation's level.

    A level is the median of the formulation's values; of the two in the
    middle, or between them, what is nearest to the column's mean. Batches of
    many formulations share a task; a formulation of more than ``hot`` batches
    is spread over tasks, its middle values being found by counting.
    ``off_high`` is NULL where a batch has one value in every cell.
    """
    width = len(bounds)
    low, high = _limits(bounds)
    middle = np.asarray(middle, dtype=float)
    limit = F.get(F.array(*[F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for a, b in zip(low, high, strict=True)]), F.col("variable"))
    placed, large = by_formulation(batches, (F.col("value") >= limit["low"]) & (F.col("value") <= limit["high"]), hot)

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("formulation", kind="stable", na_position="last").reset_index(drop=True)
        v = np.stack(pdf["v"].to_numpy()).astype(float)
        twice = np.flatnonzero(pdf["high"].notna())
        top = np.stack(pdf["high"].to_numpy()[twice]).astype(float) if len(twice) else np.zeros((0, width))
        beyond = (v < low) | (v > high)
        beyond[twice] |= (top < low) | (top > high)
        v[(v < low) | (v > high)] = np.nan
        top[(top < low) | (top > high)] = np.nan
        off = np.full(v.shape, np.nan, dtype=np.float32)
        far = np.full(top.shape, np.nan, dtype=np.float32)
        for f, a, b, n in middles_of(pdf, v, hot, large):
            at = np.where(n >= 2, np.fmin(np.fmax(middle[f], a), b), np.nan)
            off[:, f] = v[:, f] - at
            far[:, f] = top[:, f] - at[twice]
        second: list[bytes | None] = [None] * len(pdf)
        for k, x in zip(twice, far, strict=True):
            second[k] = x.tobytes()
        return pd.DataFrame({"batch": pdf["batch"], "equipment_train": pdf["equipment_train"], "outside": [np.flatnonzero(x).astype(np.int32) for x in beyond], "off": [x.tobytes() for x in off], "off_high": second})

    return placed.groupBy("bucket").applyInPandas(level, "batch string, equipment_train string, outside array<int>, off binary, off_high binary")


def usual_scatter(table: DataFrame, width: int) -> DataFrame:
    """(equipment_train, usual): per train the array of 1.4826 times the median distance in each column, NULL where that is 0.

    Medians come from histograms with bins of four percent, which add up over
    any number of rows.
    """

    def bins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf[pdf["equipment_train"].notna()]
            if not len(pdf):
                continue
            off = np.abs(np.frombuffer(b"".join(pdf["off"]), dtype=np.float32).reshape(len(pdf), width).astype(float))
            train, names = pd.factorize(pdf["equipment_train"])
            row, col = np.nonzero(~np.isnan(off))
            x = off[row, col]
            at = np.where(x > 0, np.floor(np.log(np.maximum(x, 1e-300)) / BIN), EMPTY).astype(np.int64)
            keys, n = np.unique((train[row] * width + col) * SPAN + at - EMPTY, return_counts=True)
            own, keys = np.divmod(keys, SPAN * width)
            have, first = np.unique(own, return_index=True)
            yield pd.DataFrame({"equipment_train": np.asarray(names, dtype=object)[have], **{c: [x.astype(np.int64).tobytes() for x in np.split(v, first[1:])][: len(have)] for c, v in (("keys", keys), ("n", n))}})

    def middle(keys: np.ndarray, n: np.ndarray) -> list[float | None]:
        f, at = np.divmod(keys, SPAN)  # in order
        upto = np.cumsum(n)
        out: list[float | None] = [None] * width
        for k in np.unique(f):
            a, b = np.searchsorted(f, [k, k + 1])
            before = upto[a] - n[a]
            bin_of = at[a + np.flatnonzero((upto[a:b] - before) * 2 >= upto[b - 1] - before)[0]] + EMPTY
            out[k] = float(np.exp((bin_of + 0.5) * BIN) * 1.4826) if bin_of > EMPTY else None
        return out

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        train, keys, n = None, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for pdf in frames:
            done = []
            for name, more, times in zip(pdf["equipment_train"], pdf["keys"], pdf["n"], strict=True):
                if name != train:
                    if train is not None:
                        done.append((train, middle(keys, n)))
                    train, keys, n = name, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
                keys, place = np.unique(np.r_[keys, np.frombuffer(more, dtype=np.int64)], return_inverse=True)
                n = np.bincount(place, np.r_[n, np.frombuffer(times, dtype=np.int64)], len(keys)).astype(np.int64)
            yield pd.DataFrame(done, columns=["equipment_train", "usual"])
        if train is not None:
            yield pd.DataFrame([(train, middle(keys, n))], columns=["equipment_train", "usual"])

    # The counts of one train pass one after another.
    counts = table.select("equipment_train", "off").mapInPandas(bins, "equipment_train string, keys binary, n binary")
    return counts.repartition("equipment_train").sortWithinPartitions("equipment_train").mapInPandas(merge, "equipment_train string, usual array<double>")


def _runs(v: np.ndarray) -> np.ndarray:
    """Values in runs of at least ``RUN`` equal ones down each column, missing ones left out."""
    out = np.zeros(v.shape, dtype=bool)
    for f in range(v.shape[1]):
        at = np.flatnonzero(~np.isnan(v[:, f]))
        if len(at) >= RUN:
            x = v[at, f]
            edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True])
            size = np.diff(edge)
            for k in np.flatnonzero(size >= RUN):
                out[at[edge[k] : edge[k + 1]], f] = True
    return out


def stuck_cells(batches: DataFrame, varied: list[bool], chunk: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """(batch, f) of values in runs over successive batches of one train.

    The place of a batch in its train comes from counts per month, so that no
    train is sorted in one task; then chunks of ``chunk`` batches are searched
    with ``margin`` batches of their neighbours. Where a margin has too few
    values of a column to tell, that train and column are searched value by value.
    """
    width = len(varied)
    dated = batches.where("equipment_train is not null and manufacturing_date is not null")
    month = F.year("manufacturing_date") * 12 + F.month("manufacturing_date")
    dated = dated.select("batch", "equipment_train", "manufacturing_date", month.alias("month"), "v")
    counts = dated.groupBy("equipment_train", "month").count()
    before = counts.select("equipment_train", "month", (F.sum("count").over(Window.partitionBy("equipment_train").orderBy("month")) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy("equipment_train")).alias("all"))
    rank = F.row_number().over(Window.partitionBy("equipment_train", "month").orderBy("manufacturing_date", "batch"))
    placed = dated.withColumn("r", rank).join(before, ["equipment_train", "month"]).select("batch", "equipment_train", "v", (F.col("before") + F.col("r") - 1).alias("place"), "all")
    own = F.floor(F.col("place") / chunk)
    chunks = F.sequence(F.floor(F.greatest(F.col("place") - margin, F.lit(0)) / chunk), F.floor(F.least(F.col("place") + margin, F.col("all") - 1) / chunk))
    spread = placed.select("batch", "equipment_train", "v", "place", "all", own.alias("own"), F.explode(chunks).alias("chunk"))
    skip = ~np.asarray(varied)

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place").reset_index(drop=True)
        v = np.stack(pdf["v"].to_numpy()).astype(float)
        v[:, skip] = np.nan
        mine = (pdf["own"] == key[1]).to_numpy()
        row, col = np.nonzero(_runs(v) & mine[:, None])
        found = pd.DataFrame({"batch": pdf["batch"].to_numpy()[row], "equipment_train": key[0], "f": col.astype(np.int32), "open": False})
        first, last = np.flatnonzero(mine)[[0, -1]] if mine.any() else (0, -1)
        known = ~np.isnan(v)
        thin = np.zeros(width, dtype=bool)
        if pdf["place"].iat[0] > 0:
            thin |= known[:first].sum(0) < RUN - 1
        if pdf["place"].iat[-1] < pdf["all"].iat[0] - 1:
            thin |= known[last + 1 :].sum(0) < RUN - 1
        thin &= known.any(0)
        return pd.concat([found, pd.DataFrame({"batch": None, "equipment_train": key[0], "f": np.flatnonzero(thin).astype(np.int32), "open": True})], ignore_index=True)

    searched = durable(spread.groupBy("equipment_train", "chunk").applyInPandas(search, "batch string, equipment_train string, f int, open boolean"))
    found = searched.where("not open").select("batch", "f")
    unclear = searched.where("open").select("equipment_train", "f").distinct()
    if unclear.isEmpty():
        return found
    cells = placed.select("batch", "equipment_train", "place", F.posexplode("v").alias("f", "x")).where("x is not null").join(unclear, ["equipment_train", "f"])
    per = Window.partitionBy("equipment_train", "f", "block")
    cells = cells.withColumn("block", F.floor(F.col("place") / chunk)).withColumn("r", F.row_number().over(per.orderBy("place")))
    blocks = cells.groupBy("equipment_train", "f", "block").count()
    earlier = blocks.select("equipment_train", "f", "block", (F.sum("count").over(Window.partitionBy("equipment_train", "f").orderBy("block")) - F.col("count")).alias("before"))
    cells = cells.join(earlier, ["equipment_train", "f", "block"]).withColumn("at", F.col("before") + F.col("r"))
    island = F.col("at") - F.row_number().over(Window.partitionBy("equipment_train", "f", "x").orderBy("at"))
    runs = cells.withColumn("island", island).withColumn("n", F.count("*").over(Window.partitionBy("equipment_train", "f", "x", "island")))
    return found.unionByName(runs.where(F.col("n") >= RUN).select("batch", "f")).distinct()


def _start_of_cells(table: DataFrame, width: int) -> Course:
    """A first course of rows in units of scatter: no mean, and the leading directions of all rows, large values cut back."""

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, width, width))
        for pdf in frames:
            for rows, block in zip(pdf["rows"], pdf["cells"], strict=True):
                x, seen = _cells_of(block, rows)
                x = np.clip(x, -3, 3)
                seen = seen.astype(float)
                total += [x.T @ x, seen.T @ seen]
        i, j = np.nonzero(total[1])
        yield pd.DataFrame({"i": i, "j": j, "s": total[0][i, j], "n": total[1][i, j]})

    got = table.select("rows", "cells").mapInPandas(products, "i int, j int, s double, n double").groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("c")).collect()
    cov = np.zeros((width, width))
    for r in got:
        cov[r["i"], r["j"]] = r["c"]
    values, vectors = np.linalg.eigh(cov)
    rank = min(CELL_RANK, width)
    lead = np.sqrt(np.maximum(values[::-1][:rank] - np.median(values), 0.01))
    return Course(np.column_stack([vectors[:, ::-1][:, :rank] * lead, np.zeros(width)]), 1.0, {}, {})


def cell_spikes(table: DataFrame, width: int) -> DataFrame:
    """(batch, f): cells of ``table`` (batch, equipment_train, off, off_high) off the course of their row and off their formulation's level."""
    usual = durable(usual_scatter(table, width))
    widest = [None] * width
    for r in usual.select(F.posexplode("usual").alias("f", "u")).groupBy("f").agg(F.max("u").alias("u")).collect():
        widest[r["f"]] = r["u"]
    # A batch whose train is not known is held against the train with the widest scatter.
    most = F.array(*[F.lit(x).cast("double") for x in widest])
    rows = table.join(usual, "equipment_train", "left").select("batch", F.coalesce("equipment_train", F.lit("")).alias("source"), "off", "off_high", F.coalesce("usual", most).alias("usual"))

    def scale(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                unit = np.stack(pdf["usual"].to_numpy()).astype(float)
                rows = [(np.frombuffer(b"".join(pdf[c][pdf[c].notna()]), dtype=np.float32).reshape(-1, width) / unit[pdf[c].notna()]).astype(np.float32) for c in ("off", "off_high")]
                out = pdf[["batch", "source"]].copy()
                out["cells"] = [x.tobytes() for x in rows[0]]
                top = iter(rows[1])
                out["high"] = [next(top).tobytes() if b else None for b in pdf["off_high"].notna()]
                yield out

    scaled = durable(rows.mapInPandas(scale, "batch string, source string, cells binary, high binary").sortWithinPartitions("source"))

    def block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield in_blocks(pdf, np.frombuffer(b"".join(pdf["cells"]), dtype=np.float32).reshape(len(pdf), width))

    blocks = durable(scaled.select("source", "cells").mapInPandas(block, BLOCKS))
    course = fit_course(blocks, _start_of_cells(blocks, width))

    def far(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            x, seen = _cells_of(b"".join(pdf["cells"]), len(pdf))
            top = x.copy()
            for k, b in enumerate(pdf["high"]):
                if b is not None:
                    top[k] = np.nan_to_num(np.frombuffer(b, dtype=np.float32))
            found = np.zeros(x.shape, dtype=bool)
            for source, at in by_source(pdf):
                basis, sigma = course.of(source)
                kept, (_, _, d, _) = settle(x[at], seen[at], basis, sigma, STANDS_OUT)
                for v in (x, top):
                    stands_out = ~kept | (np.abs(d + v[at] - x[at]) > STANDS_OUT * sigma)
                    found[at] |= stands_out & (np.abs(v[at]) > TIMES_SCATTER)
            row, col = np.nonzero(found)
            yield pd.DataFrame({"batch": pdf["batch"].to_numpy()[row], "f": col.astype(np.int32)})

    return scaled.mapInPandas(far, "batch string, f int")


def cell_flags(wide: DataFrame, metadata: DataFrame, families: DataFrame, record: DataFrame, derived: Sequence[str] = ()) -> DataFrame:
    """(batch, field, reason) of the implausible cells of the batch table; cells without a usable value are no readings.

    ``derived`` names columns that follow from other data and are not tested.
    """
    rules = find_rules(wide, families, record)
    columns = [c for c in measured_columns(wide) if c not in derived]
    bounds = [rules.bounds.get(c, (None, None)) for c in columns]
    batches = durable(_labelled_batches(wide, metadata, rules, columns))
    means, varied = column_facts(batches, bounds)
    table = durable(residuals(batches, bounds, means))
    spikes = cell_spikes(table, len(columns)).withColumn("reason", F.lit("spike"))
    outside = table.select("batch", F.explode("outside").alias("f")).withColumn("reason", F.lit("range"))
    stuck = stuck_cells(batches, varied)
    twice = batches.where("high is not null")
    if not twice.isEmpty():  # runs that the larger of two values in a cell belongs to
        stuck = stuck.unionByName(stuck_cells(batches.withColumn("v", F.coalesce("high", "v")), varied)).distinct()
    found = outside.unionByName(spikes).unionByName(stuck.withColumn("reason", F.lit("stuck")))
    return found.select("batch", F.get(F.array(*[F.lit(c) for c in columns]), F.col("f")).alias("field"), "reason")
