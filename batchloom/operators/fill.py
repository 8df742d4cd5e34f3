"""Filling missing values from similar records.

A number is seen as the level of its group plus a distance from it. The level
is the median of the formulation's values, or, where the formulation has none,
of the batches made around the same time, else of all. A Chow-Liu dependency
tree is fitted over the discretised distances and the category fields.
Messages passed along it give every missing cell a posterior over its bins. A
number is decoded to its level plus the median distance in the bin in which
the posterior reaches one half; of a category the group's frequency of every
label is combined with what the posterior says for it over the prior, and the
likeliest is taken. Every cell without a usable value gets one and is marked;
cells with one are not touched.

Work is on distributed tables throughout. What reaches the driver has the size
of the schema: medians per quarter of a year, counts per field and bin, the
counts of bin pairs and the tree. Medians of formulations are exact; a
formulation of any size is shared by several tasks.

Defined results for odd input: NULL, NaN and infinite numbers, numbers that
recur outside the bounds through the columns, values an earlier run filled in
and words for "no value" are missing; a batch that appears several times keeps
its first usable value per field by ``loaded_at``, of those loaded at one time
the smallest; a batch without metadata or without date is placed by the time it
was loaded; a field without any usable value keeps NULL as value but is still
reported as missing; NULL batches are left out; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.functions.domain import finite, formulation_number, usable_word
from batchloom.operators.longform import exact_middles
from batchloom.session import durable

CATEGORIES = ("scale", "equipment_train", "site", "operator_shift")
BINS = 9  # bins of a measured field
LABELS = 1000  # labels of a category field with a bin of their own; rarer ones share one, and are told apart by the group's frequencies
GROUP = 20_000  # batches of a formulation whose medians one task finds; those of more are found by counting, with the same result
BELIEFS = 1_000_000  # bins of rows whose posteriors a task holds at a time; fields with many labels take many
WIDTH, ZERO = 0.02, 40_000  # width of a bin of logarithms of distances, and what keeps their numbers positive
PERIOD_MONTHS = 3  # batches made within one such period count as made around the same time


@dataclass(frozen=True)
class Rules:
    """What is not a usable number: bounds, recurring codes, and the values earlier runs filled in."""

    bounds: dict[str, tuple[float | None, float | None]]
    codes: list[float]
    fills: dict[str, list[float]]

    def usable(self, column: str) -> Column:
        value = finite(F.col(f"`{column}`").cast("double"))
        low, high = self.bounds.get(column, (None, None))
        outside = F.lit(False)
        if low is not None:
            outside = outside | (value < low)
        if high is not None:
            outside = outside | (value > high)
        out = F.when(outside & value.isin(self.codes), None) if self.codes else F.when(F.lit(False), None)
        if self.fills.get(column):
            out = out.when(value.isin(self.fills[column]), None)
        return out.otherwise(value)


def measured_columns(wide: DataFrame) -> list[str]:
    return [c for c, kind in wide.dtypes if c != "batch" and kind in ("double", "float")]


def find_rules(wide: DataFrame, families: DataFrame, record: DataFrame) -> Rules:
    """Bounds from ``families``, fill values from ``record``, and the codes for "no value" found in ``wide``.

    A code is a whole number outside the bounds of its column that recurs in
    at least two, and a tenth, of the columns. ``families`` and ``record``
    have one row per column and per earlier fill.
    """
    columns = measured_columns(wide)
    clean = lambda x: None if x is None or x != x else float(x)
    bounds = {r.variable: (clean(r.low), clean(r.high)) for r in families.where(F.col("variable").isin(columns)).collect()}
    filled = record.where(F.col("column_name").isin(columns) & F.col("fill_value").isNotNull()).select("column_name", "fill_value").distinct().collect()
    fills: dict[str, list[float]] = {}
    for r in filled:
        if r.fill_value == r.fill_value:
            fills.setdefault(r.column_name, []).append(float(r.fill_value))
    outside = []
    for c in columns:
        low, high = bounds.get(c, (None, None))
        v = F.col(f"`{c}`")
        bad = F.lit(False) if low is None else v < low
        bad = bad if high is None else bad | (v > high)
        outside.append(F.when(bad & ~F.isnan(v) & (v == F.floor(v)), F.struct(F.lit(c).alias("column"), v.cast("double").alias("value"))))
    if not outside:
        return Rules(bounds, [], fills)
    found = wide.select(F.explode(F.filter(F.array(*outside), lambda x: x.isNotNull())).alias("x")).select("x.*")
    recurring = found.groupBy("value").agg(F.countDistinct("column").alias("n")).where(F.col("n") >= max(2, len(columns) / 10))
    return Rules(bounds, sorted(r.value for r in recurring.collect()), fills)


def first_usable(wide: DataFrame, rules: Rules) -> DataFrame:
    """One row per batch: ``v``, the array of its first usable value of every measured column, and ``_at``, when it was loaded first.

    Rows of a batch are brought together in two aggregations, each combined
    before its shuffle: first those loaded at one time, then all.
    """
    names = [f"c{i}" for i in range(len(measured_columns(wide)))]
    loaded = F.col("loaded_at") if "loaded_at" in wide.columns else F.lit(None).cast("timestamp_ntz")
    clean = wide.where("batch is not null").select("batch", loaded.alias("_at"), *[rules.usable(c).alias(n) for c, n in zip(measured_columns(wide), names, strict=True)])
    once = clean.groupBy("batch", "_at").agg(*[F.min(n).alias(n) for n in names])
    # Rows without a time of loading come last.
    order = F.coalesce(F.col("_at"), F.lit("9999-12-31").cast("timestamp_ntz"))
    first = [F.min_by(n, F.when(F.col(n).isNotNull(), order)).alias(n) for n in names]
    per = once.groupBy("batch").agg(F.min("_at").alias("_at"), *first)
    return per.select("batch", "_at", F.array(*[F.col(n) for n in names]).cast("array<double>").alias("v"))


def first_labels(metadata: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """One row per batch: formulation number, manufacturing date and first usable label of every category."""
    loaded = F.col("loaded_at") if "loaded_at" in metadata.columns else F.lit(None).cast("timestamp_ntz")
    clean = metadata.where("batch is not null").select(
        "batch", loaded.alias("_at"), formulation_number(F.col("formulation")).alias("formulation"), "manufacturing_date", *[usable_word(F.col(c)).alias(c) for c in categories]
    )
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct("_at", F.col(c))))[c].alias(c) for c in ("formulation", "manufacturing_date", *categories)]
    return clean.groupBy("batch").agg(F.min("_at").alias("_seen"), *first)


def merged_batches(wide: DataFrame, metadata: DataFrame, rules: Rules) -> DataFrame:
    """Batches of either table: in_wide, in_metadata, formulation, period, ``v`` and the category fields."""
    a = first_usable(wide, rules).withColumn("in_wide", F.lit(True))
    b = first_labels(metadata).withColumn("in_metadata", F.lit(True))
    joined = a.join(b, "batch", "full")
    made = F.coalesce("manufacturing_date", "_at", "_seen")
    period = F.floor((F.year(made) * 12 + F.month(made) - 1) / PERIOD_MONTHS).cast("int")
    none = F.array_repeat(F.lit(None).cast("double"), len(measured_columns(wide)))
    return joined.select("batch", F.coalesce("in_wide", F.lit(False)).alias("in_wide"), F.coalesce("in_metadata", F.lit(False)).alias("in_metadata"), "formulation", period.alias("period"), F.coalesce("v", none).alias("v"), *CATEGORIES)


def group_middles(v: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower middle, upper middle, number) of the known values of each row's group; ``group`` is sorted."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    order = np.lexsort((v, group))  # NaN comes last in each group
    s = v[order]
    n = np.add.reduceat((~np.isnan(v)).astype(np.int64), first)
    low, high = s[first + np.maximum(n - 1, 0) // 2], s[first + np.minimum(n // 2, np.maximum(n - 1, 0))]
    return np.repeat(low, size), np.repeat(high, size), np.repeat(n, size)


@dataclass(frozen=True)
class Middles:
    """Of formulations, sorted, the two middle values per place of ``v``, NaN where there are none."""

    formulations: np.ndarray
    values: np.ndarray  # formulations, places, 2


def by_formulation(batches: DataFrame, inside: Column, hot: int) -> tuple[DataFrame, Middles]:
    """``batches`` with ``bucket``: rows of one bucket are to be one task's; and the middles of the formulations that no bucket holds whole.

    Formulations share buckets and lie in one whole. Those of more than
    ``hot`` batches are spread over all buckets; their middles, found by
    counting over all tasks, go to the tasks once and not with every row.
    ``inside`` tells which values count, from ``variable`` and ``value``.
    """
    sizes = durable(batches.groupBy("formulation").count())
    large = sizes.where((F.col("count") > hot) & F.col("formulation").isNotNull()).select("formulation")
    n = sizes.agg(F.sum("count")).first()[0] or 0
    names = np.array(sorted(r[0] for r in large.collect()), dtype=np.int64)  # at most n / hot
    values = np.full((len(names), 0, 2), np.nan)
    spread = F.col("formulation").isNull()
    if len(names):
        cells = batches.join(F.broadcast(large), "formulation").select("formulation", F.posexplode("v").alias("variable", "value"))
        got = exact_middles(durable(cells.where(inside)), ["formulation", "variable"]).toPandas()
        values = np.full((len(names), int(got["variable"].max()) + 1 if len(got) else 0, 2), np.nan)
        values[np.searchsorted(names, got["formulation"].to_numpy(dtype=np.int64)), got["variable"].to_numpy(dtype=np.int64)] = got[["low", "high"]].to_numpy(dtype=float)
        batches = batches.join(F.broadcast(large.withColumn("_large", F.lit(True))), "formulation", "left")
        spread = spread | F.col("_large").isNotNull()
    own = F.when(spread, F.xxhash64("batch")).otherwise(F.xxhash64("formulation"))
    # Buckets of a quarter of ``hot`` on average: one with several large formulations stays near ``hot``.
    return batches.withColumn("bucket", F.pmod(own, F.lit(max(1, -(-4 * n // hot)))).cast("int")).drop("_large"), Middles(names, values)


def middles_of(pdf: pd.DataFrame, v: np.ndarray, hot: int, large: Middles) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, lower middle, upper middle, number of values) per row of a bucket sorted by formulation."""
    group = pdf["formulation"].fillna(2**62).astype(np.int64).to_numpy()
    at = np.searchsorted(large.formulations, group)
    given = np.flatnonzero(np.append(large.formulations, 2**62)[at] == group)
    given = given[group[given] != 2**62]
    for f in range(v.shape[1]):
        a, b, n = group_middles(v[:, f], group)
        if len(given):
            known = large.values[at[given], f] if f < large.values.shape[1] else np.full((len(given), 2), np.nan)
            a[given], b[given] = known.T
            n[given] = np.where(np.isnan(known[:, 0]), 0, hot)
        n[group == 2**62] = 0
        yield f, a, b, n


def period_levels(batches: DataFrame, width: int) -> dict[int | None, np.ndarray]:
    """Medians of the places of ``v`` among the batches made in one period, and under None among all; there are four periods a year."""
    mid = F.array(*[F.percentile_approx(F.get("v", F.lit(i)), 0.5, 1000) for i in range(width)]).cast("array<double>").alias("m")
    known = batches.where("in_wide")
    out = {r["period"]: np.array([np.nan if x is None else x for x in r["m"]]) for r in known.where("period is not null").groupBy("period").agg(mid).collect()}
    r = known.agg(mid).first()
    out[None] = np.array([np.nan if x is None else x for x in r["m"]]) if r["m"] is not None else np.full(width, np.nan)
    return out


def distances(batches: DataFrame, width: int, hot: int = GROUP) -> DataFrame:
    """``batches`` with ``dist``, the distances of the known values from their levels, ``level`` and ``source``, of the missing ones in order.

    ``source`` is 0 where the level is the formulation's, 1 the period's, 2 that
    of all batches, 3 where there is none.
    """
    by_period = period_levels(batches, width)
    blank = np.full(width, np.nan)
    placed, large = by_formulation(batches, F.col("value").isNotNull(), hot)

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("formulation", kind="stable", na_position="last").reset_index(drop=True)
        v = np.stack(pdf["v"].to_numpy()).astype(float)
        at, source = np.empty(v.shape), np.zeros(v.shape, dtype=np.int8)
        for f, a, b, n in middles_of(pdf, v, hot, large):
            at[:, f] = np.where(n > 0, (a + b) / 2, np.nan)
        for k, others in ((1, np.stack([by_period.get(None if p != p else p, blank) for p in pdf["period"]])), (2, by_period[None][None, :])):
            gone = np.isnan(at)
            at, source = np.where(gone, others, at), np.where(gone, np.int8(k), source)
        source[np.isnan(at)] = 3
        gone = np.isnan(v)
        out = pdf[["batch", "in_wide", "in_metadata", "formulation", "period", *CATEGORIES]].copy()
        out["dist"] = [x.tobytes() for x in (v - at).astype(np.float32)]
        out["level"] = [x[m].tobytes() for x, m in zip(at, gone, strict=True)]
        out["source"] = [x[m].tobytes() for x, m in zip(source, gone, strict=True)]
        return out

    labels = ", ".join(f"{c} string" for c in CATEGORIES)
    schema = f"batch string, in_wide boolean, in_metadata boolean, formulation long, period int, {labels}, dist binary, level binary, source binary"
    return placed.groupBy("bucket").applyInPandas(level, schema)


def unpacked(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float32).reshape(len(column), width).astype(float)


def _place(x: np.ndarray) -> np.ndarray:
    """Number of the bin of signed logarithms that holds each distance, in the order of the distances; 0 for none."""
    size = np.floor(np.log(np.maximum(np.abs(x), 1e-300)) / WIDTH).astype(np.int64) + ZERO
    return np.where(x == 0, 0, np.where(x > 0, size, -size))


def _distance(place: np.ndarray) -> np.ndarray:
    return np.where(place == 0, 0.0, np.sign(place) * np.exp((np.abs(place) - ZERO + 0.5) * WIDTH))


@dataclass(frozen=True)
class Coding:
    """How fields become bins 0..size-1; -1 is missing."""

    numbers: list[str]
    edges: list[np.ndarray]  # per number the places (see _place) from which the next bin begins
    middles: list[np.ndarray]  # per number the median distance in each bin
    labels: dict[str, list[str]]

    @property
    def fields(self) -> list[str]:
        return [*self.numbers, *self.labels]

    @property
    def sizes(self) -> list[int]:
        return [len(e) + 1 for e in self.edges] + [len(x) + 1 for x in self.labels.values()]

    def codes(self, pdf: pd.DataFrame) -> np.ndarray:
        """One row per row of ``pdf`` (dist and the categories), one column per field."""
        x = unpacked(pdf["dist"], len(self.numbers))
        out = np.full((len(pdf), len(self.fields)), -1, dtype=np.int64)
        for f, edges in enumerate(self.edges):
            known = ~np.isnan(x[:, f])
            out[known, f] = np.searchsorted(edges, _place(x[known, f]), "right")
        for f, (c, labels) in enumerate(self.labels.items(), len(self.numbers)):
            known = pdf[c].notna().to_numpy()
            out[known, f] = pdf[c][known].map({x: i for i, x in enumerate(labels)}).fillna(len(labels)).astype(np.int64)
        return out


def fit_coding(table: DataFrame, numbers: list[str]) -> Coding:
    """Bins with about equal numbers of distances, from counts that add up over tasks, and the labels of each category."""
    width = len(numbers)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = unpacked(pdf["dist"], width)
                row, f = np.nonzero(~np.isnan(x))
                keys, n = np.unique(f * (4 * ZERO) + _place(x[row, f]) + 2 * ZERO, return_counts=True)
                yield pd.DataFrame({"f": keys // (4 * ZERO), "place": keys % (4 * ZERO) - 2 * ZERO, "n": n})

    got = table.select("dist").mapInPandas(count, "f int, place long, n long").groupBy("f", "place").agg(F.sum("n").alias("n")).toPandas()
    edges, middles = [], []
    for f in range(width):
        mine = got[got["f"] == f].sort_values("place")
        place, n = mine["place"].to_numpy(dtype=np.int64), mine["n"].to_numpy(dtype=float)
        if not len(place):
            edges.append(np.zeros(0, dtype=np.int64))
            middles.append(np.zeros(1))
            continue
        middle = (np.cumsum(n) - n / 2) / n.sum()
        part = np.minimum((middle * BINS).astype(int), BINS - 1)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        edges.append(place[starts[1:]])
        middles.append(np.array([_distance(p[np.searchsorted(np.cumsum(k), k.sum() / 2)]) for p, k in zip(np.split(place, starts[1:]), np.split(n, starts[1:]), strict=True)], dtype=float))
    labels = {}
    for c in CATEGORIES:
        top = table.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(LABELS)
        labels[c] = [r[0] for r in top.collect()]
    return Coding(numbers, edges, middles, labels)


def pair_counts(table: DataFrame, coding: Coding) -> np.ndarray:
    """Counts of every pair of (field, bin) over all batches, as one square matrix.

    Each partition multiplies its one-hot rows and sends one matrix of the
    size of the schema; Spark adds them up.
    """
    starts = np.concatenate([[0], np.cumsum(coding.sizes)]).astype(np.int64)
    width = int(starts[-1])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                codes = coding.codes(pdf)
                for part in np.array_split(codes, -(-len(codes) // 4096)):
                    hot = np.zeros((len(part), width), dtype=np.float32)
                    row, field = np.nonzero(part >= 0)
                    hot[row, starts[field] + part[row, field]] = 1.0
                    gram += hot.T @ hot
        i, j = np.nonzero(np.triu(gram))
        yield pd.DataFrame({"i": i, "j": j, "n": gram[i, j]})

    total = table.select("dist", *CATEGORIES).mapInPandas(partial, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    gram = np.zeros((width, width))
    gram[total["i"].to_numpy(dtype=int), total["j"].to_numpy(dtype=int)] = total["n"]
    return np.maximum(gram, gram.T)


@dataclass(frozen=True)
class Tree:
    """Fields in an order in which each follows its parent; tables[f] is P(f = column | parent = row)."""

    order: list[int]
    parent: list[int]
    tables: list[np.ndarray]
    prior: list[np.ndarray]


def chow_liu(gram: np.ndarray, sizes: list[int], smooth: float = 0.5) -> Tree:
    """The spanning tree of largest mutual information, by Prim's rule, with smoothed conditional tables."""
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    k = len(sizes)
    block = lambda i, j: gram[starts[i] : starts[i + 1], starts[j] : starts[j + 1]]
    prior = [(np.diag(block(i, i)) + smooth) / (np.diag(block(i, i)) + smooth).sum() for i in range(k)]
    info = np.zeros((k, k))
    for i in range(k):
        for j in range(i):
            joint = block(i, j)
            total = joint.sum()
            if total > 0:
                p = joint / total
                a, b = p.sum(1, keepdims=True), p.sum(0, keepdims=True)
                seen = p > 0
                # Less the bias of as many cells, so that rarely shared fields aren't preferred.
                info[i, j] = info[j, i] = (p[seen] * np.log((p / np.where(a * b > 0, a * b, 1))[seen])).sum() - (len(a) - 1) * (b.size - 1) / (2 * total)
    order, parent, tables = [0], [-1] * k, [np.zeros((0, 0))] * k
    best = info[0].copy() if k else np.zeros(0)
    via = np.zeros(k, dtype=int)
    left = set(range(1, k))
    while left:
        f = max(left, key=lambda x: (best[x], -x))
        left.remove(f)
        p = int(via[f])
        joint = block(p, f) + smooth * prior[f][None, :]
        order.append(f)
        parent[f], tables[f] = p, joint / joint.sum(1, keepdims=True)
        for x in left:
            if info[f, x] > best[x]:
                best[x], via[x] = info[f, x], f
    return Tree(order, parent, tables, prior)


def posteriors(tree: Tree, codes: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """P(field's bin | all observed other fields), one array (rows, bins) per field, by two passes over the tree."""
    n, k = codes.shape
    local = []
    for f in range(k):
        e = np.ones((n, sizes[f]))
        seen = codes[:, f] >= 0
        e[seen] = 0.0
        e[np.nonzero(seen)[0], codes[seen, f]] = 1.0
        local.append(e)
    up: list[np.ndarray] = [np.zeros(0)] * k
    below = [x.copy() for x in local]
    for f in reversed(tree.order):
        p = tree.parent[f]
        if p >= 0:
            m = below[f] @ tree.tables[f].T
            up[f] = m / m.sum(1, keepdims=True)
            below[p] *= up[f]
    out: list[np.ndarray] = [np.zeros(0)] * k
    for f in tree.order:
        p = tree.parent[f]
        if p < 0:
            belief = below[f] * tree.prior[f]
        else:
            rest = out[p] / np.maximum(up[f], 1e-12)
            rest /= np.maximum(rest.sum(1, keepdims=True), 1e-300)
            belief = below[f] * (rest @ tree.tables[f])
        total = belief.sum(1, keepdims=True)
        out[f] = np.where(total > 0, belief / np.maximum(total, 1e-300), tree.prior[f])
    return out


def portions(rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """``rows`` in parts of which the posteriors, ``width`` bins a row, have at most ``BELIEFS`` numbers."""
    step = max(1, BELIEFS // width)
    for k in range(0, len(rows), step):
        yield rows[k : k + step]


@dataclass(frozen=True)
class Filled:
    cells: DataFrame  # batch, field, number, label, taken_from: one row per filled cell
    tree: Tree
    coding: Coding
    rules: Rules
    batches: DataFrame  # one row per batch with its usable values, as before filling


def _label_counts(labels: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Per group and field: the labels with their bins and numbers; as many as the field has labels at most."""
    counts = labels.groupBy(*keys, "field", "bin", "label").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys, "field").agg(F.collect_list(F.struct("bin", "n", "label")).alias(name))


def fill_missing(wide: DataFrame, metadata: DataFrame, families: DataFrame, record: DataFrame) -> Filled:
    """Fill every cell without a usable value; see the module's text for how."""
    rules = find_rules(wide, families, record)
    numbers = measured_columns(wide)
    width = len(numbers)
    batches = durable(merged_batches(wide, metadata, rules))
    table = durable(distances(batches, width))
    coding = fit_coding(table, numbers)
    fields, sizes = coding.fields, coding.sizes
    tree = chow_liu(pair_counts(table, coding), sizes)
    sources = np.array(["formulation", "time", "all", ""], dtype=object)

    def infer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            codes = coding.codes(pdf)
            gone = codes < 0
            wanted = gone.copy()
            wanted[:, :width] &= pdf["in_wide"].to_numpy(dtype=bool)[:, None]
            wanted[:, width:] &= pdf["in_metadata"].to_numpy(dtype=bool)[:, None]
            for at in portions(np.flatnonzero(wanted.any(1)), sum(sizes)):
                yield answers(pdf.iloc[at], codes[at], wanted[at])

    def answers(pdf: pd.DataFrame, codes: np.ndarray, wanted: np.ndarray) -> pd.DataFrame:
        beliefs, gone = posteriors(tree, codes, sizes), codes < 0
        level, source = np.full((len(pdf), width), np.nan), np.full((len(pdf), width), 3, dtype=np.int8)
        level[gone[:, :width]] = np.frombuffer(b"".join(pdf["level"]))
        source[gone[:, :width]] = np.frombuffer(b"".join(pdf["source"]), dtype=np.int8)
        rows, column, number, taken, support = [], [], [], [], []
        for f in range(len(fields)):
            at = np.flatnonzero(wanted[:, f])
            belief = beliefs[f][at]
            rows.append(at)
            column.append(np.full(len(at), f, dtype=np.int32))
            if f < width:
                half = np.minimum((np.cumsum(belief, 1) < 0.5).sum(1), sizes[f] - 1)
                number.append(level[at, f] + coding.middles[f][np.minimum(half, len(coding.middles[f]) - 1)])
                taken.append(np.where(np.isnan(number[-1]), None, sources[source[at, f]]))
                support += [None] * len(at)
            else:
                number.append(np.full(len(at), np.nan))
                taken.append(np.full(len(at), None))
                support += list((belief / tree.prior[f]).astype(np.float32))
        value = np.concatenate(number)
        out = pdf[["batch", "formulation", "period"]].iloc[np.concatenate(rows)].reset_index(drop=True)
        out["field"], out["taken_from"], out["support"] = np.concatenate(column), np.concatenate(taken), pd.Series(support, dtype=object)
        out["number"] = pd.arrays.FloatingArray(np.nan_to_num(value), np.isnan(value))
        return out

    missing = durable(table.mapInPandas(infer, "batch string, formulation long, period int, field int, number double, taken_from string, support array<float>"))

    known = spark_labels(batches.sparkSession, coding)
    entries = F.array(*[F.struct(F.lit(width + i).alias("field"), F.col(c).alias("label")) for i, c in enumerate(CATEGORIES)])
    labels = batches.select("formulation", "period", F.explode(entries).alias("e")).select("formulation", "period", "e.*").where("label is not null")
    # One row per label with a bin, at most LABELS of a field.
    labels = labels.join(F.broadcast(known), ["field", "label"], "left").select("formulation", "period", "field", "label", F.coalesce("bin", F.lit(LABELS)).alias("bin"))
    by_form = _label_counts(labels.where("formulation is not null"), ["formulation"], "form_bins")
    by_period = _label_counts(labels.where("period is not null"), ["period"], "period_bins")
    overall = _label_counts(labels, [], "all_bins")
    # The group's frequency of the label times what the other fields say for its bin over the bin's prior.
    weight = lambda x: x["n"] * (F.get("support", F.least(x["bin"].cast("int"), F.size("support") - 1)) + 1e-3)
    likeliest = F.array_max(F.transform(F.coalesce("form_bins", "period_bins", "all_bins"), lambda x: F.struct(weight(x), x["label"].alias("label"))))["label"]
    joined = missing.where("support is not null").join(by_form, ["formulation", "field"], "left").join(by_period, ["period", "field"], "left").join(F.broadcast(overall), "field", "left")
    source = F.when(F.col("form_bins").isNotNull(), "formulation").when(F.col("period_bins").isNotNull(), "time").when(F.col("all_bins").isNotNull(), "all")
    words = joined.select("batch", "field", F.lit(None).cast("double").alias("number"), likeliest.alias("label"), source.alias("taken_from"))
    figures = missing.where("support is null").select("batch", "field", "number", F.lit(None).cast("string").alias("label"), "taken_from")
    names = F.array(*[F.lit(f) for f in fields])
    cells = durable(figures.unionByName(words).withColumn("field", F.get(names, F.col("field"))))
    return Filled(cells, tree, coding, rules, batches)


def spark_labels(spark: SparkSession, coding: Coding) -> DataFrame:
    rows = [(len(coding.numbers) + i, x, k) for i, own in enumerate(coding.labels.values()) for k, x in enumerate(own)]
    return spark.createDataFrame(rows, "field int, label string, bin int")


def apply_fills(filled: Filled) -> DataFrame:
    """One row per batch with all fields filled in and ``filled``, the array of fields that were.

    A batch of only one of the two tables keeps NULL in the fields of the other.
    """
    per_batch = filled.cells.groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("number", "label")))).alias("_fills"))
    joined = filled.batches.join(per_batch, "batch", "left")
    numbers = [F.coalesce(F.get("v", F.lit(i)), F.col("_fills")[c]["number"]).alias(c) for i, c in enumerate(filled.coding.numbers)]
    labels = [F.coalesce(F.col(c), F.col("_fills")[c]["label"]).alias(c) for c in CATEGORIES]
    marks = F.coalesce(F.array_sort(F.map_keys("_fills")), F.array().cast("array<string>"))
    return joined.select("batch", "formulation", *numbers, *labels, marks.alias("filled"))
