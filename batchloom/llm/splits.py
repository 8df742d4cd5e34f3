"""Splits that keep related records together.

Records are tied to the entities they name. Ties are contracted in rounds:
every component picks its smallest incident edge, the picked edges join the
persisted spanning forest, components shrink to their roots, and edges inside
one component vanish. Each round at least halves the number of components that
still have an edge, so there are logarithmically many. Roots are then
stratified by size band and dealt systematically to the splits.

All of it is joins and aggregations on distributed tables; each round's tables
are written to the shared folder, so a lost executor costs one round at most.
Only per-round counts, the targets, one sum per split and size band, and the
groups larger than a whole split reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from batchloom.functions.domain import formulation_number, stem
from batchloom.session import durable

APART = 1.0  # groups larger than this part of the smallest split are placed one by one
BUCKETS = 1024
GOLDEN = 0.6180339887498949


@dataclass(frozen=True)
class Forest:
    roots: DataFrame  # node, root: nodes that have an edge; any other node is its own root
    edges: DataFrame  # u, v: the spanning forest
    rounds: int


def _jumped(parents: DataFrame) -> DataFrame:
    """Parent pointers (node, parent) followed until they reach roots; depth halves with each pass."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        nxt = durable(parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
        if nxt.where("moved").isEmpty():
            return nxt.select("node", "parent")
        parents = nxt.select("node", "parent")


def contract(edges: DataFrame) -> Forest:
    """Spanning forest and roots of the graph with long endpoints ``u`` and ``v``.

    NULL endpoints, loops and repeated edges are ignored; without edges both
    results are empty. The root of a component is some node of it.
    """
    spark = edges.sparkSession
    weight = F.struct(F.xxhash64("u", "v").alias("h"), F.col("u").alias("u0"), F.col("v").alias("v0"))
    left = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct().select("u", "v", weight.alias("w"))
    left = durable(left)
    roots = spark.createDataFrame([], "node bigint, root bigint")
    forest = spark.createDataFrame([], "u bigint, v bigint")
    rounds = 0
    while not left.isEmpty():
        rounds += 1
        both = left.select(F.col("u").alias("node"), F.col("v").alias("to"), "w").union(left.select("v", "u", "w"))
        # Edge weights are distinct, so the picked edges close no cycle but that of two nodes picking one edge.
        picked = durable(both.groupBy("node").agg(F.min(F.struct("w", "to")).alias("m")).select("node", F.col("m.to").alias("to"), F.col("m.w").alias("w")))
        back = picked.select(F.col("node").alias("to"), F.col("to").alias("its"))
        parents = picked.join(back, "to").select("node", F.when((F.col("its") == F.col("node")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("parent"))
        up = _jumped(durable(parents))
        forest = forest.union(picked.select(F.col("w.u0").alias("u"), F.col("w.v0").alias("v")))
        moved = up.select(F.col("node").alias("root"), F.col("parent").alias("_new"))
        seen = roots.join(moved, "root", "left").select("node", F.coalesce("_new", "root").alias("root"))
        fresh = up.join(roots.select("node"), "node", "left_anti").select("node", F.col("parent").alias("root"))
        roots = durable(seen.union(fresh))
        at_u, at_v = up.select(F.col("node").alias("u"), F.col("parent").alias("ru")), up.select(F.col("node").alias("v"), F.col("parent").alias("rv"))
        left = left.join(at_u, "u").join(at_v, "v").where("ru <> rv")
        left = durable(left.groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.min("w").alias("w")))
    return Forest(roots, durable(forest.distinct()), rounds)


def tied_batches(metadata: DataFrame) -> tuple[DataFrame, Forest]:
    """(batch, group_key, group_formulation) of every distinct batch, and the forest over formulations.

    Two batches are tied if they carry one formulation or start with the same
    nine characters. A stem with several formulations ties these to the
    smallest of them, which spans the same components with one edge per
    further formulation. A batch whose group has no formulation keeps NULL
    there, and its stem as the key. NULL batches are left out.
    """
    named = metadata.select("batch", stem(F.col("batch")).alias("stem"), formulation_number(F.col("formulation")).alias("f")).where("batch is not null").distinct()
    named = durable(named)
    pairs = named.where("f is not null").select("stem", "f").distinct()
    first = pairs.groupBy("stem").agg(F.min("f").alias("u"), F.max("f").alias("_last"))
    edges = pairs.join(first.where("u < _last"), "stem").select("u", F.col("f").alias("v")).where("u < v")
    forest = contract(edges)
    smallest = forest.roots.groupBy("root").agg(F.min("node").alias("smallest"))
    group = forest.roots.join(smallest, "root").select(F.col("node").alias("u"), "smallest")
    stems = first.select("stem", "u").join(group, "u", "left").select("stem", F.coalesce("smallest", "u").alias("group_formulation"))
    batches = named.select("batch", "stem").distinct().join(stems, "stem", "left")
    key = F.coalesce(F.concat(F.lit("F"), F.col("group_formulation").cast("string")), F.concat(F.lit("S:"), F.col("stem")))
    return batches.select("batch", key.alias("group_key"), "group_formulation"), forest


def deal(groups: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """Assign ``groups`` (group_key, size) to splits of ``targets`` (split_name, share): adds ``split_name``.

    Groups are stratified into bands of sizes between powers of two, which are
    dealt from the largest sizes down. The r-th group of a band, in hashed
    order, takes the place frac(r * golden ratio) on a line along which every
    split holds what it lacks once this band is dealt, so that what the few
    groups of a high band left uneven is made up for by the many of the next.
    Ranks come from counts per hash bucket, so no band is sorted in one task.

    A group larger than ``APART`` times the smallest split cannot be dealt like
    that: such groups, of which there are at most as many as smallest splits
    would fill the table, go to the split that lacks most. Without any
    positive share, or without groups, the result is empty.
    """
    spark = groups.sparkSession
    shares = {r.split_name: float(r.share) for r in targets.where("share > 0 and split_name is not null").groupBy("split_name").agg(F.sum("share").alias("share")).orderBy("split_name").collect()}
    schema = T.StructType([*groups.schema.fields, T.StructField("split_name", T.StringType())])
    total = groups.agg(F.sum("size")).first()[0]
    if not shares or not total:
        return spark.createDataFrame([], schema)
    scale = sum(shares.values())
    shares = {k: v / scale for k, v in shares.items()}
    limit = APART * min(shares.values()) * total
    got = dict.fromkeys(shares, 0.0)
    apart = []
    for row in groups.where(F.col("size") > limit).orderBy(F.desc("size"), "group_key").collect():
        name = max(shares, key=lambda k: (total * shares[k] - got[k], k))
        got[name] += row["size"]
        apart.append((row["group_key"], name))
    large = spark.createDataFrame(apart, "group_key string, split_name string")
    hashed = groups.where(F.col("size") <= limit).withColumn("_h", F.xxhash64("group_key", F.lit(seed))).withColumn("_band", F.floor(F.log2("size")).cast("int"))
    hashed = durable(hashed.withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS)).cast("int")))
    counts = hashed.groupBy("_band", "_bucket").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_band").orderBy("_bucket")) - F.col("_n")).drop("_n")
    ranked = hashed.join(F.broadcast(before), ["_band", "_bucket"])  # at most 64 bands by BUCKETS buckets
    ranked = ranked.withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_band", "_bucket").orderBy("_h", "group_key")))
    place = F.col("_r") * F.lit(GOLDEN) + F.col("_band") * F.lit(0.37)
    ranked = durable(ranked.select(*groups.columns, "_band", (place - F.floor(place)).alias("_x")))
    sizes = {r["_band"]: r["s"] for r in ranked.groupBy("_band").agg(F.sum("size").alias("s")).collect()}
    dealt = large.join(groups, "group_key").select(*groups.columns, "split_name")
    done = sum(got.values())
    for band in sorted(sizes, reverse=True):
        done += sizes[band]
        lacks = {k: max(done * v - got[k], 0.0) for k, v in shares.items()}
        choice, at = F.lit(None).cast("string"), 0.0
        for name, lack in lacks.items():
            at += lack / sum(lacks.values())
            choice = F.coalesce(choice, F.when(F.col("_x") < F.lit(at), F.lit(name)))
        part = ranked.where(F.col("_band") == band).select(*groups.columns, F.coalesce(choice, F.lit(max(lacks, key=lambda k: lacks[k]))).alias("split_name"))
        for r in part.groupBy("split_name").agg(F.sum("size").alias("s")).collect():
            got[r["split_name"]] += r["s"]
        dealt = dealt.unionByName(part)
    return dealt


def split_batches(metadata: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """(batch, group_key, group_formulation, split_name) of every distinct batch of ``metadata``."""
    batches, _ = tied_batches(metadata)
    batches = durable(batches)
    groups = durable(batches.groupBy("group_key").agg(F.count("*").alias("size")))
    dealt = deal(groups, targets, seed).select("group_key", "split_name")
    return batches.join(dealt, "group_key").select("batch", "group_key", "group_formulation", "split_name")
