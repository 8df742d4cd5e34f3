from __future__ import annotations

import random
from collections import defaultdict

from oracle import SMALL, assert_same

from batchloom.llm import queries, sql, splits
from batchloom.session import table


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        parent[find(u)] = find(v)
    groups = defaultdict(set)
    for x in list(parent):
        groups[find(x)].add(x)
    return {frozenset(g) for g in groups.values()}


def test_contraction_against_union_find(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 320), rng.randint(200, 320)) for _ in range(90)]
    messy = [*edges, *edges[:9], *[(v, u) for u, v in edges[:20]], (5, 5), (None, 3), (3, None)]
    got = splits.contract(spark.createDataFrame(messy, "u long, v long"))
    groups = defaultdict(set)
    for r in got.roots.collect():
        groups[r.root].add(r.node)
    want = components([e for e in edges if e[0] != e[1]])
    assert {frozenset(g) for g in groups.values()} == want
    forest = [(r.u, r.v) for r in got.edges.collect()]
    assert components(forest) == want and len(forest) == sum(len(g) - 1 for g in want)
    assert all(root in group for root, group in groups.items())


def test_no_edges(spark):
    got = splits.contract(spark.createDataFrame([(1, 1), (None, None)], "u long, v long"))
    assert got.roots.count() == 0 and got.edges.count() == 0 and got.rounds == 0


META = "batch string, formulation string, stem string, f int"


def test_ties(spark):
    rows = [("B00000001", "F1"), ("B00000001-R1", "form. 2"), ("B00000002", "F0002 rev 3"), ("B00000003", "TBD"), ("B00000003/1", None), ("B00000004", "F?"), ("B00000004.1", "f_9"), (None, "F1"), ("B00000002", "F0002 rev 3")]
    batches, _ = splits.tied_batches(spark.createDataFrame([(*r, None, 1) for r in rows], META))
    got = {r.batch: (r.group_key, r.group_formulation) for r in batches.collect()}
    assert got == {
        "B00000001": ("F1", 1), "B00000001-R1": ("F1", 1), "B00000002": ("F1", 1), "B00000003": ("S:B00000003", None),
        "B00000003/1": ("S:B00000003", None), "B00000004": ("F9", 9), "B00000004.1": ("F9", 9),
    }


def test_deal_keeps_groups_and_shares(spark):
    rng = random.Random(2)
    groups = spark.createDataFrame([(f"g{i}", rng.choice([1, 2, 3, 5, 9, 14])) for i in range(6000)] + [("hot", 3000)], "group_key string, size long")
    targets = spark.createDataFrame([("train", 0.8), ("valid", 0.1), ("test", 0.1), ("none", 0.0), (None, 0.3)], "split_name string, share double")
    dealt = splits.deal(groups, targets).collect()
    assert len({r.group_key for r in dealt}) == len(dealt) == 6001
    total = sum(r.size for r in dealt)
    share = defaultdict(float)
    for r in dealt:
        share[r.split_name] += r.size / total
    assert set(share) == {"train", "valid", "test"}
    assert abs(share["train"] - 0.8) < 0.005 and abs(share["test"] - 0.1) < 0.005


def test_deal_of_nothing(spark):
    targets = spark.createDataFrame([("train", 1.0)], "split_name string, share double")
    empty = spark.createDataFrame([], "group_key string, size long")
    assert splits.deal(empty, targets).count() == 0
    assert splits.deal(spark.createDataFrame([("a", 1)], "group_key string, size long"), targets.where("false")).count() == 0


def test_no_tie_crosses_splits(spark):
    out = splits.split_batches(table(spark, SMALL, "batch_metadata"), table(spark, SMALL, "split_targets")).collect()
    by = defaultdict(set)
    for r in out:
        by[r.group_key].add(r.split_name)
    assert out and all(len(v) == 1 for v in by.values())


def test_found_agrees_with_sql(spark, duck):
    assert_same(spark, duck, queries.QUERIES["p2_found"], sql.SQL["p2_found"], SMALL)
