"""Compare a query with its SQL: names, number of rows and values."""

from __future__ import annotations

import math

SMALL = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else round(value, 9)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return tuple(plain(x) for x in value) if isinstance(value, list) else value


def assert_same(spark, duck, query, sql: str, folder: str) -> None:
    got = query(spark, folder)
    names = sorted(got.columns)
    ours = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=repr)
    relation = duck.sql(sql)
    assert sorted(relation.columns) == names
    at = [relation.columns.index(c) for c in names]
    theirs = sorted((tuple(plain(row[i]) for i in at) for row in relation.fetchall()), key=repr)
    assert ours == theirs
