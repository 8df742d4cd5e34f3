from __future__ import annotations

import random

from oracle import SMALL

from batchloom.operators.bad_rows import load_rows
from batchloom.session import table

RAW = "line_id long, file_id string, line_no int, raw_line string"
FAMILIES = "variable string, low double, high double"


def load(spark, rows, families=(("x", 0.0, 10.0), ("y", None, None))):
    return load_rows(spark.createDataFrame(rows, RAW), spark.createDataFrame(list(families), FAMILIES))


def errors(spark, lines, head="batch,x,y,remark"):
    rows = [(0, "f", 1, head)] + [(i + 1, "f", i + 2, line) for i, line in enumerate(lines)]
    found = {}
    for r in load(spark, rows).errors.collect():
        found.setdefault(r.line_id, []).append((r.code, r.column_name))
    return [sorted(found.get(i + 1, [])) for i in range(len(lines))]


def cut(line: str, d: str):
    """Fields by a hand-written automaton, None where quoting is broken."""
    out, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            text, j = "", i + 1
            while True:
                k = line.find('"', j)
                if k < 0:
                    return None
                text += line[j:k]
                if line[k + 1 : k + 2] != '"':
                    break
                text, j = text + '"', k + 2
            i = k + 1
            out.append(text)
            if i == n:
                return out
            if line[i] != d:
                return None
            i += 1
        else:
            k = line.find(d, i)
            end = n if k < 0 else k
            if '"' in line[i:end]:
                return None
            out.append(line[i:end])
            if k < 0:
                return out
            i = k + 1


def test_codes(spark):
    b = "B00000001"
    got = errors(spark, [f"{b},1,2,ok", f'{b},1,2,"a"b', f"{b},1,2", "", "BATCH,X,Y,REMARK", "b1,99,1e,", f"{b}-R1, 5 ,.5e-1,", f"{b},-1,nan,", None, f'{b},"1",2,"say ""hi"", x"', f"{b}\n,1,2,"])
    assert got == [
        [], [("BROKEN_QUOTING", "")], [("WRONG_COLUMN_COUNT", "")], [("WRONG_COLUMN_COUNT", "")], [("REPEATED_HEADER", "")],
        [("INVALID_BATCH_ID", "batch"), ("NON_NUMERIC_IN_NUMERIC_COLUMN", "y"), ("VALUE_OUT_OF_RANGE", "x")], [],
        [("NON_NUMERIC_IN_NUMERIC_COLUMN", "y"), ("VALUE_OUT_OF_RANGE", "x")], [("WRONG_COLUMN_COUNT", "")], [], [("INVALID_BATCH_ID", "batch")],
    ]


def test_dates_and_decimal_commas(spark):
    head = "batch;x;manufacturing_date"
    days = {"2024-02-29": True, "2023-02-29": False, "2024-02-29 23:59:59": True, "2024-02-29 24:00:00": False, "2024-2-29": False, "": True, " 2024-01-01": False}
    got = errors(spark, [f"B00000001;1,5;{d}" for d in days], head)
    assert [not g for g in got] == list(days.values())
    assert errors(spark, ["B00000001;1,5,0;"], head) == [[("NON_NUMERIC_IN_NUMERIC_COLUMN", "x")]]


def test_quoting_against_automaton(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice('a",\u0001b\n') for _ in range(rng.randint(0, 9))) for _ in range(600)]
    rows = [(0, "f", 1, "p,q")] + [(i + 1, "f", i + 2, x) for i, x in enumerate(lines)]
    found = {r.line_id: r.code for r in load(spark, rows).errors.collect()}
    for i, line in enumerate(lines):
        fields = cut(line, ",")
        want = "BROKEN_QUOTING" if fields is None else "WRONG_COLUMN_COUNT" if len(fields) != 2 else None
        assert found.get(i + 1) == want, line


def test_very_long_fields(spark):
    long = '"' + 'x""' * 200_000 + '"'
    assert errors(spark, [f"B00000001,1,2,{long}", f"B00000001,1,2,{'y' * 1_000_000}", f"B00000001,1,2,{long}z"]) == [[], [], [("BROKEN_QUOTING", "")]]


def test_typed_rows_and_odd_tables(spark):
    rows = [(1, "f", 1, "batch;manufacturing_date;x"), (2, "f", 2, "B00000001;2024-01-02 03:04:05;1,5"), (3, None, 2, "a,b"), (4, "g", 5, "q")]
    out = load(spark, rows)
    (row,) = out.valid.collect()
    assert (row.batch, row.x, row.y, str(row.manufacturing_date)) == ("B00000001", 1.5, None, "2024-01-02 03:04:05")
    assert {r.line_id: r.code for r in out.errors.collect()} == {3: "WRONG_COLUMN_COUNT", 4: "WRONG_COLUMN_COUNT"}
    empty = load(spark, [], [])
    assert empty.valid.count() == 0 and empty.errors.count() == 0


def test_extra_columns_and_nothing_lost(spark):
    raw = table(spark, SMALL, "raw_batch_rows").selectExpr("*", "1 as fields", "2 as header", "3 as delimiter", "4 as errors")
    out = load_rows(raw, table(spark, SMALL, "variable_families"))
    bad = out.errors.select("line_id").distinct().count()
    assert out.valid.count() + bad == raw.where("line_no <> 1").count()
