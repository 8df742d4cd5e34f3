"""Rows that fail to parse: records of single-table files split into typed rows and reasons for rejection.

Every field is first loaded as nullable text. Cast and constraint rules are
then evaluated as column expressions into one array of errors per record, and
records are split by whether that array is empty. Nothing is dropped: each
record of a file other than its header ends up on exactly one of the two sides.

Defined results for odd input: a NULL line counts as an empty one; a file
without a line 1 has no header, so its records are reported as
WRONG_COLUMN_COUNT; header columns nobody knows are always valid; of header
columns with one name the first gives the typed value, all are checked;
repeated lines are judged one by one; an empty table gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from batchloom.functions.domain import BATCH_ID

DELIMITERS = (",", ";", "\t")
DATE_COLUMN = "manufacturing_date"
# A number: sign, ASCII digits with at most one point, exponent; in semicolon files the point may be a comma.
NUMBER = r"\A[ \t]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[ \t]*\z"
NUMBER_OR_COMMA = NUMBER.replace("[.]", "[.,]")
DATE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}( ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])?\z"

# Inside a record, \u0001 is written \u0001a while fields are cut apart at \u0001b.
_MARK, _KEPT, _CUT = "\u0001", "\u0001a", "\u0001b"


@dataclass(frozen=True)
class ParsedRows:
    """The two sides of a load."""

    valid: DataFrame  # line_id, file_id, line_no and one typed column per known name
    errors: DataFrame  # line_id, code, column_name: one row per reason


def _cut(line: Column, delimiter: Column) -> tuple[Column, Column]:
    """(quoting is sound, fields) of a record.

    Cutting at the quote character leaves text outside quotes at the even
    places and text inside at the odd ones; a doubled quote shows as an empty
    outside piece between two inside ones. Only array functions are used, so
    that no pattern can backtrack or overflow on very long fields.
    """

    def judged(pieces: Column) -> Column:
        n = F.size(pieces)

        def sound(x: Column, i: Column) -> Column:
            before = (i == 0) | F.endswith(x, delimiter)
            after = (i == n - 1) | F.startswith(x, delimiter)
            first = (i == 0) & ((n == 1) | (x == "") | F.endswith(x, delimiter))
            last = (i == n - 1) & ((i == 0) | (x == "") | F.startswith(x, delimiter))
            return F.when(i % 2 == 1, True).otherwise(first | last | ((i > 0) & (i < n - 1) & ((x == "") | (before & after))))

        def written(x: Column, i: Column) -> Column:
            outside = F.when((x == "") & (i > 0) & (i < n - 1), '"').otherwise(F.replace(x, delimiter, F.lit(_CUT)))
            return F.when(i % 2 == 1, x).otherwise(outside)

        ok = (n % 2 == 1) & F.forall(F.transform(pieces, sound), lambda x: x)
        joined = F.array_join(F.transform(pieces, written), "")
        fields = F.transform(F.split(joined, _CUT, -1), lambda x: F.replace(x, F.lit(_KEPT), F.lit(_MARK)))
        return F.struct(ok.alias("ok"), fields.alias("fields"))

    # Bound to a variable, the pieces are cut once, not once per piece.
    out = F.get(F.transform(F.array(F.split(F.regexp_replace(line, _MARK, _KEPT), '"', -1)), judged), F.lit(0))
    return out["ok"], out["fields"]


def read_fields(raw: DataFrame) -> DataFrame:
    """Each record with its file's header and its own fields, all as text.

    The header side holds one row per file. It is joined on ``file_id`` and
    left to Spark's planner: small, it is broadcast; else records are shuffled
    once and the part of a file that holds a third of all rows is split by
    adaptive execution.
    """
    lines = raw.select("line_id", "file_id", "line_no", F.coalesce("raw_line", F.lit("")).alias("line"))
    heads = lines.where("line_no = 1").groupBy("file_id").agg(F.min_by("line", "line_id").alias("head"))
    counts = [F.size(F.split("head", d, -1)) for d in DELIMITERS]
    best = F.greatest(*counts)
    delimiter = F.when(counts[0] == best, DELIMITERS[0]).when(counts[1] == best, DELIMITERS[1]).otherwise(DELIMITERS[2])
    heads = heads.withColumn("delimiter", delimiter)
    heads = heads.select("file_id", "delimiter", _cut(F.col("head"), F.col("delimiter"))[1].alias("header"))
    body = lines.where("line_no is null or line_no <> 1").withColumnRenamed("file_id", "of_file")
    joined = body.join(heads, F.col("of_file").eqNullSafe(F.col("file_id")), "left").drop("file_id").withColumnRenamed("of_file", "file_id")
    joined = joined.withColumns({"delimiter": F.coalesce("delimiter", F.lit(",")), "header": F.coalesce("header", F.array().cast("array<string>"))})
    ok, fields = _cut(F.col("line"), F.col("delimiter"))
    return joined.withColumn("cut", F.struct(ok.alias("sound"), fields.alias("fields"))).select("*", "cut.sound", "cut.fields").drop("cut", "line")


def _errors(bounds: list[tuple[str, float | None, float | None]]) -> Column:
    """Array of (code, column_name) of a record of :func:`read_fields`."""
    reason = "struct<code:string,column_name:string>"

    def whole(code: str) -> Column:
        return F.array(F.struct(F.lit(code).alias("code"), F.lit("").alias("column_name")))

    semicolon = F.col("delimiter") == ";"
    names = F.array(*[F.lit(b[0]) for b in bounds]) if bounds else F.array().cast("array<string>")
    lows = F.array(*[F.lit(b[1]).cast("double") for b in bounds]) if bounds else F.array().cast("array<double>")
    highs = F.array(*[F.lit(b[2]).cast("double") for b in bounds]) if bounds else F.array().cast("array<double>")

    def code(name: Column, text: Column) -> Column:
        at = F.array_position(names, name).cast("int")
        bare = F.trim(F.translate(text, "\t", " "))
        number = F.when(semicolon, F.translate(bare, ",", ".")).otherwise(bare).try_cast("double")
        spelled = F.when(semicolon, text.rlike(NUMBER_OR_COMMA)).otherwise(text.rlike(NUMBER))
        outside = (number < F.get(lows, at - 1)) | (number > F.get(highs, at - 1))
        day = F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))
        bad_date = ~text.rlike(DATE) | day.isNull()
        return (
            F.when(name == "batch", F.when(~text.rlike(BATCH_ID), "INVALID_BATCH_ID"))
            .when(text == "", None)
            .when(name == DATE_COLUMN, F.when(bad_date, "INVALID_DATE"))
            .when(at > 0, F.when(~spelled, "NON_NUMERIC_IN_NUMERIC_COLUMN").when(outside, "VALUE_OUT_OF_RANGE"))
        )

    each = F.zip_with("header", "fields", lambda name, text: F.struct(code(name, text).alias("code"), name.alias("column_name")))
    same = F.lower(F.array_join("header", _CUT)) == F.lower(F.array_join("fields", _CUT))
    return (
        F.when(~F.col("sound"), whole("BROKEN_QUOTING"))
        .when(F.size("header") != F.size("fields"), whole("WRONG_COLUMN_COUNT"))
        .when(same, whole("REPEATED_HEADER"))
        .otherwise(F.filter(each, lambda x: x["code"].isNotNull()))
        .cast(f"array<{reason}>")
    )


def load_rows(raw: DataFrame, families: DataFrame) -> ParsedRows:
    """Split ``raw`` (line_id, file_id, line_no, raw_line) by the columns and bounds of ``families`` (variable, low, high).

    ``families`` is the dictionary of measured columns: one row per column of
    the batch table, so it has the size of a schema and is read on the driver.
    """
    listed = families.select("variable", "low", "high").where("variable is not null").dropDuplicates(["variable"]).orderBy("variable").collect()
    bounds = [(r.variable, *(None if x is None or x != x else float(x) for x in (r.low, r.high))) for r in listed]
    judged = read_fields(raw).withColumn("errors", _errors(bounds))
    # Outer, so that the optimizer infers no filter below the explode that would judge every record twice.
    errors = judged.select("line_id", F.explode_outer("errors").alias("e")).where("e is not null").select("line_id", "e.code", "e.column_name")

    names = ["batch", "formulation", DATE_COLUMN, "remark", *(b[0] for b in bounds)]
    texts = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.nullif(F.get("fields", F.array_position("header", n).cast("int") - 1), F.lit("")))
    numbers = F.transform(F.slice("texts", 5, max(1, len(bounds))), lambda x: F.when(F.col("delimiter") == ";", F.translate(x, ",", ".")).otherwise(x))
    numbers = F.transform(numbers, lambda x: F.trim(F.translate(x, "\t", " ")).try_cast("double"))
    good = judged.where(F.size("errors") == 0).select("line_id", "file_id", "line_no", "delimiter", texts.alias("texts"))
    good = good.withColumn("numbers", numbers)
    day = F.coalesce(*[F.try_to_timestamp(F.get("texts", F.lit(2)), F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")])
    columns = [F.get("texts", F.lit(i)).alias(names[i]) for i in (0, 1)] + [day.cast(T.TimestampNTZType()).alias(DATE_COLUMN), F.get("texts", F.lit(3)).alias("remark")]
    columns += [F.get("numbers", F.lit(i)).alias(b[0]) for i, b in enumerate(bounds)]
    valid = good.select("line_id", "file_id", "line_no", *columns)
    return ParsedRows(valid, errors)
