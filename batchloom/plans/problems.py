"""The general data-preparation queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.operators.bad_rows import load_rows
from batchloom.operators.fill import Filled, apply_fills, fill_missing
from batchloom.operators.spikes import cell_flags, reading_flags
from batchloom.operators.reshape import Reshaped, curves_wide, named_as_listed, time_points
from batchloom.session import table


# Columns that follow from other columns or tables.
DERIVED = ("hpmc_mg", "lactose_pct_ww", "q30_pct")


def _filled(spark: SparkSession, sf_dir: str) -> Filled:
    return fill_missing(*(table(spark, sf_dir, n) for n in ("batch_wide", "batch_metadata", "variable_families", "imputation_record")))


def batch_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches as the batch table and its metadata write them."""
    return table(spark, sf_dir, "batch_wide").select("batch").union(table(spark, sf_dir, "batch_metadata").select("batch"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).cells.select("batch", "field")


def p1_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every filled cell with its value and where that was taken from."""
    return _filled(spark, sf_dir).cells


def p1_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches with every gap filled, and which fields were."""
    return apply_fills(_filled(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_rows(table(spark, sf_dir, "raw_batch_rows"), table(spark, sf_dir, "variable_families")).errors


def p3_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that fit, as typed rows of the batch table."""
    return load_rows(table(spark, sf_dir, "raw_batch_rows"), table(spark, sf_dir, "variable_families")).valid


def _curves(spark: SparkSession, sf_dir: str) -> Reshaped:
    dissolution = table(spark, sf_dir, "dissolution")
    return curves_wide(dissolution, time_points(dissolution))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_as_listed(_curves(spark, sf_dir).contradictions, batch_names(spark, sf_dir)).select("batch", "medium", "run_no", "time_min")


def p4_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per curve with a double column per time point."""
    wide = _curves(spark, sf_dir).wide
    return named_as_listed(wide, batch_names(spark, sf_dir)).select("batch", *[c for c in wide.columns if c != "batch_key"])


def p5_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every implausible reading or cell with the reasons it was flagged for."""
    cells = cell_flags(*(table(spark, sf_dir, n) for n in ("batch_wide", "batch_metadata", "variable_families", "imputation_record")), derived=DERIVED)
    readings = named_as_listed(reading_flags(table(spark, sf_dir, "dissolution")), batch_names(spark, sf_dir))
    run = readings.schema["run_no"].dataType
    cells = cells.select("batch", "field", F.lit("").alias("medium"), F.lit(0).cast(run).alias("run_no"), F.lit(0).alias("time_min"), "reason")
    both = readings.select("batch", F.lit("percent_released").alias("field"), "medium", "run_no", "time_min", "reason").unionByName(cells)
    return both.groupBy("batch", "field", "medium", "run_no", "time_min").agg(F.array_join(F.array_sort(F.collect_set("reason")), " ").alias("reasons"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_flags(spark, sf_dir).drop("reasons")


QUERIES = {"p1_found": p1_found, "p1_filled": p1_filled, "p1_table": p1_table, "p3_found": p3_found, "p3_valid": p3_valid, "p4_found": p4_found, "p4_wide": p4_wide, "p5_found": p5_found, "p5_flags": p5_flags}

_WORDS = "('', '-', '?', 'n/a', 'na', 'none', 'null', 'nan', 'unknown', 'not recorded', 'missing', 'tbd', 'pending')"
_MEDIUM = """CASE upper(replace(medium, ' ', '')) WHEN '0.1NHCL' THEN '0.1N HCl'
    WHEN 'PH4.5ACETATE' THEN 'pH 4.5 acetate' WHEN 'PH6.8PHOSPHATE' THEN 'pH 6.8 phosphate' ELSE trim(medium) END"""
_NAMES = """names AS (
  SELECT upper(replace(batch, ' ', '')) AS k, min(batch) AS batch
  FROM (SELECT batch FROM batch_wide UNION ALL SELECT batch FROM batch_metadata) GROUP BY 1)"""

_P1 = f"""
WITH cells AS (
  SELECT batch, field, value FROM (SELECT * EXCLUDE (loaded_at) FROM batch_wide)
  UNPIVOT INCLUDE NULLS (value FOR field IN (COLUMNS(* EXCLUDE (batch))))),
outside AS (
  SELECT c.field, c.value FROM cells c JOIN variable_families v ON v.variable = c.field
  WHERE NOT isnan(c.value) AND (c.value < v.low OR c.value > v.high)),
codes AS (
  SELECT value FROM outside WHERE value = floor(value) GROUP BY value
  HAVING count(DISTINCT field) >= greatest(2, (SELECT count(DISTINCT field) FROM cells) / 10.0)),
judged AS (
  SELECT c.batch, c.field,
    c.value IS NOT NULL AND NOT isnan(c.value) AND NOT isinf(c.value)
      AND NOT (coalesce(c.value < v.low OR c.value > v.high, FALSE) AND c.value IN (SELECT value FROM codes))
      AND NOT EXISTS (SELECT 1 FROM imputation_record r WHERE r.column_name = c.field AND r.fill_value = c.value) AS usable
  FROM cells c LEFT JOIN variable_families v ON v.variable = c.field),
labels AS (
  SELECT batch, field, value FROM (SELECT batch, scale, equipment_train, site, operator_shift FROM batch_metadata WHERE batch IS NOT NULL)
  UNPIVOT INCLUDE NULLS (value FOR field IN (scale, equipment_train, site, operator_shift))),
judged_labels AS (SELECT batch, field, value IS NOT NULL AND lower(trim(value)) NOT IN {_WORDS} AS usable FROM labels)
SELECT batch, field FROM judged WHERE batch IS NOT NULL GROUP BY 1, 2 HAVING NOT bool_or(coalesce(usable, FALSE))
UNION ALL
SELECT batch, field FROM judged_labels GROUP BY 1, 2 HAVING NOT bool_or(coalesce(usable, FALSE))
"""

_P4 = f"""
WITH {_NAMES},
cells AS (
  SELECT upper(replace(batch, ' ', '')) AS k, {_MEDIUM} AS medium, run_no, CAST(round(time_h * 60) AS INTEGER) AS time_min
  FROM dissolution WHERE percent_released IS NOT NULL AND NOT isnan(percent_released)
  GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT percent_released) > 1)
SELECT coalesce(names.batch, cells.k) AS batch, medium, run_no, time_min FROM cells LEFT JOIN names ON names.k = cells.k
"""

_P4_WIDE = f"""
WITH {_NAMES},
cells AS (
  SELECT upper(replace(batch, ' ', '')) AS k, {_MEDIUM} AS medium, run_no, CAST(round(time_h * 60) AS INTEGER) AS m,
    min(CASE WHEN NOT isnan(percent_released) THEN percent_released END) AS lo,
    max(CASE WHEN NOT isnan(percent_released) THEN percent_released END) AS hi
  FROM dissolution WHERE batch IS NOT NULL AND medium IS NOT NULL AND run_no IS NOT NULL AND time_h IS NOT NULL GROUP BY 1, 2, 3, 4),
named AS (
  SELECT cells.k, coalesce(names.batch, cells.k) AS batch, medium, run_no, 't_' || m AS t, CASE WHEN lo = hi THEN lo END AS y
  FROM cells LEFT JOIN names ON names.k = cells.k)
SELECT * EXCLUDE (k) FROM (PIVOT named ON t USING min(y) GROUP BY k, batch, medium, run_no)
"""

_P3 = r"""
WITH heads AS (
  SELECT file_id, min_by(raw_line, line_id) AS head FROM raw_batch_rows WHERE line_no = 1 GROUP BY file_id),
marks AS (
  SELECT file_id, CASE WHEN c >= s AND c >= t THEN ',' WHEN s >= t THEN ';' ELSE chr(9) END AS d FROM (
    SELECT file_id, len(string_split(head, ',')) AS c, len(string_split(head, ';')) AS s, len(string_split(head, chr(9))) AS t FROM heads)),
pieces AS (
  SELECT r.line_id, r.file_id, r.line_no, d, string_split(coalesce(raw_line, ''), '"') AS p FROM raw_batch_rows r JOIN marks USING (file_id)),
cut AS (
  SELECT line_id, file_id, line_no, d,
    len(p) % 2 = 1 AND list_bool_and(list_transform(p, lambda x, i: i % 2 = 0 OR ((i = 1 AND (len(p) = 1 OR x = '' OR suffix(x, d)))
      OR (i = len(p) AND (i = 1 OR x = '' OR prefix(x, d))) OR (i > 1 AND i < len(p) AND (x = '' OR (suffix(x, d) AND prefix(x, d))))))) AS ok,
    string_split(array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 THEN x WHEN x = '' AND i > 1 AND i < len(p) THEN '"' ELSE replace(x, d, chr(1)) END), ''), chr(1)) AS f
  FROM pieces),
body AS (
  SELECT c.line_id, c.d, c.ok, c.f, h.f AS h FROM cut c JOIN cut h ON h.file_id = c.file_id AND h.line_no = 1 WHERE c.line_no <> 1),
whole AS (
  SELECT line_id, d, f, h, CASE WHEN NOT ok THEN 'BROKEN_QUOTING' WHEN len(f) <> len(h) THEN 'WRONG_COLUMN_COUNT'
    WHEN lower(array_to_string(f, chr(1))) = lower(array_to_string(h, chr(1))) THEN 'REPEATED_HEADER' END AS code FROM body),
fields AS (SELECT line_id, d, unnest(h) AS name, unnest(f) AS x FROM whole WHERE code IS NULL),
numbers AS (
  SELECT line_id, name, x, low, high, v.variable IS NOT NULL AS measured, trim(replace(CASE WHEN d = ';' THEN replace(x, ',', '.') ELSE x END, chr(9), ' ')) AS bare
  FROM fields LEFT JOIN variable_families v ON v.variable = name),
judged AS (
  SELECT line_id, name, CASE
    WHEN name = 'batch' THEN CASE WHEN NOT regexp_full_match(x, 'B[0-9]{8}([-/._][A-Za-z]?[0-9]+)?') THEN 'INVALID_BATCH_ID' END
    WHEN x = '' THEN NULL
    WHEN name = 'manufacturing_date' THEN CASE WHEN NOT regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}( ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])?')
      OR TRY_CAST(substr(x, 1, 10) AS DATE) IS NULL THEN 'INVALID_DATE' END
    WHEN measured THEN CASE WHEN NOT regexp_full_match(bare, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN 'NON_NUMERIC_IN_NUMERIC_COLUMN'
      WHEN TRY_CAST(bare AS DOUBLE) < low OR TRY_CAST(bare AS DOUBLE) > high THEN 'VALUE_OUT_OF_RANGE' END END AS code
  FROM numbers)
SELECT line_id, code, '' AS column_name FROM whole WHERE code IS NOT NULL
UNION ALL SELECT line_id, code, name FROM judged WHERE code IS NOT NULL
"""

SQL = {"p3_found": _P3, "p1_found": _P1, "p4_found": _P4, "p4_wide": _P4_WIDE}
