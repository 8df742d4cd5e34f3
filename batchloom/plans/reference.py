"""Analytics over the batch tables, each with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from batchloom.operators import diagnostics, explore, models, profiles, response, variables
from batchloom.operators.bad_rows import read_fields
from batchloom.operators.dataset import build_dataset
from batchloom.operators.longform import batch_labels, clean_wide, exact_quantile, numeric_columns, unpivoted
from batchloom.operators.reshape import to_wide
from batchloom.plans.problems import _MEDIUM
from batchloom.session import durable, table
from batchloom.streaming import readings

CONTROL = "B00000001"
RESPONSE = "q30_pct"
PREDICTORS = ("hpmc_level_pct", "main_compression_kN", "granulation_water_pct", "mg_stearate_pct_ww", "turret_speed_rpm", "api_d50_um")
MIXTURE = ("api_pct_ww", "hpmc_level_pct", "mcc_pct_ww", "lactose_pct_ww", "mg_stearate_pct_ww", "talc_pct_ww")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _r(x: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _r(c) for c in columns})


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per batch with the values within their physical bounds; ``dataset_issues`` and ``spec_check`` are on the values as they are."""
    return clean_wide(table(spark, sf_dir, "batch_wide"), table(spark, sf_dir, "variable_families"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir)
    return unpivoted(wide, numeric_columns(wide))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_labels(table(spark, sf_dir, "batch_metadata"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.points(table(spark, sf_dir, "dissolution"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.model_rows(_wide(spark, sf_dir), _labels(spark, sf_dir), PREDICTORS, RESPONSE)


_WORDS = "('', '-', '?', 'n/a', 'na', 'none', 'null', 'nan', 'unknown', 'not recorded', 'missing', 'tbd', 'pending')"
_CELLS = """cells AS (
  SELECT u.batch, u.variable, min(CASE WHEN NOT isnan(u.value) AND NOT isinf(u.value)
    AND coalesce(u.value >= f.low, TRUE) AND coalesce(u.value <= f.high, TRUE) THEN u.value END) AS value
  FROM (SELECT batch, variable, value FROM (SELECT * EXCLUDE (loaded_at) FROM batch_wide WHERE batch IS NOT NULL)
    UNPIVOT INCLUDE NULLS (value FOR variable IN (COLUMNS(* EXCLUDE (batch))))) u
  LEFT JOIN variable_families f ON f.variable = u.variable GROUP BY 1, 2)"""
_LABELS = rf"""labels AS (
  SELECT batch, min(TRY_CAST(nullif(regexp_extract(formulation, '(?i)^[^0-9a-z]*f(?:orm(?:ulation)?)?[^0-9a-z]*([0-9]+)', 1), '') AS BIGINT)) AS formulation,
    min(CASE WHEN lower(trim(equipment_train)) NOT IN {_WORDS} THEN trim(equipment_train) END) AS equipment_train,
    min(manufacturing_date) AS manufacturing_date
  FROM batch_metadata WHERE batch IS NOT NULL GROUP BY batch)"""
_POINTS = f"""pts AS (
  SELECT batch, medium, run_no, m AS time_min, min(y) AS y, m / 60.0::DOUBLE AS t FROM (
    SELECT DISTINCT upper(replace(batch, ' ', '')) AS batch, {_MEDIUM} AS medium, run_no,
      CAST(round(time_h * 60) AS INTEGER) AS m, percent_released + 0.0 AS y
    FROM dissolution WHERE percent_released IS NOT NULL AND NOT isnan(percent_released) AND batch IS NOT NULL)
  GROUP BY 1, 2, 3, 4 HAVING count(*) = 1)"""
_ROWS = f"""known AS (
  SELECT w.batch, formulation, {', '.join(PREDICTORS)}, {RESPONSE} AS y FROM (
    SELECT batch, {', '.join(f"max(value) FILTER (WHERE variable = '{c}') AS {c}" for c in (*PREDICTORS, RESPONSE))}
    FROM cells GROUP BY batch) w JOIN labels USING (batch)
  WHERE formulation IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in (*PREDICTORS, RESPONSE))}),
dealt AS (SELECT formulation, (row_number() OVER (ORDER BY count(*) DESC, formulation) - 1) % 5 AS fold FROM known GROUP BY formulation),
rows AS (SELECT * FROM known JOIN dealt USING (formulation))"""


# ---- release profiles


@_query(f"""
WITH {_POINTS},
seq AS (SELECT *, lag(t, 1, 0.0::DOUBLE) OVER w AS t0, lag(y, 1, 0.0::DOUBLE) OVER w AS y0, row_number() OVER w AS nth
  FROM pts WINDOW w AS (PARTITION BY batch, medium, run_no ORDER BY t)),
x AS (SELECT *,
  CASE WHEN nth = 1 THEN CASE WHEN y <= 0 THEN t ELSE t * 50.0 / y END WHEN y = y0 THEN t ELSE t0 + (50.0 - y0) / (y - y0) * (t - t0) END AS c50,
  CASE WHEN nth = 1 THEN CASE WHEN y <= 0 THEN t ELSE t * 80.0 / y END WHEN y = y0 THEN t ELSE t0 + (80.0 - y0) / (y - y0) * (t - t0) END AS c80
  FROM seq)
SELECT batch, medium, run_no, count(*) AS n_time_points,
  round(CASE WHEN count(*) >= 2 AND sum(y - y0) > 0 THEN sum((t + t0) / 2 * (y - y0)) / sum(y - y0) END, 6) + 0.0 AS mdt,
  round(CASE WHEN count(*) >= 2 AND max(t) > 0 THEN sum((y + y0) / 2 * (t - t0)) / max(t) END + 1e-9, 6) + 0.0 AS dissolution_efficiency,
  round(CASE WHEN count(*) >= 2 THEN arg_min(c50, nth) FILTER (WHERE y >= 50) END, 6) + 0.0 AS t50,
  round(CASE WHEN count(*) >= 2 THEN arg_min(c80, nth) FILTER (WHERE y >= 80) END, 6) + 0.0 AS t80,
  round(CASE WHEN count(*) FILTER (WHERE y > 0 AND y < 99.5) >= 3 THEN
    sum(CASE WHEN y > 0 AND y < 99.5 THEN t * -ln(1 - y / 100) END) / sum(CASE WHEN y > 0 AND y < 99.5 THEN t * t END) END, 6) + 0.0 AS first_order_k
FROM x GROUP BY batch, medium, run_no""")
def profile_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profiles.metrics(_points(spark, sf_dir))
    # Readings have two decimals, so areas end in exact halves; a hair more decides how these are rounded.
    return _rounded(out, "mdt", "t50", "t80", "first_order_k").withColumn("dissolution_efficiency", _r(F.col("dissolution_efficiency") + 1e-9))


@_query(f"""
WITH {_POINTS},
seq AS (SELECT *, lag(t, 1, 0.0::DOUBLE) OVER w AS t0, lag(y, 1, 0.0::DOUBLE) OVER w AS y0
  FROM pts WINDOW w AS (PARTITION BY batch, medium, run_no ORDER BY t)),
m AS (SELECT batch, medium, run_no, CASE WHEN count(*) >= 2 AND sum(y - y0) > 0 THEN sum((t + t0) / 2 * (y - y0)) / sum(y - y0) END AS mdt
  FROM seq GROUP BY 1, 2, 3)
SELECT batch, run_no, count(*) AS n_media, round(max(mdt) - min(mdt), 6) + 0.0 AS spread FROM m WHERE mdt IS NOT NULL
GROUP BY batch, run_no HAVING count(*) >= 2""")
def profile_media_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profiles.spread_across_media(profiles.metrics(_points(spark, sf_dir))), "spread")


@_query(f"""
WITH {_POINTS}, ref AS (SELECT medium, time_min, y AS r FROM pts WHERE batch = '{CONTROL}' AND run_no = 1)
SELECT batch, medium, run_no, count(*) AS n_points,
  round(CASE WHEN count(*) >= 3 THEN 50 * log10(100 / sqrt(1 + avg((r - y) * (r - y)))) END, 6) + 0.0 AS f2,
  round(CASE WHEN count(*) >= 3 AND sum(r) > 0 THEN 100 * sum(abs(r - y)) / sum(r) END, 6) + 0.0 AS f1,
  count(*) FILTER (WHERE r > 85 AND y > 85) AS n_both_above_85
FROM pts JOIN ref USING (medium, time_min) GROUP BY batch, medium, run_no""")
def profile_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profiles.similarity(_points(spark, sf_dir), CONTROL), "f2", "f1")


@_query(f"""
WITH {_POINTS}, other AS (SELECT min(batch) AS b FROM pts WHERE batch <> '{CONTROL}' AND run_no = 1)
SELECT a.medium, a.time_min, round(a.y, 6) + 0.0 AS reference, round(b.y, 6) + 0.0 AS test, round(b.y - a.y, 6) + 0.0 AS difference
FROM pts a JOIN pts b ON a.medium = b.medium AND a.time_min = b.time_min
WHERE a.batch = '{CONTROL}' AND a.run_no = 1 AND b.run_no = 1 AND b.batch = (SELECT b FROM other)""")
def profile_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = _points(spark, sf_dir)
    other = pts.where((F.col("batch") != CONTROL) & (F.col("run_no") == 1)).agg(F.min("batch")).first()[0]
    return _rounded(profiles.compared(pts, CONTROL, other or CONTROL), "reference", "test", "difference")


@_query("""
WITH d AS (SELECT upper(replace(batch, ' ', '')) AS k, CASE WHEN NOT isnan(percent_released) THEN percent_released END AS y FROM dissolution),
known AS (SELECT DISTINCT upper(replace(batch, ' ', '')) AS k FROM batch_wide WHERE batch IS NOT NULL)
SELECT 'DISSOLUTION_UNKNOWN_BATCH' AS code, 'WARNING' AS severity, count(*) AS n_rows FROM d WHERE k NOT IN (SELECT k FROM known)
UNION ALL SELECT 'NO_DISSOLUTION_FOR_BATCH', 'INFO', count(*) FROM known WHERE k NOT IN (SELECT k FROM d WHERE k IS NOT NULL)
UNION ALL SELECT 'DISSOLUTION_OUT_OF_RANGE', 'WARNING', count(*) FROM d WHERE y < -1 OR y > 130""")
def profile_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.validation_issues(table(spark, sf_dir, "dissolution"), table(spark, sf_dir, "batch_wide"))


@_query()
def weibull_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.weibull(_points(spark, sf_dir))


# ---- the batch table


@_query(f"""
WITH {_CELLS}
SELECT variable, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS sd,
  round(CASE WHEN abs(avg(value)) > 1e-12 THEN 100 * stddev_samp(value) / abs(avg(value)) END, 6) + 0.0 AS rsd_pct,
  min(value) + 0.0 AS min, max(value) + 0.0 AS max, round(max(value) - min(value), 6) + 0.0 AS range
FROM cells WHERE value IS NOT NULL GROUP BY variable""")
def descriptive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(explore.describe(_cells(spark, sf_dir)), "mean", "sd", "rsd_pct", "range")


@_query(f"""
WITH {_CELLS}
SELECT variable, count(DISTINCT value) AS n_distinct, min(value) AS min, max(value) AS max, round(max(value) - min(value), 6) + 0.0 AS range,
  round(stddev_samp(value), 6) + 0.0 AS sd, round(CASE WHEN avg(value) <> 0 THEN abs(stddev_samp(value) / avg(value)) END, 6) + 0.0 AS cv,
  count(*) - count(value) AS n_missing, count(DISTINCT value) > 1 AS informative
FROM cells GROUP BY variable""")
def range_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(explore.replication(durable(_cells(spark, sf_dir))), "range", "sd", "cv")


@_query(f"""
WITH {_CELLS}
SELECT variable, count(*) - count(value) AS n_missing, round((count(*) - count(value)) / count(*)::DOUBLE, 6) AS fraction
FROM cells GROUP BY variable HAVING count(*) > count(value)""")
def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(explore.missingness(_cells(spark, sf_dir)), "fraction")


@_query(f"""
WITH {_CELLS}, per AS (SELECT variable, count(*) AS n, count(value) AS k, min(value) AS lo, max(value) AS hi FROM cells GROUP BY variable)
SELECT variable, 'ALL_MISSING_COLUMN' AS code FROM per WHERE k = 0
UNION ALL SELECT variable, 'CONSTANT_COLUMN' FROM per WHERE k > 0 AND lo = hi
UNION ALL SELECT variable, 'HIGH_MISSINGNESS' FROM per WHERE k > 0 AND (n - k) / n::DOUBLE > 0.4""")
def column_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.column_issues(_cells(spark, sf_dir))


@_query(f"""
WITH {_CELLS}, mid AS (SELECT variable, quantile_cont(value, 0.5) AS m FROM cells GROUP BY variable)
SELECT batch, variable, round(m, 6) + 0.0 AS value FROM cells JOIN mid USING (variable) WHERE value IS NULL AND m IS NOT NULL""")
def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that filling by the column's median fills."""
    filled = explore.imputed(durable(_cells(spark, sf_dir)), "median").where("filled")
    return _rounded(filled.select("batch", "variable", "value"), "value")


@_query(f"""
WITH {_CELLS}, mid AS (SELECT variable, avg(value) AS m FROM cells GROUP BY variable)
SELECT variable AS column_name, 'mean' AS method, round(min(m), 6) + 0.0 AS fill_value, count(*) AS n_filled
FROM cells JOIN mid USING (variable) WHERE value IS NULL AND m IS NOT NULL GROUP BY variable""")
def impute_mean_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(explore.imputation_log(explore.imputed(_cells(spark, sf_dir), "mean"), "mean"), "fill_value")


@_query(f"""
WITH {_CELLS} SELECT variable, round(quantile_cont(value, 0.9), 6) + 0.0 AS quantile FROM cells WHERE value IS NOT NULL GROUP BY variable""")
def ninth_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(exact_quantile(durable(_cells(spark, sf_dir)), 0.9), "quantile")


_IN = ", ".join(f"'{c}'" for c in (*PREDICTORS, RESPONSE))


@_query(f"""
WITH {_CELLS} SELECT batch FROM cells WHERE variable IN ({_IN}) AND value IS NOT NULL GROUP BY batch HAVING count(*) = {len(PREDICTORS) + 1}""")
def complete_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.complete_batches(_cells(spark, sf_dir), (*PREDICTORS, RESPONSE))


@_query("""
SELECT batch, count(*) AS n_rows, min(loaded_at) AS first_loaded FROM batch_wide WHERE batch IS NOT NULL GROUP BY batch HAVING count(*) > 1""")
def duplicate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "batch_wide").where("batch is not null").groupBy("batch")
    return rows.agg(F.count("*").alias("n_rows"), F.min("loaded_at").alias("first_loaded")).where("n_rows > 1")


@_query(f"""
WITH {_LABELS} SELECT w.batch, formulation, equipment_train, manufacturing_date
FROM (SELECT DISTINCT batch FROM batch_wide WHERE batch IS NOT NULL) w LEFT JOIN labels USING (batch)""")
def metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "batch_wide").select("batch").where("batch is not null").distinct()
    return batches.join(_labels(spark, sf_dir), "batch", "left")


@_query("""
SELECT DISTINCT batch, 'BATCH_MISSING_METADATA' AS code FROM batch_wide WHERE batch IS NOT NULL AND batch NOT IN (SELECT batch FROM batch_metadata WHERE batch IS NOT NULL)
UNION ALL SELECT DISTINCT batch, 'METADATA_WITHOUT_BATCH' FROM batch_metadata WHERE batch IS NOT NULL AND batch NOT IN (SELECT batch FROM batch_wide WHERE batch IS NOT NULL)""")
def unmatched_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "batch_wide").select("batch").where("batch is not null").distinct()
    two = table(spark, sf_dir, "batch_metadata").select("batch").where("batch is not null").distinct()
    missing = one.join(two, "batch", "left_anti").withColumn("code", F.lit("BATCH_MISSING_METADATA"))
    return missing.union(two.join(one, "batch", "left_anti").withColumn("code", F.lit("METADATA_WITHOUT_BATCH")))


@_query(f"""WITH {_LABELS} SELECT formulation, count(*) AS n_batches FROM labels WHERE formulation IS NOT NULL GROUP BY formulation""")
def batches_per_formulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).where("formulation is not null").groupBy("formulation").agg(F.count("*").alias("n_batches"))


@_query(f"""
WITH {_CELLS}, {_LABELS}
SELECT batch, manufacturing_date, value, row_number() OVER (ORDER BY manufacturing_date ASC NULLS LAST, batch) AS place
FROM cells LEFT JOIN labels USING (batch) WHERE variable = 'hardness_N' AND value IS NOT NULL""")
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.trend(_cells(spark, sf_dir), _labels(spark, sf_dir), "hardness_N")


@_query("""
WITH raw AS (SELECT batch, variable, min(CASE WHEN NOT isnan(value) AND NOT isinf(value) THEN value END) AS value
  FROM (SELECT * EXCLUDE (loaded_at) FROM batch_wide WHERE batch IS NOT NULL) UNPIVOT INCLUDE NULLS (value FOR variable IN (COLUMNS(* EXCLUDE (batch))))
  GROUP BY 1, 2)
SELECT variable, batch, value, CASE WHEN value IS NULL THEN 'no result' WHEN value < low THEN 'BELOW limit' WHEN value > high THEN 'ABOVE limit' ELSE 'within limits' END AS status
FROM raw JOIN variable_families USING (variable)""")
def spec_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "batch_wide")
    raw = unpivoted(wide.where("batch is not null"), numeric_columns(wide)).groupBy("batch", "variable").agg(F.min("value").alias("value"))
    return explore.spec_check(raw, table(spark, sf_dir, "variable_families"))


def _first_batches(spark: SparkSession, sf_dir: str, n: int) -> list[str]:
    return [r.batch for r in table(spark, sf_dir, "batch_wide").select("batch").where("batch is not null").distinct().orderBy("batch").limit(n).collect()]


@_query(f"""
WITH {_CELLS}, p AS (SELECT min(batch) AS a FROM batch_wide), q AS (SELECT min(batch) AS b FROM batch_wide WHERE batch > (SELECT a FROM p)),
v AS (SELECT variable, max(value) FILTER (WHERE batch = (SELECT a FROM p)) AS a, max(value) FILTER (WHERE batch = (SELECT b FROM q)) AS b,
  CASE WHEN count(value) >= 5 THEN stddev_samp(value) END AS sd FROM cells GROUP BY variable)
SELECT variable, a, b, round(b - a, 6) + 0.0 AS difference, round(CASE WHEN abs(a) > 1e-12 THEN 100 * (b - a) / abs(a) END, 6) + 0.0 AS percent,
  round(CASE WHEN sd > 1e-12 THEN (b - a) / sd END, 6) + 0.0 AS z, b <> a AS changed,
  row_number() OVER (ORDER BY round(abs(CASE WHEN sd > 1e-12 THEN (b - a) / sd END), 9) DESC NULLS LAST, round(abs(CASE WHEN abs(a) > 1e-12 THEN 100 * (b - a) / abs(a) END), 9) DESC NULLS LAST, variable) AS place
FROM v WHERE a IS NOT NULL AND b IS NOT NULL""")
def what_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _first_batches(spark, sf_dir, 2)
    return _rounded(explore.what_changed(_cells(spark, sf_dir), a, b), "difference", "percent", "z")


@_query(f"""
WITH {_CELLS} SELECT batch, {', '.join(f"max(value) FILTER (WHERE variable = '{c}') AS {c}" for c in (*PREDICTORS, RESPONSE))}
FROM cells GROUP BY batch""")
def long_to_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute-value rows of the main columns back to one row per batch."""
    names = (*PREDICTORS, RESPONSE)
    cells = _cells(spark, sf_dir)
    return to_wide(cells, ["batch"], "variable", F.col("value"), [(c, c, "double") for c in names]).wide


@_query(f"""
WITH {_CELLS} SELECT round(s, 6) + 0.0 AS share_hpmc, batch FROM (
  SELECT batch, max(value) FILTER (WHERE variable = 'hpmc_level_pct') / nullif(sum(value), 0) AS s
  FROM cells WHERE variable IN ({', '.join(f"'{c}'" for c in MIXTURE)}) GROUP BY batch)""")
def pseudocomponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cells(spark, sf_dir).where(F.col("variable").isin(*MIXTURE)).groupBy("batch")
    share = F.try_divide(F.max(F.when(F.col("variable") == "hpmc_level_pct", F.col("value"))), F.sum("value"))
    return rows.agg(_r(share).alias("share_hpmc"))


@_query()
def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per measured column of the raw files: fields that are no numbers, how many different ones, and the first five of these."""
    fields = read_fields(table(spark, sf_dir, "raw_batch_rows")).where("sound and size(header) = size(fields)")
    names = table(spark, sf_dir, "variable_families").select("variable")
    pairs = fields.select(F.explode(F.arrays_zip("header", "fields")).alias("p")).select(F.col("p.header").alias("variable"), F.col("p.fields").alias("text"))
    number = F.translate(F.trim("text"), ",", ".").rlike(r"\A[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z")
    bad = pairs.where((F.col("text") != "") & ~number & (F.lower("text") != F.lower("variable"))).join(F.broadcast(names), "variable").groupBy("variable", "text").agg(F.count("*").alias("c"))
    # Of each hash bucket the first five texts, then of these the first five: no task holds all texts of a column.
    bucket = F.pmod(F.xxhash64("text"), F.lit(256))
    near = bad.withColumn("r", F.row_number().over(Window.partitionBy("variable", bucket).orderBy("text")))
    per = near.groupBy("variable").agg(F.sum("c").alias("n"), F.count("*").alias("n_different"), F.slice(F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("text")))), 1, 5).alias("examples"))
    return per


# ---- what cannot be told apart


@_query(f"""
WITH {_CELLS} SELECT a.variable AS a, b.variable AS b,
  round(CASE WHEN count(*) FILTER (WHERE a.value IS NOT NULL AND b.value IS NOT NULL) >= 3
    AND min(CASE WHEN b.value IS NOT NULL THEN a.value END) < max(CASE WHEN b.value IS NOT NULL THEN a.value END)
    AND min(CASE WHEN a.value IS NOT NULL THEN b.value END) < max(CASE WHEN a.value IS NOT NULL THEN b.value END)
    THEN corr(a.value, b.value) END, 6) + 0.0 AS r,
  count(*) FILTER (WHERE a.value IS NOT NULL AND b.value IS NOT NULL) AS n
FROM cells a JOIN cells b ON a.batch = b.batch AND a.variable < b.variable GROUP BY 1, 2""")
def pairwise_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = durable(_wide(spark, sf_dir))
    return _rounded(diagnostics.correlations(wide, numeric_columns(wide)), "r")


@_query(f"""
WITH RECURSIVE {_CELLS},
edges AS (SELECT a.variable AS a, b.variable AS b, corr(a.value, b.value) AS r FROM cells a JOIN cells b ON a.batch = b.batch AND a.variable < b.variable
  GROUP BY 1, 2 HAVING stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 AND count(*) FILTER (WHERE a.value IS NOT NULL AND b.value IS NOT NULL) >= 3),
adj AS (SELECT a AS u, b AS v FROM edges WHERE abs(r) >= 0.9 UNION SELECT b, a FROM edges WHERE abs(r) >= 0.9),
reach(u, v) AS (SELECT u, v FROM adj UNION SELECT r.u, a.v FROM reach r JOIN adj a ON a.u = r.v),
low AS (SELECT u AS variable, min(least(u, v)) AS cluster_id FROM reach GROUP BY u)
SELECT variable, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS size FROM low""")
def corr_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = durable(_wide(spark, sf_dir))
    return diagnostics.clusters(diagnostics.correlations(wide, numeric_columns(wide)))


@_query(f"""
WITH {_CELLS}, {_LABELS},
r AS (SELECT variable, formulation, value FROM cells JOIN labels USING (batch) WHERE value IS NOT NULL AND formulation IS NOT NULL),
g AS (SELECT variable, formulation, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM r GROUP BY 1, 2),
t AS (SELECT variable, avg(value) AS mean, min(value) AS lo, max(value) AS hi FROM r GROUP BY 1)
SELECT variable, count(*) AS n_groups, round(CASE WHEN min(lo) < max(hi) THEN
  sum(n * (m - mean) * (m - mean)) / (sum(n * (m - mean) * (m - mean)) + sum(n * v)) END, 6) + 0.0 AS eta2
FROM g JOIN t USING (variable) GROUP BY variable""")
def eta_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(diagnostics.eta_squared(_cells(spark, sf_dir), _labels(spark, sf_dir)), "eta2")


@_query(f"""
WITH {_CELLS}, {_LABELS},
r AS (SELECT variable, value, floor(epoch(manufacturing_date)) - 1.7e9 AS secs FROM cells JOIN labels USING (batch) WHERE value IS NOT NULL AND manufacturing_date IS NOT NULL)
SELECT variable, count(*) AS n, round(CASE WHEN count(*) >= 3 AND min(value) < max(value) AND min(secs) < max(secs) THEN corr(secs, value) ^ 2 END, 6) + 0.0 AS r2
FROM r GROUP BY variable""")
def time_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(diagnostics.time_r2(_cells(spark, sf_dir), _labels(spark, sf_dir)), "r2")


@_query(f"""
WITH {_CELLS}, {_LABELS},
r AS (SELECT variable, formulation, value FROM cells JOIN labels USING (batch) WHERE value IS NOT NULL AND formulation IS NOT NULL),
g AS (SELECT variable, formulation, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM r GROUP BY 1, 2),
t AS (SELECT variable, avg(value) AS mean, stddev_samp(value) AS sd FROM r GROUP BY 1),
s AS (SELECT variable, sum(n)::DOUBLE AS n, count(*)::DOUBLE AS k, min(sd) AS sd_total, sum(n * (m - mean) * (m - mean)) AS ssb, sum(n * v) AS ssw, sum(n * n)::DOUBLE AS nn
  FROM g JOIN t USING (variable) GROUP BY variable HAVING sum(n) >= 3 AND count(*) >= 2),
q AS (SELECT *, ssb / (k - 1) AS msb, ssw / nullif(n - k, 0) AS msw, (n - nn / n) / (k - 1) AS n0 FROM s),
z AS (SELECT *, greatest((msb - msw) / n0, 0) AS b FROM q)
SELECT variable, n::BIGINT AS n, k AS n_groups, round(sd_total, 6) + 0.0 AS sd_total, round(msb, 6) + 0.0 AS msb, round(msw, 6) + 0.0 AS msw,
  round(CASE WHEN msw <> 0 THEN msb / msw END, 4) + 0.0 AS f, round(CASE WHEN b + msw <> 0 THEN b / (b + msw) END, 6) + 0.0 AS icc,
  round(sqrt(msw), 6) + 0.0 AS sd_within, round(sqrt(b), 6) + 0.0 AS sd_between FROM z""")
def variance_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.variance_components(_cells(spark, sf_dir), _labels(spark, sf_dir))
    return _rounded(out, "sd_total", "msb", "msw", "icc", "sd_within", "sd_between").withColumn("f", _r("f", 4))


@_query(f"""
WITH {_CELLS}, w AS (SELECT batch, max(value) FILTER (WHERE variable = 'hpmc_level_pct') AS a, max(value) FILTER (WHERE variable = 'main_compression_kN') AS b
  FROM cells GROUP BY batch), r AS (SELECT corr(a, b) ^ 2 AS r2 FROM w WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT unnest(['hpmc_level_pct', 'main_compression_kN']) AS variable, round(r2, 6) + 0.0 AS r2, round(1 / (1 - r2), 6) + 0.0 AS vif FROM r""")
def inflation_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(diagnostics.inflation(_wide(spark, sf_dir), ["hpmc_level_pct", "main_compression_kN"]), "r2", "vif")


@_query()
def inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.inflation(_wide(spark, sf_dir), PREDICTORS)


@_query(f"""
WITH {_CELLS}, s AS (SELECT batch, sum(value) AS total FROM cells WHERE variable IN ({', '.join(f"'{c}'" for c in MIXTURE)})
  GROUP BY batch HAVING count(value) = {len(MIXTURE)})
SELECT count(*) AS n, round(avg(total), 6) + 0.0 AS mean, round(stddev_pop(total), 6) + 0.0 AS sd FROM s""")
def mixture_row_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _cells(spark, sf_dir).where(F.col("variable").isin(*MIXTURE)).groupBy("batch").agg(F.sum("value").alias("total"), F.count("value").alias("k"))
    return sums.where(F.col("k") == len(MIXTURE)).agg(F.count("*").alias("n"), _r(F.avg("total")).alias("mean"), _r(F.stddev_pop("total")).alias("sd"))


@_query()
def mixture_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentages that together make a constant sum, and the sd of that sum."""
    names, sd = diagnostics.constant_sums(_wide(spark, sf_dir), MIXTURE)
    return spark.createDataFrame([(c, sd) for c in names], "component string, sd_of_sum double")


# ---- the response and its models


@_query(f"""
WITH {_CELLS} SELECT count(value) AS n_observed, count(*) - count(value) AS n_missing, min(value) AS min, max(value) AS max, round(avg(value), 6) + 0.0 AS mean,
  round(stddev_samp(value), 6) + 0.0 AS sd, round(max(value) - min(value), 6) + 0.0 AS range, count(value) >= 3 AND max(value) > min(value) AS usable
FROM cells WHERE variable = '{RESPONSE}'""")
def response_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(response.diagnostics(_cells(spark, sf_dir), RESPONSE), "mean", "sd", "range")


@_query(f"""
WITH {_CELLS}, y AS (SELECT batch, value AS y FROM cells WHERE variable = '{RESPONSE}' AND value IS NOT NULL),
s AS (SELECT variable, count(*) AS n, CASE WHEN count(*) >= 3 AND min(value) < max(value) AND min(y) < max(y) THEN corr(value, y) END AS r
  FROM cells JOIN y USING (batch) WHERE variable <> '{RESPONSE}' AND value IS NOT NULL GROUP BY variable)
SELECT variable, n, round(r, 6) + 0.0 AS r, round(r * sqrt(n - 2) / nullif(sqrt(1 - r * r), 0), 4) + 0.0 AS t FROM s""")
def univariate_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = response.screen(durable(_wide(spark, sf_dir)), RESPONSE).drop("p")
    return _rounded(out, "r").withColumn("t", _r("t", 4))


@_query()
def screen_q_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return response.with_q_values(response.screen(durable(_wide(spark, sf_dir)), RESPONSE))


@_query(f"""
WITH {_CELLS}, {_LABELS}, s AS (SELECT variable, round(stddev_samp(value), 9) AS sd, count(value) AS n FROM cells GROUP BY variable)
SELECT variable, greatest(1, least(10, floor(n / 5.0)::INTEGER)) AS cap, CASE WHEN sd IS NULL OR sd <= 0 THEN 1.0 ELSE round(10.0 ^ floor(log10(sd)) *
  CASE WHEN sd / 10.0 ^ floor(log10(sd)) <= 1 THEN 1 WHEN sd / 10.0 ^ floor(log10(sd)) <= 2 THEN 2 WHEN sd / 10.0 ^ floor(log10(sd)) <= 5 THEN 5 ELSE 10 END, 9) END AS step FROM s""")
def effect_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per variable: the step in which an effect is told, and how many predictors its batches can carry."""
    per = _cells(spark, sf_dir).groupBy("variable").agg(F.round(F.stddev_samp("value"), 9).alias("sd"), F.count("value").alias("n"))
    return per.select("variable", response.complexity_cap(F.col("n")).alias("cap"), F.round(response.nice_step(F.col("sd")), 9).alias("step"))


@_query(f"""
WITH {_CELLS}, {_LABELS}, {_ROWS} SELECT fold::INTEGER AS fold, count(*) AS n_batches, count(DISTINCT formulation) AS n_formulations FROM rows GROUP BY fold""")
def formulation_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of whole formulations, dealt in turn from the largest down."""
    per = _rows(spark, sf_dir).groupBy("fold", "formulation").agg(F.count("*").alias("n"))
    return per.groupBy("fold").agg(F.sum("n").alias("n_batches"), F.count("*").alias("n_formulations"))


@_query(f"""
WITH {_CELLS}, {_LABELS}, {_ROWS},
f AS (SELECT fold, count(*)::DOUBLE AS n, sum(hpmc_level_pct) AS x, sum(y) AS y, sum(hpmc_level_pct * hpmc_level_pct) AS xx, sum(hpmc_level_pct * y) AS xy FROM rows GROUP BY fold),
t AS (SELECT a.fold, sum(b.n) AS n, sum(b.x) AS x, sum(b.y) AS y, sum(b.xx) AS xx, sum(b.xy) AS xy FROM f a JOIN f b ON a.fold <> b.fold GROUP BY a.fold),
c AS (SELECT fold, (xy - x * y / n) / (xx - x * x / n) AS slope, y / n AS my, x / n AS mx FROM t),
e AS (SELECT sum((r.y - (my + slope * (hpmc_level_pct - mx))) ^ 2) AS sse, count(*) AS n FROM rows r JOIN c USING (fold))
SELECT round(1 - sse / (SELECT var_pop(y) * count(*) FROM rows), 6) + 0.0 AS q2, round(sqrt(sse / n), 6) + 0.0 AS rmse, n FROM e""")
def cv_single_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out Q2 of least squares on one predictor over folds of whole formulations."""
    rows = _rows(spark, sf_dir).select("batch", "fold", "x0", "y")
    got = models.cross_validate("ols", models.fold_sums(rows, PREDICTORS[:1]))
    return spark.createDataFrame([(round(float(got["q2"]), 6) + 0.0, round(got["rmse"], 6) + 0.0, got["n"])], "q2 double, rmse double, n long")


def _predictors(spark: SparkSession, sf_dir: str) -> list[str]:
    """The columns of the four predictor families that vary."""
    families = {r.variable: r.family for r in table(spark, sf_dir, "variable_families").select("variable", "family").collect()}
    built = build_dataset(table(spark, sf_dir, "batch_wide"), families, table(spark, sf_dir, "batch_metadata"))
    return [c for c in built.predictors if c != RESPONSE]


def _features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str], dict[str, list[str]]]:
    """(rows for models, features, plan): all predictors, mixtures without their remainder, correlated columns entering as one."""
    wide = durable(_wide(spark, sf_dir))
    columns = _predictors(spark, sf_dir)
    mixture, _ = diagnostics.constant_sums(wide, [c for c in MIXTURE if c in columns])
    gone = diagnostics.safe_of_mixtures(wide, columns, mixture)
    kept = [c for c in columns if c not in gone]
    plan = diagnostics.plan_of(diagnostics.clusters(diagnostics.correlations(wide, kept)), kept)
    features = diagnostics.cluster_features(wide, plan).join(wide.select("batch", RESPONSE), "batch")
    rows = durable(models.model_rows(features, _labels(spark, sf_dir), list(plan), RESPONSE, fill=True))
    return rows, list(plan), plan


@_query()
def model_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out Q2 of every linear model over all predictors, tuned inside each fold, with the fitted coefficients.

    The group lasso works on the single columns, the members of a cluster being one group.
    """
    rows, names, plan = _features(spark, sf_dir)
    sums = models.fold_sums(rows, names)
    wide = _wide(spark, sf_dir)
    single = [c for m in plan.values() for c in m]
    groups, at = [], 0
    for m in plan.values():
        groups.append(list(range(at, at + len(m))))
        at += len(m)
    apart = models.fold_sums(models.model_rows(wide, _labels(spark, sf_dir), single, RESPONSE, fill=True), single)
    out = []
    for model in ("ols", "ridge", "lasso", "elastic_net", "group_lasso", "pls"):
        s, g = (apart, groups) if model == "group_lasso" else (sums, None)
        got = models.cross_validate(model, s, g)
        setting, coef, intercept = models.tuned(model, s.by_fold, g)
        out.append((model, setting, got["q2"], got["rmse"], got["n"], intercept, {c: float(x) for c, x in zip(s.columns, coef, strict=True) if x}))
    return spark.createDataFrame(out, "model string, setting string, q2 double, rmse double, n long, intercept double, coef map<string,double>")


@_query()
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the held-out Q2 of the elastic net beats complete refits to permuted responses."""
    rows, names, _ = _features(spark, sf_dir)
    sums = models.fold_sums(rows, names)
    q2 = models.cross_validate("elastic_net", sums)["q2"]
    null = durable(models.permutation_null(rows, sums, "elastic_net"))
    return models.permutation_summary(null, q2).withColumn("q2", F.lit(q2))


@_query()
def stability_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the elastic net keeps each feature over resampled formulations, the steadiest first."""
    rows, names, _ = _features(spark, sf_dir)
    return models.stability(rows, names).orderBy(F.desc("frequency"), "feature")


@_query()
def stability_of_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over resampled single batches."""
    rows, names, _ = _features(spark, sf_dir)
    return models.stability(rows, names, scheme="batch", replicates=200).orderBy(F.desc("frequency"), "feature")


@_query()
def validation_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be said of the elastic net: held-out Q2, beside that over random rows (for comparison only), the permutation null and stability."""
    rows, names, _ = _features(spark, sf_dir)
    return models.validated(rows, names)


@_query(f"""
WITH {_CELLS}, {_LABELS}, {_ROWS}
SELECT 'leave_one_formulation_out' AS scheme, count(DISTINCT formulation) AS n_folds, count(*) AS n_batches FROM rows
UNION ALL SELECT 'grouped_kfold_formulation', count(DISTINCT fold), count(*) FROM rows
UNION ALL SELECT 'leave_one_batch_out', count(DISTINCT batch), count(*) FROM rows""")
def grouped_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schemes by which batches are left out, and their numbers of folds."""
    rows = durable(_rows(spark, sf_dir))
    out = None
    for scheme in models.SCHEMES:
        folds = models.split(rows, scheme).groupBy("fold").agg(F.count("*").alias("n"))
        one = folds.agg(F.count("*").alias("n_folds"), F.sum("n").alias("n_batches")).select(F.lit(scheme).alias("scheme"), "n_folds", "n_batches")
        out = one if out is None else out.unionByName(one)
    return out


def _held_out_sql(fold: str) -> str:
    return f"""
WITH {_CELLS}, {_LABELS}, {_ROWS}, u AS (SELECT *, {fold} AS unit FROM rows),
f AS (SELECT unit, count(*)::DOUBLE AS n, sum(hpmc_level_pct) AS x, sum(y) AS y, sum(hpmc_level_pct * hpmc_level_pct) AS xx, sum(hpmc_level_pct * y) AS xy FROM u GROUP BY unit),
a AS (SELECT sum(n) AS n, sum(x) AS x, sum(y) AS y, sum(xx) AS xx, sum(xy) AS xy FROM f),
t AS (SELECT f.unit, a.n - f.n AS n, a.x - f.x AS x, a.y - f.y AS y, a.xx - f.xx AS xx, a.xy - f.xy AS xy FROM f, a),
c AS (SELECT unit, (xy - x * y / n) / (xx - x * x / n) AS slope, y / n AS my, x / n AS mx FROM t)
SELECT u.batch, unit AS fold, round(u.y, 6) + 0.0 AS observed, round(my + slope * (hpmc_level_pct - mx), 6) + 0.0 AS prediction FROM u JOIN c USING (unit)"""


@_query(_held_out_sql("formulation"))
def heldout_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch's response and what least squares on one predictor, fitted without its formulation, says."""
    out = models.held_out_line(models.split(durable(_rows(spark, sf_dir)), "leave_one_formulation_out"))
    return out.select("batch", "fold", _r("y").alias("observed"), _r("prediction").alias("prediction"))


@_query(_held_out_sql("batch"))
def heldout_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, leaving out one batch at a time."""
    out = models.held_out_line(models.split(durable(_rows(spark, sf_dir)), "leave_one_batch_out"))
    return out.select("batch", "fold", _r("y").alias("observed"), _r("prediction").alias("prediction"))


@_query()
def tree_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(_rows(spark, sf_dir))
    got = [models.trees(rows, PREDICTORS, kind) for kind in ("random_forest", "gbm")]
    return spark.createDataFrame([(g["model"], g["q2"], g["n"], g["importance"]) for g in got], "model string, q2 double, n long, importance map<string,double>")


@_query()
def scheffe_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical coefficients of the mixture's components for the response, at constant total."""
    rows = models.model_rows(_wide(spark, sf_dir), _labels(spark, sf_dir), MIXTURE, RESPONSE)
    total = sum((F.col(f"x{i}") for i in range(1, len(MIXTURE))), F.col("x0"))
    shares = rows.withColumn("_t", total).where("_t > 0").withColumns({f"x{i}": F.col(f"x{i}") / F.col("_t") for i in range(len(MIXTURE))})
    coef = models.scheffe(models.fold_sums(shares, MIXTURE).total)
    return spark.createDataFrame([(c, float(b)) for c, b in zip(MIXTURE, coef, strict=True)], "component string, coef double")


@_query(_held_out_sql("fold"))
def observed_vs_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch's response and what least squares on one predictor, fitted without its fold of formulations, says."""
    out = models.held_out_line(models.split(durable(_rows(spark, sf_dir)), "grouped_kfold_formulation"))
    return out.select("batch", F.col("fold").cast("long").alias("fold"), _r("y").alias("observed"), _r("prediction").alias("prediction"))


@_query(f"""
WITH {_CELLS}, {_LABELS}, {_ROWS} SELECT variable, min(value) AS low, max(value) AS high, round((min(value) + max(value)) / 2, 6) + 0.0 AS centre FROM (
  SELECT batch, {', '.join(PREDICTORS)} FROM rows) UNPIVOT (value FOR variable IN ({', '.join(PREDICTORS)})) GROUP BY variable""")
def experiment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low, high and centre settings of the candidate factors of a confirming experiment, as observed."""
    entries = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"x{i}").alias("value")) for i, c in enumerate(PREDICTORS)])
    rows = _rows(spark, sf_dir).select(F.explode(entries).alias("e")).groupBy("e.variable")
    return rows.agg(F.min("e.value").alias("low"), F.max("e.value").alias("high"), _r((F.min("e.value") + F.max("e.value")) / 2).alias("centre"))


@_query(f"""
WITH {_CELLS}, {_LABELS}, {_ROWS}, c AS (SELECT regr_slope(y, hpmc_level_pct) AS s, avg(hpmc_level_pct) AS m FROM rows)
SELECT batch, 'hpmc_level_pct' AS feature, round(s * (hpmc_level_pct - m), 6) + 0.0 AS contribution FROM rows, c""")
def linear_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first predictor adds to each batch's prediction in a single-predictor fit."""
    rows = durable(_rows(spark, sf_dir))
    total = models.fold_sums(rows.select("fold", "x0", "y"), PREDICTORS[:1]).total
    coef, _ = models.ridge(total, 0.0)
    return _rounded(models.contributions(rows, PREDICTORS[:1], coef, models.centred(total).mean), "contribution")


@_query()
def partial_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = durable(_rows(spark, sf_dir))
    _, coef, intercept = models.tuned("ridge", models.fold_sums(rows, PREDICTORS).by_fold)
    return models.partial_dependence(rows, PREDICTORS, PREDICTORS[0], coef, intercept)


@_query()
def experiment_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-level design with centre points in three factors, at their observed extremes."""
    return models.factorial_design(experiment_ranges(spark, sf_dir), PREDICTORS[:3])


@_query(f"""
WITH {_CELLS}, per AS (SELECT variable, count(*) AS n, count(value) AS k, min(value) AS lo, max(value) AS hi FROM (
  SELECT batch, variable, min(CASE WHEN NOT isnan(value) THEN value END) AS value FROM (SELECT * EXCLUDE (loaded_at) FROM batch_wide WHERE batch IS NOT NULL)
  UNPIVOT INCLUDE NULLS (value FOR variable IN (COLUMNS(* EXCLUDE (batch)))) GROUP BY 1, 2) GROUP BY variable),
own AS (SELECT DISTINCT batch FROM batch_wide WHERE batch IS NOT NULL), other AS (SELECT DISTINCT batch FROM batch_metadata WHERE batch IS NOT NULL),
i AS (
  SELECT 'ERROR' AS severity, 'DUPLICATE_BATCH_ID' AS code, count(*) AS n_rows FROM (SELECT batch FROM batch_wide WHERE batch IS NOT NULL GROUP BY batch HAVING count(*) > 1)
  UNION ALL SELECT 'ERROR', 'BATCH_MISSING_METADATA', count(*) FROM own WHERE batch NOT IN (SELECT batch FROM other)
  UNION ALL SELECT 'WARNING', 'METADATA_WITHOUT_BATCH', count(*) FROM other WHERE batch NOT IN (SELECT batch FROM own)
  UNION ALL SELECT 'WARNING', 'CONSTANT_COLUMN', count(*) FROM per WHERE k > 0 AND lo = hi
  UNION ALL SELECT 'INFO', 'SHAPE', count(*) FROM own)
SELECT * FROM i WHERE n_rows > 0""")
def dataset_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the tables taken together; missing cells depend on which repeated row is kept and are in ``missingness``."""
    families = {r.variable: r.family for r in table(spark, sf_dir, "variable_families").select("variable", "family").collect()}
    built = build_dataset(table(spark, sf_dir, "batch_wide"), families, table(spark, sf_dir, "batch_metadata"))
    return built.issues.where("code <> 'HIGH_MISSINGNESS'").select("severity", "code", "n_rows")


# ---- the dictionary of variables, roles and aliases


@_query("SELECT variable, family, unit, low, high FROM variable_families WHERE family IN ('FORMULATION', 'RESPONSE')")
def variable_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variables.dictionary(table(spark, sf_dir, "variable_families"), ("FORMULATION", "RESPONSE")).select("variable", "family", "unit", "low", "high")


@_query("SELECT family, count(*) AS n_variables FROM variable_families GROUP BY family")
def variables_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variables.per_family(table(spark, sf_dir, "variable_families"))


@_query("SELECT variable, count(DISTINCT family) AS n_families FROM variable_families GROUP BY variable HAVING count(DISTINCT family) > 1")
def dual_role_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variables.dual_role(table(spark, sf_dir, "variable_families"))


@_query("""
WITH h AS (SELECT DISTINCT trim(unnest(string_split_regex(raw_line, '[,;\t]')), '" ') AS variable FROM raw_batch_rows WHERE line_no = 1)
SELECT variable, coalesce(min(family), 'PROCESS') AS family, regexp_matches(lower(variable), 'pct|%|percent|_ww$') AS percent,
  coalesce(coalesce(min(family), 'PROCESS') IN ('FORMULATION', 'PROCESS', 'MATERIAL'), TRUE) AS settable
FROM h LEFT JOIN variable_families USING (variable) GROUP BY variable""")
def roles_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family and roles of every column that the raw files' headers name."""
    heads = table(spark, sf_dir, "raw_batch_rows").where("line_no = 1")
    names = heads.select(F.explode(F.split("raw_line", r"[,;\t]")).alias("v")).select(F.trim(F.col("v"), F.lit('" ')).alias("variable")).distinct()
    known = variables.families_for(names, table(spark, sf_dir, "variable_families"))
    return known.select("variable", "family", variables.looks_like_percent(F.col("variable")).alias("percent"), variables.settable(F.col("family")).alias("settable"))


_SEARCHED = (*variables.CAUSAL, r"\bnew\b")
# Words end where no letter, digit or underscore of any script follows.
_CAUSAL_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{p}' AS pattern FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){p.removeprefix(chr(92) + 'b').removesuffix(chr(92) + 'b')}($|[^\\p{{L}}\\p{{N}}_])')" for p in _SEARCHED
)


@_query(f"SELECT pattern, count(*) AS n_texts FROM ({_CAUSAL_SQL}) GROUP BY pattern")
def causal_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with causal phrases, by pattern; one more pattern that is frequent in any text shows that they are searched."""
    hits = variables.causal_language(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", _SEARCHED)
    return hits.groupBy("pattern").agg(F.countDistinct("doc_id").alias("n_texts"))


@_query(f"""
WITH {_LABELS}, w AS (SELECT DISTINCT batch FROM batch_wide WHERE batch IS NOT NULL), n AS (SELECT count(*) AS b, count(DISTINCT formulation) AS f FROM w LEFT JOIN labels USING (batch))
SELECT b AS n_batches, f AS n_formulations, 40 AS n_predictors, 40 > b / 3.0 AS above_a_third, 40 >= b AS no_fewer_than_batches FROM n""")
def effective_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches and formulations against forty predictors."""
    return diagnostics.effective_size(table(spark, sf_dir, "batch_wide").where("batch is not null"), _labels(spark, sf_dir), 40)


_ETA_SQL = SQL["eta_squared"].strip().removeprefix("WITH").strip()


@_query(f"""
WITH e AS (WITH {_ETA_SQL}), t AS ({SQL['time_r2']})
SELECT variable, 'formulation' AS alias_of, eta2 AS strength FROM e WHERE eta2 > 0.6
UNION ALL SELECT variable, 'manufacturing_date', r2 FROM t WHERE r2 > 0.6""")
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables of which formulation or date of manufacture explains more than 60 %."""
    cells, labels = durable(_cells(spark, sf_dir)), durable(_labels(spark, sf_dir))
    return _rounded(diagnostics.aliases(diagnostics.eta_squared(cells, labels), diagnostics.time_r2(cells, labels), 0.6), "strength")


_NEAR = f"""{_CELLS},
edges AS (SELECT a.variable AS a, b.variable AS b, corr(a.value, b.value) AS r FROM cells a JOIN cells b ON a.batch = b.batch AND a.variable < b.variable
  GROUP BY 1, 2 HAVING stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 AND count(*) FILTER (WHERE a.value IS NOT NULL AND b.value IS NOT NULL) >= 3),
adj AS (SELECT a AS u, b AS v FROM edges WHERE abs(r) >= 0.9 UNION SELECT b, a FROM edges WHERE abs(r) >= 0.9),
reach(u, v) AS (SELECT u, v FROM adj UNION SELECT r.u, a.v FROM reach r JOIN adj a ON a.u = r.v),
low AS (SELECT u AS variable, min(least(u, v)) AS cluster_id, count(DISTINCT v) AS size FROM reach GROUP BY u)"""


@_query(f"""
WITH RECURSIVE {_NEAR}
SELECT cluster_id, 'cluster[' || cluster_id || '+' || (size - 1) || ']' AS name, size, a, b, round(r, 6) + 0.0 AS r FROM (
  SELECT cluster_id, size, a, b, r, row_number() OVER (PARTITION BY cluster_id ORDER BY round(-abs(r), 9), a, b) AS k FROM edges JOIN low ON low.variable = edges.a WHERE abs(r) >= 0.9) WHERE k = 1""")
def cluster_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = durable(_wide(spark, sf_dir))
    return _rounded(diagnostics.cluster_examples(durable(diagnostics.correlations(wide, numeric_columns(wide)))), "r")


@_query(f"""
WITH RECURSIVE {_NEAR}, e AS (WITH {_ETA_SQL}), t AS ({SQL['time_r2']})
SELECT a.variable, b.variable AS confounded_with FROM low a JOIN low b ON a.cluster_id = b.cluster_id AND a.variable <> b.variable
UNION ALL SELECT variable, 'formulation' FROM e WHERE eta2 > 0.95 UNION ALL SELECT variable, 'manufacturing_date' FROM t WHERE r2 > 0.95""")
def confounded_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each variable cannot be told apart from."""
    wide = durable(_wide(spark, sf_dir))
    cells, labels = unpivoted(wide, numeric_columns(wide)), durable(_labels(spark, sf_dir))
    alias = diagnostics.aliases(diagnostics.eta_squared(cells, labels), diagnostics.time_r2(cells, labels))
    return diagnostics.confounds(durable(diagnostics.correlations(wide, numeric_columns(wide))), alias)


@_query()
def cluster_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features that models work on, and the columns each stands for."""
    _, _, plan = _features(spark, sf_dir)
    return spark.createDataFrame([(f, m) for f, m in plan.items()], "feature string, members array<string>")


@_query(f"""
WITH {_CELLS}, w AS (SELECT batch, {', '.join(f"max(value) FILTER (WHERE variable = '{c}') AS {c}" for c in MIXTURE[:3])} FROM cells GROUP BY batch),
s AS (SELECT batch, {', '.join(f'{c} / nullif({" + ".join(f"coalesce({m}, 0)" for m in MIXTURE[:3])}, 0) AS s{i}' for i, c in enumerate(MIXTURE[:3]))} FROM w)
SELECT batch, {', '.join(f'round(s{i}, 6) + 0.0 AS "{c}"' for i, c in enumerate(MIXTURE[:3]))},
  {', '.join(f'round(s{i} * s{j}, 6) + 0.0 AS "{MIXTURE[i]} x {MIXTURE[j]}"' for i in range(3) for j in range(i + 1, 3))} FROM s""")
def mixture_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of three components of the mixture, and the products of every two: the terms of a quadratic mixture model."""
    return models.mixture_terms(_wide(spark, sf_dir), MIXTURE[:3], lambda x: _r(x))


@_query(f"""
WITH {_CELLS}, w AS (SELECT batch, {', '.join(f"max(value) FILTER (WHERE variable = '{c}') AS {c}" for c in (*MIXTURE[:2], RESPONSE))} FROM cells GROUP BY batch),
k AS (SELECT {MIXTURE[0]} / ({MIXTURE[0]} + {MIXTURE[1]}) AS p, {MIXTURE[1]} / ({MIXTURE[0]} + {MIXTURE[1]}) AS q, {RESPONSE} AS y FROM w
  JOIN (WITH {_LABELS} SELECT batch FROM labels WHERE formulation IS NOT NULL) USING (batch)
  WHERE {MIXTURE[0]} IS NOT NULL AND {MIXTURE[1]} IS NOT NULL AND {RESPONSE} IS NOT NULL AND {MIXTURE[0]} + {MIXTURE[1]} > 0),
t AS (SELECT sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * y) AS py, sum(q * y) AS qy FROM k),
b AS (SELECT (py * qq - qy * pq) / (pp * qq - pq * pq) AS one, (qy * pp - py * pq) / (pp * qq - pq * pq) AS two FROM t)
SELECT '{MIXTURE[0]}' AS a, '{MIXTURE[1]}' AS b, round(one - two, 4) + 0.0 AS difference FROM b""")
def component_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replacing one component of a two-part mixture by the other does to the response."""
    coef = models.mixture_fit(models.model_rows(_wide(spark, sf_dir), _labels(spark, sf_dir), MIXTURE[:2], RESPONSE), MIXTURE[:2])
    return spark.createDataFrame([(a, b, round(d, 4) + 0.0) for a, b, d in models.contrasts(MIXTURE[:2], coef)], "a string, b string, difference double")


@_query()
def scheffe_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of the quadratic mixture model, and every contrast of two components."""
    rows = models.model_rows(_wide(spark, sf_dir), _labels(spark, sf_dir), MIXTURE, RESPONSE)
    terms, coef = models.mixture_fit_quadratic(rows, MIXTURE)
    return spark.createDataFrame([(c, float(b)) for c, b in zip(terms, coef, strict=True)], "term string, coef double")


@_query()
def effects_per_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one unit of every column changes in the elastic net's prediction, the largest effects per spread first."""
    rows, names, plan = _features(spark, sf_dir)
    _, coef, _ = models.tuned("elastic_net", models.fold_sums(rows, names).by_fold)
    return models.per_unit(_wide(spark, sf_dir), plan, dict(zip(names, map(float, coef), strict=True))).orderBy(F.desc(F.abs("per_sd")), "variable")


@_query(f"""
WITH {_POINTS}, seq AS (SELECT *, lag(t, 1, 0.0::DOUBLE) OVER w AS t0, lag(y, 1, 0.0::DOUBLE) OVER w AS y0 FROM pts WHERE medium = 'pH 6.8 phosphate' AND run_no = 1 WINDOW w AS (PARTITION BY batch ORDER BY t))
SELECT batch, round(CASE WHEN count(*) >= 2 AND sum(y - y0) > 0 THEN sum((t + t0) / 2 * (y - y0)) / sum(y - y0) END, 6) + 0.0 AS y FROM seq GROUP BY batch
HAVING CASE WHEN count(*) >= 2 AND sum(y - y0) > 0 THEN TRUE END""")
def response_from_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean dissolution time in one medium as the response to be explained."""
    return _rounded(response.from_profiles(_points(spark, sf_dir), "mdt", "pH 6.8 phosphate"), "y")


@_query(f"""
WITH {_POINTS}, ref AS (SELECT time_min, y AS r FROM pts WHERE batch = '{CONTROL}' AND run_no = 1 AND medium = '0.1N HCl')
SELECT batch, round(50 * log10(100 / sqrt(1 + avg((r - y) * (r - y)))), 6) + 0.0 AS y FROM pts JOIN ref USING (time_min) WHERE medium = '0.1N HCl' AND run_no = 1 GROUP BY batch HAVING count(*) >= 3""")
def response_from_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity (f2) to the control batch in one medium as the response."""
    return _rounded(response.from_profiles(_points(spark, sf_dir), "f2", "0.1N HCl", CONTROL), "y")


@_query(f"""
WITH {_CELLS}, p AS (SELECT min(batch) AS a FROM batch_wide), q AS (SELECT min(batch) AS b FROM batch_wide WHERE batch > (SELECT a FROM p))
SELECT variable, min(family) AS family, max(value) FILTER (WHERE batch = (SELECT a FROM p)) AS first, max(value) FILTER (WHERE batch = (SELECT b FROM q)) AS second
FROM cells LEFT JOIN variable_families USING (variable) GROUP BY variable""")
def compare_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two batches side by side, one row per variable."""
    a, b = _first_batches(spark, sf_dir, 2)
    out = explore.compare(_cells(spark, sf_dir), table(spark, sf_dir, "variable_families"), [a, b])
    return out.select("variable", "family", F.col(a).alias("first"), F.col(b).alias("second"))


# ---- streaming


@_query("""
SELECT date_trunc('day', loaded_at)::TIMESTAMP AS day, coalesce(instrument, '') AS instrument, count(*) AS n_rows,
  count(CASE WHEN NOT isnan(percent_released) THEN percent_released END) AS n_readings,
  count(CASE WHEN NOT isnan(percent_released) AND (percent_released < -1 OR percent_released > 130) THEN 1 END) AS n_outside
FROM dissolution GROUP BY 1, 2""")
def stream_daily_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = readings.run_to_table(readings.daily_counts(readings.reading_stream(spark, sf_dir)))
    return counts.withColumn("day", F.col("day").cast("timestamp_ntz"))


