"""SQL that checks the queries of this package."""

P2_FOUND = r"""
WITH RECURSIVE named AS (
  SELECT DISTINCT batch, substr(batch, 1, 9) AS stem,
    TRY_CAST(nullif(regexp_extract(formulation, '(?i)^[^0-9a-z]*f(?:orm(?:ulation)?)?[^0-9a-z]*([0-9]+)', 1), '') AS BIGINT) AS f
  FROM batch_metadata WHERE batch IS NOT NULL),
pairs AS (SELECT DISTINCT stem, f FROM named WHERE f IS NOT NULL),
adj AS (SELECT DISTINCT a.f AS u, b.f AS v FROM pairs a JOIN pairs b ON a.stem = b.stem),
reach(u, v) AS (SELECT u, v FROM adj UNION SELECT r.u, a.v FROM reach r JOIN adj a ON r.v = a.u),
low AS (SELECT u, min(v) AS g FROM reach GROUP BY u),
stems AS (SELECT stem, min(g) AS g FROM pairs JOIN low ON low.u = pairs.f GROUP BY stem)
SELECT DISTINCT named.batch, stems.g AS group_formulation FROM named JOIN stems ON stems.stem = named.stem
"""

P2_GROUPS = f"SELECT group_formulation, count(*) AS n_batches, 1::BIGINT AS n_splits FROM ({P2_FOUND}) GROUP BY group_formulation"

# A forest has one edge less than nodes in each group; which edges span it is free, so only their number per group is fixed.
SQL = {"p2_found": P2_FOUND, "p2_groups": P2_GROUPS}
