"""The dictionary of variables: families, roles and predicates on names; and the linter of causal language.

The dictionary is a table (variable, family, unit, low, high) with one row per
listing; a variable may be listed in several families, the first listing
counting. Names are NULL-safe: a NULL name or family is left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_FAMILY = "PROCESS"
SETTABLE = ("FORMULATION", "PROCESS", "MATERIAL")
# The metrics of a release profile, with what each is measured in.
PROFILE_METRICS = (
    ("mdt", "h"), ("dissolution_efficiency", "%"), ("t50", "h"), ("t80", "h"), ("first_order_k", "1/h"), ("weibull_td", "h"), ("weibull_beta", ""), ("f1", ""), ("f2", ""),
)
# Patterns of causal language, and the contexts in which they are allowed.
CAUSAL = (
    r"\bcaus(e|es|ed|ing)\b",
    r"\bdue to\b",
    r"\bbecause of\b",
    r"\bdriven by\b",
    r"\bdriver of\b",
    r"\bresponsible for\b",
    r"\bleads? to\b",
    r"\bresults? in\b",
    r"\bimpact(s|ed)? the\b",
    r"\beffect of .* on\b",
)
ALLOWED = ("cannot establish caus", "not causation", "would establish caus", "to establish which", "establish causation")


def dictionary(families: DataFrame, chosen: Sequence[str] | None = None) -> DataFrame:
    """The listings of ``chosen`` families, or of all."""
    known = families.where("variable is not null and family is not null")
    return known if chosen is None else known.where(F.col("family").isin(list(chosen)))


def profile_metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROFILE_METRICS), "metric string, unit string")


def families_for(names: DataFrame, families: DataFrame) -> DataFrame:
    """(variable, family) of ``names`` (variable): the first listing, in the order of the families' names; ``PROCESS`` for what is not listed."""
    first = dictionary(families).groupBy("variable").agg(F.min("family").alias("_f"))
    return names.where("variable is not null").join(F.broadcast(first), "variable", "left").select("variable", F.coalesce("_f", F.lit(DEFAULT_FAMILY)).alias("family"))  # one row per column


def dual_role(families: DataFrame) -> DataFrame:
    """(variable, n_families) of the variables listed in more than one family."""
    return dictionary(families).groupBy("variable").agg(F.countDistinct("family").alias("n_families")).where("n_families > 1")


def per_family(families: DataFrame) -> DataFrame:
    return dictionary(families).groupBy("family").agg(F.count("*").alias("n_variables"))


def looks_like_percent(name: Column) -> Column:
    return F.lower(name).rlike(r"pct|%|percent|_ww$")


def settable(family: Column) -> Column:
    """Whether variables of a family can be set; without a family they are taken to be."""
    return F.coalesce(family.isin(*SETTABLE), F.lit(True))


def causal_language(texts: DataFrame, key: str, patterns: Sequence[str] = CAUSAL) -> DataFrame:
    """(key, pattern, fragment) of every causal phrase in ``texts`` (key, text) that no allowed context surrounds.

    Texts without any of the patterns are sorted out before Python sees them.
    """
    low = F.lower("text")
    some = texts.where(low.rlike("|".join(f"({p})" for p in patterns))).select(key, low.alias("text"))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        compiled = [re.compile(p) for p in patterns]
        for pdf in frames:
            rows = []
            for k, text in zip(pdf[key], pdf["text"], strict=True):
                for p in compiled:
                    for m in p.finditer(text):
                        if not any(a in text[max(0, m.start() - 60) : m.end() + 40] for a in ALLOWED):
                            rows.append((k, p.pattern, text[max(0, m.start() - 30) : m.end() + 30].strip()))
            yield pd.DataFrame(rows, columns=[key, "pattern", "fragment"])

    return some.mapInPandas(find, f"{key} {dict(texts.dtypes)[key]}, pattern string, fragment string")


def register_functions(spark: SparkSession) -> None:
    """Make ``f2``, ``mdt``, ``t_to_pct`` and ``causal_hits`` callable from SQL; all are expressions over arrays or text, no Python.

    ``f2(reference, test)`` and ``mdt(times, values)`` take arrays of equal
    length in order of time; ``t_to_pct(times, values, pct)`` is the time at
    which the curve, through the origin, first reaches ``pct``.
    """
    make = lambda name, args, kind, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    make("f2", "r ARRAY<DOUBLE>, t ARRAY<DOUBLE>", "DOUBLE", "CASE WHEN size(r) >= 3 AND size(r) = size(t) THEN 50 * log10(100 / sqrt(1 + aggregate(zip_with(r, t, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x) / size(r))) END")
    steps = "transform(sequence(1, size(y)), i -> named_struct('t', t[i - 1], 'y', y[i - 1], 't0', CASE WHEN i > 1 THEN get(t, i - 2) ELSE 0D END, 'y0', CASE WHEN i > 1 THEN get(y, i - 2) ELSE 0D END))"
    make("mdt", "t ARRAY<DOUBLE>, y ARRAY<DOUBLE>", "DOUBLE", f"CASE WHEN size(y) >= 2 AND size(t) = size(y) AND y[size(y) - 1] > 0 THEN aggregate({steps}, 0D, (s, x) -> s + (x.t + x.t0) / 2 * (x.y - x.y0)) / y[size(y) - 1] END")
    make("t_to_pct", "t ARRAY<DOUBLE>, y ARRAY<DOUBLE>, pct DOUBLE", "DOUBLE", f"CASE WHEN size(y) >= 2 AND size(t) = size(y) THEN get(transform(filter({steps}, x -> x.y >= pct), x -> CASE WHEN x.y = x.y0 THEN x.t ELSE x.t0 + (pct - x.y0) / (x.y - x.y0) * (x.t - x.t0) END), 0) END")
    hits = " + ".join(f"regexp_count(lower(s), r'{p}')" for p in CAUSAL)
    make("causal_hits", "s STRING", "INT", hits)
