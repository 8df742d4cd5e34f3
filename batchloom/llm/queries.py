"""Queries over the corpus and the split of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from batchloom.llm.encoding import find_garbled, margin_report
from batchloom.llm.leaks import find_leaks
from batchloom.llm.mixing import draw, plan, shares, with_tokens
from batchloom.llm.splits import split_batches, tied_batches
from batchloom.session import durable, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches, _ = tied_batches(table(spark, sf_dir, "batch_metadata"))
    return batches.where(F.col("group_formulation").isNotNull()).select("batch", "group_formulation")


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every batch."""
    return split_batches(table(spark, sf_dir, "batch_metadata"), table(spark, sf_dir, "split_targets"))


def p2_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning forest over the formulations that batches or their sub-lots tie, one row per edge."""
    return tied_batches(table(spark, sf_dir, "batch_metadata"))[1].edges


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group of tied batches: how many there are, and over how many splits they spread."""
    split = split_batches(table(spark, sf_dir, "batch_metadata"), table(spark, sf_dir, "split_targets")).where("group_formulation is not null")
    return split.groupBy("group_formulation").agg(F.count("*").alias("n_batches"), F.countDistinct("split_name").alias("n_splits"))


def p2_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of each split, the share asked for and the share reached."""
    targets = table(spark, sf_dir, "split_targets")
    got = split_batches(table(spark, sf_dir, "batch_metadata"), targets).groupBy("split_name").agg(F.count("*").alias("n_batches"))
    whole = F.sum("n_batches").over(Window.partitionBy())  # one row per split
    return targets.join(got, "split_name", "left").select("split_name", "share", F.coalesce("n_batches", F.lit(0)).alias("n_batches"), (F.col("n_batches") / whole).alias("share_reached"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each leaked item: the pages that hold it and the longest passage found, in words."""
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_pages"), F.max("n_words").alias("most_words"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dict]]:
    """The drawn pages and their plan. Only pages of sources with a target are put through the tokenizer."""
    targets = table(spark, sf_dir, "mix_targets")
    wanted = [r.source for r in targets.where("source is not null").select("source").distinct().collect()]
    pages = durable(with_tokens(table(spark, sf_dir, "documents").where(F.col("source").isin(wanted))))
    mix = plan(pages, targets)
    return draw(pages, mix), mix


def p7_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages drawn, with their tokens and copies."""
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target shares and the shares really reached."""
    drawn, mix = _mixed(spark, sf_dir)
    return shares(durable(drawn), mix)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(table(spark, sf_dir, "documents"), restore=False).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled pages with the likeliest chain and their text as it was before."""
    return find_garbled(table(spark, sf_dir, "documents"))


def p8_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the margin does on clean lines garbled on purpose, by chain."""
    return margin_report(table(spark, sf_dir, "documents"))


QUERIES = {"p2_found": p2_found, "p2_splits": p2_splits, "p2_forest": p2_forest, "p2_groups": p2_groups, "p2_shares": p2_shares, "p6_found": p6_found, "p6_items": p6_items, "p7_sample": p7_sample, "p7_shares": p7_shares, "p8_found": p8_found, "p8_restored": p8_restored, "p8_margin": p8_margin}
