"""Mixing sources to target weights.

Sizes are counted in tokens of a public tokenizer. Every page of a source gets
the same expected number of copies, the whole part of which it surely gets;
whether it gets one more is drawn by the cube method: fractional inclusion
probabilities are moved along the null space of the constraints, which are the
tokens and the number of pages of the source, until at most two of a source
are left undecided. That landing problem is settled by lot.

The moves are made in blocks of at most ``BLOCK`` pages in parallel, each
keeping its own totals, and then again among what the blocks left, so that no
source, however large, is gathered in one task, and totals stay exact up to
the landing.

Defined results for odd input: pages without source, or of a source without
target, are not drawn; NULL and empty texts have no tokens and are not drawn;
sources with a target but no pages cannot be drawn, the others share what is
theirs in proportion; a target that is not positive draws nothing; without any
drawable source the result is empty. Repeated rows are drawn as rows of their
own.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.session import durable

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which this public vocabulary's texts are cut into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 4096
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE encoder whose ranks ``path`` lists; loaded once per worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def with_tokens(documents: DataFrame, tokenizer: str = TOKENIZER, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, tokens) of ``documents`` (doc_id, source, text), each row as a whole."""
    path = os.path.join(folder, tokenizer)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path)
        for pdf in frames:
            tokens = [len(own.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": np.asarray(tokens, dtype=np.int64)})

    return documents.select("doc_id", "source", "text").mapInPandas(count, f"doc_id {dict(documents.dtypes)['doc_id']}, source string, tokens long")


def flight(size: np.ndarray, chance: np.ndarray, seed: int) -> np.ndarray:
    """Inclusion probabilities moved to 0 or 1 while their sum, and their sum weighted by ``size``, stay; at most two stay fractional."""
    p, x = chance.astype(float).tolist(), size.astype(float).tolist()
    lots = iter(np.random.default_rng(seed).random(2 * len(p) + 8).tolist())
    tiny = 1e-9
    waiting = [i for i in range(len(p)) if tiny < p[i] < 1 - tiny]
    waiting.reverse()
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) == 3:
            i, j, k = active
            u = (x[j] - x[k], x[k] - x[i], x[i] - x[j])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
        elif len(active) == 2 and x[active[0]] == x[active[1]]:
            u = (1.0, -1.0)
        else:
            return np.asarray(p)
        up = min(((1 - p[m]) / d if d > 0 else p[m] / -d) for m, d in zip(active, u, strict=False) if d)
        down = min((p[m] / d if d > 0 else (1 - p[m]) / -d) for m, d in zip(active, u, strict=False) if d)
        step = up if next(lots) * (up + down) < down else -down
        for m, d in zip(active, u, strict=False):
            p[m] = min(1.0, max(0.0, p[m] + step * d))
        active = [m for m in active if tiny < p[m] < 1 - tiny]
        if len(active) == 3:  # rounding kept all three inside; the nearest to an end is settled there
            m = min(active, key=lambda q: min(p[q], 1 - p[q]))
            p[m] = float(round(p[m]))
            active.remove(m)


def plan(pages: DataFrame, targets: DataFrame, total: int | None = None) -> list[dict]:
    """Per target source: pages, tokens, share among the sources with pages, and the expected copies of a page.

    ``total`` tokens are drawn, at most what the caps allow while the shares
    hold; by default that most. Targets are a small fixed table.
    """
    wanted = {r.source: r for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").collect()}
    stats = pages.where("tokens > 0").groupBy("source").agg(F.count("*").alias("pages"), F.sum("tokens").alias("tokens")).where(F.col("source").isin(list(wanted)) if wanted else F.lit(False))
    have = {r.source: r for r in stats.collect()}
    whole = sum(wanted[s].target_share for s in have)
    most = min((have[s].tokens * wanted[s].max_repeats / (wanted[s].target_share / whole) for s in have), default=0.0)
    draw = most if total is None else min(float(total), most)
    out = []
    for s in sorted(wanted):
        share = wanted[s].target_share / whole if s in have else 0.0
        tokens = have[s].tokens if s in have else 0
        copies = min(draw * share / tokens, float(wanted[s].max_repeats)) if tokens else 0.0
        out.append({"source": s, "target_share": float(wanted[s].target_share), "max_repeats": int(wanted[s].max_repeats), "pages": have[s].pages if s in have else 0, "tokens": tokens, "copies": copies})
    return out


def _mover(seed: int, level: int, last: bool):
    """The move of one block: a flight, and on the last level the landing of the at most two pages it leaves."""

    def move(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tokens"], kind="stable").reset_index(drop=True)
        lots = np.random.default_rng([seed, level, int(key[1]), len(pdf), int(pdf["tokens"].sum())])
        order = lots.permutation(len(pdf))
        p = np.empty(len(pdf))
        p[order] = flight(pdf["tokens"].to_numpy()[order], pdf["chance"].to_numpy()[order], int(lots.integers(2**31)))
        if last:
            loose = (p > 1e-9) & (p < 1 - 1e-9)
            p[loose] = lots.random(loose.sum()) < p[loose]
        pdf["chance"] = p
        return pdf[["doc_id", "source", "tokens", "whole", "chance"]]

    return move


def draw(pages: DataFrame, mix: list[dict], seed: int = 7) -> DataFrame:
    """(doc_id, source, tokens, copies) of all pages drawn at least once under the plan ``mix``."""
    spark = pages.sparkSession
    rates = spark.createDataFrame([(m["source"], m["copies"]) for m in mix], "source string, rate double")
    known = pages.where("tokens > 0").join(F.broadcast(rates), "source")
    known = known.withColumn("whole", F.floor(F.col("rate") + 1e-12).cast("int"))
    known = known.withColumn("chance", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    key = dict(pages.dtypes)["doc_id"]
    schema = f"doc_id {key}, source string, tokens long, whole int, chance double"
    settled = known.where("chance <= 1e-9").select("doc_id", "source", "tokens", "whole", "chance")
    left = durable(known.where("chance > 1e-9").select("doc_id", "source", "tokens", "whole", "chance"))
    done = [settled]
    level = 0
    while True:
        sizes = {r.source: r["count"] for r in left.groupBy("source").count().collect()}
        if not sizes:
            break
        last = max(sizes.values()) <= BLOCK
        blocks = spark.createDataFrame([(s, max(1, -(-2 * n // BLOCK)) if n > BLOCK else 1) for s, n in sizes.items()], "source string, blocks int")
        number = F.pmod(F.xxhash64("doc_id", "tokens", F.lit(seed + level)), F.col("blocks")).cast("int")
        placed = left.join(F.broadcast(blocks), "source").withColumn("block", number).drop("blocks")

        moved = durable(placed.groupBy("source", "block").applyInPandas(_mover(seed, level, last), schema))
        done.append(moved.where("chance <= 1e-9 or chance >= 1 - 1e-9"))
        if last:
            break
        left = moved.where("chance > 1e-9 and chance < 1 - 1e-9")
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    drawn = out.select("doc_id", "source", "tokens", (F.col("whole") + F.round("chance").cast("int")).alias("copies"))
    return drawn.where("copies > 0")


def shares(drawn: DataFrame, mix: list[dict]) -> DataFrame:
    """Per target source: what was asked for and what was really reached."""
    spark = drawn.sparkSession
    asked = spark.createDataFrame([(m["source"], m["target_share"], m["max_repeats"], m["pages"], m["tokens"]) for m in mix], "source string, target_share double, max_repeats int, pages long, tokens long")
    got = drawn.groupBy("source").agg(F.count("*").alias("pages_drawn"), F.sum("copies").alias("copies_drawn"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens_drawn"), F.max("copies").alias("most_repeats"))
    total = got.agg(F.sum("tokens_drawn").alias("all_tokens")).first()["all_tokens"]
    zero = {"pages_drawn": 0, "copies_drawn": 0, "tokens_drawn": 0, "most_repeats": 0}
    return asked.join(got, "source", "left").na.fill(zero).withColumn("share_reached", F.try_divide(F.col("tokens_drawn"), F.lit(total).cast("double")))
