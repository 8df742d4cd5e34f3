from __future__ import annotations

import numpy as np
import pytest
from oracle import SMALL

from batchloom.llm import mixing as M
from batchloom.session import durable, table


def test_flight_keeps_totals_and_chances():
    rng = np.random.default_rng(1)
    x, p = rng.integers(1, 900, 300), rng.uniform(0.05, 0.95, 300)
    mean = np.zeros(300)
    for seed in range(300):
        q = M.flight(x, p, seed)
        loose = (q > 1e-9) & (q < 1 - 1e-9)
        assert loose.sum() <= 2
        assert q.sum() == pytest.approx(p.sum()) and (q * x).sum() == pytest.approx((p * x).sum())
        mean += q / 300
    assert np.abs(mean - p).max() < 0.12 and np.abs(mean - p).mean() < 0.03


@pytest.mark.parametrize("x", [[5, 5, 5, 5], [1], [], [3, 4]])
def test_small_flights(x):
    q = M.flight(np.array(x), np.full(len(x), 0.5), 3)
    assert len(q) == len(x) and (not x or (q * x).sum() == pytest.approx(sum(x) / 2))


def made(spark, sizes):
    rows = [(i, s, t) for i, (s, t) in enumerate(sizes)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


TARGETS = "source string, target_share double, max_repeats int"


def test_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 64)
    rng = np.random.default_rng(2)
    pages = made(spark, [("a", int(t)) for t in rng.integers(50, 900, 1500)] + [("b", int(t)) for t in rng.integers(50, 900, 200)] + [("c", 70)] * 9 + [(None, 5), ("z", 5), ("a", 0)])
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.0, 3), ("gone", 0.2, 3)], TARGETS)
    mix = M.plan(pages, targets)
    drawn = durable(M.draw(pages, mix))
    got = {r.source: r for r in M.shares(drawn, mix).collect()}
    assert set(got) == {"a", "b", "gone"} and got["gone"].tokens_drawn == 0
    assert got["a"].share_reached == pytest.approx(0.625, abs=0.004) and got["b"].share_reached == pytest.approx(0.375, abs=0.004)
    assert got["a"].most_repeats <= 2 and got["b"].most_repeats <= 4
    assert drawn.groupBy("doc_id").count().where("count > 1").count() == 0


def test_wanted_total(spark):
    pages = made(spark, [("a", 100)] * 50 + [("b", 10)] * 400)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    mix = M.plan(pages, targets, total=2000)
    got = {r.source: r.tokens_drawn for r in M.shares(M.draw(pages, mix), mix).collect()}
    assert abs(got["a"] - 1000) <= 200 and abs(got["b"] - 1000) <= 20


def test_nothing_to_draw(spark):
    empty = made(spark, [("q", 1)]).where("false")
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    mix = M.plan(empty, targets)
    assert M.draw(empty, mix).count() == 0 and M.shares(M.draw(empty, mix), mix).first().tokens_drawn == 0
    assert M.plan(empty, targets.where("false")) == []


def test_tokens_of_whole_texts(spark):
    docs = spark.createDataFrame([(1, "s", "The quay was sold. " * 3), (2, "s", ""), (3, None, None), (4, "s", "z" * 100_000)], "doc_id long, source string, text string")
    got = {r.doc_id: r.tokens for r in M.with_tokens(docs).collect()}
    own = M.encoder(f"{M.TOKENIZER_DIR}/{M.TOKENIZER}")
    assert got[1] == len(own.encode_ordinary("The quay was sold. " * 3)) and got[2] == got[3] == 0 and got[4] > 1000
    assert own.decode(own.encode_ordinary("Größe – 12 ½, новый мост")) == "Größe – 12 ½, новый мост"


def test_real_sources(spark):
    pages = durable(M.with_tokens(table(spark, SMALL, "documents")))
    mix = M.plan(pages, table(spark, SMALL, "mix_targets"))
    assert all(m["copies"] <= m["max_repeats"] for m in mix)
