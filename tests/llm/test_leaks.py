from __future__ import annotations

import random

import numpy as np
import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from batchloom.llm import leaks as L
from batchloom.session import table

WORDS = "harbour lantern orchard bishop granary tollgate kennel turnpike meadow vessel mortgage tannery jury widow census wharf parish barley furnace election signal market steady costly damaged severe unpaid spacious crowded northern modest foreign praised shipped leased rebuilt examined removed numbered opened".split()


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def page(rng, quote, before=80, after=60, noise=0.0):
    text = " ".join([*words(rng, before), *quote, *words(rng, after)])
    swaps = {"e": "c", "h": "b", "n": "u", "o": "0", "l": "1", "m": "rn", "t": "f"}
    text = "".join(swaps[c] if c in swaps and rng.random() < noise else c for c in text)
    lines, line = [], ""
    for w in text.split(" "):
        if len(line) + len(w) > 30:
            cut = len(w) // 2 if len(w) > 6 and rng.random() < 0.5 else 0
            lines.append((line + " " + w[:cut] + "-").strip() if cut else line)
            line = w[cut:]
        else:
            line = (line + " " + w).strip()
    return "\n".join([*lines, line])


def found(pages, items, extended=L.extended):
    index = L.Items(list(range(len(items))), items)
    marks = np.zeros(1 << L.BITS, dtype=bool)
    marks[L.slots(index.values, len(marks))] = True
    got = L.page_prints(pages, marks)
    return {(p, q): n for p, q, n in extended(index, *([x[k] for x in got] for k in range(3)))}


def test_whole_part_short_and_shuffled():
    rng = random.Random(1)
    items = [words(rng, 90) for _ in range(6)]
    shuffled = items[3][:]
    rng.shuffle(shuffled)
    pages = [page(rng, items[0]), page(rng, items[1][20:45]), page(rng, items[2][10:22]), page(rng, shuffled), page(rng, [])]
    got = found(pages, [" ".join(i) for i in items])
    assert set(got) == {(0, 0), (1, 1)} and got[0, 0] >= 89 and 24 <= got[1, 1] <= 28


def test_noise_advert_and_case():
    rng = random.Random(2)
    items = [words(rng, 60) for _ in range(20)]
    pages = [page(rng, i[10:40], noise=0.03) for i in items]
    split = page(rng, items[5][:14]).split("\n") + ["----------", "TO BE LET, a fine cellar near", "Upper Street, rent £14", "Apply within", "----------"]
    pages.append("\n".join(split[:-6]) + "\n" + " ".join(items[5][:12]) + "\nTO BE LET, a fine cellar near\nUpper Street, rent £14\n" + " ".join(items[5][12:30]).upper())
    got = found(pages, [" ".join(i) for i in items])
    assert {(k, k) for k in range(20)} <= set(got) and (20, 5) in got and got[20, 5] >= 28


SHORT = "va de la mer un roi bon sel nuit por que los mas fin hoy col ame sur pan eau lit".split()


def test_short_words_across_an_advert_and_misread():
    rng = random.Random(5)
    item = [*words(rng, 30), *SHORT, *words(rng, 30)]
    quote = item[30:51]
    assert len("".join(quote)) < 70
    advert = ["TO", "BE", "LET", "a", "fine", "cellar", "near", "Upper", "Street"]
    misread = " ".join(quote).replace("roi", "xoi").replace("hoy", "hqy").split(" ")
    pages = [page(rng, [*quote[:10], *advert, *quote[10:]]), page(rng, misread), page(rng, quote[:16])]
    got = found(pages, [" ".join(item)])
    assert set(got) == {(0, 0), (1, 0)} and got[0, 0] >= 20


def test_what_is_not_extended_gets_nowhere(monkeypatch):
    rng = random.Random(6)
    items = [" ".join(words(rng, 60)) for _ in range(30)]
    phrases = [" ".join(i.split()[k : k + 3]) for i in items for k in range(0, 57, 5)]
    pages = [page(rng, rng.sample(phrases, 12), noise=0.02) for _ in range(10)] + [page(rng, items[k].split()[5:30], noise=0.05) for k in range(5)]
    some = found(pages, items)
    monkeypatch.setattr(L, "words_in_reach", lambda items, classes, owner, start, page, *rest: np.full(len(page), 10**6))
    assert found(pages, items) == some and some


def test_only_what_may_go_on_is_looked_for_beyond_insertions(monkeypatch):
    rng = random.Random(8)
    items = [" ".join(words(rng, 60)) for _ in range(30)]
    phrases = [" ".join(i.split()[k : k + 3]) for i in items for k in range(0, 57, 5)]
    pages = [page(rng, [w for x in rng.sample(phrases, 12) for w in (x, f"{rng.getrandbits(64):x}")], before=0, after=0) for _ in range(10)] + [page(rng, items[0].split()[5:30])]
    runs, looked, exact, resumed = [], [], L.exact_runs, L.Side._resumed
    monkeypatch.setattr(L, "exact_runs", lambda *a: runs.append(exact(*a)) or runs[-1])
    monkeypatch.setattr(L.Side, "_resumed", lambda side, page, *rest: looked.append(len(page)) or resumed(side, page, *rest))
    assert (10, 0) in found(pages, items)
    assert sum(len(x[0]) for x in runs) > 100 and sum(looked) < sum(len(x[0]) for x in runs) / 2


@pytest.mark.parametrize("most", [1, 7])
def test_portions_of_an_extension_change_nothing(monkeypatch, most):
    rng = random.Random(7)
    items = ["ab" * 300, " ".join(["la"] * 80), *(" ".join(words(rng, 60)) for _ in range(6))]
    pages = ["ab " * 400, " ".join(["la"] * 200), *(page(rng, [*items[k].split()[:12], *words(rng, 5), *items[k].split()[12:40]], noise=0.03) for k in range(2, 8))]
    whole = found(pages, items)
    monkeypatch.setattr(L.Side, "MOST", most)
    monkeypatch.setattr(L.Side, "LOT", most)
    assert found(pages, items) == whole and len(whole) >= 7


def test_winnowing_keeps_what_it_promises():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, 400).astype(np.uint64)
    inside = rng.random(400) > 0.05
    kept = set(L.winnowed(values, inside).tolist())
    for i in range(400 - L.WINDOW + 1):
        window = [j for j in range(i, i + L.WINDOW) if inside[j]]
        if window:
            low = min(values[j] for j in window)
            assert any(values[j] == low and j in kept for j in window)


def test_columns_read_across_and_run_together():
    left = ["alpha beta gamma delta", "epsilon zeta eta theta", "iota kappa lambda mu"]
    right = ["one two three four five", "six seven eight nine", "ten eleven twelve more"]
    text, x0, y0, x1 = [], [], [], []
    for k, (a, b) in enumerate(zip(left, right, strict=True)):
        if k == 1:
            text.append(a + " " + b)
            x0.append(80)
            x1.append(900 + 30 * len(b))
            y0.append(k * 40)
        else:
            for t, x in ((a, 80), (b, 900)):
                text.append(t)
                x0.append(x)
                x1.append(x + 30 * len(t))
                y0.append(k * 40)
    got = L.read_columns("\n".join(text), np.array(x0), np.array(y0), np.array(x1))
    assert got.split("\n") == left + right
    assert L.read_columns("a\nb", np.array([1]), np.array([1]), np.array([2])) == "a\nb"


def brute(pages, items):
    """Longest common run of letters of every pair, by a plain table."""
    out = set()
    for d, p in enumerate(pages):
        for i, t in enumerate(items):
            a, b = L.letters([t])[0], L.letters([p])[0]
            row = np.zeros(len(b) + 1, dtype=int)
            best = 0
            for x in a:
                row[1:] = np.where(b == x, row[:-1] + 1, 0)
                best = max(best, int(row.max()))
            if best >= 130:
                out.add((d, i))
    return out


def test_against_brute_force():
    rng = random.Random(9)
    items = [" ".join(words(rng, 50)) for _ in range(8)]
    pages = [page(rng, items[rng.randrange(8)].split()[rng.randrange(10) :][: rng.choice([8, 30])]) for _ in range(25)]
    assert brute(pages, items) <= set(found(pages, items))


def test_odd_tables(spark):
    docs, items = table(spark, SMALL, "documents"), table(spark, SMALL, "eval_items")
    assert L.find_leaks(docs.limit(0), items).count() == 0 and L.find_leaks(docs, items.limit(0)).count() == 0
    text = " ".join(words(random.Random(4), 40))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, text), (3, text), (4, "x " * 200_000)], "doc_id long, text string")
    some = spark.createDataFrame([(7, text, 1), (8, None, 1), (9, "", 1), (10, text, 1)], "item_id long, text string, n_words int")
    assert sorted(tuple(r)[:2] for r in L.find_leaks(odd, some).collect()) == [(3, 7), (3, 7), (3, 10), (3, 10)]


def test_lots_and_bits_change_nothing(spark):
    docs, items = table(spark, "/root/testdata/sf0.01", "documents").limit(300), table(spark, SMALL, "eval_items")
    whole = {tuple(r) for r in L.find_leaks(docs, items).collect()}
    assert {tuple(r) for r in L.find_leaks(docs, items, lot_letters=20_000, block=60_000, power=10).collect()} == whole and whole


def test_many_items(spark):
    """The corpus is read once; a hundred thousand items that no page holds cost it nothing and hide none that some page does."""
    docs, items = table(spark, SMALL, "documents"), table(spark, SMALL, "eval_items")
    own = {tuple(r) for r in L.find_leaks(docs, items).collect()}
    text = F.concat_ws(" ", *[F.sha1(F.concat(F.col("id"), F.lit(f"w{k}"))) for k in range(3)])
    many = spark.range(100_000).select((F.col("id") + 10**6).alias("item_id"), text.alias("text"))
    both = items.select("item_id", "text").unionByName(many)
    assert {tuple(r) for r in L.find_leaks(docs, both).collect()} == own and own


@pytest.mark.parametrize("text", ["", "—«»", "a"])
def test_items_without_words(text):
    assert found([text, "some page"], [text]) == {}
