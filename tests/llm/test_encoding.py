from __future__ import annotations

import pytest
from oracle import SMALL

from batchloom.llm import encoding as E
from batchloom.session import table


@pytest.fixture(scope="module")
def model(spark):
    return E.train(table(spark, "/root/testdata/sf0.01", "documents"))


@pytest.mark.parametrize("chain", E.chains())
def test_exact_round_trip(chain):
    text = "Größe, müßig: «été» – “naïve” £5 ½ mañana" if not any(c in chain for c in ("1251", "koi8", "866", "8859", "cyrillic")) else "новый мост открыт"
    bad = E.garble(text, chain)
    if E.undo(bad, chain) != text:  # single-byte codecs lack some characters of the sample
        assert not chain.startswith("utf_8")
        text = "".join(c for c in text if E.undo(E.garble(c, chain), chain) == c)
        bad = E.garble(text, chain)
    assert E.undo(bad, chain) == text


def test_margin_on_held_out_lines(spark):
    got = {r.chain: r for r in E.margin_report(table(spark, "/root/testdata/sf0.01", "documents")).collect()}
    assert got["none"].n > 500 and got["none"].found == 0
    rest = [r for c, r in got.items() if c != "none"]
    assert sum(r.found for r in rest) > 0.97 * sum(r.n for r in rest) and sum(r.restored for r in rest) > 0.95 * sum(r.n for r in rest)


def test_found_and_restored(spark, model):
    clean = "Die nötige Bürgermeisterschule in Mühlenau wird für 12 Gulden veräußert, während die Käse längst über die Straße müßig sind."
    ru = "новый мост и тяжёлый лес за рекой был закрыт, сказал господин, ещё один большой завод"
    rows = [(1, clean), (2, E.garble(clean, "utf_8>cp1252")), (3, E.garble(ru, "koi8_r>cp1251")), (4, None), (5, ""), (6, "CRÈME DE SÃO\n£590 ½"), (7, "K" * 300_000), (8, clean.encode("cp1252").decode("utf-8", "replace")), (9, E.garble(clean, "utf_8>cp1252"))]
    texts = spark.createDataFrame([(*r, 0, "x", 1.0) for r in rows], "doc_id long, text string, fold int, chain string, gain double")
    got = {r.doc_id: r for r in E.judged(texts, [model], E.MARGIN).collect()}
    assert set(got) == {2, 3, 8, 9}
    assert got[2].restored == got[9].restored == clean and got[3].restored == ru
    assert got[8].restored.count("�") < 3


def test_long_and_lost_words(spark, model):
    by = E.Judge(model)
    word = "Bürgermeister"
    lost = word.replace("ü", E.LOST)
    assert by.refill(lost) == word and by.word(lost)[0] == "lost" and by.word(lost)[1] > E.MARGIN
    assert by.refill(E.LOST * 9) == E.LOST * 9 and len(by.filled("a" + E.LOST * 3000)) == 3001
    assert by.refill("M" + E.LOST * 8 + "s").count(E.LOST) == 0  # however many are lost


@pytest.mark.parametrize("share", [20, 4])
def test_garbled_records_do_not_teach_the_model_that_judges_them(spark, share):
    """One in ``share`` Russian pages is garbled by one chain, before training: all are found, and none besides."""
    pages = table(spark, "/root/testdata/sf0.01", "documents").where("text <> ''")
    known = {r.doc_id for r in E.find_garbled(pages, restore=False).collect()}
    clean = [r for r in pages.where("lang = 'ru'").select("doc_id", "text").collect() if r.doc_id not in known]
    bad = {r.doc_id: E.garble(r.text, "koi8_r>cp1251") for r in clean[::share]}
    fresh = spark.createDataFrame([(i, t) for i, t in bad.items()], "doc_id long, bad string")
    mixed = pages.join(fresh, "doc_id", "left").selectExpr("doc_id", "coalesce(bad, text) as text")
    found = {r.doc_id for r in E.find_garbled(mixed, restore=False).collect()}
    assert set(bad) <= found and len(found - known - set(bad)) <= 1


def test_margin_grows_with_a_long_tail(spark):
    few = spark.createDataFrame([(3.5,), (50.0,)], "gain double")
    tail = spark.createDataFrame([(float(x),) for x in list(3 + 9 * (i / 3000) for i in range(3000))], "gain double")
    assert E.chosen_margin(few) == E.MARGIN and E.chosen_margin(tail) > 2 * E.MARGIN


def test_no_documents(spark):
    empty = table(spark, SMALL, "documents").limit(0)
    assert E.find_garbled(empty).count() == 0


def test_judges_share_the_readings_of_a_word(model, monkeypatch):
    calls, undo = [], E.undo
    monkeypatch.setattr(E, "undo", lambda *a: calls.append(a) or undo(*a))
    words = ["GrÃ¶ÃŸe", "mÃ¼ÃŸig", "новый", "été", "na�ve", "Ã©tÃ©"]
    E._READ.clear()
    first = [E.Judge(model).word(w) for w in words]
    n = len(calls)
    assert n and [E.Judge(model).word(w) for w in words] == first and len(calls) == n
    for w in words:
        want: dict[str, str] = {}
        for chain in E.chains():
            new = undo(w, chain)
            if new != w and new not in want and E._plausible(new, w):
                want[new] = chain
        assert E.read_back(w) == want and "lost" not in E.read_back(w).values()
