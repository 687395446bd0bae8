"""Texts against names by shared weight: the prefix filter and the salts against all pairs."""

import math
import random

import pytest

from lattiq.operators import matching


def plain(texts, names, least):
    df = {}
    for _, own in names:
        for t in set(own.split()):
            df[t] = df.get(t, 0) + 1
    w = lambda t: math.log((len(names) + 1) / (df.get(t, 0) + 0.5))
    found = {}
    for text in texts:
        wanted = set(text.split())
        for k, own in names:
            shared = wanted & set(own.split())
            cover = sum(map(w, shared)) / sum(map(w, wanted))
            if shared and cover >= least:
                found[text, k] = round(cover, 6)
    return found


@pytest.mark.parametrize("least", [0.0, 0.45])
def test_covers(spark, monkeypatch, least):
    """Nearly all names hold one token, a third another; the hot ones are split into salts."""
    monkeypatch.setattr(matching, "HOT", 300)
    r = random.Random(4)
    names = [(k, "club " * (k % 20 > 0) + "unite " * (k % 3 == 0) + f"town{r.randint(0, 400)} x{r.randint(0, 40)}") for k in range(4000)]
    texts = ["club", "club unite", "club town7", "town9 unite x3", "nowhere", "x1 nowhere", "club town5 town6 x7", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "wording string")
    found = matching.covers(frame, ["wording"], spark.createDataFrame(names, "id long, name string"), least=least)
    assert {(r.wording, r.id): round(r.cover, 6) for r in found.collect()} == plain([t for t in texts if t], names, least)


def test_holding_all(spark, monkeypatch):
    monkeypatch.setattr(matching, "HOT", 300)
    names = [(k, f"club town{k % 50} x{k % 7}") for k in range(2000)]
    texts = ["club town7", "x3 club", "club", "club town7 nowhere", ""]
    found = matching.holding_all(spark.createDataFrame([(t,) for t in texts], "w string"), ["w"], spark.createDataFrame(names, "id long, name string"), "w")
    assert {(r.w, r.id) for r in found.collect()} == {(t, k) for t in texts if t for k, n in names if set(t.split()) <= set(n.split())}


def test_hot_token_is_not_one_key(spark, monkeypatch):
    """A text of a rare and a hot token meets names on the rare one alone."""
    names = spark.range(200_000).selectExpr("id", "concat('club town', id) AS name")
    held, weights, hot = matching.postings(names)
    assert {r["__hot"]: r.salts for r in hot.collect()} == {"club": 20}
    one = spark.createDataFrame([("club town77",)], "wording string")
    found = matching.covers(one, ["wording"], names, least=0.45)
    assert [(r.id, r.cover > 0.9) for r in found.collect()] == [(77, True)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan
    met = matching.meet(one.selectExpr("wording", "explode(array('town77')) AS token"), held, hot, ["wording"])
    assert met.count() == 1
