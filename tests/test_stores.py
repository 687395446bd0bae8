"""What is written and read back: the index over a crash, captures, the ledger over runs, answers in parts, and the readers and writers of files."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lattiq.operators import assemble, replay
from lattiq.sources import plans, publish, readers, snapshots


def index_of(spark, name, players=None):
    named = lambda rows: spark.createDataFrame(rows, "id long, name string")
    return {"groups": named([(1, "g")]), "branches": named([(2, "b")]), "teams": named([(3, name)]), "players": named([(4, "p"), (4, "p")]) if players is None else players, "version": None}


def test_publication_survives_a_crash(spark, tmp_path):
    """A table that fails in the middle of a publication, and one that can't be read back as it was, leave readers with the old version."""
    path = str(tmp_path / "index")
    assert publish.read_index(spark, path) == {} and publish.last_pointer(spark, path) is None
    publish.publish(index_of(spark, "old"), path)
    broken = spark.range(1).select("id", F.raise_error(F.lit("lost")).cast("string").alias("name"))
    with pytest.raises(Exception, match="lost"):
        publish.publish(index_of(spark, "new", broken), path)
    unsteady = spark.range(3).select("id", F.udf(lambda: str(time.time_ns()))().alias("name"))
    with pytest.raises(publish.Unfaithful, match="players"):
        publish.publish(index_of(spark, "new", unsteady), path)
    assert [r.name for r in publish.read_index(spark, path)["teams"].collect()] == ["old"]
    publish.publish(index_of(spark, "new"), path)
    assert [r.name for r in publish.read_index(spark, path)["teams"].collect()] == ["new"]
    assert [r.name for r in publish.read_index(spark, path, 1)["teams"].collect()] == ["old"]
    first, second = publish.pointers(spark, path).orderBy("n").collect()
    assert (first.n, second.n) == (1, 2) and second.counts == {"groups": 1, "branches": 1, "teams": 1, "players": 2} and first.version != second.version


def test_captures(spark, tmp_path):
    """Unknown fields survive; the order of keys is no change; null values, nested ones and broken documents."""
    schema = "grain string, kind string, json string"
    was = [("match", "offer", '{"id":1,"b":{"z":1,"a":2},"x":[1,2],"secret":"kept"}'), ("match", "offer", '{"id":2}'), ("match", "offer", "nope"), ("match", "event", '{"id":"x"}'), ("match", "event", '{"id":2}'), ("match", "offer", None), ("match", "offer", "[1]")]
    now = [("match", "offer", '{"x":[1,2],"b":{"a":2,"z":1},"id":1,"secret":null,"new":null}'), ("match", "offer", '{"id":3}'), ("match", "event", '{"id":2}')]
    captured, faults = snapshots.capture(spark.createDataFrame(was, schema))
    assert {r.json for r in faults.collect()} == {"nope", '{"id":"x"}', None, "[1]"}
    path = str(tmp_path / "capture")
    assert snapshots.read(spark, path).count() == 0
    snapshots.write(captured, path)
    held = snapshots.read(spark, path)
    typed = {r.id: (r.x, r.b, r.missing) for r in snapshots.typed(held, "match", "offer", "id bigint, x array<int>, b struct<a:int>, missing string").collect()}
    assert typed[1][0] == [1, 2] and typed[1][1].a == 2 and typed[1][2] is None and typed[2] == (None, None, None)
    found = {(r.kind, r.id, r.field, r.verdict, r.was, r.now) for r in snapshots.drift(held, snapshots.capture(spark.createDataFrame(now, schema))[0]).collect()}
    assert found == {("offer", 2, None, "VANISHED", None, None), ("offer", 3, None, "APPEARED", None, None), ("offer", 1, "new", "ADDED", None, "null"), ("offer", 1, "secret", "CHANGED", '"kept"', "null")}


def test_ledger_over_runs(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = lambda *x: spark.createDataFrame(list(x), "key string, kind string, input string, output string")
    assert replay.ledger(spark, path).count() == 0
    replay.record(spark, path, rows(("a", "k", "i", None), ("a", "k", "i", None), ("b", "k", "i", "yes")), 1)
    for _ in range(2):  # a run that comes again
        replay.record(spark, path, rows(("a", "k", "i", "late"), ("b", "k", "i", "no"), ("c", "k", "i", None)), 2)
    replay.record(spark, path, rows(("a", "k", "i", "other"), ("c", "k", "i", None)), 3)
    assert {(r.key, r.output, r.batch) for r in replay.ledger(spark, path).collect()} == {("a", "late", 2), ("b", "yes", 1), ("c", None, 2)}
    assert spark.read.parquet(path).count() == 4


def test_answer_parts(spark):
    """One event holds nearly all of an answer; parts hold all rows in order, and none is longer than the bound and one row."""
    hot = spark.range(60_000).select(F.lit("q").alias("query_id"), F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(7).alias("event_id"), F.col("id").alias("outcome_id"), F.repeat(F.lit("é"), (F.col("id") % 30).cast("int")).alias("text"))
    parts = assemble.answer_parts(hot, assemble.row_bytes(F.col("text")), 100_000).orderBy("part").collect()
    assert [p.part for p in parts] == list(range(len(parts))) and len(parts) > 30
    sizes = [sum(40 + len(r.text.encode()) for r in p.rows) for p in parts]
    assert max(sizes) <= 100_100 and sum(sizes) == sum(40 + 2 * (k % 30) for k in range(60_000))
    every = [(r.event_id, r.outcome_id) for p in parts for r in p.rows]
    assert every == sorted(every) and len(every) == 60_000


def test_files(spark, tmp_path):
    """Coupons by group, the index as one document, answers with parts, and the schema for writers of plans."""
    for group, rows in ((5, [{"id": 1, "prePackCouponTags": ["CUSTOM"], "prePackCouponRows": [{"id": 9, "eventId": 77, "outcome": {"id": 3, "betOfferId": 2}}], "prePackCouponBets": [{"odds": {"decimal": 2500}}]}]), (6, [{"id": 2}])):
        folder = tmp_path / "coupons" / f"group_id={group}"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text("\n".join(map(json.dumps, rows)))
    found = readers.read_coupons(spark, str(tmp_path / "coupons"), [5]).collect()
    assert [(r.coupon_id, r.group_id, r.event_ids, r.custom) for r in found] == [(1, 5, [77], True)]
    index = {"version": "v", "groups": [{"id": 1, "name": "g", "branch": 1}], "branches": [{"id": 1, "name": "g"}], "teams": [{"id": 2, "name": "t", "competitionIds": [1]}], "players": [{"id": 3, "name": "p", "competitionIds": [1], "countryTeamId": 2}]}
    (tmp_path / "index.json").write_text(json.dumps(index))
    tables = readers.scope_index(spark, str(tmp_path / "index.json"))
    assert {k: v.count() for k, v in tables.items()} == {"groups": 1, "branches": 1, "teams": 1, "players": 1, "rosters": 2}
    assert {k: v.count() for k, v in readers.scope_index(spark, str(tmp_path / "none.json")).items()} == {"groups": 0, "branches": 0, "teams": 0, "players": 0, "rosters": 0}
    rows = spark.createDataFrame([("q", 1, 2, "x")], "query_id string, event_id long, outcome_id long, text string")
    answers = spark.createDataFrame([("q", "b1", ["n"])], "query_id string, batch string, notes array<string>")
    readers.write_envelopes(answers, str(tmp_path / "out"), assemble.answer_parts(rows, F.lit(10)))
    assert spark.read.json(str(tmp_path / "out" / "answers")).first().notes == ["n"]
    assert spark.read.json(str(tmp_path / "out" / "parts")).first().rows[0].text == "x"
    schema = plans.plan_schema()
    assert schema["properties"]["sport"] == {"type": "string"} and schema["properties"]["selectors"]["items"]["properties"]["market_concept"] == {"type": "string"}
