"""Newest versions from a disordered stream, over a crash and a restart."""

import json

import pytest

from lattiq.streaming import versions


@pytest.fixture
def states(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", versions.PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def row(event, version, payload, at="2026-06-01T12:00:00", state="STARTED"):
    return {"event_id": event, "version": version, "state": state, "payload": payload, "at": at + "Z"}


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_newest_versions_over_a_restart(spark, states, tmp_path):
    """Out of order, repeated and equal versions; the second batch's commit is lost after its rows were written, and it comes again."""
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    writer, seen = versions.write_once(out, "event_id"), []

    def failing(batch, number):
        writer(batch, number)
        if batch.where("event_id = 4").count():
            seen.append(number)
            if len(seen) == 1:
                raise RuntimeError("lost after the write")

    put(source, "a", [row(1, 2, "b"), row(1, 1, "a"), row(2, 5, "x"), row(2, 5, "y"), row(None, 1, "no id"), row(3, None, "no version")])
    stream = versions.newest_versions(versions.read_versions(spark, str(source), 1))
    query = versions.follow(stream, failing, checkpoint)
    query.processAllAvailable()
    put(source, "b", [row(1, 1, "old"), row(1, 2, "again"), row(2, 6, "z"), row(4, 1, "new")])
    with pytest.raises(Exception):
        query.processAllAvailable()
    query.stop()
    assert {(r.event_id, r.version, r.payload) for r in versions.current(spark, out).collect()} == {(1, 2, "b"), (2, 6, "z"), (4, 1, "new")}
    query = versions.follow(versions.newest_versions(versions.read_versions(spark, str(source), 1)), failing, checkpoint)
    query.processAllAvailable()
    put(source, "c", [row(2, 4, "late"), row(1, 3, "c")])
    query.processAllAvailable()
    query.stop()
    assert len(seen) == 2 and seen[0] == seen[1]
    rows = spark.read.parquet(out)
    assert {(r.event_id, r.version, r.payload) for r in versions.current(spark, out).collect()} == {(1, 3, "c"), (2, 6, "z"), (4, 1, "new")}
    assert rows.groupBy("event_id", "version").count().where("count > 1").count() == 0


def test_finished_events_expire(spark, states, tmp_path):
    """A finished event's timer drops its state once the watermark has passed; late rows are dropped by the watermark before."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    put(source, "a", [row(1, 1, "a"), row(1, 2, "end", state="FINISHED"), row(2, 1, "a")])
    stream = versions.newest_versions(versions.read_versions(spark, str(source), 1), late="10 minutes", keep_ms=60_000)
    query = versions.follow(stream, versions.write_once(out, "event_id"), str(tmp_path / "cp"))
    query.processAllAvailable()
    held = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    put(source, "b", [row(2, 2, "b", at="2026-06-01T15:00:00")])
    query.processAllAvailable()
    put(source, "c", [row(2, 3, "c", at="2026-06-01T15:01:00"), row(1, 9, "too late")])
    query.processAllAvailable()
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    query.stop()
    assert left < held
    assert {(r.event_id, r.version) for r in versions.current(spark, out).collect()} == {(1, 2), (2, 3)}
