"""Fetching from a capped source, in rounds, and the windows of tournaments."""

import pytest
from pyspark.sql import functions as F

from lattiq.operators import fetch
from lattiq.plans import pipeline

INPUT = "query_id string, event_ids array<long>, participant_ids array<long>, group_ids array<long>, levels array<string>, play_state string"


@pytest.fixture(scope="module")
def source(spark):
    """Group 1 has three events of 2, 5 and 9 offers of three types; group 2 one event of one offer."""
    offers = [(e * 100 + k, e, g, k % 3) for e, g, n in ((11, 1, 2), (12, 1, 5), (13, 1, 9), (21, 2, 1)) for k in range(n)]
    events = [(11, 1, "fixture", "NOT_STARTED"), (12, 1, None, "NOT_STARTED"), (13, 1, "fixture", None), (21, 2, "competition", "STARTED")]
    known = spark.createDataFrame(events, "event_id long, group_id long, level string, state string").withColumn("start", F.lit(None).cast("timestamp_ntz"))
    return spark.createDataFrame(offers, "offer_id long, event_id long, group_id long, offer_type int"), known, spark.createDataFrame([(11, 7), (13, 7), (13, 8)], "event_id long, participant_id long")


@pytest.mark.parametrize("cap,rounds", [(100, 1), (16, 1), (9, 2), (7, 4), (3, 4), (2, 4)])
def test_rounds(spark, source, cap, rounds):
    offers, events, members = source
    asked = spark.createDataFrame([("q", [], [], [1, 2], [], None)], INPUT)
    found = fetch.fetch(asked, offers, events, members, cap)
    log = found["log"].collect()
    rows = [(r.query_id, r.offer_id) for r in found["offers"].collect()]
    assert max(r.round for r in log) == rounds and len(rows) == len(set(rows))
    if cap > 2:
        assert len(rows) == 17 and not any(r.total > r.returned and not r.refined for r in log)
    else:  # a type of event 13 has three offers, and nothing finer can be asked
        assert len(rows) == 14 and sum(r.total > r.returned and not r.refined for r in log) == 3
    flags = {r.truncated for r in pipeline.planner.fetch_flags(fetch.flags(found["log"])).collect()}
    assert flags == {cap == 2}


def test_ways_to_ask(spark, source):
    """Named events alone, participants and groups together; what doesn't fit the levels or the play state isn't asked for."""
    offers, events, members = source
    asked = spark.createDataFrame(
        [("named", [12, 21, 11], [7], [1], [], None), ("mixed", [], [8], [2], [], None), ("level", [], [], [1], ["competition"], None), ("live", None, [], [1], ["fixture"], "live"), ("none", [], [], [], [], None)], INPUT
    )
    found = fetch.fetch(asked, offers, events, members, 3)
    by = {}
    for r in found["offers"].collect():
        by.setdefault(r.query_id, set()).add(r.event_id)
    assert by == {"named": {11, 12, 21}, "mixed": {13, 21}, "level": {12}, "live": {13}}
    short = fetch.fetch(spark.createDataFrame([("all", [], [], [1], [], None)], INPUT), offers, events, members, 3, most_events=1)
    assert {r.event_id for r in short["offers"].collect()} == {11}
    assert [(r.query_id, r.truncated) for r in pipeline.planner.fetch_flags(fetch.flags(short["log"])).collect()] == [("all", True)]
    assert fetch.fetch(asked.limit(0), offers, events, members, 3)["offers"].count() == 0


def test_tournament_windows(spark):
    """The next edition, else the running one, else an open window; the weekend that the edition opens with."""
    editions = [(1, "2026-06-11", "2026-07-19"), (1, "2030-06-08", None), (2, "2026-01-01", "2026-12-31"), (3, "2020-01-01", "2020-02-01"), (4, "2026-05-30", None), (4, "2026-05-01", "2026-06-30")]
    frame = spark.createDataFrame(editions, "competition_id long, starts string, ends string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("starts", "ends")})
    legs = spark.createDataFrame([(k, "weekend", "tournament", None, None) for k in (1, 2, 3, 4, None)], "competition_id long, date_window string, anchor string, kickoff string, pick_order string")
    now = F.lit("2026-06-01 12:00:00").cast("timestamp_ntz")
    found = pipeline.with_windows(pipeline.with_starts(legs, frame, now), now, F.col("tournament_start")).collect()
    seen = {r.competition_id: (str(r.tournament_start), str(r.window_start)) for r in found}
    assert seen[1] == ("2026-06-11 00:00:00", "2026-06-12 18:00:00") and seen[2][0] == "2026-01-01 00:00:00" and seen[4][0] == "2026-05-30 00:00:00"
    assert seen[3] == seen[None] == ("None", "None") and not any(r.time_unresolved for r in found)


@pytest.mark.parametrize("cap", [100, 7, 2])
def test_offers_are_read_once(spark, source, cap):
    """However many rounds there are, and only for what they may reach."""
    offers, events, members = source
    reads = spark.sparkContext.accumulator(0)

    def count(e):
        reads.add(1)
        return e

    counted = offers.withColumn("event_id", F.udf(count, "long").asNondeterministic()("event_id"))
    asked = spark.createDataFrame([("q", [], [8], [1, 2], [], None), ("named", [12], [], [], [], None)], INPUT)
    found = fetch.fetch(asked, counted, events, members, cap)
    assert found["offers"].count() > 0 and found["log"].count() > 0
    assert reads.value == 17


def test_offers_beside_the_list_of_events(spark, source):
    """An answer by group goes by the offers' own group, a batch by the listed events; an offer that is there twice counts twice in totals."""
    offers, events, members = source
    more = spark.createDataFrame([(3100, 31, 1, 0), (4100, 41, 9, 0), (2100, 21, 2, 0)], offers.schema)
    listed = spark.createDataFrame([(41, 1, None, None), (21, 1, None, None)], "event_id long, group_id long, level string, state string")
    events = events.unionByName(listed.withColumn("start", F.lit(None).cast("timestamp_ntz")))
    asked = spark.createDataFrame([("q", [], [], [1], [], None), ("two", [], [], [2], [], None)], INPUT)
    for cap, wanted in ((100, {11, 12, 13, 31}), (7, {11, 12, 13, 21, 41})):
        found = fetch.fetch(asked, offers.unionByName(more), events, members, cap)
        assert {r.event_id for r in found["offers"].where("query_id = 'q'").collect()} == wanted
        assert [(r.total, r.returned) for r in found["log"].where("query_id = 'two'").collect()] == [(2, 2)]
