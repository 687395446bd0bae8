"""What the pipeline reads of events and outcomes: what its queries may reach, once."""

from pyspark.sql import functions as F

from lattiq.operators import fetch
from lattiq.plans import bindings, pipeline
from lattiq.sources.written import whole
from tests.conftest import DATA


def test_reachable_events(spark):
    """By name, else by participant and by group; each once, and none by an unknown group or without members."""
    none = "array<long>"
    asked = spark.createDataFrame([("a", [1, 99], [5], [10]), ("b", [], [6], [20]), ("c", None, [6, 7], None), ("d", [], [], [30])], f"query_id string, event_ids {none}, participant_ids {none}, group_ids {none}")
    rows = [(1, 10, [5]), (2, 10, [5, 8]), (3, 20, [6, 7]), (4, None, [7]), (5, None, None), (6, 30, []), (7, 6, [20]), (8, None, [None, 6])]
    found = fetch.reachable_events(asked, spark.createDataFrame(rows, f"event_id long, group_id long, members {none}"))
    assert sorted(r.event_id for r in found.collect()) == [1, 3, 4, 6, 8]


def test_rows_of_other_events_are_dropped_before_the_joins(spark):
    """The same rows as those that are left of the whole tables, but nothing else meets parts, suppliers or customers."""
    ids = spark.createDataFrame([(k,) for k in (1, 2, 29, 37, 41, 50, 10**9)], "event_id long")
    for table in (bindings.events, bindings.outcomes):
        pruned, every = table(spark, DATA, whole, ids), table(spark, DATA, whole)
        wanted = every.join(ids, "event_id", "left_semi")
        assert sorted(map(str, pruned.collect())) == sorted(map(str, wanted.select(*pruned.columns).collect())) != []
        steps = [line for line in pruned._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
        assert "LeftSemi" in steps[-1] and all("Inner" in line for line in steps[:-1]) and len(steps) > 1


def test_outcomes_are_read_once(spark, monkeypatch):
    """However many steps use them, and only those of events that a query may reach."""
    reads, read = spark.sparkContext.accumulator(0), bindings.outcomes
    every = read(spark, DATA).count()

    def count(e):
        reads.add(1)
        return e

    monkeypatch.setattr(bindings, "outcomes", lambda *of, **more: read(*of, **more).withColumn("event_id", F.udf(count, "long").asNondeterministic()("event_id")))
    for cap in (None, 3):
        before = reads.value
        rows = pipeline.answers(spark, DATA, cap, ("a1", "a4")).collect()
        assert sum(r.outcomes for r in rows) > 0 and 0 < reads.value - before < every / 2
