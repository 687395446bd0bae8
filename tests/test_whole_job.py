"""Queries over all of their rows, where the registered SQL keeps a subset of them."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from lattiq.operators import replay
from lattiq.plans import pipeline, queries
from tests.conftest import TABLES, plain
from tests.test_operators import NOW, catalog

#: Larger than the other tests' tables, so that every subset shows.
MORE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def same_as_whole_sql(spark):
    """Checks a query's rows against its SQL without the text that keeps a subset."""
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{MORE}/{name}.parquet'")

    def check(name, subset):
        frame = queries.QUERIES[name](spark, MORE)
        names = sorted(frame.columns)
        cursor = connection.execute(queries.ORACLES[name].replace(subset, ""))
        found = [c[0] for c in cursor.description]
        assert sorted(found) == names
        wanted = sorted(tuple(plain(r[found.index(c)]) for c in names) for r in cursor.fetchall())
        assert sorted(tuple(plain(r[c]) for c in names) for r in frame.collect()) == wanted

    return check


@pytest.mark.parametrize("name", ["agg_coupon_score", "win_coupon_rank"])
def test_coupons_of_all_events(name, same_as_whole_sql):
    same_as_whole_sql(name, " WHERE o.event_id < 3000")


def test_offers_of_all_events(same_as_whole_sql):
    same_as_whole_sql("win_round_robin", " WHERE event_id < 40")


def test_pairs_of_all_orders(spark, tmp_path):
    """Against the greedy rule in plain Python, on orders with keys on either side of 2,000."""
    parts = [(1, "SMALL"), (2, "SMALL"), (3, "LARGE"), (4, "PROMO"), (5, "LARGE")]
    items = [(k, part, "ANR"[(k + part) % 3]) for k in (1, 2, 1999, 2000, 5001, 600000) for part, _ in parts]
    spark.createDataFrame(parts, "p_partkey long, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    kinds, wanted = dict(parts), set()
    for k in {k for k, _, _ in items}:
        free = sorted(p for o, p, flag in items if o == k and flag != "A")
        for gold in sorted(p for o, p, flag in items if o == k and flag == "A"):
            taken = next((p for p in free if kinds[p] == kinds[gold]), None)
            free = [p for p in free if p != taken]
            wanted.add((k, gold, taken))
    found = queries.QUERIES["jon_greedy_pairs"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.gold_idx, r.pred_idx) for r in found} == wanted and len(found) == len(wanted)
    assert any(k >= 2000 and p is not None for k, _, p in wanted)


@pytest.mark.parametrize("name, subset", [("jon_semi_whitelist", " AND c_custkey % 50 = 0"), ("jon_allow_set", " WHERE club_id < 4")])
def test_whole_sets(name, subset, same_as_whole_sql):
    same_as_whole_sql(name, subset)


def test_resolve_suggests_related_markets(spark):
    start = datetime.datetime(2026, 6, 26, 18)
    events = spark.createDataFrame(
        [(901, "Reds - Blues", "Reds", "Blues", start, "NOT_STARTED", "fixture", 10, [1, 2], [1, 2])],
        "event_id long, event_name string, home_name string, away_name string, start timestamp_ntz, state string, level string, group_id long, teams array<long>, members array<long>",
    )
    names = "offer_id long, event_id long, criterion_id long, offer_type int, tags array<string>, label string, ord int, outcome_id long, kind string, english_label string, outcome_label string, participant string, participant_id long, odds long, line long, home_score string, away_score string"
    rows = [(9010, 901, 5, 6, ["MAIN"], "Total Goals", k, 90100 + k, "OT_OVER" if k == 1 else "OT_UNDER", "Over" if k == 1 else "Under", None, None, None, 1500, 2500, None, None) for k in (1, 2)]
    for at, label in enumerate(("Corners", "Cards", "Throws"), 1):
        rows += [(9010 + at, 901, 5 + at, 2, [], label, k, 90100 + at * 10 + k, None, f"{label} {k}", None, None, None, 2000 + k, None, None, None) for k in (1, 2)]
    plan = '{"status":"ok","sport":"football","selectors":[{"subject":{"kind":"event"},"market_concept":"total goals","line":"2.5","competition":"Cup","teams":["Reds"],"level":"fixture"}]}'
    phrase = spark.createDataFrame([("total goals",)], "phrase string")
    menu = F.array(*map(F.lit, ("Total Goals", "Throws", "Corners", "Cards")))
    markets = phrase.select(replay.market_key(F.col("phrase"), menu).alias("key"), F.lit("Total Goals").alias("label"), F.lit("exact").alias("match"), F.lit(None).cast("string").alias("outcome_label"), F.array(F.lit("Cards"), F.lit("Corners")).alias("related"))
    entities = spark.createDataFrame([], "key string, pass int, action string, id long, phrase string, question string")
    entities = entities.unionByName(spark.createDataFrame([("Kup", "Cup")], "said string, phrase string").select(
        replay.entity_key(F.lit("q2"), F.lit("competition"), F.col("said"), F.array().cast("array<struct<id:bigint,score:double>>")).alias("key"),
        F.lit(1).alias("pass"), F.lit("reexpress").alias("action"), F.lit(None).cast("long").alias("id"), "phrase", F.lit(None).cast("string").alias("question")))
    other = plan.replace("total goals", "corners").replace('"Cup"', '"Kup"')
    broken = plan.replace('"kind":"event"', '"kind":"soft","kinds":["x"]')
    asked = spark.createDataFrame([("q1", plan), ("q2", other), ("q3", broken), ("q4", None), ("q5", '{"sport":"football","selectors":[]}')], "query_id string, plan string")
    coupons = {
        "coupons": spark.createDataFrame([(1, 10, [901, 950], False, 4000, None), (2, 10, [], True, 2000, "CUSTOM"), (3, 77, [901], True, 2000, "CUSTOM")], "coupon_id long, group_id long, event_ids array<long>, custom boolean, price long, tag string"),
        "refs": spark.createDataFrame([(1, 90101, None, 0), (1, 95001, None, 1), (2, 90101, None, 0), (3, 90101, None, 0)], "coupon_id long, outcome_id long, offer_id long, ord int"),
        "outcomes": spark.createDataFrame([(90101, 9010, 901, 5, "Total Goals", "Over"), (95001, 9500, 950, 5, "Total Goals", "Under")], "outcome_id long, offer_id long, event_id long, criterion_id long, market_label string, outcome_label string"),
    }
    events = events.unionByName(events.withColumns({"event_id": F.lit(950).cast("long"), "group_id": F.lit(99).cast("long"), "teams": F.array().cast("array<bigint>"), "members": F.array().cast("array<bigint>")}))
    fetches = spark.createDataFrame([("q1", "group", 5000, 2000, False), ("q1", "participant", None, 2000, False), ("q2", "group", 5000, 2000, False), ("q2", "fanout", 9, 9, True)], "query_id string, route string, total long, returned long, failed boolean")
    tables = pipeline.resolve(spark, asked, catalog(spark), events, spark.createDataFrame(rows, names), markets, entities, spark.createDataFrame([("football",)], "sport string"), F.lit(NOW).cast("timestamp_ntz"), F.create_map(F.lit("u21"), F.lit("u21")), coupons=coupons, fetches=fetches)
    found = {r.query_id: r for r in tables["envelopes"].collect()}
    assert {q: found[q].clarification for q in found} == {"q1": None, "q2": None, "q3": "invalid_plan", "q4": "invalid_plan", "q5": "incomplete"}
    assert found["q1"].notes == ["truncated"] and found["q2"].notes == ["line_absent", "partly_failed"]
    assert [(c.coupon_id, c.tag, [(x.outcome_label, x.matched) for x in c.legs]) for c in found["q1"].combinations] == [(1, "AUTO", [("Over", True), ("Under", False)])]
    assert [e.event_id for e in found["q1"].combination_events] == [950]
    settled = {r.key: r.settled_by for r in tables["settled"].where("settled_by = 'recorded'").collect()}
    assert len(settled) == 1 and tables["legs"].where("query_id = 'q2'").first().competition_id == 10
    answer = found["q1"]
    assert [(a.rank, a.label, a.offer_id, [o.outcome_id for o in a.outcomes]) for a in answer.additional] == [(0, "Cards", 9012, [90121, 90122]), (1, "Corners", 9011, [90111, 90112])]
