"""Golden values of single operators, missing data, and independence of the rows' order."""

import random
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattiq.functions import offering, text, timewin
from lattiq.operators import assemble, etl, evaluation, grounding, menu, planner, replay, scope, selecting, subject
from lattiq.plans import pipeline
from lattiq.sources import plans, readers
from lattiq.streaming import stages

NOW = "2026-06-24 00:00:00"
PAIR = """event_id long, start timestamp_ntz, state string, level string, group_id long, teams array<long>, leg int, leg_level string, competition_id long, play_state string,
 team_ids array<long>, window_start timestamp_ntz, window_end timestamp_ntz, after_hour int, before_hour int, relative string, pick_order string, pick_count int"""


def pair_rows(spark, **leg):
    at = lambda x: pd.Timestamp(x).to_pydatetime()
    events = [
        (900, at("2026-06-23 03:00"), "NOT_STARTED", "competition", 10, []),
        (901, at("2026-06-26 18:00"), "NOT_STARTED", "fixture", 10, [1, 2]),
        (902, at("2026-07-01 18:00"), "NOT_STARTED", "fixture", 10, [1, 3]),
        (903, at("2020-01-01 00:00"), "NOT_STARTED", "fixture", 10, [5, 6]),
        (904, None, "NOT_STARTED", "competition", 20, []),
    ]
    base = {"leg_level": "fixture", "competition_id": None, "play_state": None, "team_ids": [], "window_start": None, "window_end": None, "after_hour": None, "before_hour": None, "relative": None, "pick_order": None, "pick_count": None}
    own = tuple((base | leg).values())
    return spark.createDataFrame([(*e, 1, *own) for e in events], PAIR)


@pytest.mark.parametrize(
    ("leg", "wanted"),
    [
        ({"pick_order": "earliest", "pick_count": 1, "window_start": pd.Timestamp(NOW).to_pydatetime()}, {901}),
        ({"pick_order": "latest", "pick_count": 1, "window_start": pd.Timestamp(NOW).to_pydatetime()}, {902}),
        ({"pick_order": "earliest", "pick_count": 2, "window_start": pd.Timestamp(NOW).to_pydatetime()}, {901, 902}),
        ({}, {901, 902, 903}),
        ({"leg_level": "competition", "competition_id": 10}, {900}),
        ({"team_ids": [1, 3]}, {902}),
        ({"leg_level": "competition"}, {900, 904}),
    ],
)
def test_scope(spark, leg, wanted):
    assert {r.event_id for r in scope.scope_events(pair_rows(spark, **leg), ["leg"]).collect()} == wanted


def test_missing_data_keeps_rows(spark):
    none = spark.sql("SELECT CAST(NULL AS TIMESTAMP_NTZ) AS t, CAST(NULL AS STRING) AS s, CAST(NULL AS BIGINT) AS n")
    at = F.lit(NOW).cast("timestamp_ntz")
    kept = none.select(
        timewin.within(F.col("t"), at, at),
        timewin.in_hours(F.col("t"), F.lit(3), F.lit(4)),
        scope.right_grain(F.col("s"), F.lit("fixture")),
        scope.right_competition(F.col("n"), F.lit(3)),
        scope.right_state(F.col("s"), F.lit("live")),
        scope.all_teams(F.array(F.lit(1)), F.array().cast("array<int>")),
        selecting.within_odds(F.col("n"), F.lit(1.0), F.lit(2.0)),
    ).first()
    assert all(kept)
    assert not none.select(scope.right_state(F.col("s"), F.lit("prematch"))).first()[0]


def test_order_of_rows_does_not_matter(spark):
    rows = pair_rows(spark, pick_order="latest", pick_count=2).collect()
    results = []
    for seed in (1, 2, 3):
        random.Random(seed).shuffle(rows)
        results.append({r.event_id for r in scope.scope_events(spark.createDataFrame(rows, PAIR), ["leg"]).collect()})
    assert results[0] == results[1] == results[2] == {901, 902}


def reference_fold(s):
    bare = "".join(c for c in unicodedata.normalize("NFD", s) if not 0x300 <= ord(c) <= 0x36F).lower()
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in bare).split())


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(st.characters(max_codepoint=0x24F), max_size=12), min_size=20, max_size=60))
def test_fold(spark, names):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", text.fold(F.col("n")).alias("f")).collect()
    assert {r.k: r.f for r in rows} == {k: reference_fold(n) for k, n in enumerate(names)}


def test_fold_of_letters_without_parts(spark):
    names = ["Ødegaard", "Łukasz Straße", "Çalhanoğlu", "Kylian Mbappé"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(text.fold(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["degaard", "ukasz stra e", "calhanoglu", "kylian mbappe"]


def test_result_tokens(spark):
    cases = [("win/win", "away", "2/2"), ("win/win", "home", "1/1"), ("loss/win", "away", "1/2"), ("draw/win", "away", "x/2"), ("win/draw", "home", "1/x"), ("win/win", None, None), ("2/2", "home", None)]
    rows = spark.createDataFrame(cases, "p string, s string, w string").select(text.result_tokens(F.col("p"), F.col("s")), "w").collect()
    assert all(a == b for a, b in rows)
    assert spark.sql("SELECT '2-0' AS x").select(text.reverse_score(F.col("x"))).first()[0] == "0-2"


OUTCOME = """leg int, offer_id long, offer_type int, outcome_id long, kind string, english_label string, outcome_label string, participant string, participant_id long, odds long, line long, home_score string, away_score string, home_name string, away_name string,
 line_value string, outcome_wanted string, subject string, subject_id long, subject_on string, odds_min double, odds_max double, direction string, odds_sort string, pick_n int"""


def choose(spark, outcomes, **spec):
    names = ["offer_id", "offer_type", "outcome_id", "kind", "english_label", "outcome_label", "participant", "participant_id", "odds", "line", "home_score", "away_score", "home_name", "away_name"]
    asked = ["line_value", "outcome_wanted", "subject", "subject_id", "subject_on", "odds_min", "odds_max", "direction", "odds_sort", "pick_n"]
    rows = [(1, *[o.get(n) for n in names], *[spec.get(n) for n in asked]) for o in outcomes]
    found = selecting.select_outcomes(spark.createDataFrame(rows, OUTCOME), ["leg"], ["outcome_id"]).orderBy("outcome_id").collect()
    return [r.outcome_id for r in found if r.is_selected], [r.outcome_id for r in found if r.in_pool], found[0].fallback, [r.chosen_line for r in found if r.is_selected]


def test_half_time_tokens(spark):
    market = [{"offer_id": 1, "offer_type": 8, "outcome_id": k, "english_label": t} for k, t in enumerate(["1/1", "X/2", "2/2", "1/2"], 1)]
    assert choose(spark, market, line_value="win/win", subject_on="away")[0] == [3]
    assert choose(spark, market, line_value="draw/win", subject_on="away")[0] == [2]
    assert choose(spark, market, line_value="win/win")[2] == "subject-absent"
    assert choose(spark, market, line_value="2/2")[0] == [3]


def test_correct_score(spark):
    market = [{"offer_id": 1, "offer_type": 3, "outcome_id": 1, "home_score": "2", "away_score": "0"}, {"offer_id": 1, "offer_type": 3, "outcome_id": 2, "home_score": "0", "away_score": "2"}]
    assert choose(spark, market, line_value="2-0", subject_on="home")[0] == [1]
    assert choose(spark, market[1:], line_value="2-0", subject_on="away")[0] == [2]


def test_three_way_handicap_is_the_home_sides(spark):
    market = []
    for offer, line in ((1, 1000), (2, -1000)):
        market += [{"offer_id": offer, "offer_type": 11, "outcome_id": offer * 10, "kind": "OT_ONE", "line": line, "participant_id": 7}, {"offer_id": offer, "offer_type": 11, "outcome_id": offer * 10 + 1, "kind": "OT_TWO", "line": line, "participant_id": 8}]
    assert choose(spark, market, line_value="-1", subject_id=8)[0] == [11]
    assert choose(spark, market, line_value="1.0", subject_id=7)[0] == [10]


def test_nearest_line_and_odds(spark):
    market = [{"offer_id": 1, "offer_type": 6, "outcome_id": k, "kind": "OT_OVER", "line": x, "odds": o} for k, x, o in ((1, 1500, 1300), (2, 2500, 1900), (3, 3500, None))]
    assert choose(spark, market, line_value="2.25")[:2] == ([2], [1, 2, 3])
    assert choose(spark, market, line_value="2.25", odds_max=1.5)[:2] == ([1], [1, 3])
    assert choose(spark, market[:2], line_value="x")[2] == "line-absent"
    assert choose(spark, market[:2], odds_min=9.0)[2] == "odds-absent"


def test_field_by_price_and_owner_market(spark):
    field = [{"offer_id": 1, "offer_type": 4, "outcome_id": k, "english_label": f"{n} wins", "participant": n, "participant_id": k, "odds": o} for k, n, o in ((1, "A", 5000), (2, "B", 2000), (3, "C", None))]
    assert choose(spark, field, direction="yes", odds_sort="low", pick_n=2)[:2] == ([2], [1, 2])
    assert choose(spark, field, subject_id=3)[0] == [3]
    assert choose(spark, field, subject_id=9)[2] == "subject-absent"
    owner = [{"offer_id": 1, "offer_type": 18, "outcome_id": 1, "kind": "OT_NO", "english_label": "No"}, {"offer_id": 1, "offer_type": 18, "outcome_id": 2, "kind": "OT_YES", "english_label": "Yes"}]
    assert choose(spark, owner, subject_id=9)[:2] == ([2], [1, 2])
    assert choose(spark, owner)[0] == [2]


def test_a_leg_is_no_windows_partition(spark):
    """Many legs at once, each with its own rule, as one by one; only a field's first few are put in order."""
    field = [{"offer_id": k % 5, "offer_type": 4, "outcome_id": k, "english_label": f"n{k}", "participant": "x", "odds": 9000 - k % 7 * 1000 if k % 11 else None, "line": k % 4 * 500 or None} for k in range(1, 60)]
    asked = [{"direction": "yes", "odds_sort": "high", "pick_n": 3}, {"line_value": "1.1"}, {"odds_min": 5.0}, {"direction": "over"}, {"line_value": "zz"}, {"odds_min": 99.0, "odds_max": 100.0}]
    names = OUTCOME.replace("\n", " ").split(",")
    rows = [tuple((o | a | {"leg": k}).get(n.split()[0]) for n in names) for k, a in enumerate(asked) for o in field]
    found = selecting.select_outcomes(spark.createDataFrame(rows, OUTCOME), ["leg"], ["outcome_id"])
    got = {k: ([], []) for k in range(len(asked))}
    for r in found.orderBy("outcome_id").collect():
        got[r.leg][0].extend([r.outcome_id] * r.is_selected)
        got[r.leg][1].extend([r.outcome_id] * r.in_pool)
    by_price = sorted(field, key=lambda o: (o["odds"] is None, -(o["odds"] or 0), o["outcome_id"]))
    assert got[0] == ([by_price[0]["outcome_id"]], sorted(o["outcome_id"] for o in by_price[:3]))
    for k, a in enumerate(asked[1:], 1):
        assert got[k] == choose(spark, field, **a)[:2]
    assert got[1][0] == [2] and got[4] == ([], []) and got[5][1] == [o["outcome_id"] for o in field if o["odds"] is None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1


def test_accents_do_not_hide_a_subject(spark):
    row = spark.sql("SELECT array(struct('Kylian Mbappé' AS participant, 5L AS participant_id, 'Yes' AS label)) AS o, 'To score' AS label, 'France - Italy' AS e, 'France' AS h, 'Italy' AS a")
    own = lambda s, label="label": subject.prices_subject(F.col("o"), F.col(label), F.col("e"), F.col("h"), F.col("a"), text.fold(F.lit(s)), F.lit(None).cast("long"))
    assert row.select(own("Mbappe")).first()[0]
    assert not row.withColumn("label", F.lit("Italy to win")).select(own("France")).first()[0]


def test_suggestions_spend_places_that_show(spark):
    related = spark.createDataFrame([("q", 0, 0, "a"), ("q", 1, 0, "b"), ("q", 0, 1, "c"), ("q", 1, 1, "d"), ("q", 0, 2, "e")], "query_id string, leg_idx int, rank int, label string")
    offers = spark.createDataFrame([("q", 0, "a", 1), ("q", 1, "b", 1), ("q", 0, "c", 2), ("q", 1, "d", 3), ("q", 0, "e", 4)], "query_id string, leg_idx int, label string, offer_id long")
    shown = spark.createDataFrame([("q", 9)], "query_id string, offer_id long")
    assert {(r.label, r.offer_id) for r in assemble.suggestions(related, offers, shown).collect()} == {("a", 1), ("c", 2), ("d", 3)}


def test_plan_repair(spark):
    legs = [
        '{"subject":{"kind":"team","name":" "},"line":"","odds":{"min":0},"odds_sort":"up","count":0,"play_state":"soon","stage":" ","time":{"date_window":null,"kickoff_time_of_day":" "}}',
        '{"subject":{"kind":"player","name":"X"},"line":"2.5","odds":{"min":1.5,"max":3},"odds_sort":"low","count":2,"play_state":"live","teams":["A"],"players":[{"name":"X","role":"r"}]}',
    ]
    fixed = plans.repair_selectors(spark.createDataFrame([(k, x) for k, x in enumerate(legs)], "k int, j string"), "j").orderBy("k").collect()
    a, b = fixed
    assert (a.subject_kind, a.line_num, a.line_txt, a.odds_min, a.odds_sort, a["count"], a.play_state, a.stage, a.date_window, a.kickoff) == ("event", *[None] * 9)
    assert (b.subject_kind, b.line_num, b.odds_min, b.odds_max, b.odds_sort, b["count"], b.play_state, b.teams, b.players) == ("player", 2.5, 1.5, 3.0, "low", 2, "live", ["A"], ["X"])


def catalog(spark):
    groups = [(10, "Cup", 1), (11, "Cup Women", 1), (12, "National League", 2), (13, "Cup 2026", 1)]
    teams = [(1, "Reds", [10], [100], None), (2, "Blues", [10, 12], [100], None), (3, "Reds Ladies", [11], [100], None), (4, "Norland", [13], [100], "senior_men"), (5, "Norland", [13], [100], "youth_men_u21")]
    players = [(50, "Ann Lee", 3, None, [11]), (51, "Bob Lee", 1, 4, [10]), (52, "Cy Young", 2, None, [10, 12])]
    rosters = [(10, p) for p in range(60, 70)] + [(13, p) for p in range(60, 62)] + [(11, 50)]
    frame = spark.createDataFrame
    return {
        "groups": frame(groups, "id long, name string, branch long"),
        "branches": frame([(1, "Norland"), (2, "Southland")], "id long, name string"),
        "teams": frame(teams, "id long, name string, competition_ids array<long>, group_ids array<long>, variant string"),
        "players": frame(players, "id long, name string, club_id long, country_team_id long, competition_ids array<long>"),
        "rosters": frame(rosters, "owner_id long, player_id long"),
        "region_aliases": frame([("norse", "Norland")], "key string, value string"),
        "competition_aliases": frame([("the big one", "Cup")], "key string, value string"),
    }


def test_grounding(spark):
    c = catalog(spark)
    markers = F.create_map(F.lit("u21"), F.lit("u21"))
    teams = {r.text: (r.tier, [x.id for x in r.candidates]) for r in grounding.ground_teams(spark.createDataFrame([("Reds",), ("norland",), ("Ladies",), ("Norland U21",), ("zzz",)], "text string"), c["teams"], markers).collect()}
    assert teams["Reds"] == ("confident", [1])
    assert teams["norland"] == ("confident", [4])
    assert teams["Ladies"] == ("confident", [3])
    assert teams["zzz"] == ("none", [])
    asked = spark.createDataFrame([("a", "Cup", None, False), ("b", "Cup", None, True), ("c", "Cup", 2, False), ("d", "The Big One", None, False), ("e", "Cup", None, True)], "context string, text string, branch long, bound boolean")
    allowed = spark.createDataFrame([("b", 11), ("e", 999)], "context string, id long")
    comps = {r.context: (r.tier, [x.id for x in r.candidates]) for r in grounding.ground_competitions(asked, c["groups"], c["rosters"], c["competition_aliases"], allowed).collect()}
    assert comps["a"] == ("confident", [10])
    assert comps["b"] == ("confident", [11])  # the anchor's league, not the plain one
    assert comps["c"] == ("none", [])  # nothing under the branch shares a token
    assert comps["d"] == ("confident", [10])
    assert comps["e"] == ("none", [])
    regions = {r.text: (r.tier, [x.id for x in r.candidates]) for r in grounding.ground_regions(spark.createDataFrame([("Norse",), ("southland",), ("x",)], "text string"), c["branches"], c["region_aliases"]).collect()}
    assert regions == {"Norse": ("confident", [1]), "southland": ("confident", [2]), "x": ("none", [])}
    who = spark.createDataFrame([("1", "Lee"), ("2", "Lee"), ("1", "Cy Young")], "context string, text string")
    scopes = spark.createDataFrame([("2", 1)], "context string, team_id long")
    players = {(r.context, r.text): (r.tier, [x.id for x in r.candidates]) for r in grounding.ground_players(who, c["players"], scopes).collect()}
    assert players[("1", "Lee")] == ("shortlist", [50, 51])
    assert players[("2", "Lee")] == ("confident", [51])
    assert players[("1", "Cy Young")] == ("confident", [52])


def test_replay(spark):
    cells = spark.createDataFrame([("a", "confident", [(1, 1.0)]), ("b", "ambiguous", [(2, 1.0), (3, 1.0)]), ("c", "none", []), ("d", "shortlist", [(4, 0.7)]), ("e", "ambiguous", [(5, 1.0)])], "key string, tier string, candidates array<struct<id:long,score:double>>")
    decisions = spark.createDataFrame([("b", 1, "pick", 3, None, None), ("c", 1, "reexpress", None, "Cup", None), ("d", 1, "pick", 99, None, None), ("d", 2, "clarify", None, None, "which?")], "key string, pass int, action string, id long, phrase string, question string")
    again = spark.createDataFrame([("Cup", "confident", [(7, 1.0)])], "phrase string, tier string, candidates array<struct<id:long,score:double>>")
    found = {r.key: (r.id, r.settled_by, r.question) for r in replay.settle_entities(cells, decisions, again).collect()}
    assert found == {"a": (1, "confident", None), "b": (3, "recorded", None), "c": (7, "recorded", None), "d": (None, "recorded", "which?"), "e": (5, "fallback", None)}


def test_guarded_picks(spark):
    labels = spark.createDataFrame([(1, "Total Goals", None), (1, "Match Winner", ["Draw at last", "Same side"]), (2, "Corners", None)], "m int, label string, outcome_labels array<string>")
    phrases = spark.createDataFrame([(1, 1, "goals total", "k1"), (2, 1, "winner", "k2"), (3, 1, "cards", "k3"), (4, 2, "winner", "k4")], "p int, m int, phrase string, key string")
    recorded = spark.createDataFrame([("k2", "Match Winner", "exact", "Same side", ["Total Goals", "Match Winner", "Nope", "Total Goals"]), ("k4", "Match Winner", "exact", None, [])], "key string, label string, match string, outcome_label string, related array<string>")
    found = {r.p: r for r in replay.pick_markets(phrases, labels, recorded, ["p"], ["m"]).collect()}
    assert (found[1].label, found[1].match, found[1].source) == ("Total Goals", "exact", "lexical")
    assert (found[2].label, found[2].outcome_label, found[2].related, found[2].source) == ("Match Winner", "Same side", ["Total Goals"], "recorded")
    assert (found[3].label, found[3].match) == (None, "none")
    assert (found[4].label, found[4].match) == (None, "none")


def test_catalog_preparation(spark):
    feed = spark.read.schema(readers.FEED).json(
        spark.sparkContext.parallelize(['{"participants":[{"id":1,"type":"TEAM","names":[{"locale":"en_GB","name":"T"}],"groupIds":[5],"teamMembers":[{"id":9,"type":"PARTICIPANT","names":[{"locale":"sv","name":"Doe, Jo (USA)"}],"groupIds":[5]}]},{"id":2,"type":"TEAM","names":[],"groupIds":[]}]}'])
    )
    teams, members = etl.flatten_feed(feed)
    assert [(r.id, r.name) for r in teams.collect()] == [(1, "T")]
    assert [(r.id, r.name, r.club_id) for r in members.collect()] == [(9, "Jo Doe", 1)]
    nodes = spark.createDataFrame([(1, "Root", None), (2, "Land", 1), (3, "Cup", 2), (4, "Testing", 2)], "id long, name string, parent long")
    walked = etl.walk_tree(spark, nodes)
    groups, branches = etl.whitelist(walked, spark.createDataFrame([(3,)], "id long"))
    assert [(r.id, r.branch) for r in groups.collect()] == [(3, 2)]
    assert [(r.id, r.name) for r in branches.collect()] == [(2, "Land")]
    assert {r.id: r.kind for r in etl.classify(walked).collect()} == {1: "group", 2: "group", 3: "competition", 4: "market"}
    member = spark.createDataFrame([(1, "f1"), (2, "f2"), (3, "f1"), (3, "f2"), (3, "f3")], "id long, feed string")
    feeds = {"f1": "men", "f2": "women", "f3": "women main"}
    assert {r.id: r.gender for r in etl.provenance(member, feeds).collect()} == {1: "men", 2: "women", 3: "women"}
    assert {r.name: r.n for r in etl.counts(nodes=nodes).collect()} == {"nodes": 4}


def test_sources(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text('{"id":"g1","tags":["t"]}\n\n{broken\n')
    records, faults = readers.read_lines(spark, str(tmp_path / "gold.jsonl"), readers.GOLD)
    assert [r.id for r in records.collect()] == ["g1"] and faults.count() == 1
    assert readers.read_json(spark, str(tmp_path / "nothing.json"), readers.ALIASES).count() == 0
    (tmp_path / "aliases.json").write_text('{"competitions":{"wc":"World Cup"},"regions":{},"markers":{"u21":"u21"}}')
    assert {(r.kind, r.key) for r in readers.aliases(spark, str(tmp_path / "aliases.json")).collect()} == {("competitions", "wc"), ("markers", "u21")}
    tree = '{"group":{"groups":[{"id":1,"name":"a","groups":[{"id":2,"name":"b","groups":[]}]},{"id":3,"name":"c"}]}}'
    flat = readers.flatten_tree(spark.createDataFrame([(tree,)], "json string"))
    assert {(r.id, r.parent) for r in flat.collect()} == {(1, None), (2, 1), (3, None)}
    offer = '{"id":1,"eventId":2,"criterion":{"id":3,"englishLabel":"Goals"},"betOfferType":{"id":6},"tags":["MAIN"],"outcomes":[{"id":4,"type":"OT_OVER","odds":1500,"line":2500}]}'
    rows = readers.flat_outcomes(spark.read.schema(readers.OFFER).json(spark.sparkContext.parallelize([offer]))).collect()
    assert [(r.offer_id, r.label, r.outcome_id, r.kind, r.odds) for r in rows] == [(1, "Goals", 4, "OT_OVER", 1500)]
    event = '{"id":2,"name":"A - B","start":"2026-06-26T18:00:00Z","tags":["MATCH"],"participants":[{"participantId":1,"participantType":"TEAM"}]}'
    own = readers.flat_events(spark.read.schema(readers.EVENT).json(spark.sparkContext.parallelize([event]))).first()
    assert (own.event_id, str(own.start), own.level, own.teams) == (2, "2026-06-26 18:00:00", "fixture", [1])


def test_grading(spark):
    gold = spark.createDataFrame([("q", 0, ["goals"]), ("q", 1, ["goals"]), ("r", 0, ["x"])], "query_id string, idx int, accept array<string>")
    predicted = spark.createDataFrame([("q", 0, "Total goals"), ("q", 1, "goals"), ("r", 0, "y")], "query_id string, idx int, market string")
    pairs = {(r.query_id, r.gold_idx): r.pred_idx for r in evaluation.pair_selectors(gold, predicted).collect()}
    assert pairs == {("q", 0): 0, ("q", 1): 1, ("r", 0): None}


def test_resolve(spark):
    c = catalog(spark)
    at = lambda x: pd.Timestamp(x).to_pydatetime()
    events = spark.createDataFrame(
        [(901, "Reds - Blues", "Reds", "Blues", at("2026-06-26 18:00"), "NOT_STARTED", "fixture", 10, [1, 2], [1, 2]), (902, "Blues - Reds", "Blues", "Reds", at("2026-07-01 18:00"), "NOT_STARTED", "fixture", 10, [2, 1], [2, 1])],
        "event_id long, event_name string, home_name string, away_name string, start timestamp_ntz, state string, level string, group_id long, teams array<long>, members array<long>",
    )
    names = "offer_id long, event_id long, criterion_id long, offer_type int, tags array<string>, label string, ord int, outcome_id long, kind string, english_label string, outcome_label string, participant string, participant_id long, odds long, line long, home_score string, away_score string"
    rows = []
    for e in (901, 902):
        rows += [(e * 10, e, 5, 6, ["MAIN"], "Total Goals", k, e * 100 + k, "OT_OVER" if k % 2 else "OT_UNDER", "Over" if k % 2 else "Under", None, None, None, 1500 + k, line, None, None) for k, line in enumerate((1500, 1500, 2500, 2500), 1)]
        rows += [(e * 10 + 1, e, 6, 2, [], "Match Winner", k, e * 100 + 10 + k, None, n + " wins", None, n, i, 2000, None, None, None) for k, (n, i) in enumerate((("Reds", 1), ("Blues", 2)))]
    plan = '{"status":"ok","sport":"football","selectors":[{"subject":{"kind":"event"},"market_concept":"total goals","line":"2.4","competition":"Cup","teams":["Reds"],"level":"fixture","time":{"fixture_pick":{"order":"earliest","count":1}}},{"subject":{"kind":"team","name":"Reds"},"market_concept":"match winner","competition":"Cup","teams":["Reds"],"level":"fixture"}]}'
    asked = spark.createDataFrame([("q1", plan), ("q2", '{"sport":"golf","selectors":[{"teams":["Reds"]}]}'), ("q3", '{"sport":"football","selectors":[{"market_concept":"x"}]}')], "query_id string, plan string")
    markets = spark.createDataFrame([], "key string, label string, match string, outcome_label string, related array<string>")
    entities = spark.createDataFrame([], "key string, pass int, action string, id long, phrase string, question string")
    tables = pipeline.resolve(spark, asked, c, events, spark.createDataFrame(rows, names), markets, entities, spark.createDataFrame([("football",)], "sport string"), F.lit(NOW).cast("timestamp_ntz"), F.create_map(F.lit("u21"), F.lit("u21")))
    answers = {r.query_id: r for r in tables["envelopes"].collect()}
    chosen = {o.outcome_id for r in answers["q1"].results for h in r.highlighted for o in h.outcomes if o.is_selected}
    assert {x for x in chosen if x % 100 < 10} == {90103} or {x for x in chosen if x % 100 < 10} == {90104}
    assert {x for x in chosen if x % 100 >= 10} == {90110}  # a named subject keeps the first of its outcomes
    assert answers["q2"].clarification == "unsupported_sport"
    assert answers["q3"].clarification == "incomplete"


def test_streams(spark, tmp_path):
    assert [s for s, _ in stages.run(lambda: {})] == stages.STAGES
    assert [s for s, _ in stages.run(lambda: 1 / 0)][-1] == "error"
    spark.createDataFrame([(1, "STARTED"), (2, "NOT_STARTED"), (3, None)], "event_id long, state string").write.parquet(str(tmp_path / "in"))
    stream = stages.watch_events(spark, str(tmp_path / "in"), "event_id long, state string", "live")
    seen = []
    done = stages.write_answers(stream, lambda df, n: seen.extend(r.event_id for r in df.collect()), str(tmp_path / "cp"))
    done.processAllAvailable()
    done.stop()
    assert sorted(seen) == [1, 3]
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id int, version int, score string")
    assert {(r.id, r.score) for r in stages.latest_versions(rows, "id", "version").collect()} == {(1, "b"), (2, "c")}


def test_small_rules(spark):
    one = spark.range(1)
    assert one.select(offering.locale(F.lit("SWEDISH "))).first()[0] == "sv_SE"
    assert one.select(text.append_missing(F.lit("goals for Jo"), F.array(F.lit("Jo Doe")))).first()[0] == "goals for Jo"
    assert one.select(text.append_missing(F.lit("goals"), F.array(F.lit("Jo Doe")))).first()[0] == "goals Jo Doe"
    assert one.select(offering.bet_phrase(F.lit("goals"), F.lit("player"), F.lit(False))).first()[0] == "goals (for one player)"
    assert one.select(text.percent(F.lit(2), F.lit(3))).first()[0] == 67
    assert planner.doubtful(spark.createDataFrame([("none",), ("confident",)], "tier string")).count() == 1
    assert menu.build_menu(spark.createDataFrame([], "label string, criterion_id long, event_id long, ord int, kind string, participant string, english_label string, outcome_label string"), []).count() == 0
