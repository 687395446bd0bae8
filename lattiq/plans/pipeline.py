"""From query plans to answers, for many queries in one job."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions import text, timewin
from lattiq.functions.offering import bet_phrase, is_main
from lattiq.operators import assemble, combos, fetch, grounding, menu, planner, replay, scope, selecting, subject
from lattiq.plans import bindings
from lattiq.sources.plans import read_plans, unreadable
from lattiq.sources.written import few, stage, whole

LEG = ["query_id", "leg_idx"]
#: Legs of a query that ask the same of the same events share a menu.
GROUP = ["query_id", "leg_group"]
_IDS = "array<bigint>"


def with_starts(legs: DataFrame, editions: DataFrame, now: Column) -> DataFrame:
    """Legs with tournament_start: of their competition's editions(competition_id, starts, ends) the first that starts at now or later, else the
    last that runs now; null without either."""
    at = now.cast("timestamp_ntz")
    runs = (F.col("starts") <= at) & F.coalesce(F.col("ends") >= at, F.lit(True))
    ahead, running = F.min(F.when(F.col("starts") >= at, F.col("starts"))), F.max(F.when(runs, F.col("starts")))
    known = editions.groupBy("competition_id").agg(F.coalesce(ahead, running).alias("tournament_start"))
    return legs.join(known, "competition_id", "left")


def with_windows(legs: DataFrame, now: Column, tournament_start: Column | None = None) -> DataFrame:
    """Legs with window_start, window_end, after_hour, before_hour, relative and time_unresolved.

    A window anchored at a tournament without a known start is left open. A pick starts at now unless a window says otherwise.
    """
    base = F.when(F.col("anchor") == "tournament", F.lit(None).cast("timestamp_ntz") if tournament_start is None else tournament_start).otherwise(now.cast("timestamp_ntz"))
    window = timewin.date_window(F.col("date_window"), base, now)
    asked = F.col("date_window").isNotNull() & base.isNotNull()
    band = timewin.kickoff(F.col("kickoff"))
    start = F.when(asked, window.start)
    return legs.withColumns(
        {
            "window_start": F.when(F.col("pick_order").isNotNull(), F.coalesce(start, now.cast("timestamp_ntz"))).otherwise(start),
            "window_end": F.when(asked, window.end),
            "after_hour": band.after,
            "before_hour": band.before,
            "relative": band.relative,
            "time_unresolved": (asked & ~window.known) | (F.col("kickoff").isNotNull() & ~band.known),
        }
    )


def settled_legs(legs: DataFrame, settled: DataFrame, cells: DataFrame, players: DataFrame) -> DataFrame:
    """Legs with competition_id, team_ids, player_ids, subject_id and participant_ids (teams, players, and the players' teams)."""
    known = cells.join(settled, "key").where("id IS NOT NULL")
    home = players.select(F.col("id").alias("__player"), F.array_compact(F.array("club_id", "country_team_id")).alias("__teams"))
    rows = known.join(home, (F.col("id") == F.col("__player")) & (F.col("cell") == "player"), "left")
    of = lambda cell: F.array_sort(F.collect_set(F.when(F.col("cell") == cell, F.col("id"))))
    found = rows.groupBy(*LEG).agg(
        F.max(F.when(F.col("cell") == "competition", F.col("id"))).alias("competition_id"),
        of("team").alias("team_ids"),
        of("player").alias("player_ids"),
        F.array_sort(F.collect_set(F.when(F.col("cell").isin("team", "player"), F.struct(F.concat_ws(":", "cell", text.fold(F.col("text"))).alias("k"), F.col("id").alias("v"))))).alias("__by_text"),
        F.array_distinct(F.flatten(F.collect_list("__teams"))).alias("__homes"),
    )
    none = F.array().cast(_IDS)
    joined = legs.join(found, LEG, "left").withColumns({c: F.coalesce(c, none) for c in ("team_ids", "player_ids", "__homes")})
    named = F.concat_ws(":", F.col("subject_kind"), text.fold(F.col("subject_name")))
    return joined.withColumns(
        {
            "subject_id": F.try_element_at(F.filter("__by_text", lambda e: e["k"] == named), F.lit(1))["v"],
            "participant_ids": F.array_distinct(F.concat("team_ids", "player_ids", F.when(F.size("player_ids") > 0, F.col("__homes")).otherwise(none))),
        }
    ).drop("__by_text", "__homes")


def _reworded(ready: DataFrame, cells: DataFrame, decisions: DataFrame, catalog: dict[str, DataFrame], markers: Column) -> DataFrame:
    """(key, phrase, tier, candidates): the cells that a recorded decision words anew, grounded again in their own legs."""
    said = planner.first_of(decisions.where((F.col("pass") == 1) & (F.col("action") == "reexpress")), ["key"], ["phrase"]).select("key", "phrase")
    again = stage(cells.join(said, "key").select("key", *LEG, "cell", "text", "phrase"))
    if again.isEmpty():
        return again.select("key", "phrase").join(cells.select("key", "tier", "candidates").limit(0), "key")
    swaps = again.groupBy(*LEG).agg(F.collect_set(F.struct("cell", "text", "phrase")).alias("__swaps"))
    worded = lambda cell, x: F.coalesce(F.try_element_at(F.filter("__swaps", lambda w: (w["cell"] == cell) & (w["text"] == x)), F.lit(1))["phrase"], x)
    legs = ready.join(swaps, LEG).withColumns(
        {
            "region": worded("region", F.col("region")),
            "competition": worded("competition", F.col("competition")),
            "teams": F.transform("teams", lambda x: worded("team", x)),
            "players": F.transform("players", lambda x: worded("player", x)),
            "subject_player": worded("player", F.col("subject_player")),
        }
    )
    found = grounding.ground_legs(legs.drop("__swaps"), catalog, markers, stage)
    return again.join(found.withColumnRenamed("text", "phrase"), [*LEG, "cell", "phrase"]).select("key", "phrase", "tier", "candidates")


def _combined(bound: DataFrame, fetched: DataFrame, events: DataFrame, kept: DataFrame, chosen: DataFrame, coupons: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(combinations, events that only they name) of each query: coupons of its legs' competitions, else of the groups of what was fetched.

    coupons: coupons(coupon_id, group_id, event_ids, custom, price, tag), refs(coupon_id, outcome_id, offer_id, ord) and outcomes(outcome_id,
    offer_id, event_id, criterion_id, market_label, outcome_label). A coupon without events is none.
    """
    own = bound.where("competition_id IS NOT NULL").select("query_id", F.col("competition_id").alias("group_id")).distinct()
    active = fetched.join(own.select("query_id").distinct(), "query_id", "left_anti").join(events.select("event_id", "group_id"), "event_id").where("group_id IS NOT NULL")
    groups = own.unionByName(active.select("query_id", "group_id").distinct())
    shown = kept.select("query_id", "event_id").distinct()
    picks = chosen.groupBy("query_id").agg(*[F.collect_set(c).alias(f"{c}s") for c in ("outcome_id", "offer_id")], F.collect_set("criterion_id").alias("criterion_ids"))
    none = F.array().cast(_IDS)
    seen = shown.groupBy("query_id").agg(F.collect_set("event_id").alias("shown_ids"))
    offered = coupons["coupons"].where(F.size("event_ids") > 0)
    picked = groups.join(offered.select("coupon_id", "group_id"), "group_id").select("query_id", "coupon_id").distinct().join(picks, "query_id", "left").join(seen, "query_id", "left")
    picked = stage(picked.select("query_id", "coupon_id", *[F.coalesce(c, none).alias(c) for c in ("outcome_ids", "offer_ids", "criterion_ids")], F.coalesce("shown_ids", none).alias("event_ids")))
    scores = combos.score_coupons(coupons["refs"], coupons["outcomes"], picked)
    facts = offered.select("coupon_id", "custom", "price", "tag", F.col("event_ids").alias("__events")).dropDuplicates(["coupon_id"])
    on_shown = F.arrays_overlap("__events", "event_ids").alias("on_shown_event")
    rows = scores.join(picked.select("query_id", "coupon_id", "event_ids"), ["query_id", "coupon_id"]).join(facts, "coupon_id")
    ranked = stage(combos.rank_coupons(rows.select(*scores.columns, "custom", "price", "tag", on_shown)))
    shaped = combos.shape_coupons(ranked, coupons["refs"], coupons["outcomes"], picked)
    ordered = shaped.select("query_id", "place", "coupon_id", "price", "tag", "legs")
    return ordered, combos.combination_events(ranked, coupons["refs"], coupons["outcomes"], shown)


def resolve_stages(
    spark: SparkSession,
    plans: DataFrame,
    catalog: dict[str, DataFrame],
    events: DataFrame,
    outcomes: DataFrame,
    recorded_markets: DataFrame,
    recorded_entities: DataFrame,
    sports: DataFrame,
    now: Column,
    markers: Column,
    coupons: dict[str, DataFrame] | None = None,
    fetches: DataFrame | None = None,
    individual: Column | None = None,
    cap: int | None = None,
    pinned: DataFrame | None = None,
    editions: DataFrame | None = None,
    of_events: tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]] | None = None,
) -> Iterator[tuple[str, dict[str, DataFrame]]]:
    """(stage, tables so far), each as soon as its rows are written; after ``done``, ``envelopes`` holds one answer for each query of plans.

    plans(query_id, plan as JSON); catalog as in grounding; events(event_id, event_name, home_name, away_name, start, state, level, group_id, teams, members);
    outcomes as in select_outcomes() with event_id, offer_id, label, criterion_id, tags and ord; coupons as in _combined();
    fetches as in planner.fetch_flags(), if the data came from requests that may be cut or fail; individual: whether a sport is one of single
    players; cap: the most offers that an answer of the source holds, beyond which fetch.fetch() asks on; pinned(query_id, event_id): fixtures that a
    query names itself; editions(competition_id, starts, ends) as in with_starts(); of_events: how to read the rows of events and of outcomes for given event_ids, from
    a source that can leave out the others before it joins. Recorded decisions are looked up by replay.market_key() and replay.entity_key().

    A plan that can't be read, or holds a leg that no plan may, gets the clarification ``invalid_plan``; one that names nothing
    ``incomplete``; else one of a sport that isn't known ``unsupported_sport``.
    """
    tables: dict[str, DataFrame] = {}
    every = read_plans(plans).withColumn("subject_player", F.when(F.col("subject_kind") == "player", F.col("subject_name")))
    every = stage(every)
    refused = stage(unreadable(plans, every))
    legs = every.join(refused, "query_id", "left_anti")
    open_queries = stage(planner.incomplete(legs).where("incomplete").select("query_id"))
    closed = legs.join(open_queries, "query_id", "left_anti")
    unknown = stage(planner.unsupported(closed.select("query_id", "sport").distinct(), sports))
    ready = stage(closed.join(unknown.select("query_id"), "query_id", "left_anti"))
    yield "resolving", tables
    cells = grounding.ground_legs(ready, catalog, markers, stage)
    cells = stage(cells.withColumn("key", replay.entity_key(F.col("query_id"), F.col("cell"), F.col("text"), F.col("candidates"))))
    tables["cells"] = cells
    settled = stage(replay.settle_entities(cells.select("key", "tier", "candidates").dropDuplicates(["key"]), recorded_entities, _reworded(ready, cells, recorded_entities, catalog, markers)))
    tables["settled"] = settled
    bound = settled_legs(ready, settled, cells.select("key", *LEG, "cell", "text"), catalog["players"])
    if editions is None:
        bound = with_windows(bound, now)
    else:
        bound = with_windows(with_starts(bound, editions, now), now, F.col("tournament_start")).drop("tournament_start")
    bound = bound.withColumn("leg_level", F.coalesce("level", F.lit("fixture"))).drop("level")
    own_name = F.when(F.col("subject_kind").isin("player", "team"), F.col("subject_name"))
    own_side = F.when(F.col("subject_kind") == "either_match_team", F.col("subject_side"))
    bound = bound.withColumns({"own_name": own_name, "own_side": own_side})
    timing = ["window_start", "window_end", "after_hour", "before_hour", "relative", "pick_order", "pick_count"]
    bound = stage(planner.signature(bound, ["own_name", "own_side", "subject_id", "leg_level", "competition_id", "stage", "play_state", *timing], ["team_ids"]))
    tables["legs"] = bound
    yield "routing", tables
    wide = bound.where("leg_level = 'competition'").select("query_id", F.explode("team_ids").alias("owner_id")).distinct()
    squads = planner.squads(catalog["rosters"].join(wide.select("owner_id").distinct(), "owner_id", "left_semi"))
    extra = wide.join(squads, "owner_id").groupBy("query_id").agg(F.collect_set("player_id").alias("__squad"))
    inputs = planner.recall_inputs(bound.withColumns({"level": F.col("leg_level"), "concept": F.col("market_concept")})).join(extra, "query_id", "left")
    inputs = inputs.withColumn("participant_ids", F.array_distinct(F.concat("participant_ids", F.coalesce("__squad", F.array().cast(_IDS)))))
    named = F.array().cast(_IDS)
    if pinned is not None:
        inputs = inputs.join(pinned.groupBy("query_id").agg(F.array_sort(F.collect_set("event_id")).alias("__named")), "query_id", "left")
        named = F.coalesce("__named", named)
    inputs = stage(inputs.withColumn("event_ids", named))
    # the tables of events and outcomes are read here, and written for what any query may reach: all that follows reads that
    ids = fetch.reachable_events(inputs, events)
    near = stage(events.join(whole(ids), "event_id", "left_semi") if of_events is None else of_events[0](ids))
    ids = near.select("event_id")
    outcomes = stage(outcomes.join(whole(ids), "event_id", "left_semi") if of_events is None else of_events[1](ids))
    members = near.select("event_id", F.explode("members").alias("participant_id")).distinct()
    groups_of = near.select("event_id", "group_id")
    if cap is None:
        fetched = planner.recall(inputs, outcomes.select("offer_id", "event_id").distinct().join(groups_of, "event_id"), members)
    else:
        typed = outcomes.select("offer_id", "event_id", F.col("offer_type")).distinct().join(groups_of, "event_id")
        answers_of = fetch.fetch(inputs, typed, near, members, cap)
        fetched, fetches = answers_of["offers"], fetch.flags(answers_of["log"])
        tables["fetches"] = answers_of["log"]
    by_query = stage(fetched.select("query_id", "event_id").distinct())
    asks = planner.first_of(bound, GROUP, ["leg_idx"]).select(*GROUP, "leg_level", "competition_id", "play_state", "team_ids", "own_name", "own_side", "subject_id", *timing)
    asks = stage(asks)
    pairs = asks.drop("own_name", "own_side", "subject_id").join(by_query, "query_id").join(near, "event_id")
    kept = stage(scope.scope_events(pairs, GROUP).select(*GROUP, "event_id"))
    subjects = asks.select(*GROUP, F.col("own_name").alias("subject_name"), F.col("own_side").alias("subject_side"), "subject_id")
    named = F.struct("participant", "participant_id", F.coalesce("english_label", "outcome_label").alias("label"))
    per_offer = outcomes.join(kept.select("event_id").distinct(), "event_id", "left_semi").groupBy("offer_id", "event_id", "label").agg(F.collect_list(named).alias("outcomes"))
    names = near.select("event_id", "event_name", "home_name", "away_name")
    priced = subject.keep_priced(kept.join(per_offer, "event_id").join(names, "event_id").join(subjects, GROUP)).select(*GROUP, "offer_id", "event_id", "label")
    if cap is not None:
        priced = priced.join(fetched.select("query_id", "offer_id"), ["query_id", "offer_id"], "left_semi")
    offered = stage(priced.join(outcomes, ["offer_id", "event_id", "label"]))
    menus = stage(menu.build_menu(offered, GROUP))
    tables["menus"] = menus
    yield "disambiguating", tables
    said_by = bet_phrase(F.col("market_concept"), F.col("subject_kind"), F.lit(False) if individual is None else individual)
    phrases = bound.where("market_concept <> 'main'").select(*LEG, "leg_group", said_by.alias("phrase"))
    shown = menus.groupBy(*GROUP).agg(F.collect_set("label").alias("__menu"))
    key = replay.market_key(F.col("phrase"), F.coalesce("__menu", F.array().cast("array<string>")))
    phrases = stage(phrases.join(shown, GROUP, "left").withColumn("key", key).drop("__menu"))
    picks = stage(replay.pick_markets(phrases, menus.select(*GROUP, "label", "outcome_labels"), recorded_markets, LEG, GROUP))
    mains = offered.where(is_main(F.col("tags")) & F.col("criterion_id").isNotNull()).select(*GROUP, "label").distinct()
    mains = mains.join(bound.where("market_concept = 'main'").select(*LEG, "leg_group"), GROUP)
    chosen = picks.where("label IS NOT NULL").select(*LEG, "leg_group", "label", F.col("outcome_label").alias("outcome_wanted"))
    chosen = chosen.withColumn("only_main", F.lit(False))
    chosen = stage(chosen.unionByName(mains.select(*LEG, "leg_group", "label", F.lit(None).cast("string").alias("outcome_wanted"), F.lit(True).alias("only_main"))))
    tables["picks"] = chosen
    yield "searching", tables
    specs = bound.select(
        *LEG,
        F.coalesce(F.col("line_num").cast("string"), F.col("line_txt")).alias("line_value"),
        F.coalesce("own_name", "own_side").alias("subject"),
        "subject_id",
        "odds_min",
        "odds_max",
        F.lit(None).cast("string").alias("direction"),
        "odds_sort",
        F.col("count").alias("pick_n"),
    )
    teams = near.select("event_id", "home_name", "away_name", F.try_element_at("members", F.lit(1)).alias("__home"), F.try_element_at("members", F.lit(2)).alias("__away"))
    main_offer = is_main(F.col("tags")) & F.col("criterion_id").isNotNull()
    wanted = few(stage(selecting.wishes(chosen.join(specs, LEG))))
    rows = offered.join(wanted, [*GROUP, "label"]).where(~F.col("only_main") | main_offer).drop("only_main").join(teams, "event_id")
    side = F.when(F.col("subject_id") == F.col("__home"), "home").when(F.col("subject_id") == F.col("__away"), "away")
    found = selecting.select_outcomes(rows.withColumn("subject_on", side).drop("__home", "__away"), [*LEG, "label"], ["ord", "outcome_id"])
    found = stage(found)
    tables["selection"] = found
    pool = found.where("in_pool")
    facts = pool.select("query_id", "leg_idx", "outcome_id", "is_selected", "offer_id", "event_id", F.struct("label", "criterion_id", "tags").alias("offer"), F.struct("english_label", "participant", "odds", "line").alias("outcome"))
    placed = facts.join(near.select("event_id", F.struct("event_name", "start", "state").alias("event")), "event_id")
    related = stage(picks.select(*LEG, "leg_group", F.posexplode("related").alias("rank", "label")))
    beside = offered.join(few(related.select(*LEG, "leg_group", "label")), [*GROUP, "label"]).join(pool.select(*LEG, "event_id").distinct(), [*LEG, "event_id"], "left_semi")
    trimmed = stage(selecting.trim_field(beside.join(specs.select(*LEG, "subject", "subject_id"), LEG), [*LEG, "offer_id"], ["ord", "outcome_id"]))
    listed_once = trimmed.select(*LEG, "label", "offer_id").distinct()
    suggested = assemble.suggestions(related.drop("leg_group"), listed_once, pool.select("query_id", "offer_id").distinct()).select(*LEG, "rank", "label", "offer_id")
    shaped = F.array_sort(F.collect_list(F.struct("ord", "outcome_id", F.struct("english_label", "participant", "odds", "line").alias("outcome"))))
    additional = suggested.join(trimmed, [*LEG, "label", "offer_id"]).groupBy("query_id", "rank", "leg_idx", "event_id", "offer_id", "label").agg(shaped.alias("outcomes"))
    told = bound.select(*LEG, "leg_group", "time_unresolved", (F.col("window_start").isNotNull() | F.col("window_end").isNotNull()).alias("has_window"), "other_sports")
    status = found.groupBy(*LEG).agg(F.max("fallback").alias("fallback"), F.bool_or("in_pool").alias("found"))
    on_events = placed.select(*LEG).distinct().withColumn("placed", F.lit(True))
    seen = kept.select(*GROUP).distinct().withColumn("had_fixture", F.lit(True))
    state = told.join(status, LEG, "left").join(on_events, LEG, "left").join(seen, GROUP, "left").join(chosen.select(*LEG).distinct().withColumn("picked", F.lit(True)), LEG, "left")
    if fetches is not None:
        state = state.join(planner.fetch_flags(fetches), "query_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    state = state.select(
        *LEG,
        F.when(F.coalesce("picked", F.lit(False)), "exact").otherwise("none").alias("match"),
        flag("had_fixture"),
        "fallback",
        flag("found"),
        flag("placed"),
        "time_unresolved",
        "has_window",
        "other_sports",
        *[flag(c) if fetches is not None else F.lit(False).alias(c) for c in ("truncated", "failed")],
    )
    unsettled = cells.join(settled.where("id IS NULL"), "key").select("query_id", F.lit("clarification").alias("kind"), "leg_idx", F.col("question").alias("code")).distinct()
    # where nothing is known to fetch, the question is all there is to say
    idle = inputs.where((F.size("participant_ids") == 0) & (F.size("group_ids") == 0) & (F.size("event_ids") == 0)).select("query_id").join(unsettled, "query_id", "left_semi")
    said = assemble.notes(state.join(idle, "query_id", "left_anti")).unionByName(unsettled)
    gates = [(refused, F.col("code")), (unknown, F.lit("unsupported_sport")), (open_queries, F.lit("incomplete"))]
    for rows_of, code in gates:
        said = said.unionByName(rows_of.select("query_id", F.lit("clarification").alias("kind"), F.lit(None).cast("int").alias("leg_idx"), code.alias("code")))
    combinations = others = None
    if coupons is not None:
        combinations, others = _combined(bound, by_query, events, kept, found.where("is_selected"), coupons)
        others = others.join(events.select("event_id", "event_name", "start", "state"), "event_id")
    tables["envelopes"] = assemble.envelopes(placed, additional, said, combinations, plans, others)
    yield "done", tables


def resolve(*inputs, **more) -> dict[str, DataFrame]:
    """All tables of resolve_stages(), whose arguments it takes."""
    tables: dict[str, DataFrame] = {}
    for _, tables in resolve_stages(*inputs, **more):
        pass
    return tables


#: Queries over the test tables: query_id, gate (what they are stopped by), team, competition, play_state, level, market, line, odds_min. Those of OPENING ask for
#: the weekend that their competition's edition opens with.
SAMPLES = [
    ("a1", None, "Customer#000000007", None, None, "fixture", "ECONOMY", 20.5, None),
    ("a2", None, None, "NATION_7", "live", "fixture", "STANDARD", 10.0, 60.0),
    ("a3", None, None, "NATION_12", None, "competition", "main", None, None),
    ("a4", None, "customer 000000011", None, "prematch", "fixture", "MEDIUM", None, 5.0),
    ("a5", None, None, "NATION_20", None, "fixture", "MEDIUM", 33.0, 1000000.0),
    ("a6", None, None, "NATION_5", None, "fixture", "throw-ins", None, None),
    ("a7", None, None, "NATION_9", None, "fixture", "PROMO", None, None),
    ("a8", None, None, "NATION_14", "prematch", "fixture", "STANDARD", None, None),
    ("b1", "unsupported_sport", "Customer#000000007", None, None, "fixture", "ECONOMY", None, None),
    ("b2", "incomplete", None, None, None, "fixture", "ECONOMY", None, None),
    ("b3", "invalid_plan", "Customer#000000007", None, None, "fixture", "ECONOMY", None, None),
    ("b4", "invalid_plan", None, None, None, None, None, None, None),
    ("b5", "which one is meant?", "Nobody United", None, None, "fixture", "ECONOMY", None, None),
]


OPENING = ["a7", "a8"]


def sample_queries(spark: SparkSession) -> DataFrame:
    """(query_id, plan) of SAMPLES: b3 has a soft subject of one kind, b4 isn't JSON."""
    rows = []
    for name, gate, team, competition, state, level, market, line, low in SAMPLES:
        subject_of = {"kind": "soft", "kinds": ["player"]} if name == "b3" else {"kind": "event"}
        leg = {"subject": subject_of, "market_concept": market, "level": level, "teams": [team] if team else [], "competition": competition, "play_state": state}
        leg |= {"line": str(line)} if line is not None else {}
        leg |= {"odds": {"min": low}} if low is not None else {}
        leg |= {"time": {"date_window": "weekend", "anchor": "tournament"}} if name in OPENING else {}
        plan = json.dumps({"status": "ok", "sport": "golf" if gate == "unsupported_sport" else "football", "otherSports": ["tennis"] if name == "a1" else [], "selectors": [leg]})
        rows.append((name, "{not json" if name == "b4" else plan))
    return spark.createDataFrame(rows, "query_id string, plan string")


def _table_events(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """The test tables' events as resolve_stages() takes them; with ids(event_id) only those."""
    return bindings.events(spark, sf_dir, whole, ids).withColumns({"members": F.array("home_id", "away_id").cast(_IDS), "teams": F.col("teams").cast(_IDS)})


def _table_outcomes(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Their outcomes; with ids(event_id) only these events'."""
    return bindings.outcomes(spark, sf_dir, whole, ids).withColumn("ord", F.col("outcome_id"))


def table_inputs(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """(catalog, events, outcomes) of the test tables: nations are competitions, customers teams, suppliers players of the customer of their key.

    Events and outcomes meet large tables, which would pass the driver if they were broadcast.
    """
    nation, customer, supplier = (bindings.read(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    group = lambda c: (F.col(c) + 1000).cast("long")
    none = spark.createDataFrame([], "key string, value string")
    catalog = {
        "groups": nation.select(group("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 100).cast("long").alias("branch")),
        "branches": bindings.read(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("long").alias("id"), F.col("r_name").alias("name")),
        "teams": customer.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.array(group("c_nationkey")).alias("competition_ids"), F.array().cast(_IDS).alias("group_ids"), F.lit(None).cast("string").alias("variant")),
        "players": supplier.select(
            (F.col("s_suppkey") + 1_000_000_000).cast("long").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("long").alias("club_id"), F.lit(None).cast("long").alias("country_team_id"), F.array(group("s_nationkey")).alias("competition_ids")
        ),
        "rosters": customer.select(group("c_nationkey").alias("owner_id"), F.col("c_custkey").cast("long").alias("player_id")),
        "region_aliases": none,
        "competition_aliases": none,
    }
    return catalog, _table_events(spark, sf_dir), _table_outcomes(spark, sf_dir)


def table_editions(events: DataFrame) -> DataFrame:
    """editions(competition_id, starts, ends): a competition's events of one year."""
    known = events.where("group_id IS NOT NULL AND start IS NOT NULL")
    return known.groupBy(F.col("group_id").alias("competition_id"), F.year("start").alias("year")).agg(F.min("start").alias("starts"), F.max("start").alias("ends")).drop("year")


def answer_samples(spark: SparkSession, sf_dir: str, cap: int | None = None, without: tuple[str, ...] = ()) -> Iterator[tuple[str, dict[str, DataFrame]]]:
    """resolve_stages() of SAMPLES (``without`` some) over the test tables, without recorded decisions."""
    catalog, known, offered = table_inputs(spark, sf_dir)
    markets = spark.createDataFrame([], "key string, label string, match string, outcome_label string, related array<string>")
    entities = spark.createDataFrame([], "key string, pass int, action string, id long, phrase string, question string")
    sports, now = spark.createDataFrame([("football",)], "sport string"), F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    markers = F.create_map(F.lit("u21"), F.lit("u21"))
    plans = sample_queries(spark).where(~F.col("query_id").isin(*without)) if without else sample_queries(spark)
    of_events = (lambda ids: _table_events(spark, sf_dir, ids), lambda ids: _table_outcomes(spark, sf_dir, ids))
    return resolve_stages(spark, plans, catalog, known, offered, markets, entities, sports, now, markers, cap=cap, editions=table_editions(known), of_events=of_events)


def answers(spark: SparkSession, sf_dir: str, cap: int | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """What resolve() answers to SAMPLES: one row for each, with the sizes of its results and the selected outcomes."""
    for _, tables in answer_samples(spark, sf_dir, cap, without):
        pass
    offers = F.flatten(F.transform("results", lambda r: r["highlighted"]))
    held = F.flatten(F.transform(offers, lambda h: h["outcomes"]))
    taken = F.transform(F.filter(held, lambda o: o["is_selected"]), lambda o: o["outcome_id"])
    size = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
    return tables["envelopes"].select(
        "query_id", "clarification", F.array_join("notes", ",").alias("notes"), size("events").alias("events"), size(offers).alias("offers"), size(held).alias("outcomes"), size(taken).alias("selected"), F.array_min(taken).alias("first_selected")
    )


def _answers_sql() -> str:
    asked = bindings.values(SAMPLES, "q(query_id, gate, team, comp, play_state, lvl, want, line_num, odds_min)", ["VARCHAR"] * 7 + ["DOUBLE", "DOUBLE"])
    steps = [
        """lg AS (SELECT q.*, c_custkey AS team_id, n_nationkey + 1000 AS comp_id FROM q LEFT JOIN customer ON replace(lower(c_name), '#', ' ') = replace(lower(team), '#', ' ') LEFT JOIN nation ON n_name = comp WHERE gate IS NULL)""",
        """ed AS (SELECT comp_id, date_trunc('day', d) + CASE dayofweek(d) WHEN 6 THEN 0 WHEN 0 THEN -1 ELSE 6 - dayofweek(d) END * INTERVAL 1 DAY AS saturday FROM (
 SELECT group_id AS comp_id, coalesce(min(starts) FILTER (starts >= TIMESTAMP '1998-01-01'), max(starts) FILTER (starts <= TIMESTAMP '1998-01-01' AND ends >= TIMESTAMP '1998-01-01')) AS d
 FROM (SELECT group_id, min(start) AS starts, max(start) AS ends FROM v_event WHERE group_id IS NOT NULL AND start IS NOT NULL GROUP BY group_id, year(start)) GROUP BY 1))""",
        """ev AS (SELECT lg.*, e.event_id, e.level FROM lg LEFT JOIN ed USING (comp_id) JOIN v_event e ON CASE WHEN team IS NOT NULL THEN team_id IN (home_id, away_id) ELSE e.group_id = comp_id END
 WHERE (e.level IS NULL OR e.level = lvl) AND (comp_id IS NULL OR e.group_id IS NULL OR e.group_id = comp_id)
 AND CASE play_state WHEN 'live' THEN state IS DISTINCT FROM 'NOT_STARTED' WHEN 'prematch' THEN state IS NOT DISTINCT FROM 'NOT_STARTED' ELSE true END AND (lvl <> 'fixture' OR team_id IS NULL OR len(teams) = 0 OR list_contains(teams, team_id))
 AND (query_id NOT IN ('a7', 'a8') OR saturday IS NULL OR start IS NULL OR (start >= saturday - INTERVAL 6 HOUR AND start < saturday + INTERVAL 2 DAY)))""",
        "ofr AS (SELECT query_id, want, line_num, odds_min, o.* FROM ev JOIN v_outcome o USING (event_id))",
        "pk AS (SELECT DISTINCT query_id, label FROM ofr WHERE criterion_id IS NOT NULL AND CASE WHEN want = 'main' THEN list_contains(tags, 'MAIN') ELSE label = want END)",
        """rw AS (SELECT *, odds IS NULL OR odds_min IS NULL OR odds / 1000.0 >= odds_min AS pool, CASE WHEN sided >= 2 AND smin = smax AND kind = 'OT_TWO' THEN -line / 1000.0 ELSE line / 1000.0 END AS eff FROM (
 SELECT ofr.*, count(CASE WHEN kind = 'OT_TWO' THEN line END) OVER w AS sided, min(CASE WHEN kind = 'OT_TWO' THEN line END) OVER w AS smin, max(CASE WHEN kind = 'OT_TWO' THEN line END) OVER w AS smax FROM ofr JOIN pk USING (query_id, label)
 WHERE want <> 'main' OR (list_contains(tags, 'MAIN') AND criterion_id IS NOT NULL) WINDOW w AS (PARTITION BY query_id, label, offer_id)))""",
        """sl AS (SELECT *, (line_num IS NULL OR any_line) AND pool AND n = 1 AS taken, pool AND (line_num IS NULL OR any_line) AS shown FROM (SELECT *, bool_or(pool AND eff IS NOT NULL) OVER (PARTITION BY query_id, label) AS any_line,
 row_number() OVER (PARTITION BY query_id, label, pool ORDER BY CASE WHEN line_num IS NULL THEN 0 WHEN eff IS NULL THEN 2 WHEN eff = line_num THEN 0 ELSE 1 END, abs(eff - line_num) NULLS LAST, outcome_id) AS n FROM rw))""",
        """ag AS (SELECT query_id, count(DISTINCT event_id) FILTER (WHERE shown) AS events, count(DISTINCT offer_id) FILTER (WHERE shown) AS offers, count(*) FILTER (WHERE shown) AS outcomes, count(*) FILTER (WHERE taken) AS selected, min(outcome_id) FILTER (WHERE taken) AS first_selected,
 CASE WHEN NOT bool_or(pool) THEN 'odds_absent' WHEN any_value(line_num) IS NOT NULL AND NOT bool_or(any_line) THEN 'line_absent' END AS missing FROM sl GROUP BY 1)""",
    ]
    body = """SELECT q.query_id, CASE WHEN q.gate IS NOT NULL THEN q.gate WHEN q.query_id NOT IN (SELECT query_id FROM ev) THEN 'no_fixture' WHEN q.query_id NOT IN (SELECT query_id FROM pk) THEN 'no_market' END AS clarification,
 CASE WHEN q.gate IS NOT NULL THEN '' ELSE array_to_string(list_sort(list_filter([missing, CASE WHEN q.query_id = 'a1' THEN 'other_sports' END], lambda x: x IS NOT NULL)), ',') END AS notes,
 coalesce(events, 0) AS events, coalesce(offers, 0) AS offers, coalesce(outcomes, 0) AS outcomes, coalesce(selected, 0) AS selected, first_selected FROM q LEFT JOIN ag USING (query_id)"""
    return bindings.sql(body, bindings.EVENTS, bindings.OUTCOMES, asked, *steps)


ANSWERS_SQL = _answers_sql()


#: (query_id, leg_idx, label, line, odds_min) for the legs of bindings.LEGS.
ASKED = [("q1", 0, "ECONOMY", 20.5, 5.0), ("q1", 1, "PROMO", 2.0, None), ("q2", 0, "STANDARD", 30.0, 60.0), ("q3", 0, "MEDIUM", 10.0, None), ("q4", 0, "SMALL — ring", 25.0, 1.8), ("q5", 0, "ECONOMY", 7.0, 90.0), ("q6", 0, "LARGE — bolt", 12.0, None)]
_ASKED_SCHEMA = "query_id string, leg_idx int, label string, line_num double, odds_min double"


def sample_plans(spark: SparkSession) -> DataFrame:
    """The markets, lines and prices asked for."""
    return spark.createDataFrame(ASKED, _ASKED_SCHEMA)


def next_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leg: its fixtures, the market's outcomes that are priced high enough, and the one with the nearest line."""
    kept = scope.scope_events(bindings.leg_events(spark, sf_dir), LEG).select(*LEG, "event_id", "home_name", "away_name")
    none = lambda kind: F.lit(None).cast(kind)
    asked = sample_plans(spark).withColumn("line_value", F.col("line_num").cast("string")).drop("line_num")
    asked = asked.withColumns({"outcome_wanted": none("string"), "subject": none("string"), "subject_id": none("long"), "subject_on": none("string"), "odds_max": none("double"), "direction": none("string"), "odds_sort": none("string"), "pick_n": none("int")})
    rows = kept.join(F.broadcast(selecting.wishes(asked)), LEG).join(bindings.outcomes(spark, sf_dir), ["event_id", "label"])
    found = selecting.select_outcomes(rows.withColumn("offer_type", F.lit(11)), LEG, ["outcome_id"])
    return found.groupBy(*LEG, "label").agg(
        F.count("*").alias("outcomes"),
        F.count_if("in_pool").alias("pool"),
        F.max("fallback").alias("fallback"),
        F.max(F.when(F.col("is_selected"), F.col("outcome_id"))).alias("outcome_id"),
        F.max(F.when(F.col("is_selected"), F.col("event_id"))).alias("event_id"),
        F.max("chosen_line").alias("chosen_line"),
    )


def _oracle() -> str:
    from lattiq.plans.event_queries import _PAIRS, _SCOPED

    asked = bindings.values(ASKED, "a(query_id, leg_idx, label, line_num, odds_min)", ["VARCHAR", "INTEGER", "VARCHAR", "DOUBLE", "DOUBLE"])
    body = """SELECT query_id, leg_idx, label, count(*) AS outcomes, CAST(coalesce(sum(CASE WHEN pool AND any_line THEN 1 ELSE 0 END), 0) AS BIGINT) AS pool,
 CASE WHEN NOT bool_or(pool) THEN 'odds-absent' WHEN NOT bool_or(pool AND eff IS NOT NULL) THEN 'line-absent' END AS fallback, max(CASE WHEN pool AND any_line AND n = 1 THEN outcome_id END) AS outcome_id,
 max(CASE WHEN pool AND any_line AND n = 1 THEN event_id END) AS event_id, max(CASE WHEN pool AND any_line AND n = 1 THEN eff END) AS chosen_line FROM (
 SELECT *, bool_or(pool AND eff IS NOT NULL) OVER (PARTITION BY query_id, leg_idx) AS any_line, row_number() OVER (PARTITION BY query_id, leg_idx, pool ORDER BY CASE WHEN eff IS NULL THEN 2 WHEN eff = line_num THEN 0 ELSE 1 END, abs(eff - line_num) NULLS LAST, outcome_id) AS n FROM (
 SELECT *, odds IS NULL OR odds_min IS NULL OR odds / 1000.0 >= odds_min AS pool, CASE WHEN sided >= 2 AND smin = smax AND kind = 'OT_TWO' THEN -line / 1000.0 ELSE line / 1000.0 END AS eff FROM (
 SELECT s.query_id, s.leg_idx, a.label, a.line_num, a.odds_min, o.event_id, o.outcome_id, o.odds, o.line, o.kind, count(CASE WHEN kind = 'OT_TWO' THEN line END) OVER w AS sided, min(CASE WHEN kind = 'OT_TWO' THEN line END) OVER w AS smin,
 max(CASE WHEN kind = 'OT_TWO' THEN line END) OVER w AS smax FROM scoped s JOIN a USING (query_id, leg_idx) JOIN v_outcome o ON o.event_id = s.event_id AND o.label = a.label WINDOW w AS (PARTITION BY s.query_id, s.leg_idx, o.offer_id)))) GROUP BY 1, 2, 3"""
    return bindings.sql(body, bindings.EVENTS, bindings.OUTCOMES, bindings.LEGS_SQL, _PAIRS, _SCOPED, asked)


ORACLE = _oracle()
