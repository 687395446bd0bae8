"""Queries over events and outcomes: projections, filters, windows, menus, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.functions import offering, timewin
from lattiq.operators import assemble, grounding, menu, planner, scope, selecting, subject
from lattiq.plans.bindings import EVENTS, FOLD, LEGS_SQL, OUTCOMES, events, leg_events, outcomes, query, read, sql, values

LEG = ["query_id", "leg_idx"]
_PAIRS = "p AS (SELECT * FROM v_leg JOIN v_event USING (recall_group))"
_IDS = "query_id, leg_idx, event_id"


def _ids(df: DataFrame) -> DataFrame:
    return df.select(*LEG, "event_id")


@query(sql("SELECT outcome_id, label FROM v_outcome", OUTCOMES))
def prj_market_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes(spark, sf_dir)
    return rows.select("outcome_id", offering.market_label(F.col("market"), F.lit("other"), F.col("variant")).alias("label"))


@query(sql("SELECT event_id, level FROM v_event", EVENTS))
def prj_level_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", offering.event_level(F.col("tags")).alias("level"))


@query(sql("SELECT outcome_id, line / 1000.0 AS line, odds / 1000.0 AS odds FROM v_outcome", OUTCOMES))
def prj_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).select("outcome_id", offering.decimal(F.col("line")).alias("line"), offering.decimal(F.col("odds")).alias("odds"))


@query(sql("SELECT outcome_id, CASE kind WHEN 'OT_OVER' THEN 'over' WHEN 'OT_UNDER' THEN 'under' WHEN 'OT_UNTYPED' THEN CASE WHEN lower(shown) IN ('over', 'under', 'yes', 'no') THEN lower(shown) END END AS direction FROM (SELECT *, CASE WHEN participant_id % 3 = 0 THEN 'YES' ELSE english_label END AS shown FROM v_outcome)", OUTCOMES))
def prj_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("participant_id") % 3 == 0, "YES").otherwise(F.col("english_label"))
    return outcomes(spark, sf_dir).select("outcome_id", offering.direction(F.col("kind"), shown, F.col("outcome_label")).alias("direction"))


@query(sql("SELECT event_id, CASE state WHEN 'STARTED' THEN 'LIVE' WHEN 'FINISHED' THEN 'FINISHED' ELSE 'PREMATCH' END AS state FROM v_event", EVENTS))
def prj_live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", offering.live_state(F.col("state")).alias("state"))


@query(sql("SELECT outcome_id, list_contains(tags, 'MAIN') AS main, participant IS NOT NULL AND participant <> english_label AS named FROM v_outcome", OUTCOMES))
def prj_main_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = offering.is_named(F.col("participant"), F.col("english_label"), F.col("outcome_label"))
    return outcomes(spark, sf_dir).select("outcome_id", offering.is_main(F.col("tags")).alias("main"), named.alias("named"))


@query(sql("SELECT event_id, coalesce(CAST(start AS VARCHAR), '') AS start, CASE state WHEN 'STARTED' THEN 'LIVE' WHEN 'FINISHED' THEN 'FINISHED' ELSE 'PREMATCH' END AS state, event_id AS id, home_name AS first_name, CASE WHEN event_id % 2 = 0 THEN 'TEAM' ELSE 'UNKNOWN' END AS first_type, CASE WHEN event_id % 3 <> 0 THEN home_name END AS first_english FROM v_event", EVENTS))
def prj_mappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = F.struct(
        F.col("home_id").alias("participantId"),
        F.col("home_name").alias("name"),
        F.when(F.col("event_id") % 3 != 0, F.col("home_name")).otherwise("").alias("englishName"),
        F.lit(True).alias("home"),
        F.when(F.col("event_id") % 2 == 0, "TEAM").otherwise("CLUB").alias("participantType"),
    )
    shape = F.struct(
        F.col("event_id").alias("id"),
        F.col("event_name").alias("name"),
        F.col("home_name").alias("homeName"),
        F.col("away_name").alias("awayName"),
        F.col("start").cast("string").alias("start"),
        F.lit(None).cast("string").alias("group"),
        F.lit("SPORT").alias("sport"),
        F.col("tags"),
        F.array(member).alias("participants"),
        F.col("state"),
    )
    row = events(spark, sf_dir).select("event_id", shape.alias("e")).select("event_id", offering.event_row(F.col("e")).alias("e"))
    first = F.col("e.participants")[0]
    return row.select("event_id", "e.start", "e.state", F.col("e.id").alias("id"), first["name"].alias("first_name"), first["participantType"].alias("first_type"), first["englishName"].alias("first_english"))


@query(sql(f"SELECT {_IDS} FROM p WHERE (level IS NULL OR level = leg_level) AND (competition_id IS NULL OR group_id IS NULL OR group_id = competition_id) AND CASE play_state WHEN 'prematch' THEN coalesce(state = 'NOT_STARTED', false) WHEN 'live' THEN coalesce(state <> 'NOT_STARTED', true) ELSE true END", EVENTS, LEGS_SQL, _PAIRS))
def flt_grain_comp_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = leg_events(spark, sf_dir)
    rows = rows.where(scope.right_grain(F.col("level"), F.col("leg_level"))).where(scope.right_competition(F.col("group_id"), F.col("competition_id")))
    return _ids(rows.where(scope.right_state(F.col("state"), F.col("play_state"))))


@query(sql(f"SELECT {_IDS} FROM p WHERE leg_level <> 'fixture' OR ((start IS NULL OR (coalesce(start >= window_start, true) AND coalesce(start <= window_end, true))) AND (len(teams) = 0 OR list_has_all(teams, team_ids)))", EVENTS, LEGS_SQL, _PAIRS))
def flt_match_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = timewin.within(F.col("start"), F.col("window_start"), F.col("window_end")) & scope.all_teams(F.col("team_ids"), F.col("teams"))
    return _ids(leg_events(spark, sf_dir).where((F.col("leg_level") != "fixture") | bound))


@query(sql("SELECT event_id FROM v_event WHERE len(teams) = 0 OR list_has_all(teams, [event_id % 100, (event_id % 100 + 7) % 100])", EVENTS))
def flt_all_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.array((F.col("event_id") % 100), ((F.col("event_id") % 100 + 7) % 100))
    return events(spark, sf_dir).where(scope.all_teams(named, F.col("teams"))).select("event_id")


@query(sql("SELECT event_id FROM v_event WHERE start IS NULL OR (start >= TIMESTAMP '1997-03-01' AND start <= TIMESTAMP '1998-03-01')", EVENTS))
def flt_date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return events(spark, sf_dir).where(timewin.within(F.col("start"), at("1997-03-01"), at("1998-03-01"))).select("event_id")


@query("SELECT event_id FROM events WHERE event_id % 13 = 0 OR (hour(ts) >= 12 AND hour(ts) < 18)")
def flt_hour_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("event_id") % 13 != 0, F.col("ts"))
    return read(spark, sf_dir, "events").where(timewin.in_hours(start, F.lit(12), F.lit(18))).select("event_id")


@query("SELECT event_id, hour(ts) = max(hour(ts)) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS late, hour(ts) = min(hour(ts)) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS early FROM events")
def flt_late_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = lambda word: scope.right_hour_of_day(F.col("ts"), F.lit(word), ["user_id"])
    return read(spark, sf_dir, "events").select("event_id", on("late").alias("late"), on("early").alias("early"))


_OFFERS = f"""o AS (SELECT v.offer_id, v.event_id, any_value(v.label) AS label, any_value(event_name) AS event_name, any_value(home_name) AS home_name, any_value(away_name) AS away_name,
 bool_or(participant_id = home_id % 100) AS by_id, bool_or(contains({FOLD.format("coalesce(participant, '')")}, {FOLD.format("'Supplier#00000' || lpad(CAST(v.event_id % 100 AS VARCHAR), 4, '0')")})
 OR contains({FOLD.format('english_label')}, {FOLD.format("'Supplier#00000' || lpad(CAST(v.event_id % 100 AS VARCHAR), 4, '0')")})) AS by_name FROM v_outcome v JOIN v_event USING (event_id) GROUP BY 1, 2)"""


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = outcomes(spark, sf_dir).select("offer_id", "event_id", "label", "participant", "participant_id", "english_label")
    listed = own.groupBy("offer_id", "event_id").agg(
        F.min("label").alias("label"), F.collect_list(F.struct("participant", "participant_id", F.col("english_label").alias("label"))).alias("outcomes")
    )
    return listed.join(events(spark, sf_dir), "event_id")


@query(sql("SELECT offer_id, by_name AS kept_by_name FROM o", EVENTS, OUTCOMES, _OFFERS))
def flt_subject_homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Supplier#00000"), F.lpad((F.col("event_id") % 100).cast("string"), 4, "0"))
    rows = _offers(spark, sf_dir)
    priced = subject.prices_subject(F.col("outcomes"), F.col("label"), F.col("event_name"), F.col("home_name"), F.col("away_name"), subject.fold(name), F.lit(None).cast("long"))
    return rows.select("offer_id", priced.alias("kept_by_name"))


@query(sql("SELECT DISTINCT offer_id, event_id % 3 = 0 AS kept FROM v_outcome JOIN v_event USING (event_id) WHERE home_id <> away_id", EVENTS, OUTCOMES))
def flt_opponent_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _offers(spark, sf_dir).where("home_id <> away_id")
    label = F.when(F.col("event_id") % 3 == 0, F.concat("home_name", F.lit(" wins"))).otherwise(F.concat("away_name", F.lit(" wins")))
    priced = subject.prices_subject(F.col("outcomes"), label, F.col("event_name"), F.col("home_name"), F.col("away_name"), subject.fold(F.col("home_name")), F.lit(None).cast("long"))
    return rows.select("offer_id", priced.alias("kept"))


@query(sql("SELECT outcome_id, odds IS NULL OR (odds / 1000.0 >= 20 AND odds / 1000.0 <= 60) AS kept FROM v_outcome", OUTCOMES))
def flt_odds_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).select("outcome_id", selecting.within_odds(F.col("odds"), F.lit(20.0), F.lit(60.0)).alias("kept"))


@query(sql("SELECT outcome_id, CASE WHEN offer_id % 2 = 0 THEN participant_id = offer_id % 100 WHEN offer_id % 3 = 0 THEN contains(coalesce(lower(replace(participant, '#', ' ')), ''), 'supplier 00000000') ELSE true END AS own FROM v_outcome", OUTCOMES))
def flt_subject_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.when(F.col("offer_id") % 2 == 0, F.col("offer_id") % 100)
    name = F.when(F.col("offer_id") % 3 == 0, "Supplier 00000000").otherwise("home")
    own = subject.outcome_is_subjects(F.col("participant"), F.col("participant_id"), wanted, name)
    return outcomes(spark, sf_dir).select("outcome_id", own.alias("own"))


@query(sql("SELECT outcome_id, kind = 'OT_UNTYPED' AND participant <> english_label AND event_id % 2 = 0 OR (kind = 'OT_TWO' AND event_id % 2 = 1) AS on_side FROM v_outcome", OUTCOMES))
def flt_relational_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_id") % 2 == 0, "home").otherwise("away")
    home = F.when(F.col("event_id") % 2 == 0, F.col("participant"))
    own = subject.on_side(side, F.col("kind"), F.col("english_label"), F.col("outcome_label"), F.col("participant"), home, F.lit(None).cast("string"))
    return outcomes(spark, sf_dir).select("outcome_id", own.alias("on_side"))


_TOLD = "kind = 'OT_UNTYPED' AND (participant IS DISTINCT FROM english_label)"


@query(sql(f"SELECT outcome_id, {_TOLD} AS told FROM v_outcome", OUTCOMES))
def flt_meaningful_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = offering.is_meaningful(F.col("kind"), F.col("participant"), F.col("english_label"), F.col("outcome_label"))
    return outcomes(spark, sf_dir).select("outcome_id", told.alias("told"))


@query("SELECT o_orderkey, count(*) AS returned, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 > count(*) ELSE count(*) >= 2000 END AS truncated FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def flt_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("returned"))
    rows = rows.join(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    total = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 7)
    return rows.select("o_orderkey", "returned", offering.truncated(total, F.col("returned")).alias("truncated"))


@query("SELECT l_orderkey AS query_id, NOT bool_or(l_partkey % 5 = 0 OR l_partkey % 7 = 0 OR l_suppkey % 9 = 0 OR l_suppkey % 11 = 0 OR (l_linenumber = 3 AND l_returnflag = 'R')) AS incomplete FROM lineitem GROUP BY 1")
def flt_incomplete_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as queries, their items as legs, which name something or hold nulls and empty texts by rule."""
    part, supplier, none = F.col("l_partkey"), F.col("l_suppkey"), F.array().cast("array<string>")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"),
        F.when(part % 5 == 0, F.array(F.lit("A"))).when(part % 2 == 0, none).alias("teams"),
        F.when(part % 7 == 0, F.array(F.lit("B"))).when(part % 3 == 0, none).alias("players"),
        F.when(supplier % 9 == 0, "Cup").when(supplier % 2 == 0, "").alias("competition"),
        F.when(supplier % 11 == 0, "Land").when(supplier % 3 == 0, "").alias("region"),
        F.when((F.col("l_linenumber") == 3) & (F.col("l_returnflag") == "R"), F.col("l_returnflag")).alias("subject_player"),
    )
    return planner.incomplete(rows)


@query("SELECT c_custkey, c_mktsegment AS sport FROM customer WHERE c_mktsegment NOT IN ('FURNITURE', 'MACHINERY')")
def flt_sport_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sports = spark.createDataFrame([("FURNITURE",), ("MACHINERY",)], "sport string")
    plans = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("sport"))
    return planner.unsupported(plans, sports).select("c_custkey", "sport")


def _picks(order: str, count: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = events(spark, sf_dir).withColumns({"pick_order": F.lit(order), "pick_count": F.lit(count)})
        return scope.pick_fixtures(rows, ["home_id"]).select("home_id", "event_id")

    return run


_PICK = "SELECT home_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY home_id ORDER BY start {0}, event_id {0}) AS n FROM v_event WHERE start IS NOT NULL) WHERE n <= {1}"
for _name, _order, _sort, _n in (("win_fixture_pick_first", "earliest", "ASC", 2), ("win_fixture_pick_last", "latest", "DESC", 3)):
    _function = _picks(_order, _n)
    _function.__name__ = _name
    query(sql(_PICK.format(_sort, _n), EVENTS))(_function)


@query(sql("SELECT event_id, outcome_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY CASE WHEN line IS NULL THEN 2 WHEN line / 1000.0 = 20.0 THEN 0 ELSE 1 END, abs(line / 1000.0 - 20.0) NULLS LAST, outcome_id) AS n FROM v_outcome) WHERE n = 1", OUTCOMES))
def win_nearest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = selecting.nearest_line(offering.decimal(F.col("line")), F.lit(20.0), ["event_id"], ["outcome_id"])
    return outcomes(spark, sf_dir).withColumn("n", place).where("n = 1").select("event_id", "outcome_id")


@query(sql("SELECT event_id, outcome_id, n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY event_id ORDER BY odds DESC NULLS LAST, outcome_id) AS INTEGER) AS n FROM v_outcome) WHERE n <= 3", OUTCOMES))
def win_field_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = selecting.by_price(F.col("odds"), F.lit("high"), ["event_id"], ["outcome_id"])
    return outcomes(spark, sf_dir).withColumn("n", place).where("n <= 3").select("event_id", "outcome_id", "n")


_TRIM = """SELECT criterion, outcome_id FROM (SELECT *, bool_or(named) OVER w AS any_named, bool_or(line IS NOT NULL) OVER w AS any_line,
 row_number() OVER (PARTITION BY criterion ORDER BY odds NULLS LAST, outcome_id) AS n FROM (SELECT *, participant IS NOT NULL AND participant <> english_label AS named, participant_id AS criterion FROM v_outcome
 WHERE CASE participant_id % 3 WHEN 0 THEN true WHEN 1 THEN kind <> 'OT_UNTYPED' ELSE kind <> 'OT_UNTYPED' AND line IS NULL END) WINDOW w AS (PARTITION BY criterion))
 WHERE CASE WHEN any_named THEN participant_id = criterion AND outcome_id % 2 = 0 WHEN any_line THEN true ELSE n <= 8 END"""


@query(sql(_TRIM, OUTCOMES))
def win_trim_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("participant_id") % 3
    typed = F.col("kind") != "OT_UNTYPED"
    rows = outcomes(spark, sf_dir).where(F.when(k == 0, True).when(k == 1, typed).otherwise(typed & F.col("line").isNull()))
    rows = rows.withColumns({"criterion": F.col("participant_id"), "subject": F.lit(None).cast("string"), "subject_id": F.lit(1)})
    rows = rows.withColumn("participant_id", F.when(F.col("outcome_id") % 2 == 0, 1).otherwise(0))
    return selecting.trim_field(rows, ["criterion"], ["outcome_id"]).select("criterion", "outcome_id")


_RELATED = [("q1", 0, 0, "ECONOMY"), ("q1", 0, 1, "PROMO"), ("q1", 1, 0, "ECONOMY"), ("q1", 1, 1, "STANDARD"), ("q1", 1, 2, "MEDIUM"), ("q2", 0, 0, "none such"), ("q2", 0, 1, "MEDIUM"), ("q2", 0, 2, "PROMO")]
_RELATED_SQL = values(_RELATED, "r(query_id, leg_idx, rank, label)", ["VARCHAR", "INTEGER", "INTEGER", "VARCHAR"])


@query(sql("""SELECT query_id, leg_idx, rank, label, offer_id FROM (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY rank, leg_idx) AS place FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id, offer_id ORDER BY rank, leg_idx) AS n FROM (SELECT r.*, o.offer_id FROM r JOIN (SELECT DISTINCT label, offer_id, event_id FROM v_outcome) o ON o.label = r.label
 AND (r.query_id <> 'q1' OR o.event_id % 2 = 0) WHERE o.offer_id % 5 <> 0)) WHERE n = 1) WHERE place <= 3""", OUTCOMES, _RELATED_SQL))
def win_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    related = spark.createDataFrame(_RELATED, "query_id string, leg_idx int, rank int, label string")
    own = outcomes(spark, sf_dir).select("label", "offer_id", "event_id").distinct()
    offers = related.select("query_id", "leg_idx").distinct().join(F.broadcast(related.select("query_id", "leg_idx", "label").distinct()), ["query_id", "leg_idx"])
    offers = own.join(F.broadcast(offers), "label").where("query_id <> 'q1' OR event_id % 2 = 0").select("query_id", "leg_idx", "label", "offer_id")
    shown = offers.where("offer_id % 5 = 0").select("query_id", "offer_id").distinct()
    return assemble.suggestions(related, offers, shown).select("query_id", "leg_idx", "rank", "label", "offer_id")


@query(sql(f"""SELECT label, min(offer_id) AS ord, arg_min(event_id, offer_id) AS event_id, CASE WHEN count(DISTINCT CASE WHEN {_TOLD} THEN english_label END) >= 2 THEN
 array_to_string(list_sort(list(DISTINCT english_label) FILTER (WHERE {_TOLD})), ';') END AS labels FROM v_outcome WHERE criterion_id IS NOT NULL GROUP BY 1""", OUTCOMES))
def agg_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes(spark, sf_dir).withColumn("ord", F.col("offer_id"))
    found = menu.build_menu(rows, [])
    return found.select("label", "ord", "event_id", F.array_join("outcome_labels", ";").alias("labels"))


@query(sql("SELECT offer_id, count(CASE WHEN kind IN ('OT_ONE', 'OT_TWO') THEN line END) >= 2 AND min(CASE WHEN kind IN ('OT_ONE', 'OT_TWO') THEN line END) = max(CASE WHEN kind IN ('OT_ONE', 'OT_TWO') THEN line END) AS same FROM (SELECT * REPLACE (line // 20000 AS line) FROM v_outcome) GROUP BY 1", OUTCOMES))
def agg_same_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outcomes(spark, sf_dir).withColumn("line", F.floor(F.col("line") / 20000))
    return rows.groupBy("offer_id").agg(selecting.home_lines().alias("same"))


_FUNNEL = [
    ("a", "ECONOMY", None, None, None, None, None, 5.0, 60.0, None, None, None),
    ("b", "SMALL — ring", "20.5", None, None, None, None, None, None, None, None, None),
    ("c", "PROMO", "2-1", None, None, None, "away", None, None, None, None, None),
    ("d", "MEDIUM", None, None, "Supplier 000000003", None, None, None, None, None, None, None),
    ("e", "STANDARD", None, None, None, 17, None, None, None, "yes", "low", 2),
    ("f", "LARGE — bolt", None, "Over", None, None, None, None, None, None, None, None),
    ("g", "ECONOMY", None, None, None, None, None, None, None, "under", None, None),
    ("h", "MEDIUM", "abc", None, None, None, None, None, None, None, None, None),
    ("i", "STANDARD", None, None, "away", None, None, None, None, None, None, None),
    ("j", "ECONOMY", None, None, None, None, None, 500.0, None, None, None, None),
]
_FUNNEL_SCHEMA = "leg string, label string, line_value string, outcome_wanted string, subject string, subject_id long, subject_on string, odds_min double, odds_max double, direction string, odds_sort string, pick_n int"
_FUNNEL_SQL = values(_FUNNEL, "f(leg, label, line_value, outcome_wanted, subject, subject_id, subject_on, odds_min, odds_max, direction, odds_sort, pick_n)", ["VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR", "VARCHAR", "BIGINT", "VARCHAR", "DOUBLE", "DOUBLE", "VARCHAR", "VARCHAR", "INTEGER"])


def funnel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The legs above with the outcomes of their market, one leg for each event."""
    legs = selecting.wishes(spark.createDataFrame(_FUNNEL, _FUNNEL_SCHEMA))
    names = events(spark, sf_dir).select("event_id", "home_name", "away_name")
    return outcomes(spark, sf_dir).join(F.broadcast(legs), "label").join(names, "event_id")


_SELECT = f"""SELECT leg, event_id, outcome_id, rule, pooled AS in_pool, chosen AS is_selected FROM (
 SELECT *, CASE rule WHEN 'token' THEN tok AND ntok = 1 WHEN 'label' THEN lab AND nlab = 1 WHEN 'outright' THEN byid WHEN 'line' THEN pool AND near = 1 WHEN 'direction' THEN pool AND dirhit AND ndir = 1
 WHEN 'field' THEN pool AND price = 1 WHEN 'plain' THEN pool AND (plain = 1 OR subject IN ('home', 'away') IS TRUE) ELSE false END AS chosen,
 CASE rule WHEN 'token' THEN tok AND ntok = 1 WHEN 'label' THEN lab AND nlab = 1 WHEN 'outright' THEN byid WHEN 'field' THEN pool AND price <= coalesce(pick_n, 2147483647) WHEN 'line' THEN pool WHEN 'direction' THEN pool WHEN 'plain' THEN pool ELSE false END AS pooled FROM (
 SELECT *, CASE WHEN combo THEN CASE WHEN bool_or(tok) OVER w THEN 'token' ELSE 'subject-absent' END WHEN bool_or(lab) OVER w THEN 'label'
 WHEN subject_id IS NOT NULL AND nid = 1 AND line_value IS NULL AND coalesce(direction, 'yes') = 'yes' AND bool_or(byid AND dir IS NULL) OVER w THEN 'outright'
 WHEN NOT bool_or(first) OVER w THEN 'subject-absent' WHEN NOT bool_or(pool) OVER w THEN 'odds-absent'
 WHEN line_value IS NOT NULL THEN CASE WHEN num IS NOT NULL AND bool_or(pool AND eff IS NOT NULL) OVER w THEN 'line' ELSE 'line-absent' END
 WHEN direction IS NOT NULL THEN CASE WHEN bool_or(pool AND dirhit) OVER w THEN 'direction' WHEN NOT bool_or(pool AND dir IS NOT NULL) OVER w AND direction <> 'no' THEN 'field' ELSE 'subject-absent' END ELSE 'plain' END AS rule,
 row_number() OVER (PARTITION BY leg, event_id, tok ORDER BY outcome_id) AS ntok, row_number() OVER (PARTITION BY leg, event_id, lab ORDER BY outcome_id) AS nlab,
 row_number() OVER (PARTITION BY leg, event_id, pool ORDER BY CASE WHEN eff IS NULL THEN 2 WHEN eff = num THEN 0 ELSE 1 END, abs(eff - num) NULLS LAST, outcome_id) AS near,
 row_number() OVER (PARTITION BY leg, event_id, pool ORDER BY CASE WHEN dirhit THEN 0 ELSE 1 END, outcome_id) AS ndir,
 row_number() OVER (PARTITION BY leg, event_id, pool ORDER BY CASE WHEN odds_sort = 'low' THEN odds WHEN odds_sort = 'high' THEN -odds END NULLS LAST, outcome_id) AS price,
 row_number() OVER (PARTITION BY leg, event_id, pool ORDER BY CASE WHEN dir = 'yes' AND NOT has_named THEN 0 ELSE 1 END, outcome_id) AS plain FROM (
 SELECT *, first AND (odds IS NULL OR (coalesce(odds / 1000.0 >= odds_min, true) AND coalesce(odds / 1000.0 <= odds_max, true))) AS pool FROM (
 SELECT *, CASE WHEN subject_id IS NOT NULL THEN CASE WHEN nid > 0 THEN byid ELSE has_yes END WHEN subject = 'away' THEN kind = 'OT_TWO' OR (named AND contains({FOLD.format('participant')}, {FOLD.format('away_name')}))
 WHEN subject IS NOT NULL THEN CASE WHEN has_named THEN contains({FOLD.format("coalesce(participant, '')")}, {FOLD.format('subject')}) ELSE true END ELSE true END AS first FROM (
 SELECT *, count(*) FILTER (WHERE byid) OVER w AS nid, bool_or(dir IS NOT NULL AND dir = 'yes') OVER w AS has_yes, bool_or(named) OVER w AS has_named, coalesce(dir = direction, false) AS dirhit,
 combo AND ((home_score || '-' || away_score) IN (line_value, CASE WHEN subject_on = 'away' THEN '1-2' END) IS TRUE OR lower(english_label) = line_value) AS tok,
 CASE WHEN sided >= 2 AND smin = smax AND (kind = 'OT_TWO' OR english_label = '2') THEN -line / 1000.0 ELSE line / 1000.0 END AS eff FROM (
 SELECT v.*, f.* EXCLUDE (label), e.home_name, e.away_name, CASE kind WHEN 'OT_OVER' THEN 'over' WHEN 'OT_UNDER' THEN 'under' END AS dir, participant IS NOT NULL AND participant <> english_label AS named,
 f.label = 'PROMO' AND line_value IS NOT NULL AS combo, f.label <> 'PROMO' AND coalesce(replace(lower(english_label), ' ', '') = replace(lower(outcome_wanted), ' ', ''), false) AS lab,
 coalesce(participant_id = subject_id, false) AS byid, TRY_CAST(line_value AS DOUBLE) AS num,
 count(CASE WHEN kind = 'OT_TWO' THEN line END) OVER o AS sided, min(CASE WHEN kind = 'OT_TWO' THEN line END) OVER o AS smin, max(CASE WHEN kind = 'OT_TWO' THEN line END) OVER o AS smax
 FROM v_outcome v JOIN f ON f.label = v.label JOIN v_event e ON e.event_id = v.event_id WINDOW o AS (PARTITION BY leg, v.event_id, offer_id)) WINDOW w AS (PARTITION BY leg, event_id))))
 WINDOW w AS (PARTITION BY leg, event_id)))"""


@query(sql(_SELECT, EVENTS, OUTCOMES, _FUNNEL_SQL))
def cmp_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selecting.select_outcomes(funnel_rows(spark, sf_dir), ["leg", "event_id"], ["outcome_id"])
    return found.select("leg", "event_id", "outcome_id", "rule", "in_pool", "is_selected")


_SCOPED = f"""s0 AS (SELECT * FROM p WHERE (level IS NULL OR level = leg_level) AND (competition_id IS NULL OR group_id IS NULL OR group_id = competition_id)
 AND CASE play_state WHEN 'prematch' THEN coalesce(state = 'NOT_STARTED', false) WHEN 'live' THEN coalesce(state <> 'NOT_STARTED', true) ELSE true END AND (leg_level <> 'fixture' OR len(teams) = 0 OR list_has_all(teams, team_ids))),
s1 AS (SELECT *, CASE relative WHEN 'late' THEN hour(start) = max(hour(start)) OVER d WHEN 'early' THEN hour(start) = min(hour(start)) OVER d ELSE true END AS h FROM s0 WINDOW d AS (PARTITION BY query_id, leg_idx, CAST(start AS DATE))),
s2 AS (SELECT * FROM s1 WHERE leg_level <> 'fixture' OR start IS NULL OR (h AND coalesce(start >= window_start, true) AND coalesce(start <= window_end, true) AND coalesce(hour(start) >= after_hour, true) AND coalesce(hour(start) < before_hour, true))),
s3 AS (SELECT *, row_number() OVER (PARTITION BY query_id, leg_idx ORDER BY start NULLS LAST, event_id) AS a, row_number() OVER (PARTITION BY query_id, leg_idx ORDER BY start DESC NULLS LAST, event_id DESC) AS z FROM s2),
scoped AS (SELECT * FROM s3 WHERE leg_level <> 'fixture' OR pick_order IS NULL OR (start IS NOT NULL AND CASE pick_order WHEN 'earliest' THEN a ELSE z END <= pick_count))"""


@query(sql(f"SELECT {_IDS} FROM scoped", EVENTS, LEGS_SQL, _PAIRS, _SCOPED))
def cmp_scope_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(scope.scope_events(leg_events(spark, sf_dir), LEG))


@query(sql("SELECT query_id, leg_idx, label, count(DISTINCT offer_id) AS offers, min(o.offer_id) AS first_offer FROM scoped JOIN v_outcome o USING (event_id) WHERE criterion_id IS NOT NULL GROUP BY 1, 2, 3", EVENTS, OUTCOMES, LEGS_SQL, _PAIRS, _SCOPED))
def cmp_scope_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = scope.scope_events(leg_events(spark, sf_dir), LEG).select(*LEG, "event_id")
    rows = outcomes(spark, sf_dir).withColumn("ord", F.col("offer_id")).join(kept, "event_id")
    found = menu.build_menu(rows, LEG)
    n = rows.where("criterion_id IS NOT NULL").groupBy(*LEG, "label").agg(F.count_distinct("offer_id").alias("offers"))
    return found.join(n, [*LEG, "label"]).select(*LEG, "label", "offers", F.col("ord").alias("first_offer"))


@query("SELECT user_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 3 GROUP BY 1")
def win_squad_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = read(spark, sf_dir, "events").select(F.col("user_id").alias("owner_id"), F.col("event_id").alias("player_id"))
    return planner.squads(members, most=3).groupBy(F.col("owner_id").alias("user_id")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC) AS n FROM lineitem) WHERE n = 1")
def win_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return planner.last_of(rows, ["l_orderkey", "l_linenumber"], ["l_partkey"])


@query("SELECT user_id, event_id, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR value - lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 0.000001 AS clear FROM events")
def win_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", "event_id", grounding.clear_lead(F.col("value"), ["user_id"], ["ts", "event_id"]).alias("clear"))
