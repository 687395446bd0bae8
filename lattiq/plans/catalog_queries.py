"""Queries over the catalog: trees, grounding joins, preparation, sets, aggregates, evaluation, combinations, replay, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions import offering, text
from lattiq.operators import assemble, combos, etl, evaluation, fetch, grounding, menu, planner, replay, scope
from lattiq.plans import pipeline
from lattiq.plans.bindings import EVENTS, FOLD, GROUPS, OUTCOMES, content, events, groups, outcomes, query, read, sql, values
from lattiq.streaming import stages

# ---- sources and trees ----


@query("SELECT event_id, src FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY src) AS n FROM (SELECT event_id, 0 AS src FROM events WHERE user_id % 2 = 0 UNION ALL SELECT event_id, 1 FROM events WHERE user_id % 3 = 0 UNION ALL SELECT event_id, 2 FROM events)) WHERE n = 1")
def src_first_id_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three feeds of which the last holds every event."""
    rows = read(spark, sf_dir, "events")
    feeds = [rows.where(f"user_id % {m} = 0").select(F.col("event_id").alias("id"), F.lit(k).alias("src")) for k, m in ((0, 2), (1, 3), (2, 1))]
    return etl.concat_feeds(feeds).select(F.col("id").alias("event_id"), "src")


@query("SELECT n_nationkey, n_name FROM nation")
def src_wrapped_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattiq.sources import readers

    nation = read(spark, sf_dir, "nation")
    item = F.struct(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    feeds = nation.groupBy((F.col("n_nationkey") % 2).alias("odd")).agg(F.collect_list(item).alias("groups"))
    wrapped = F.when(F.col("odd") == 0, F.to_json(F.struct(F.struct("groups").alias("group")))).otherwise(F.to_json(F.struct("groups")))
    found = readers.unwrap_groups(feeds.select(wrapped.alias("json")))
    return found.select(F.col("id").cast("int").alias("n_nationkey"), F.col("name").alias("n_name"))


_WALK = """w AS (SELECT g.id, g.name, g.parent, CASE WHEN g.parent IS NULL THEN 0 WHEN p.parent IS NULL THEN 1 ELSE 2 END AS depth,
 CASE WHEN g.parent IS NULL THEN NULL WHEN p.parent IS NULL THEN g.id ELSE p.id END AS branch, (SELECT count(*) FROM v_group c WHERE c.parent = g.id) AS child_count FROM v_group g LEFT JOIN v_group p ON p.id = g.parent)"""


@query(sql("SELECT id, CAST(depth AS INTEGER) AS depth, branch, child_count FROM w", GROUPS, _WALK))
def prj_branch_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = etl.walk_tree(spark, groups(spark, sf_dir))
    return walked.select("id", "depth", etl.branch_of(F.col("path")).alias("branch"), "child_count")


@query(sql("SELECT id, CASE WHEN depth = 0 THEN 'group' WHEN name IN ('ASIA', 'EUROPE') OR parent = (SELECT id FROM v_group WHERE name = 'EUROPE') OR contains(name, '(TEST') THEN 'market' WHEN depth = 1 AND child_count > 0 THEN 'group' ELSE 'competition' END AS kind FROM (SELECT w.* REPLACE (CASE WHEN id % 7 = 0 AND name NOT IN ('ASIA', 'EUROPE') THEN name || ' (TEST)' ELSE name END AS name) FROM w)", GROUPS, _WALK))
def prj_node_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region is a bucket, another the root of copies, with all below it."""
    named = F.when(F.col("name") == "ASIA", "Specials").when(F.col("name") == "EUROPE", "Marcatore").when(F.col("id") % 7 == 0, F.concat("name", F.lit(" (TEST)"))).otherwise(F.col("name"))
    return etl.classify(etl.walk_tree(spark, groups(spark, sf_dir)).withColumn("name", named)).select("id", "kind")


@query("SELECT left(sha256(string_agg(h, chr(10) ORDER BY part)), 12) AS version FROM (SELECT part, sha256(string_agg(c_custkey || chr(9) || c_name, chr(10) ORDER BY c_custkey)) AS h FROM (SELECT *, c_custkey // 65536 AS part FROM customer) GROUP BY part)")
def prj_version_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.index_version(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@query("SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'British' WHEN 1 THEN 'American' WHEN 2 THEN 'Guam' WHEN 3 THEN 'Other' ELSE 'Svenska' END AS name FROM nation")
def prj_english_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 5
    one = lambda locale, name: F.struct(F.lit(locale).alias("locale"), F.lit(name).alias("name"))
    swede = one("sv_SE", "Svenska")
    names = F.when(k == 0, F.array(swede, one("en_US", "American"), one("en_GB", "British"))).when(k == 1, F.array(one("en_GU", "Guam"), one("en_US", "American")))
    names = names.when(k == 2, F.array(swede, one("en_GU", "Guam"))).when(k == 3, F.array(swede, one("en_ZZ", "Other"))).otherwise(F.array(swede))
    return read(spark, sf_dir, "nation").select("n_nationkey", offering.english_name(names).alias("name"))


# ---- joins ----


@query("SELECT CAST(1000 + n_nationkey AS BIGINT) AS id, CAST(100 + n_regionkey AS BIGINT) AS branch FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000)")
def jon_semi_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = read(spark, sf_dir, "customer").where("c_acctbal > 5000").select((F.col("c_nationkey") + 1000).cast("long").alias("id")).distinct()
    kept, _ = etl.whitelist(etl.walk_tree(spark, groups(spark, sf_dir)), seen)
    return kept.select("id", "branch")


@query("SELECT DISTINCT o_custkey AS query_id, l_suppkey AS event_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey EXCEPT SELECT o_custkey, o_orderkey % 10 FROM orders")
def jon_anti_leftover(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = read(spark, sf_dir, "orders"), outcomes(spark, sf_dir)
    shaped = orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("coupon_id"))
    shown = orders.select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 10).alias("event_id")).distinct()
    named = items.select("outcome_id", F.col("participant_id").alias("event_id")).distinct()
    return combos.combination_events(shaped, items.select(F.col("event_id").alias("coupon_id"), "outcome_id"), named, shown)


def _players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as players: a club (a supplier), a national team for every third, two competitions."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    return read(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.concat(F.lit("Given"), (k % 40).cast("string"), F.lit(" "), "c_mktsegment", (k % 25).cast("string")).alias("name"),
        (k % 10).alias("club_id"),
        F.when(k % 3 == 0, n + 500).alias("country_team_id"),
        F.array(n + 1000, n % 5 + 1000).alias("competition_ids"),
    )


_PLAYERS = "pl AS (SELECT c_custkey AS id, 'Given' || (c_custkey % 40) || ' ' || c_mktsegment || (c_custkey % 25) AS name, c_custkey % 10 AS club_id, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 500 END AS country_team_id, [c_nationkey + 1000, c_nationkey % 5 + 1000] AS competition_ids FROM customer)"


@query(sql("SELECT CAST(owner_id AS BIGINT) AS owner_id, count(*) AS players, min(player_id) AS first_player FROM (SELECT DISTINCT unnest(CASE WHEN country_team_id IS NULL THEN competition_ids ELSE list_append(competition_ids, country_team_id) END) AS owner_id, id AS player_id FROM pl) GROUP BY 1", _PLAYERS))
def jon_roster_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return etl.rosters(_players(spark, sf_dir)).groupBy("owner_id").agg(F.count("*").alias("players"), F.min("player_id").alias("first_player"))


@query(sql("SELECT CAST(club_id AS VARCHAR) AS context, CAST(id AS BIGINT) AS id FROM (SELECT DISTINCT club_id, unnest(competition_ids) AS id FROM pl)", _PLAYERS))
def jon_allow_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    players = _players(spark, sf_dir)
    found = players.select(F.col("club_id").cast("string").alias("context"), F.array(F.struct("id", F.lit(1.0).alias("score"))).alias("candidates"))
    return grounding.allow_set(found, players)


@query("SELECT c_custkey, list_sort(CASE WHEN c_custkey % 4 = 0 AND c_nationkey < 25 AND n_nationkey IS NOT NULL THEN [1, 1000 + n_nationkey] WHEN c_custkey % 4 = 0 THEN [1] ELSE [1, 2] END)[-1] AS last_group FROM customer LEFT JOIN nation ON n_name = CASE WHEN c_custkey % 8 = 0 THEN 'NATION_' || c_nationkey ELSE c_name END")
def jon_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    clubs = read(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.when(k % 8 == 0, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 4 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("group_ids"),
    )
    countries = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1000).alias("id"), F.col("n_name").alias("name"))
    return etl.backfill_countries(clubs, countries, 1).select(F.col("id").alias("c_custkey"), F.element_at("group_ids", -1).alias("last_group"))


@query("SELECT a.p_partkey AS men, b.p_partkey AS women FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 100 WHERE a.p_partkey % 200 < 100")
def jon_self_twin(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    base = F.concat(F.lit("League "), (F.floor(k / 200) * 200 + k % 100).cast("string"))
    nodes = read(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 200 >= 100, F.concat(base, F.lit(" WOMEN"))).otherwise(base).alias("name"))
    return etl.twins(nodes)


_REGIONS = [("Africa",), ("Far East",), ("asia ",), ("Middle Kingdom",), ("the middle east",), ("Nowhere",)]
_REGION_SQL = values(_REGIONS, "t(text)", ["VARCHAR"])


@query(sql(f"SELECT text, CASE WHEN e.id IS NOT NULL THEN 'confident' WHEN c.id IS NOT NULL THEN CASE WHEN c.cover >= 0.99 THEN 'confident' ELSE 'shortlist' END ELSE 'none' END AS tier, coalesce(e.id, c.id) AS id FROM (SELECT text, CASE WHEN {FOLD.format('text')} = 'far east' THEN 'asia' ELSE {FOLD.format('text')} END AS k FROM t) LEFT JOIN (SELECT 100 + r_regionkey AS id, {FOLD.format('r_name')} AS k FROM region) e USING (k) LEFT JOIN (SELECT 100 + r_regionkey AS id, 'middle kingdom' AS k, ln(6 / 1.5) / (ln(6 / 1.5) + ln(6 / 0.5)) AS cover FROM region WHERE r_name = 'MIDDLE EAST' AND ln(6 / 1.5) / (ln(6 / 1.5) + ln(6 / 0.5)) >= 0.45 UNION ALL SELECT 100 + r_regionkey, 'the middle east', 1.0 FROM region WHERE r_name = 'MIDDLE EAST') c USING (k)", _REGION_SQL))
def jon_region_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    branches = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("id"), F.col("r_name").alias("name"))
    aliases = spark.createDataFrame([("Far-East", "Asia")], "key string, value string")
    found = grounding.ground_regions(spark.createDataFrame(_REGIONS, "text string"), branches, aliases)
    return found.select("text", "tier", F.try_element_at("candidates", F.lit(1))["id"].cast("int").alias("id"))


_TEAMS = [("Supplier#000000003",), ("supplier 000000004",), ("000000007",), ("Supplier",), ("Nobody United",)]
_TEAM_SQL = values(_TEAMS, "t(text)", ["VARCHAR"])


@query(sql(f"SELECT text, CASE WHEN exact > 0 THEN CASE WHEN exact = 1 THEN 'confident' ELSE 'ambiguous' END WHEN part = 1 THEN 'confident' WHEN part > 1 THEN 'shortlist' ELSE 'none' END AS tier, CASE WHEN exact > 0 THEN least(exact, 5) ELSE least(part, 5) END AS n, CASE WHEN exact > 0 THEN exact_id WHEN part > 0 THEN part_id END AS first_id FROM (SELECT text, count(*) FILTER (WHERE {FOLD.format('s_name')} = {FOLD.format('text')}) AS exact, count(*) FILTER (WHERE list_has_all({content('s_name')}, {content('text')})) AS part, min(s_suppkey) FILTER (WHERE {FOLD.format('s_name')} = {FOLD.format('text')}) AS exact_id, min(s_suppkey) FILTER (WHERE list_has_all({content('s_name')}, {content('text')})) AS part_id FROM t, supplier GROUP BY 1)", _TEAM_SQL))
def jon_team_exact_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("variant"))
    markers = F.create_map(F.lit("u21"), F.lit("u21"))
    found = grounding.ground_teams(spark.createDataFrame(_TEAMS, "text string"), teams, markers)
    return found.select("text", "tier", F.size("candidates").cast("long").alias("n"), F.try_element_at("candidates", F.lit(1))["id"].alias("first_id"))


_WHO = [("c1", "Given3 BUILDING3"), ("c1", "Furniture7"), ("c2", "given3 building3"), ("c2", "Mister MACHINERY11"), ("c3", "Nobody"), ("c1", "Given1 MACHINERY1")]
_WHO_SQL = values(_WHO, "t(context, text)", ["VARCHAR", "VARCHAR"])


@query(sql(f"""SELECT context, text, CASE WHEN n IS NULL THEN 'none' WHEN weak AND NOT scoped THEN 'shortlist' WHEN n = 1 THEN 'confident' ELSE 'ambiguous' END AS tier, CASE WHEN n IS NULL THEN 0 ELSE least(n, 5) END AS n, first_id FROM t LEFT JOIN (
 SELECT context, text, bool_or(weak) AS weak, bool_or(inside) AS scoped, CASE WHEN bool_or(inside) THEN count(*) FILTER (WHERE inside) ELSE count(*) END AS n, CASE WHEN bool_or(inside) THEN min(id) FILTER (WHERE inside) ELSE min(id) END AS first_id FROM (
 SELECT *, context = 'c1' AND (club_id = 3 OR coalesce(country_team_id = 503, false)) AS inside, bool_or(NOT weak) OVER (PARTITION BY context, text) AS strong FROM (
 SELECT context, text, id, club_id, country_team_id, {FOLD.format('name')} <> {FOLD.format('text')} AS weak FROM t JOIN pl ON string_split({FOLD.format('name')}, ' ')[-1] = string_split({FOLD.format('text')}, ' ')[-1])) WHERE weak <> strong GROUP BY 1, 2) USING (context, text)""", _PLAYERS, _WHO_SQL))
def jon_player_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = spark.createDataFrame([("c1", 3), ("c1", 503)], "context string, team_id long")
    found = grounding.ground_players(spark.createDataFrame(_WHO, "context string, text string"), _players(spark, sf_dir), scopes)
    return found.select("context", "text", "tier", F.size("candidates").cast("long").alias("n"), F.try_element_at("candidates", F.lit(1))["id"].alias("first_id"))


def _leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand").alias("name"), (F.col("p_size") % 3).cast("long").alias("branch"))


_LEAGUES = "lg AS (SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_brand AS name, CAST(p_size % 3 AS BIGINT) AS branch FROM part)"
_ASKED = [("a", "red widget promo", None), ("b", "Blue ring economy brand 3", 1), ("c", "unknown rod", None), ("d", "gear", 2), ("e", "nothing", None), ("f", "small bolt medium brand 7", 7)]
_ASKED_SQL = values(_ASKED, "t(context, text, branch)", ["VARCHAR", "VARCHAR", "BIGINT"])


@query(sql(f"""SELECT context, text, tier, coalesce(array_to_string(list(id ORDER BY place) FILTER (WHERE place <= 5), ','), '') AS ids FROM (SELECT *, row_number() OVER (PARTITION BY context, text ORDER BY CASE WHEN n_full > 0 THEN size ELSE round(cover, 9) END DESC, CASE WHEN n_full > 0 THEN round(cover, 9) ELSE size END DESC, id) AS place FROM (
 SELECT * FROM (SELECT *, CASE WHEN n_full = 0 THEN 'shortlist' WHEN n_full = 1 THEN 'confident' ELSE 'ambiguous' END AS tier FROM (SELECT *, count(*) FILTER (WHERE cover >= 0.99) OVER w AS n_full, max(cover) OVER w AS best FROM (
 SELECT context, text, lg.id, cover, coalesce(size, 0) AS size FROM (SELECT context, text, id, sum(wt) FILTER (WHERE list_contains(have, tok)) / sum(wt) AS cover, any_value(want_branch) AS want_branch, any_value(branch) AS branch FROM (
 SELECT t.context, t.text, t.branch AS want_branch, lg.id, lg.branch, have, tok, ln(((SELECT count(*) FROM lg) + 1) / (coalesce(df, 0) + 0.5)) AS wt FROM (SELECT *, unnest({content('text')}) AS tok FROM t) t, (SELECT *, {content('name')} AS have FROM lg) lg
 LEFT JOIN (SELECT tok AS dtok, count(*) AS df FROM (SELECT unnest({content('name')}) AS tok FROM lg) GROUP BY 1) ON dtok = tok) GROUP BY 1, 2, 3) c JOIN lg ON lg.id = c.id LEFT JOIN (SELECT l_partkey AS id, count(*) AS size FROM lineitem GROUP BY 1) s ON s.id = lg.id
 WHERE cover > 0 AND (want_branch IS NULL OR want_branch NOT IN (SELECT branch FROM lg) OR c.branch = want_branch)) WINDOW w AS (PARTITION BY context, text))) WHERE CASE WHEN n_full > 0 THEN cover >= 0.99 ELSE best >= 0.45 END)) GROUP BY 1, 2, 3
 UNION ALL SELECT context, text, 'none', '' FROM t WHERE context IN ('c', 'e')""", _LEAGUES, _ASKED_SQL))
def jon_cover_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(_ASKED, "context string, text string, branch long").withColumn("bound", F.lit(False))
    sizes = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("owner_id"), F.col("l_suppkey").alias("player_id"))
    aliases = spark.createDataFrame([], "key string, value string")
    found = grounding.ground_competitions(asked, _leagues(spark, sf_dir), sizes, aliases)
    ids = F.array_join(F.transform("candidates", lambda c: c["id"].cast("string")), ",")
    return found.select("context", "text", "tier", ids.alias("ids"))


# ---- sets ----


_RECALLED = [("u1", [], [3, 7], [1004]), ("u2", [1, 2, 3, 4, 5, 6, 7], [1], [1001]), ("u3", [], [], [1002, 1003]), ("u4", [], [], [])]
_RECALLED_SQL = values(_RECALLED, "u(query_id, event_ids, participant_ids, group_ids)", ["VARCHAR", "BIGINT[]", "BIGINT[]", "BIGINT[]"])


@query(sql("""SELECT query_id, offer_id, route FROM (SELECT *, row_number() OVER (PARTITION BY query_id, offer_id ORDER BY rank) AS n FROM (
 SELECT query_id, offer_id, 0 AS rank, 'event' AS route FROM u JOIN o ON list_contains(event_ids, event_id) UNION ALL
 SELECT query_id, offer_id, 1, 'participant' FROM u JOIN o ON len(event_ids) = 0 AND (list_contains(participant_ids, home_id) OR list_contains(participant_ids, away_id)) UNION ALL
 SELECT query_id, offer_id, 2, 'group' FROM u JOIN o ON len(event_ids) = 0 AND list_contains(group_ids, group_id))) WHERE n = 1""", EVENTS, OUTCOMES, _RECALLED_SQL, "o AS (SELECT DISTINCT offer_id, event_id, home_id, away_id, group_id FROM v_outcome JOIN v_event USING (event_id))"))
def set_union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = spark.createDataFrame(_RECALLED, "query_id string, event_ids array<long>, participant_ids array<long>, group_ids array<long>")
    known = events(spark, sf_dir)
    offers = outcomes(spark, sf_dir).select("offer_id", "event_id").distinct().join(known.select("event_id", "group_id"), "event_id")
    members = known.select("event_id", F.explode(F.array("home_id", "away_id")).alias("participant_id")).distinct()
    return planner.recall(inputs, offers, members).select("query_id", "offer_id", "route")


@query("SELECT o_orderkey AS query_id, o_custkey % 10 AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = o_custkey % 10 AND l_linenumber <= 5)")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 10).alias("id"))
    shown = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("place"))
    return planner.valid_picks(picks, shown, ["query_id"])


@query("SELECT n_name AS sport, n_nationkey AS query_id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_name").alias("sport"))
    known = nation.join(read(spark, sf_dir, "supplier").where("s_acctbal > 5000"), F.col("query_id") == F.col("s_nationkey"), "left_semi").select("sport")
    return planner.unsupported(nation, known)


_ORDERSETS = "st AS (SELECT l_orderkey AS query_id, list(DISTINCT l_suppkey) AS a, list(DISTINCT l_suppkey) FILTER (WHERE l_linenumber > 1) AS b FROM lineitem GROUP BY 1)"


@query(sql("SELECT query_id, CASE WHEN query_id % 9 = 0 AND b IS NULL THEN 'BOTH_EMPTY' WHEN query_id % 9 = 0 THEN 'EMPTY_TO_RESULT' WHEN b IS NULL THEN 'RESULT_TO_EMPTY' WHEN list_sort(a) = list_sort(b) THEN 'MATCH' ELSE 'DRIFT' END AS verdict FROM st", _ORDERSETS))
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(
        F.collect_list("l_suppkey").alias("a"), F.collect_list(F.when(F.col("l_linenumber") > 1, F.col("l_suppkey"))).alias("b")
    )
    was = rows.select("query_id", F.when(F.col("query_id") % 9 != 0, F.col("a")).alias("ids"))
    return evaluation.drift(was, rows.select("query_id", F.col("b").alias("ids")))


@query(sql("SELECT query_id, b IS NULL OR list_has_all(b, list_filter(a, lambda x: x % 2 = 0)) AS held FROM st", _ORDERSETS))
def set_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(
        F.collect_set("l_suppkey").alias("a"), F.collect_set(F.when(F.col("l_linenumber") > 1, F.col("l_suppkey"))).alias("b")
    )
    return rows.select("query_id", scope.all_teams(F.filter("a", lambda x: x % 2 == 0), F.col("b")).alias("held"))


# ---- aggregates ----


@query(sql(f"SELECT tok AS token, count(*) AS df, round(ln(((SELECT count(*) FROM part) + 1) / (count(*) + 0.5)), 6) AS idf FROM (SELECT unnest({content('name')}) AS tok FROM lg) GROUP BY 1", _LEAGUES))
def agg_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _leagues(spark, sf_dir)
    n = names.agg(F.count("*").alias("n"))
    return menu.lexicon(names, "name", ["id"]).join(F.broadcast(n)).select("token", "df", F.round(text.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(sql("SELECT id, CAST(country AS BIGINT) AS country FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, first, country) AS n FROM (SELECT s_suppkey AS id, 1000 + c_nationkey AS country, count(*) AS votes, min(o_orderkey) AS first FROM (SELECT DISTINCT l_suppkey AS s_suppkey, l_orderkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)) WHERE n = 1"))
def agg_vote_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every nation is a country and gets a competition below it, which its customers' orders play in
    tree = groups(spark, sf_dir)
    leaves = tree.where("id >= 1000").select((F.col("id") + 1000).alias("id"), F.concat("name", F.lit(" League")).alias("name"), F.col("id").alias("parent"))
    lifted = tree.where("id >= 1000").select("id", "name", F.lit(1).cast("long").alias("parent"))
    nodes = etl.classify(etl.walk_tree(spark, tree.where("id = 1").unionByName(lifted).unionByName(leaves)))
    pairs = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_orderkey").alias("event_id")).distinct()
    members = pairs.join(events(spark, sf_dir).select("event_id", "recall_group"), "event_id").select("id", (F.col("recall_group") + 1000).alias("competition_id"), F.col("event_id").alias("ord"))
    return etl.home_country(members, nodes).select("id", "country")


@query("SELECT min(c_custkey) AS id, list_aggregate(list_sort(list_distinct(flatten(list([c_nationkey, c_custkey % 4])))), 'string_agg', ',') AS competitions FROM customer GROUP BY c_mktsegment, c_nationkey % 3")
def agg_keeper_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), (F.col("c_nationkey") % 3).alias("part"), F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 4).alias("competition_ids")
    )
    merged = etl.merge_keepers(rows, [F.col("name"), F.col("part")], ["competition_ids"])
    return merged.select("id", F.array_join(F.transform("competition_ids", lambda x: x.cast("string")), ",").alias("competitions"))


_UNANIMOUS = "SELECT query_id, list_aggregate(list_sort(list_distinct(flatten(list(ids)))), 'string_agg', ',') AS participants, CASE WHEN count(DISTINCT st) = 1 AND count(st) = count(*) THEN max(st) END AS play_state, bool_and(main) AS main_only FROM (SELECT o_custkey % 300 AS query_id, [o_custkey, o_orderkey % 10] AS ids, CASE o_orderstatus WHEN 'O' THEN 'prematch' WHEN 'P' THEN 'live' END AS st, o_orderkey % 5 <> 0 AS main FROM orders) GROUP BY 1"


@query(_UNANIMOUS)
def agg_unanimity(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    legs = read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 300).alias("query_id"),
        F.array(F.col("o_custkey"), F.col("o_orderkey") % 10).alias("participant_ids"),
        F.lit(1).cast("long").alias("competition_id"),
        F.lit("fixture").alias("level"),
        F.when(status == "O", "prematch").when(status == "P", "live").alias("play_state"),
        F.when(F.col("o_orderkey") % 5 != 0, "main").otherwise("goals").alias("concept"),
    )
    found = planner.recall_inputs(legs)
    return found.select("query_id", F.array_join(F.transform("participant_ids", lambda x: x.cast("string")), ",").alias("participants"), "play_state", "main_only")


@query("SELECT tag, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS passed, CAST(round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*)) AS BIGINT) AS percent FROM (SELECT quality, unnest([lang, source]) AS tag FROM labels JOIN documents USING (doc_id)) GROUP BY 1")
def agg_tag_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return evaluation.tag_rates(rows.select(F.array("lang", "source").alias("tags"), (F.col("quality") == 1).alias("passed")))


@query("SELECT bool_and(p = n) FILTER (WHERE critical) AS critical_ok, round(sum(p) FILTER (WHERE NOT critical) / sum(n) FILTER (WHERE NOT critical), 6) AS soft_rate, sum(p) FILTER (WHERE NOT critical) / sum(n) FILTER (WHERE NOT critical) >= 0.9 AS soft_ok FROM (SELECT lang = 'en' AS critical, source, count(*) AS n, count(*) FILTER (WHERE toxic = 0) AS p FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2)")
def agg_ship_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    graded = rows.select(F.col("source").alias("tag"), (F.col("lang") == "en").alias("critical"), (F.col("toxic") == 0).alias("passed"))
    return evaluation.ship_gate(graded).withColumn("soft_rate", F.round("soft_rate", 6))


@query("SELECT lang AS kind, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS recalled, count(*) FILTER (WHERE toxic = 0) AS confident, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS confident_right FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def agg_entity_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    cells = rows.select(F.col("lang").alias("kind"), F.array("quality").alias("gold_ids"), F.array(F.lit(1), F.lit(5)).alias("candidate_ids"), F.when(F.col("toxic") == 0, "confident").otherwise("none").alias("tier"))
    return evaluation.entity_rates(cells)


@query("SELECT lang AS category, count(*) FILTER (WHERE quality = 1) AS scored, count(*) FILTER (WHERE quality = 0) AS pending, count(*) FILTER (WHERE toxic = 0) AS passed FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def agg_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return evaluation.scoreboard(rows.select(F.col("lang").alias("category"), F.when(F.col("quality") == 1, "scored").otherwise("pending").alias("status"), (F.col("toxic") == 0).alias("passed")))


@query("SELECT o_custkey AS query_id, bool_and(o_totalprice > 50000) AS passed FROM orders GROUP BY 1")
def agg_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.repeated(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_totalprice") > 50000).alias("passed")))


# ---- combinations ----


def _coupons(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(refs, outcomes, picked): an order's line items as a coupon, fetched for its customer; the picks are by rule."""
    items = outcomes(spark, sf_dir)
    refs = items.select(F.col("event_id").alias("coupon_id"), "outcome_id", F.when(F.col("outcome_id") % 3 != 0, F.col("offer_id")).alias("offer_id"), F.col("outcome_id").alias("ord"))
    known = items.select("outcome_id", "offer_id", F.col("participant_id").alias("event_id"), "criterion_id", F.col("label").alias("market_label"), F.col("english_label").alias("outcome_label")).dropDuplicates(["outcome_id"])
    queries = events(spark, sf_dir).select(F.col("home_id").alias("query_id"), F.col("event_id").alias("coupon_id"))
    picked = queries.withColumns({"event_ids": F.array(F.lit(3), F.lit(5)), "criterion_ids": F.array(F.lit(4)), "offer_ids": F.array(F.col("coupon_id") * 10 + 1), "outcome_ids": F.array(((F.col("coupon_id") * 100000 + 5) * 10 + 1) * 10000 + 3)})
    return refs, known, picked


_SCORES = """sc AS (SELECT o_custkey AS query_id, o.event_id AS coupon_id, count(*) FILTER (WHERE outcome_id = ((o.event_id * 100000 + 5) * 10 + 1) * 10000 + 3) AS exact, count(*) FILTER (WHERE offer_id = o.event_id * 10 + 1) AS same_offer, count(*) FILTER (WHERE participant_id IN (3, 5)) AS shown_event, count(*) FILTER (WHERE criterion_id = 4) AS same_market FROM v_outcome o JOIN orders ON o_orderkey = o.event_id GROUP BY 1, 2)"""


@query(sql("SELECT query_id, coupon_id, exact, same_offer, shown_event, same_market FROM sc", OUTCOMES, _SCORES))
def agg_coupon_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return combos.score_coupons(*_coupons(spark, sf_dir))


@query(sql("SELECT query_id, coupon_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, same_offer DESC, shown_event DESC, same_market DESC, CASE WHEN coupon_id % 2 = 0 THEN 1 ELSE 0 END DESC, coupon_id % 7, coupon_id) AS place FROM sc WHERE exact > 0 OR same_offer > 0 OR same_market > 0 OR shown_event > 0) WHERE place <= 3", OUTCOMES, _SCORES))
def win_coupon_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = combos.score_coupons(*_coupons(spark, sf_dir))
    rows = scores.withColumns({"on_shown_event": F.col("shown_event") > 0, "custom": F.col("coupon_id") % 2 == 0, "price": F.col("coupon_id") % 7})
    return combos.rank_coupons(rows).select("query_id", "coupon_id", "place")


@query(sql("SELECT event_id AS coupon_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE CAST(round(1000 * product((1000 + participant_id % 4 * 500) / 1000.0)) AS BIGINT) END AS price FROM v_outcome GROUP BY 1", OUTCOMES))
def prj_coupon_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    leg = F.struct(F.struct((1000 + F.col("participant_id") % 4 * 500).alias("decimal")).alias("odds"))
    rows = outcomes(spark, sf_dir).groupBy(F.col("event_id").alias("coupon_id")).agg(F.collect_list(leg).alias("rows"))
    bets = F.when(F.col("coupon_id") % 3 == 0, F.array(F.struct(F.struct(F.col("coupon_id").alias("decimal")).alias("odds"))))
    return rows.select("coupon_id", offering.coupon_price(F.col("rows"), bets).alias("price"))


@query(sql("SELECT event_id AS coupon_id, count(*) AS refs, CAST(sum(outcome_id) AS BIGINT) AS ids FROM v_outcome GROUP BY 1", OUTCOMES))
def prj_coupon_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.col("outcome_id").alias("id"), F.col("offer_id").alias("betOfferId"))
    kind, none = F.col("outcome_id") % 3, F.array().cast("array<struct<id:bigint,betOfferId:bigint>>")
    group = F.struct(F.when(kind == 1, F.array(F.struct(F.array(one).alias("outcomes")))).alias("groups"), F.when(kind == 2, F.array(one)).otherwise(none).alias("outcomes"))
    row = F.struct(F.when(kind == 0, one).alias("outcome"), F.when(kind != 0, group).alias("group"))
    rows = outcomes(spark, sf_dir).groupBy(F.col("event_id").alias("coupon_id")).agg(F.collect_list(row).alias("rows"))
    refs = rows.select("coupon_id", offering.coupon_refs(F.col("rows")).alias("r"))
    return refs.select("coupon_id", F.size("r").cast("long").alias("refs"), F.aggregate("r", F.lit(0).cast("long"), lambda s, x: s + x["id"]).alias("ids"))


# ---- replay ----

_HITS = "SELECT event_id, 'pick-' || left(sha256('{\"user\":' || user_id || ',\"kind\":\"' || event_type || '\"}'), 16) AS key, CASE WHEN user_id % 2 = 0 THEN event_type END AS output, user_id % 2 <> 0 AS pending FROM events"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events")
    key = replay.request_key("pick", F.col("user_id").alias("user"), F.col("event_type").alias("kind"))
    return rows.select("event_id", "user_id", "event_type", key.alias("key"))


@query(_HITS)
def udf_replay_hit_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir)
    recorded = requests.where("user_id % 2 = 0").select("key", F.col("event_type").alias("output"))
    return replay.answer(requests, recorded).select("event_id", "key", "output", "pending")


@query(f"SELECT DISTINCT key, input FROM (SELECT h.key, event_type AS input FROM ({_HITS}) h JOIN events USING (event_id) WHERE pending)")
def udf_replay_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir).withColumns({"kind": F.lit("pick"), "input": F.col("event_type")})
    recorded = requests.where("user_id % 2 = 0").select("key")
    return replay.misses(requests, recorded).select("key", "input")


# ---- grading and answers ----


@query("SELECT query_id, hard_misses, soft_misses FROM (SELECT o_custkey AS query_id, coalesce(string_agg(DISTINCT CASE WHEN o_orderkey % 4 = 0 THEN 'pairing' WHEN o_orderkey % 3 = 0 THEN 'line' END, ',' ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN 'pairing' WHEN o_orderkey % 3 = 0 THEN 'line' END), '') AS hard_misses, CASE WHEN bool_or(o_orderkey % 4 <> 0 AND o_orderkey % 5 = 0) THEN 'level' ELSE '' END AS soft_misses FROM orders GROUP BY 1)")
def cmp_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    pairs = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("query_id"),
        F.when(k % 4 != 0, 0).alias("pred_idx"),
        F.lit(2.5).alias("gold_line"),
        F.when(k % 3 != 0, 2.5).alias("pred_line"),
        F.lit(None).cast("string").alias("gold_level"),
        F.when(k % 5 == 0, "fixture").alias("pred_level"),
    )
    found = evaluation.grade_records(pairs, ["line"], ["level"])
    return found.select("query_id", F.array_join("hard_misses", ",").alias("hard_misses"), F.array_join("soft_misses", ",").alias("soft_misses"))


@query(f"""WITH RECURSIVE {', '.join(['i AS (SELECT l_orderkey AS q, l_partkey AS idx, p_type, l_returnflag = $$A$$ AS g FROM lineitem JOIN part ON l_partkey = p_partkey)',
 'f AS (SELECT a.q, list({{g: a.idx, p: b.idx}} ORDER BY a.idx, b.idx) AS fs FROM i a JOIN i b ON a.q = b.q AND a.g AND NOT b.g AND a.p_type = b.p_type GROUP BY 1)'.replace('{{', '{').replace('}}', '}'),
 'w(q, k, fs, gs, ps) AS (SELECT q, 0, fs, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM f UNION ALL SELECT q, k + 1, fs, CASE WHEN free THEN list_append(gs, g) ELSE gs END, CASE WHEN free THEN list_append(ps, p) ELSE ps END FROM (SELECT *, fs[k + 1].g AS g, fs[k + 1].p AS p, NOT list_contains(gs, fs[k + 1].g) AND NOT list_contains(ps, fs[k + 1].p) AS free FROM w WHERE k < len(fs)))',
 'm AS (SELECT q, unnest(gs) AS g, unnest(ps) AS p FROM w WHERE k = len(fs))'])} SELECT i.q AS query_id, i.idx AS gold_idx, m.p AS pred_idx FROM i LEFT JOIN m ON m.q = i.q AND m.g = i.idx WHERE i.g""".replace("$$", "'"))
def jon_greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    gold = items.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("idx"), F.array("p_type").alias("accept"))
    predicted = items.where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("idx"), F.col("p_type").alias("market"))
    return evaluation.pair_selectors(gold, predicted)


@query("SELECT o_orderkey, len(list_filter(ids, lambda x: x = o_custkey % 100)) > 0 AND (lo IS NULL OR lo / 1000.0 >= 5) AS passed FROM (SELECT o_orderkey, o_custkey, list(l_suppkey) AS ids, min(CAST(floor(l_extendedprice) AS BIGINT)) AS lo FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)")
def flt_grade_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("ids"), F.collect_list(F.floor("l_extendedprice").cast("long")).alias("odds"))
    joined = rows.join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    graded = evaluation.grade_answer(F.array(F.array(F.col("o_custkey") % 100)), F.col("ids"), F.col("odds"), F.lit(5.0), F.lit(None).cast("double"))
    return joined.select("o_orderkey", graded.alias("passed"))


_NOTES = [("q1", 0, "none", False, None, False, False, False, False, [], False, False), ("q1", 1, "none", True, None, False, False, True, True, ["golf"], True, False), ("q2", 0, "exact", True, "line-absent", False, False, True, False, [], False, True), ("q2", 1, "exact", True, None, True, False, True, False, [], False, True), ("q3", 0, "exact", True, None, False, False, False, False, [], False, False)]


@query(sql("""SELECT DISTINCT query_id, unnest(list_filter([CASE WHEN m = 'none' AND NOT f THEN 'no_fixture' WHEN m = 'none' THEN 'no_market' WHEN fb IS NOT NULL THEN replace(fb, '-', '_') WHEN NOT fo THEN 'nothing_found' WHEN NOT pl THEN 'no_event' END,
 CASE WHEN tu AND hw THEN 'time_partly_understood' WHEN tu THEN 'time_not_understood' END, CASE WHEN len(os) > 0 THEN 'other_sports' END, CASE WHEN tr THEN 'truncated' END, CASE WHEN fa THEN 'partly_failed' END], lambda x: x IS NOT NULL)) AS code FROM n""",
 values(_NOTES, "n(query_id, leg_idx, m, f, fb, fo, pl, tu, hw, os, tr, fa)", ["VARCHAR", "INTEGER", "VARCHAR", "BOOLEAN", "VARCHAR", "BOOLEAN", "BOOLEAN", "BOOLEAN", "BOOLEAN", "VARCHAR[]", "BOOLEAN", "BOOLEAN"])))
def cmp_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_NOTES, "query_id string, leg_idx int, match string, had_fixture boolean, fallback string, found boolean, placed boolean, time_unresolved boolean, has_window boolean, other_sports array<string>, truncated boolean, failed boolean")
    return assemble.notes(rows).select("query_id", "code").distinct()


@query(sql("SELECT home_id AS query_id, event_id, count(DISTINCT offer_id) AS offers, count(*) AS outcomes, min(outcome_id) AS first_outcome FROM v_outcome JOIN v_event USING (event_id) GROUP BY 1, 2", EVENTS, OUTCOMES))
def cmp_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = outcomes(spark, sf_dir)
    known = events(spark, sf_dir).select("event_id", "home_id", F.struct("event_name", "start", "state").alias("event"))
    picks = own.select("outcome_id", "event_id").join(known.select("event_id", F.col("home_id").alias("query_id")), "event_id").select("query_id", F.lit(0).alias("leg_idx"), "outcome_id", F.lit(True).alias("is_selected"))
    facts = own.select("outcome_id", "offer_id", "event_id", F.col("offer_id").alias("ord"), F.struct("label").alias("offer"), F.struct("english_label", "odds", "line").alias("outcome"))
    placed = assemble.place_outcomes(picks, facts, known)
    said = spark.createDataFrame([], "query_id long, kind string, leg_idx int, code string")
    answer = assemble.envelopes(placed, None, said)
    each = answer.select("query_id", F.explode("results").alias("r")).select("query_id", "r.event_id", F.explode("r.highlighted").alias("h"))
    ids = each.select("query_id", "event_id", "h.offer_id", F.explode("h.outcomes").alias("o"))
    return ids.groupBy("query_id", "event_id").agg(F.count_distinct("offer_id").alias("offers"), F.count("*").alias("outcomes"), F.min("o.outcome_id").alias("first_outcome"))


@query(pipeline.ORACLE)
def cmp_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.next_fixtures(spark, sf_dir)


@query(pipeline.ANSWERS_SQL)
def cmp_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.answers(spark, sf_dir)


@query(f"SELECT * FROM ({pipeline.ANSWERS_SQL}) WHERE query_id NOT IN ('a1', 'a4')")
def cmp_capped_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers from a source that gives three offers at most for each request; a1 and a4 ask by team, which no finer request completes."""
    return pipeline.answers(spark, sf_dir, cap=3, without=("a1", "a4"))


_FETCHED = """asked(query_id, group_id, lvl, state_of) AS (VALUES ('f1', 1005, 'fixture', 'live'), ('f2', 1011, NULL, NULL), ('f2', 1020, NULL, NULL), ('f3', 1007, 'competition', 'prematch')),
 fo AS (SELECT query_id, e.group_id, e.event_id, o.offer_id FROM asked a JOIN v_event e ON e.group_id = a.group_id JOIN (SELECT DISTINCT event_id, offer_id FROM v_outcome) o ON o.event_id = e.event_id
 WHERE (lvl IS NULL OR e.level IS NULL OR e.level = lvl) AND CASE state_of WHEN 'live' THEN state IS DISTINCT FROM 'NOT_STARTED' WHEN 'prematch' THEN state IS NOT DISTINCT FROM 'NOT_STARTED' ELSE true END),
 al AS (SELECT query_id, a.group_id, count(DISTINCT o.offer_id) AS total FROM asked a JOIN v_event e ON e.group_id = a.group_id JOIN v_outcome o ON o.event_id = e.event_id GROUP BY ALL)"""


@query(sql("SELECT query_id, event_id, offer_id FROM fo JOIN al USING (query_id, group_id) WHERE total > 3", EVENTS, OUTCOMES, _FETCHED))
def flt_capped_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every offer of the groups' events that may fit, though each answer holds three at most."""
    asked = [("f1", [1005], ["fixture"], "live"), ("f2", [1011, 1020], [], None), ("f3", [1007], ["competition"], "prematch")]
    none = F.array().cast("array<bigint>")
    inputs = spark.createDataFrame(asked, "query_id string, group_ids array<long>, levels array<string>, play_state string").withColumns({"event_ids": none, "participant_ids": none})
    known = events(spark, sf_dir)
    offers = outcomes(spark, sf_dir).select("offer_id", "event_id", "offer_type").distinct().join(known.select("event_id", "group_id"), "event_id")
    members = known.select("event_id", F.col("home_id").alias("participant_id"))
    return fetch.fetch(inputs, offers, known.select("event_id", "group_id", "level", "state", "start"), members, cap=3)["offers"]


@query("SELECT * FROM (VALUES (0, 'resolving'), (1, 'routing'), (2, 'disambiguating'), (3, 'searching'), (4, 'done')) AS t(position, stage)")
def stm_stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = [(k, name) for k, (name, _) in enumerate(stages.run(lambda: pipeline.answer_samples(spark, sf_dir)))]
    return spark.createDataFrame(seen, "position int, stage string")
