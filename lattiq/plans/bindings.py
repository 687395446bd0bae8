"""The offering's tables as they are read from the test data, in Spark and as SQL text for DuckDB.

orders and customers stand for events, line items and parts for outcomes of markets, nations and regions for the group
tree. Both sides use the same expressions; some values are set to null by rule, so that predicates that keep rows
without data are put to the test.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.sources.written import whole

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column, pairs: list[tuple], other=None):
    out = F.lit(other)
    for key, value in reversed(pairs):
        out = F.when(column == key, value).otherwise(out)
    return out


Side = Callable[[DataFrame], DataFrame]


def _of_events(table: DataFrame, key: str, ids: DataFrame | None) -> DataFrame:
    """The rows of a table whose key is one of ids(event_id), all without ids: they are dropped before anything is joined, as the planner leaves a semi join where it stands."""
    return table if ids is None else table.join(whole(ids.select(F.col("event_id").alias(key))), key, "left_semi")


def events(spark: SparkSession, sf_dir: str, side: Side = lambda table: table, ids: DataFrame | None = None) -> DataFrame:
    """event_id, start, state, level, group_id, recall_group, home_id, away_id, home_name, away_name, event_name, tags, teams. ``side`` may hint how the orders meet their customers; with ids(event_id) only those."""
    orders, customers = _of_events(read(spark, sf_dir, "orders"), "o_orderkey", ids), side(read(spark, sf_dir, "customer"))
    k = F.col("o_orderkey")
    away = (F.col("o_custkey") + 7) % 100
    pad = lambda c: F.concat(F.lit("Customer#"), F.lpad(c.cast("string"), 9, "0"))
    priority = F.col("o_orderpriority")
    level = F.when(priority == "5-LOW", "competition").when(priority != "4-NOT SPECIFIED", "fixture")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("event_id"),
        F.when(k % 50 != 0, F.col("o_orderdate")).alias("start"),
        F.when(k % 41 != 0, _case(F.col("o_orderstatus"), [("O", "NOT_STARTED"), ("P", "STARTED"), ("F", "FINISHED")])).alias("state"),
        level.alias("level"),
        F.when(k % 37 != 0, F.col("c_nationkey") + 1000).cast("long").alias("group_id"),
        (F.col("c_nationkey") + 1000).cast("long").alias("recall_group"),
        F.col("o_custkey").alias("home_id"),
        away.alias("away_id"),
        F.col("c_name").alias("home_name"),
        pad(away).alias("away_name"),
    )
    return rows.withColumns(
        {
            "event_name": F.concat("home_name", F.lit(" - "), "away_name"),
            "tags": F.when(F.col("level") == "competition", F.array(F.lit("COMPETITION"), F.lit("MATCH"))).when(F.col("level") == "fixture", F.array(F.lit("MATCH"))).otherwise(F.array().cast("array<string>")),
            "teams": F.when(F.col("event_id") % 29 != 0, F.array("home_id", "away_id")).otherwise(F.array().cast("array<bigint>")),
        }
    )


EVENTS = """v_event AS (SELECT *, home_name || ' - ' || away_name AS event_name,
  CASE WHEN level = 'competition' THEN ['COMPETITION', 'MATCH'] WHEN level = 'fixture' THEN ['MATCH'] ELSE [] END AS tags,
  CASE WHEN event_id % 29 <> 0 THEN [home_id, away_id] ELSE [] END AS teams FROM (
  SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS start,
  CASE WHEN o_orderkey % 41 <> 0 THEN CASE o_orderstatus WHEN 'O' THEN 'NOT_STARTED' WHEN 'P' THEN 'STARTED' WHEN 'F' THEN 'FINISHED' END END AS state,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'competition' WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN 'fixture' END AS level,
  CAST(CASE WHEN o_orderkey % 37 <> 0 THEN c_nationkey + 1000 END AS BIGINT) AS group_id, CAST(c_nationkey + 1000 AS BIGINT) AS recall_group,
  o_custkey AS home_id, (o_custkey + 7) % 100 AS away_id, c_name AS home_name, 'Customer#' || lpad(CAST((o_custkey + 7) % 100 AS VARCHAR), 9, '0') AS away_name
  FROM orders JOIN customer ON o_custkey = c_custkey))"""

_TYPES = ["ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE"]


def outcomes(spark: SparkSession, sf_dir: str, side: Side = lambda table: table, ids: DataFrame | None = None) -> DataFrame:
    """One row for each outcome of an offer; an event's line items of one part type make an offer. ``side`` may hint how the items meet their parts and suppliers; with ids(event_id) only these events'."""
    items, parts, suppliers = _of_events(read(spark, sf_dir, "lineitem"), "l_orderkey", ids), *(side(read(spark, sf_dir, t)) for t in ("part", "supplier"))
    flag, code = F.col("l_returnflag"), F.array_position(F.array(*map(F.lit, _TYPES)), F.col("p_type")).cast("long")
    open_item = (flag == "N") & (F.col("l_linestatus") == "O")
    kind = F.when(flag == "A", "OT_OVER").when(flag == "R", "OT_UNDER").when(open_item, "OT_UNTYPED").otherwise("OT_TWO")
    wins = F.when(F.col("l_suppkey") % 2 == 0, F.concat("s_name", F.lit(" wins"))).otherwise(F.col("s_name"))
    odds = F.floor("l_extendedprice").cast("long")
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.col("l_orderkey").alias("event_id"),
        (F.col("l_orderkey") * 10 + code).alias("offer_id"),
        F.when(F.col("l_partkey") % 43 != 0, code).alias("criterion_id"),
        F.when(F.col("p_type") == "PROMO", 3).otherwise(code.cast("int") + 10).alias("offer_type"),
        F.when(F.col("l_tax") > 0.04, F.array(F.lit("MAIN"))).otherwise(F.array(F.lit("MAIN_LINE"))).alias("tags"),
        F.col("p_type").alias("market"),
        F.when(F.col("p_type").isin("SMALL", "LARGE"), F.concat(F.lit(" "), F.element_at(F.split("p_name", " "), 2))).alias("variant"),
        (((F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 10 + F.col("l_linenumber")) * 10000 + F.col("l_suppkey")).alias("outcome_id"),
        kind.alias("kind"),
        F.when(flag == "A", "Over").when(flag == "R", "Under").when(open_item, wins).otherwise("2").alias("english_label"),
        F.col("l_shipdate").cast("string").alias("outcome_label"),
        F.when(open_item, F.col("s_name")).alias("participant"),
        F.col("l_suppkey").alias("participant_id"),
        F.when(odds % 17 != 0, odds).alias("odds"),
        F.when(F.col("l_linenumber") != 1, F.floor(F.col("l_quantity") * 1000)).cast("long").alias("line"),
        F.when(F.col("p_type") == "PROMO", (F.col("l_linenumber") % 4).cast("string")).alias("home_score"),
        F.when(F.col("p_type") == "PROMO", (F.col("l_suppkey") % 4).cast("string")).alias("away_score"),
    ).withColumn("label", F.when(F.col("variant").isNotNull(), F.concat("market", F.lit(" — "), F.trim("variant"))).otherwise(F.col("market")))


OUTCOMES = """v_outcome AS (SELECT *, CASE WHEN variant IS NOT NULL THEN market || ' — ' || trim(variant) ELSE market END AS label FROM (
  SELECT l_orderkey AS event_id, l_orderkey * 10 + code AS offer_id, CASE WHEN l_partkey % 43 <> 0 THEN code END AS criterion_id,
  CAST(CASE WHEN p_type = 'PROMO' THEN 3 ELSE code + 10 END AS INTEGER) AS offer_type, CASE WHEN l_tax > 0.04 THEN ['MAIN'] ELSE ['MAIN_LINE'] END AS tags,
  p_type AS market, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN ' ' || string_split(p_name, ' ')[2] END AS variant,
  ((l_orderkey * 100000 + l_partkey) * 10 + l_linenumber) * 10000 + l_suppkey AS outcome_id,
  CASE WHEN l_returnflag = 'A' THEN 'OT_OVER' WHEN l_returnflag = 'R' THEN 'OT_UNDER' WHEN l_linestatus = 'O' THEN 'OT_UNTYPED' ELSE 'OT_TWO' END AS kind,
  CASE WHEN l_returnflag = 'A' THEN 'Over' WHEN l_returnflag = 'R' THEN 'Under' WHEN l_linestatus = 'O' THEN CASE WHEN l_suppkey % 2 = 0 THEN s_name || ' wins' ELSE s_name END ELSE '2' END AS english_label,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN s_name END AS participant, l_suppkey AS participant_id,
  CASE WHEN CAST(floor(l_extendedprice) AS BIGINT) % 17 <> 0 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS odds,
  CASE WHEN l_linenumber <> 1 THEN CAST(floor(l_quantity * 1000) AS BIGINT) END AS line,
  CASE WHEN p_type = 'PROMO' THEN CAST(l_linenumber % 4 AS VARCHAR) END AS home_score, CASE WHEN p_type = 'PROMO' THEN CAST(l_suppkey % 4 AS VARCHAR) END AS away_score
  FROM (SELECT *, CAST(list_position(['ECONOMY', 'SMALL', 'MEDIUM', 'PROMO', 'STANDARD', 'LARGE'], p_type) AS BIGINT) AS code FROM part) p
  JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey))"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group tree: a root, regions below it, nations below these (id, name, parent)."""
    region, nation = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    root = spark.createDataFrame([(1, "Root", None)], "id long, name string, parent long")
    below = region.select((F.col("r_regionkey") + 100).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(1).cast("long").alias("parent"))
    leaves = nation.select((F.col("n_nationkey") + 1000).cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 100).cast("long").alias("parent"))
    return root.unionByName(below).unionByName(leaves)


GROUPS = """v_group AS (SELECT CAST(1 AS BIGINT) AS id, 'Root' AS name, CAST(NULL AS BIGINT) AS parent
  UNION ALL SELECT CAST(100 + r_regionkey AS BIGINT), r_name, 1 FROM region UNION ALL SELECT CAST(1000 + n_nationkey AS BIGINT), n_name, CAST(100 + n_regionkey AS BIGINT) FROM nation)"""

#: Legs of queries: (query_id, leg_idx, leg_level, competition_id, recall_group, play_state, team_ids, window_start, window_end, after_hour, before_hour, relative, pick_order, pick_count).
LEGS = [
    ("q1", 0, "fixture", 1003, 1003, "prematch", [], None, None, None, None, None, "earliest", 2),
    ("q1", 1, "competition", 1003, 1003, None, [], None, None, None, None, None, None, None),
    ("q2", 0, "fixture", None, 1005, "live", [], "1997-01-01 00:00:00", "1998-06-30 23:59:59", None, None, None, None, None),
    ("q3", 0, "fixture", 1007, 1007, None, [57], None, None, None, None, None, "latest", 3),
    ("q4", 0, "fixture", 1011, 1011, None, [], "1999-01-01 00:00:00", None, 0, 12, None, None, None),
    ("q5", 0, "fixture", 1012, 1012, None, [], None, "1996-01-01 00:00:00", None, None, "late", None, None),
    ("q6", 0, "competition", None, 1020, "prematch", [3, 4], "2000-01-01 00:00:00", None, 20, None, "early", "latest", 1),
]
_LEG_SCHEMA = "query_id string, leg_idx int, leg_level string, competition_id long, recall_group long, play_state string, team_ids array<bigint>, window_start string, window_end string, after_hour int, before_hour int, relative string, pick_order string, pick_count int"


def legs(spark: SparkSession) -> DataFrame:
    """The legs above."""
    rows = spark.createDataFrame(LEGS, _LEG_SCHEMA)
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def values(rows: list[tuple], names: str, types: list[str]) -> str:
    """Rows as a SQL table expression named ``names``: ``t(a, b)``."""

    def one(x, kind):
        if x is None:
            return f"CAST(NULL AS {kind})"
        if isinstance(x, list):
            return f"CAST([{', '.join(one(y, kind[:-2]) for y in x)}] AS {kind})"
        return f"CAST({x if isinstance(x, (int, float)) else repr(x)} AS {kind})"

    table, columns = names.split("(", 1)
    body = ", ".join("(" + ", ".join(one(x, k) for x, k in zip(r, types)) + ")" for r in rows)
    return f"{table.strip()} AS (SELECT * FROM (VALUES {body}) AS x({columns})"


LEGS_SQL = values(
    LEGS,
    "v_leg(query_id, leg_idx, leg_level, competition_id, recall_group, play_state, team_ids, window_start, window_end, after_hour, before_hour, relative, pick_order, pick_count)",
    ["VARCHAR", "INTEGER", "VARCHAR", "BIGINT", "BIGINT", "VARCHAR", "BIGINT[]", "TIMESTAMP", "TIMESTAMP", "INTEGER", "INTEGER", "VARCHAR", "VARCHAR", "INTEGER"],
)


def sql(body: str, *views: str) -> str:
    """SQL with views before it."""
    return f"WITH {', '.join(views)} {body}" if views else body


def leg_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What recall fetched for each leg: its group's events."""
    return legs(spark).join(events(spark, sf_dir), "recall_group")


FOLD = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
PLAIN = "trim(regexp_replace(replace(replace(lower({0}), '’', ''), chr(39), ''), '[^a-z0-9]+', ' ', 'g'))"
NORMAL = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_STOP = "['the', 'a', 'an', 'to', 'of', 'in', 'on', 'at', 'by', 'for', 'and', 'or', 'with', 'is', 'are', 'be', 's', 'any', 'all', 'their']"


def content(x: str) -> str:
    """DuckDB: the distinct content tokens of x, in any order."""
    bare = f"regexp_replace({x}, '\\(settled[^)]*\\)', '', 'gi')"
    words = f"string_split(regexp_replace({PLAIN.format(bare)}, '\\bgoalscorers?\\b', 'goal scorer', 'g'), ' ')"
    kept = f"list_filter({words}, lambda t: t <> '' AND NOT list_contains({_STOP}, t))"
    return f"list_distinct(list_transform({kept}, lambda t: CASE WHEN length(t) > 3 AND t LIKE '%s' THEN left(t, length(t) - 1) ELSE t END))"
