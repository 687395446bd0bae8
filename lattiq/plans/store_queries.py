"""Queries over what is written and read back: the index, captures, the ledger of decisions, answers in parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.operators import assemble, etl, replay
from lattiq.plans.bindings import GROUPS, OUTCOMES, groups, outcomes, query, read, sql
from lattiq.plans.build_queries import _CLUBS, _members
from lattiq.sources import publish, snapshots
from lattiq.sources.written import own_folder

_REFERRED = "id IN (SELECT unnest(competition_ids) FROM cl UNION SELECT unnest(group_ids) FROM cl UNION SELECT 1000 + s_nationkey FROM supplier UNION SELECT 1000 + (s_nationkey + 1) % 25 FROM supplier)"


@query(sql(f"""SELECT 'groups' AS name, id, name AS text FROM v_group WHERE {_REFERRED}
 UNION ALL SELECT 'branches', id, name FROM v_group WHERE id IN (SELECT CASE WHEN id >= 1000 THEN parent ELSE id END FROM v_group WHERE id <> 1 AND {_REFERRED})
 UNION ALL SELECT 'teams', id, name || ' FC' FROM cl UNION ALL SELECT 'players', 1000000000 + s_suppkey, s_name FROM supplier""", GROUPS, _CLUBS))
def snk_published_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the index as a reader finds them, once a second version with other names of teams is published after a first."""
    clubs, players = _members(spark, sf_dir)
    walked, path = etl.walk_tree(spark, groups(spark, sf_dir)), own_folder(spark, "index")
    publish.publish(etl.build_index(walked, clubs, players), path)
    publish.publish(etl.build_index(walked, clubs.withColumn("name", F.concat("name", F.lit(" FC"))), players), path)
    tables = publish.read_index(spark, path)
    rows = [tables[t].select(F.lit(t).alias("name"), "id", F.col("name").alias("text")) for t in publish.NAMED]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


_CAPTURED = """o AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_custkey AS c, o_orderkey % 7 = 0 AS gone, o_orderkey % 5 = 0 AS changed, o_orderkey % 11 = 0 AS added, o_orderkey % 13 = 0 AS removed FROM orders),
 k AS (SELECT c_custkey AS id, c_custkey % 9 = 0 AS fresh FROM customer)"""


@query(sql("""SELECT 'match' AS grain, 'offer' AS kind, id, NULL AS field, 'VANISHED' AS verdict, NULL AS was, NULL AS now FROM o WHERE gone
 UNION ALL SELECT 'match', 'offer', id, 'state', 'CHANGED', '{"code":"' || s || '","of":' || c || '}', '{"code":"' || s || '","of":' || (c + 1) || '}' FROM o WHERE NOT gone AND changed
 UNION ALL SELECT 'match', 'offer', id, 'unknown', 'ADDED', NULL, '[1,' || id || ']' FROM o WHERE NOT gone AND added
 UNION ALL SELECT 'match', 'offer', id, 'closed', 'REMOVED', '"' || s || '"', NULL FROM o WHERE NOT gone AND removed
 UNION ALL SELECT 'competition', 'event', id, NULL, 'APPEARED', NULL, NULL FROM k WHERE fresh""", _CAPTURED))
def src_capture_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two captures of all orders and customers, both written and read back."""
    k = F.col("o_orderkey")
    state = lambda more: F.struct((F.col("o_custkey") + more).alias("of"), F.col("o_orderstatus").alias("code"))
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    first = orders.select(F.struct(state(0).alias("state"), F.when(k % 13 == 0, F.col("o_orderstatus")).alias("closed"), k.alias("id")).alias("d"))
    moved = F.when(k % 5 == 0, state(1)).otherwise(state(0))
    second = orders.where(k % 7 != 0).select(F.struct(k.alias("id"), moved.alias("state"), F.when(k % 11 == 0, F.array(F.lit(1), k)).alias("unknown")).alias("d"))
    document = lambda rows, grain, kind: rows.select(F.lit(grain).alias("grain"), F.lit(kind).alias("kind"), F.to_json("d").alias("json"))
    people = customers.select(F.struct("id", "name").alias("d"))
    captures = [(first, people.where("d.id % 9 <> 0")), (second, people)]
    held = []
    for offers, events in captures:
        path = own_folder(spark, "capture")
        snapshots.write(snapshots.capture(document(offers, "match", "offer").unionByName(document(events, "competition", "event")))[0], path)
        held.append(snapshots.read(spark, path))
    return snapshots.drift(*held)


@query("SELECT 'r' || user_id || event_type AS key, count(*) FILTER (event_id % 2 = 0) = 0 AS late, CASE WHEN count(*) FILTER (event_id % 2 = 0 AND user_id % 3 = 0) > 0 THEN 'first' WHEN count(*) FILTER (event_id % 2 = 1 AND user_id % 4 = 0) > 0 THEN 'second' END AS output FROM events GROUP BY user_id, event_type")
def udf_ledger_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request of all events once, after two runs of which the second came twice and answers some requests anew."""
    k = F.col("event_id")
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.lit("r"), F.col("user_id").cast("string"), "event_type").alias("key"), F.lit("pick").alias("kind"), F.col("event_type").alias("input"))
    path = own_folder(spark, "ledger")
    said = lambda which, every: F.when(F.col("user_id") % every == 0, which)
    replay.record(spark, path, rows.where(k % 2 == 0).withColumn("output", said("first", 3)).drop("event_id", "user_id"), 1)
    for _ in range(2):
        replay.record(spark, path, rows.where(k % 2 == 1).withColumn("output", said("second", 4)).drop("event_id", "user_id"), 2)
    first = rows.where(k % 2 == 0).select("key").distinct().withColumn("early", F.lit(True))
    return replay.ledger(spark, path).join(first, "key", "left").select("key", F.col("early").isNull().alias("late"), "output")


@query(sql("""SELECT query_id, part, count(*) AS n, min(outcome_id) AS lowest, max(outcome_id) AS highest FROM (SELECT query_id, outcome_id, CAST(floor((sum(size) OVER (PARTITION BY query_id ORDER BY event_id, outcome_id ROWS UNBOUNDED PRECEDING) - size) / 20000) AS BIGINT) AS part
 FROM (SELECT event_id % 3 AS query_id, event_id, outcome_id, 40 + octet_length(encode(label)) + octet_length(encode(english_label)) AS size FROM v_outcome)) GROUP BY 1, 2""", OUTCOMES))
def cmp_answer_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All outcomes as the answers of three queries, in parts of 20,000 bytes."""
    rows = outcomes(spark, sf_dir).select((F.col("event_id") % 3).alias("query_id"), "event_id", "outcome_id", "label", "english_label")
    parts = assemble.answer_parts(rows, assemble.row_bytes(F.col("label"), F.col("english_label")), 20_000)
    ids = F.transform("rows", lambda r: r["outcome_id"])
    return parts.select("query_id", "part", F.size("rows").cast("long").alias("n"), F.array_min(ids).alias("lowest"), F.array_max(ids).alias("highest"))
