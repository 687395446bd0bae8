"""Queries over text, time and repair functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions import offering, text, timewin
from lattiq.plans.bindings import FOLD, NORMAL, PLAIN, content, query, read, sql, values
from lattiq.sources import plans

_HEAD = "substr(text, 1, 400)"


@query(f"SELECT doc_id, md5({FOLD.format('text')}) AS folded FROM documents")
def str_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


@query(f"SELECT item_id, md5({PLAIN.format('text')}) AS plain, md5({NORMAL.format('text')}) AS normal FROM benchmark")
def str_lc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.md5(text.plain(F.col("text"))).alias("plain"), F.md5(text.normalize(F.col("text"))).alias("normal"))


@query(f"SELECT item_id, array_to_string(list_sort({content('text')}), ' ') AS tokens FROM benchmark")
def str_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(text.content_tokens(F.col("text"))), " ").alias("tokens"))


@query(sql("SELECT p_partkey, word, n <> '' AND w <> '' AND (n = w OR contains(n, w) OR contains(w, n)) AS equal FROM (SELECT p_partkey, word, trim(regexp_replace(lower(p_name || '!'), '[^a-z0-9]+', ' ', 'g')) AS n, trim(regexp_replace(lower(word), '[^a-z0-9]+', ' ', 'g')) AS w FROM part JOIN t ON p_size % 4 = k)", values([(0, "Ring"), (1, "blue-bolt"), (2, "--"), (3, "small ring, large")], "t(k, word)", ["INTEGER", "VARCHAR"])))
def str_loose_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spark.createDataFrame([(0, "Ring"), (1, "blue-bolt"), (2, "--"), (3, "small ring, large")], "k int, word string")
    rows = read(spark, sf_dir, "part").withColumn("k", F.col("p_size") % 4).join(F.broadcast(words), "k")
    return rows.select("p_partkey", "word", text.loosely_equal(F.concat("p_name", F.lit("!")), F.col("word")).alias("equal"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, regexp_replace(x, '^(\\d+)-(\\d+)$', '\\2-\\1') AS turned FROM (SELECT *, CASE WHEN l_linenumber = 2 THEN 'x' ELSE '' END || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS x FROM lineitem)")
def str_score_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.concat(F.when(F.col("l_linenumber") == 2, "x").otherwise(""), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", text.reverse_score(score).alias("turned"))


@query("""SELECT o_orderkey, CASE WHEN side IS NOT NULL AND list_contains(['win', 'draw', 'loss'], a) AND (b IS NULL OR list_contains(['win', 'draw', 'loss'], b)) THEN
 CASE WHEN a = 'draw' THEN 'x' WHEN (a = 'win') = (side = 'home') THEN '1' ELSE '2' END || CASE WHEN b IS NULL THEN '' WHEN b = 'draw' THEN '/x' WHEN (b = 'win') = (side = 'home') THEN '/1' ELSE '/2' END END AS token
 FROM (SELECT o_orderkey, ['win', 'draw', 'loss', '2'][o_orderkey % 4 + 1] AS a, CASE WHEN o_custkey % 6 > 0 THEN ['win', 'draw', 'loss', 'lost'][o_custkey % 4 + 1] END AS b, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'away' ELSE 'home' END AS side FROM orders)""")
def str_htft_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of half and full time in words, by rule, written with and without blanks and capitals."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda at, *words: F.element_at(F.array(*map(F.lit, words)), (at % 4 + 1).cast("int"))
    first, second = pick(k, "win", "draw", "loss", "2"), pick(c, "win", "draw", "loss", "lost")
    phrase = F.when(c % 6 == 0, first).when(k % 3 == 0, F.concat(F.initcap(first), F.lit(" / "), second)).otherwise(F.concat(first, F.lit("/"), second))
    side = F.when(k % 5 == 1, "away").when(k % 5 > 1, "home")
    return read(spark, sf_dir, "orders").select("o_orderkey", text.result_tokens(phrase, side).alias("token"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(b, '^[^,]+,\\s+\\S') THEN regexp_replace(b, '^([^,]*[^,\\s])\\s*,\\s+(.+?)\\s*$', '\\2 \\1') ELSE b END AS name FROM (SELECT c_custkey, trim(regexp_replace(CASE WHEN c_custkey % 2 = 0 THEN 'Last' || c_nationkey || ', ' || c_mktsegment || ' (X' || c_nationkey || ')' ELSE c_name END, '\\s*\\([^)]+\\)\\s*$', '')) AS b FROM customer)")
def str_player_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey").cast("string")
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Last"), n, F.lit(", "), "c_mktsegment", F.lit(" (X"), n, F.lit(")"))).otherwise(F.col("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", offering.player_name(raw).alias("name"))


@query(r"""SELECT p_partkey, length(name) <= 1 OR contains(name, '  ') OR regexp_matches(name, '\s(Penalties|Extra Time|Regular Time)$') OR regexp_matches(name, 'win\s*&|&\s*(Over|Under)\s') AS noise
 FROM (SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_name || ' Penalties' WHEN 1 THEN left(p_name, 1) WHEN 2 THEN p_name || '  ' || p_brand WHEN 3 THEN p_name || ' to win & score' WHEN 4 THEN p_brand || ' & Over 2' WHEN 5 THEN p_name || ' Extra Time' WHEN 6 THEN 'Extra Time ' || p_name ELSE p_name END AS name FROM part)""")
def str_noise_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattiq.operators.etl import noise_name

    k, name, brand = F.col("p_partkey") % 8, F.col("p_name"), F.col("p_brand")
    shapes = [F.concat(name, F.lit(" Penalties")), F.left(name, F.lit(1)), F.concat(name, F.lit("  "), brand), F.concat(name, F.lit(" to win & score")), F.concat(brand, F.lit(" & Over 2")), F.concat(name, F.lit(" Extra Time")), F.concat(F.lit("Extra Time "), name)]
    own = name
    for case, shape in enumerate(shapes):
        own = F.when(k == case, shape).otherwise(own)
    return read(spark, sf_dir, "part").select("p_partkey", noise_name(own).alias("noise"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'sv_SE' ELSE 'en_GB' END AS locale FROM customer")
def src_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known languages in any writing, unknown ones, and none."""
    k = F.col("c_custkey") % 4
    language = F.when(k == 0, F.when(F.col("c_custkey") % 3 == 0, " Swedish").otherwise("SWEDISH")).when(k == 1, "english").when(k == 2, F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", offering.locale(language).alias("locale"))


_TOKENS = ["today", "Tonight ", "tomorrow", "weekend", "friday", "sunday", "next_3_hours", "next_1_day", "next_2_weeks", "someday"]
_DAY = "CASE WHEN v = 'sunday' THEN 0 WHEN v = 'monday' THEN 1 WHEN v = 'tuesday' THEN 2 WHEN v = 'wednesday' THEN 3 WHEN v = 'thursday' THEN 4 WHEN v = 'friday' THEN 5 WHEN v = 'saturday' THEN 6 END"


@query(sql(f"""SELECT event_id, token, CASE WHEN unit <> '' THEN ts WHEN v = 'tomorrow' THEN d + INTERVAL 1 DAY WHEN v IN ('today', 'tonight') THEN ts WHEN v = 'weekend' THEN sat - INTERVAL 6 HOUR
 WHEN wait = 0 THEN ts WHEN wait > 0 THEN d + to_days(CAST(wait AS INTEGER)) END AS low,
 CASE WHEN unit = 'hour' THEN ts + to_hours(n) WHEN unit = 'day' THEN ts + to_days(n) WHEN unit = 'week' THEN ts + to_days(7 * n) WHEN v = 'tomorrow' THEN d + INTERVAL 2 DAY - INTERVAL 1 MILLISECOND
 WHEN v IN ('today', 'tonight') THEN d + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND WHEN v = 'weekend' THEN sat + INTERVAL 2 DAY - INTERVAL 1 MILLISECOND WHEN wait >= 0 THEN d + to_days(CAST(wait AS INTEGER)) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND END AS high
 FROM (SELECT *, date_trunc('day', ts) + to_days(CAST(CASE WHEN dow = 0 THEN -1 ELSE 6 - dow END AS INTEGER)) AS sat, CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, ({_DAY} - dow + 7) % 7 AS wait FROM (
 SELECT event_id, token, ts, dayofweek(ts) AS dow, lower(trim(token)) AS v, regexp_extract(lower(trim(token)), '^next_(\\d+)_(hour|day|week)s?$', 2) AS unit,
 TRY_CAST(regexp_extract(lower(trim(token)), '^next_(\\d+)_(hour|day|week)s?$', 1) AS INTEGER) AS n FROM events JOIN t ON user_id % 10 = k))""", values(list(enumerate(_TOKENS)), "t(k, token)", ["INTEGER", "VARCHAR"])))
def dat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = spark.createDataFrame(list(enumerate(_TOKENS)), "k int, token string")
    rows = read(spark, sf_dir, "events").withColumn("k", (F.col("user_id") % 10).cast("int")).join(F.broadcast(tokens), "k")
    window = timewin.date_window(F.col("token"), F.col("ts"), F.col("ts"))
    return rows.select("event_id", "token", window.start.alias("low"), window.end.alias("high"))


@query("SELECT event_id, CAST(sat - INTERVAL 6 HOUR AS TIMESTAMP) AS low, CAST(sat + INTERVAL 2 DAY - INTERVAL 1 MILLISECOND AS TIMESTAMP) AS high FROM (SELECT event_id, date_trunc('day', ts) + to_days(CAST(CASE WHEN dayofweek(ts) = 0 THEN -1 ELSE 6 - dayofweek(ts) END AS INTEGER)) AS sat FROM events)")
def dat_weekend(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = timewin.weekend(F.col("ts"))
    return read(spark, sf_dir, "events").select("event_id", low.alias("low"), high.alias("high"))


_PHRASE = """t AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'after ' || (user_id % 13) || 'pm' WHEN 1 THEN 'Before ' || (user_id % 13) || ' am' WHEN 2 THEN 'after ' || (user_id % 24) WHEN 3 THEN 'this Evening' WHEN 4 THEN 'morning or ' || event_type
 WHEN 5 THEN 'late night' WHEN 6 THEN 'the early ' || event_type WHEN 7 THEN ' afternoon ' ELSE event_type || ' lately' END AS phrase FROM events)"""


@query(sql("""SELECT event_id, CASE WHEN a IS NOT NULL THEN a WHEN b IS NOT NULL THEN NULL WHEN m THEN NULL WHEN v LIKE '%afternoon%' THEN 12 WHEN v LIKE '%evening%' THEN 17 WHEN v LIKE '%night%' THEN 20 END AS after_hour,
 CASE WHEN a IS NOT NULL THEN NULL WHEN b IS NOT NULL THEN b WHEN m THEN 12 WHEN v LIKE '%afternoon%' THEN 18 END AS before_hour,
 CASE WHEN a IS NOT NULL OR b IS NOT NULL OR m OR regexp_matches(v, 'afternoon|evening|night') THEN NULL WHEN regexp_matches(v, '\\blate\\b') THEN 'late' WHEN regexp_matches(v, '\\bearly\\b') THEN 'early' END AS relative,
 a IS NOT NULL OR b IS NOT NULL OR regexp_matches(v, '\\b(morning|afternoon|evening|night|late|early)\\b') AS known FROM (SELECT event_id, v, v LIKE '%morning%' AS m,
 CASE WHEN ah = 'pm' AND an < 12 THEN an + 12 WHEN ah = 'am' AND an = 12 THEN 0 ELSE an END AS a, CASE WHEN bh = 'pm' AND bn < 12 THEN bn + 12 WHEN bh = 'am' AND bn = 12 THEN 0 ELSE bn END AS b FROM (
 SELECT event_id, lower(trim(phrase)) AS v, TRY_CAST(regexp_extract(lower(phrase), '\\bafter\\s+(\\d{1,2})\\s*(am|pm)?\\b', 1) AS INTEGER) AS an, regexp_extract(lower(phrase), '\\bafter\\s+(\\d{1,2})\\s*(am|pm)?\\b', 2) AS ah,
 TRY_CAST(regexp_extract(lower(phrase), '\\bbefore\\s+(\\d{1,2})\\s*(am|pm)?\\b', 1) AS INTEGER) AS bn, regexp_extract(lower(phrase), '\\bbefore\\s+(\\d{1,2})\\s*(am|pm)?\\b', 2) AS bh FROM t))""", _PHRASE))
def dat_kickoff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase for each event, by rule."""
    k, u, kind = F.col("event_id") % 9, F.col("user_id"), F.col("event_type")
    text_of = lambda x: x.cast("string")
    shapes = [F.concat(F.lit("after "), text_of(u % 13), F.lit("pm")), F.concat(F.lit("Before "), text_of(u % 13), F.lit(" am")), F.concat(F.lit("after "), text_of(u % 24)), F.lit("this Evening"), F.concat(F.lit("morning or "), kind), F.lit("late night"), F.concat(F.lit("the early "), kind), F.lit(" afternoon ")]
    phrase = F.concat(kind, F.lit(" lately"))
    for case, shape in enumerate(shapes):
        phrase = F.when(k == case, shape).otherwise(phrase)
    band = timewin.kickoff(phrase)
    return read(spark, sf_dir, "events").select("event_id", band.after.alias("after_hour"), band.before.alias("before_hour"), band.relative.alias("relative"), band.known.alias("known"))


@query("SELECT event_id AS query_id, event_type AS sport, CAST(i AS INTEGER) AS leg_idx, 'bet ' || user_id || ' ' || i AS market_concept, list_filter([event_type], lambda x: user_id % 3 = 0) AS other_sports FROM events, range(2) AS r(i) WHERE user_id % 5 <> 0")
def jsn_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("user_id"), F.col("event_type")
    leg = lambda i: F.struct(F.concat(F.lit("bet "), k.cast("string"), F.lit(f" {i}")).alias("market_concept"))
    others = F.when(k % 3 == 0, F.array(kind))
    plan = F.to_json(F.struct(F.when(k % 5 != 0, kind).alias("sport"), others.alias("otherSports"), F.array(leg(0), leg(1)).alias("selectors")))
    # every other plan is a JSON text within JSON
    wrapped = F.when(k % 2 == 0, F.substring(F.to_json(F.struct(plan.alias("x"))), 6, 1_000_000)).otherwise(plan)
    texts = F.when(k % 2 == 0, F.left(wrapped, F.length(wrapped) - 1)).otherwise(wrapped)
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), texts.alias("plan"))
    return plans.read_plans(rows).select("query_id", "sport", "leg_idx", "market_concept", "other_sports")


@query("""SELECT event_id, CASE WHEN k % 2 = 0 THEN 'live' END AS play_state, CASE WHEN k % 4 <> 0 THEN k / 10.0 END AS line_num, CASE WHEN k % 3 <> 0 THEN CAST(k AS DOUBLE) END AS odds_min,
 CASE WHEN k % 5 <> 0 THEN CAST(k % 7 AS INTEGER) END AS n, CASE WHEN k % 7 = 0 THEN 'event' ELSE 'team' END AS subject_kind, false AS has_time FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE k % 7 <> 0 OR k % 5 = 0 OR true""".replace("CASE WHEN k % 5 <> 0 THEN CAST(k % 7 AS INTEGER) END AS n", "CASE WHEN k % 5 <> 0 AND k % 7 >= 1 THEN CAST(k % 7 AS INTEGER) END AS n").replace("CASE WHEN k % 3 <> 0 THEN CAST(k AS DOUBLE) END AS odds_min", "CASE WHEN k % 3 <> 0 AND k > 0 THEN CAST(k AS DOUBLE) END AS odds_min"))
def jsn_plan_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    raw = F.struct(
        F.when(k % 2 == 0, "live").otherwise("sometime").alias("play_state"),
        F.when(k % 4 != 0, (k / 10.0).cast("string")).otherwise("").alias("line"),
        F.struct(F.when(k % 3 != 0, k.cast("double")).otherwise(-1.0).alias("min"), F.lit(None).cast("double").alias("max")).alias("odds"),
        F.when(k % 5 != 0, (k % 7).cast("double")).otherwise(1.5).alias("count"),
        F.struct(F.lit("team").alias("kind"), F.when(k % 7 != 0, "Somewhere").alias("name")).alias("subject"),
        F.struct(F.lit(None).cast("string").alias("date_window"), F.lit(" ").alias("kickoff_time_of_day")).alias("time"),
    )
    rows = read(spark, sf_dir, "events").select("event_id", F.to_json(raw).alias("json"))
    fixed = plans.repair_selectors(rows, "json")
    return fixed.select("event_id", "play_state", "line_num", "odds_min", F.col("count").alias("n"), "subject_kind", (F.col("date_window").isNotNull() | F.col("kickoff").isNotNull()).alias("has_time"))
