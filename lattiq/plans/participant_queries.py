"""Queries over the participants' build: a raw feed of all customers' and orders' rows, on a tree of nations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.operators import etl, participants
from lattiq.plans.bindings import query, read, sql, values
from lattiq.sources.written import Build, own_folder

#: Nodes that stand beside the nations: (id, name, parent).
FIXED_NODES = [
    (1, "Football", None), (900, "International Tournaments", 1), (901, "World Cup", 900), (902, "International Friendly", 900), (950, "Specials", 1), (951, "Winner Odds", 950),
    (960, "Marcatore", 1), (961, "Coppa", 960), (970, "Testing", 1),
]


def sport_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation a country with a league, a cup and friendlies; regions as empty countries."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    n = F.col("n_nationkey").cast("long")
    country = nation.select((n + 1000).alias("id"), F.col("n_name").alias("name"), F.lit(1).cast("long").alias("parent"))
    empty = region.select((F.col("r_regionkey") + 100).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(1).cast("long").alias("parent"))
    names = F.array(F.concat("n_name", F.lit(" League")), F.concat("n_name", F.lit(" Cup")), F.concat(F.lit("Club Friendly "), F.col("n_name")))
    leaves = nation.select(n.alias("n"), F.posexplode(names).alias("k", "name")).select((F.col("n") * 10 + F.col("k") + 10000).alias("id"), "name", (F.col("n") + 1000).alias("parent"))
    return spark.createDataFrame(FIXED_NODES, "id long, name string, parent long").unionByName(country).unionByName(empty).unionByName(leaves)


_NODES = f"""{values(FIXED_NODES, "fixed(id, name, parent)", ["BIGINT", "VARCHAR", "BIGINT"])},
nodes AS (SELECT * FROM fixed UNION ALL SELECT 1000 + n_nationkey, n_name, 1 FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, 1 FROM region
 UNION ALL SELECT 10000 + n_nationkey * 10 + k, CASE k WHEN 0 THEN n_name || ' League' WHEN 1 THEN n_name || ' Cup' ELSE 'Club Friendly ' || n_name END, 1000 + n_nationkey FROM nation, (VALUES (0), (1), (2)) x(k)),
kinds AS (SELECT id, name, parent, CASE WHEN id = 1 OR id BETWEEN 1000 AND 1999 OR id = 900 THEN 'group' WHEN id IN (950, 960, 961, 970) THEN 'market' ELSE 'competition' END AS kind,
 CASE WHEN id >= 10000 THEN parent END AS country FROM nodes)"""


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed(page, participants): every customer a team, every order a member of its customer's team, a hundred teams a page.

    Names and nodes go by rule, so that each rule of the build removes some: other sports, national teams, friendlies, doubles, placeholders, bets.
    """
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    other = k * 7 % 25
    name = lambda locale, x: F.struct(F.lit(locale).alias("locale"), x.alias("name"))
    club = F.when(k % 50 == 0, F.concat(F.lit("NATION_"), n.cast("string"))).when(k % 11 == 0, F.concat(F.lit("Twin "), (k % 22).cast("string"))).otherwise(F.col("c_name"))
    names = F.when(k % 3 == 0, F.array(name("sv_SE", F.concat(F.lit("Lag "), k.cast("string"))), name("en_GB", club))).when(k % 3 == 1, F.array(name("en_US", club))).otherwise(F.array(name("sv_SE", club)))
    league = lambda country, step: F.lit(10000) + country * 10 + step
    one, long = F.lit(1).cast("long"), lambda x: F.lit(x).cast("long")
    usual = F.array(one, n + 1000, league(n, k % 2), league(other, k % 3), F.when(k % 4 == 0, league(other, (k + 1) % 3)).otherwise(long(951)))
    nodes = F.when(k % 50 == 0, F.array(one, long(901))).when(k % 13 == 0, F.array(one, long(902), league(n, long(2)))).when(k % 17 == 0, F.array(one, *map(long, (950, 961, 970, 999999)))).otherwise(usual)
    teams = read(spark, sf_dir, "customer").select(
        k.alias("key"), F.when(k == 7, F.lit(etl.OTHER_SPORTS[0])).otherwise(k).cast("long").alias("id"), F.when(k % 29 == 0, "LABEL").otherwise("TEAM").alias("type"), names.alias("names"), nodes.alias("groupIds"), club.alias("club"), n.alias("n")
    )
    o = F.col("o_orderkey")
    text = o.cast("string")
    kinds = [F.concat(F.lit("Last"), text, F.lit(", First (USA)")), F.concat("club", F.lit(" #"), text), F.concat(F.lit("P"), text, F.lit(" Penalties")), F.lit("a"), F.lit("x  y"), F.concat(F.lit("A win & B"), text), F.concat(F.lit("P"), text, F.lit(" & Over 2"))]
    called = F.when(o % 20 >= 14, F.concat(F.lit("Star "), (o % 3).cast("string"))).otherwise(F.concat(F.lit("Player "), (o % 5000).cast("string")))
    for case, own in enumerate(kinds):
        called = F.when(o % 20 == case, own).otherwise(called)
    own_nodes = F.array(one, F.col("n") + 1000, league(o % 25, o % 3), (o % 25 + 1000))
    member = F.struct((o % 5000 + 1_000_000_000).alias("id"), F.when(o % 23 == 0, "LABEL").otherwise("PARTICIPANT").alias("type"), F.array(name("en_GB", called)).alias("names"), own_nodes.alias("groupIds"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    members = orders.join(teams.select("key", "club", "n"), "key").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", member.alias("m")))).alias("ms"))
    rows = teams.join(members, "key", "left").select("key", F.struct("id", "type", "names", "groupIds", F.transform("ms", lambda x: x["m"]).alias("teamMembers")).alias("p"))
    pages = rows.groupBy(F.floor(F.col("key") / 100).cast("long").alias("page")).agg(F.array_sort(F.collect_list(F.struct("key", "p"))).alias("ps"))
    return pages.select("page", F.transform("ps", lambda x: x["p"]).alias("participants"))


_FEED = """teams AS (SELECT c_custkey AS key, CASE WHEN c_custkey = 7 THEN 1000011657 ELSE c_custkey END AS id, c_custkey % 29 <> 0 AND c_custkey IN (SELECT o_custkey FROM orders) AS is_team, c_nationkey AS n,
 CASE WHEN c_custkey % 50 = 0 THEN 'NATION_' || c_nationkey WHEN c_custkey % 11 = 0 THEN 'Twin ' || (c_custkey % 22) ELSE c_name END AS name,
 CASE WHEN c_custkey % 50 = 0 THEN [1, 901] WHEN c_custkey % 13 = 0 THEN [1, 902, 10002 + c_nationkey * 10] WHEN c_custkey % 17 = 0 THEN [1, 950, 961, 970, 999999]
 ELSE [1, 1000 + c_nationkey, 10000 + c_nationkey * 10 + c_custkey % 2, 10000 + (c_custkey * 7 % 25) * 10 + c_custkey % 3, CASE WHEN c_custkey % 4 = 0 THEN 10000 + (c_custkey * 7 % 25) * 10 + (c_custkey + 1) % 3 ELSE 951 END] END AS ns FROM customer),
team_nodes AS (SELECT t.id, t.key, x.pos, k.id AS node, k.kind, k.country FROM (SELECT id, key, unnest(ns) AS node, unnest(range(len(ns))) AS pos FROM teams WHERE is_team) x JOIN teams t USING (key) JOIN kinds k ON k.id = x.node),
homes AS (SELECT key, country FROM (SELECT key, country, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(pos), country) AS r FROM team_nodes WHERE kind = 'competition' AND country IS NOT NULL GROUP BY key, country) WHERE r = 1),
placed AS (SELECT t.key, t.id, t.name, t.n, h.country AS home, coalesce((SELECT list_sort(list(DISTINCT node)) FROM team_nodes d WHERE d.key = t.key AND kind = 'competition'), []) AS cs,
 coalesce((SELECT list_sort(list(DISTINCT node)) FROM team_nodes d WHERE d.key = t.key AND kind = 'group' AND (node = 1 OR node = h.country)), []) AS gs FROM teams t LEFT JOIN homes h USING (key) WHERE is_team),
clubs AS (SELECT key, id, name, n, home, cs, nation, CASE WHEN nation IS NULL THEN gs ELSE list_sort(list_distinct(list_append(gs, nation))) END AS gs
 FROM (SELECT p.*, CASE WHEN len(list_filter(gs, lambda x: x <> 1)) = 0 THEN k.id END AS nation FROM placed p LEFT JOIN kinds k ON k.name = p.name AND k.id BETWEEN 1000 AND 1999)),
members AS (SELECT 1000000000 + o_orderkey % 5000 AS id, c.id AS club_id, c.key, o_orderkey AS o, c.home, c.nation, c.n,
 CASE o_orderkey % 20 WHEN 0 THEN 'First Last' || o_orderkey WHEN 1 THEN c.name || ' #' || o_orderkey WHEN 2 THEN 'P' || o_orderkey || ' Penalties' WHEN 3 THEN 'a' WHEN 4 THEN 'x  y' WHEN 5 THEN 'A win & B' || o_orderkey WHEN 6 THEN 'P' || o_orderkey || ' & Over 2'
 ELSE CASE WHEN o_orderkey % 20 >= 14 THEN 'Star ' || (o_orderkey % 3) ELSE 'Player ' || (o_orderkey % 5000) END END AS name FROM orders JOIN clubs c ON c.key = o_custkey WHERE o_orderkey % 23 <> 0),
firsts AS (SELECT id, arg_min(name, key * 100000000 + o) AS name, arg_min(club_id, key * 100000000 + o) AS club_id, list_sort(list(DISTINCT 10000 + (o % 25) * 10 + o % 3)) AS cs,
 list_sort(list_filter(list_distinct(flatten([list(1), list(CASE WHEN 1000 + n = home THEN home END), list(CASE WHEN 1000 + o % 25 = home THEN home END), list(nation)])), lambda x: x IS NOT NULL)) AS gs FROM members GROUP BY id),
early AS (SELECT *, CASE WHEN id = 1000011657 THEN 'other sport' WHEN len(cs) = 0 THEN 'no competition' WHEN len(list_filter(cs, lambda x: x <> 902 AND NOT (x >= 10000 AND x % 10 = 2))) = 0 THEN 'friendlies only' END AS why FROM clubs),
twins AS (SELECT name, gs, min(id) AS keeper, list_sort(list_distinct(flatten(list(cs)))) AS cs FROM early WHERE why IS NULL GROUP BY name, gs),
judged AS (SELECT e.id, e.name, CASE WHEN e.id = t.keeper AND why IS NULL THEN t.cs ELSE e.cs END AS cs, e.gs, CASE WHEN why IS NULL AND e.id <> t.keeper THEN 'double club' ELSE why END AS why FROM early e LEFT JOIN twins t ON t.name = e.name AND t.gs = e.gs),
told AS (SELECT f.*, CASE WHEN j.id IS NULL THEN 'club removed' WHEN length(f.name) <= 1 OR contains(f.name, '  ') OR regexp_matches(f.name, '\\sPenalties$') OR regexp_matches(f.name, 'win\\s*&|&\\s*(Over|Under)\\s') THEN 'no name of a person'
 WHEN regexp_matches(f.name, '^' || j.name || ' #[0-9]+$') THEN 'placeholder' END AS why FROM firsts f LEFT JOIN judged j ON j.id = f.club_id AND j.why IS NULL),
pairs AS (SELECT name, club_id, min(id) AS keeper, list_sort(list_distinct(flatten(list(cs)))) AS cs, list_sort(list_distinct(flatten(list(gs)))) AS gs FROM told WHERE why IS NULL GROUP BY name, club_id),
players AS (SELECT t.id, t.name, t.club_id, CASE WHEN t.id = p.keeper AND why IS NULL THEN p.cs ELSE t.cs END AS cs, CASE WHEN t.id = p.keeper AND why IS NULL THEN p.gs ELSE t.gs END AS gs,
 CASE WHEN why IS NULL AND t.id <> p.keeper THEN 'double player' ELSE why END AS why FROM told t LEFT JOIN pairs p ON p.name = t.name AND p.club_id = t.club_id),
swept AS (SELECT id, name, cs, gs, CASE WHEN why IS NULL AND id NOT IN (SELECT club_id FROM players WHERE why IS NULL) THEN 'no players' ELSE why END AS why FROM judged)"""

_RULES = values([(k, rule) for k, rule in enumerate(["read", *[r for r, _ in participants.RULES]])], "rules(step, rule)", ["INTEGER", "VARCHAR"])


def prepared(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The participants' build over all customers and orders, in a folder of its own."""
    build = Build(spark, own_folder(spark, "participants"), sf_dir)
    return participants.prepare(build, raw_feed(spark, sf_dir), sport_nodes(spark, sf_dir))


@query(sql("SELECT kind, id, name, club_id, array_to_string(cs, ',') AS competitions, array_to_string(gs, ',') AS groups, why AS removed_by FROM (SELECT 'club' AS kind, id, name, CAST(NULL AS BIGINT) AS club_id, cs, gs, why FROM swept UNION ALL SELECT 'player', id, name, club_id, cs, gs, why FROM players)", _NODES, _FEED))
def cmp_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every club and player of the feed as the build leaves it, with the rule that removes it."""
    tables = prepared(spark, sf_dir)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    row = lambda kind, club: [F.lit(kind).alias("kind"), "id", "name", club.alias("club_id"), text("competition_ids").alias("competitions"), text("group_ids").alias("groups"), "removed_by"]
    return tables["clubs"].select(*row("club", F.lit(None).cast("long"))).unionByName(tables["players"].select(*row("player", F.col("club_id"))))


@query(sql("SELECT step, rule, (SELECT count(*) FROM swept LEFT JOIN rules r ON r.rule = why WHERE coalesce(r.step, 99) > rules.step) AS clubs, (SELECT count(*) FROM players LEFT JOIN rules r ON r.rule = why WHERE coalesce(r.step, 99) > rules.step) AS players FROM rules", _NODES, _FEED, _RULES))
def cmp_participant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clubs and players left after every rule."""
    return prepared(spark, sf_dir)["counts"]
