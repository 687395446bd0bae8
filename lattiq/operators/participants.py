"""The participants of a sport, from a raw feed and the sport's tree to clubs and players: one build of written tables.

A build goes on where an earlier one stopped (sources.written.Build). No row vanishes on the way: a club or player that a rule removes keeps the
rule's name, so that the counts after every rule are read from the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.operators import etl, trees
from lattiq.sources.written import Build

#: The rules in their order, and whether they remove clubs or players.
RULES = [
    ("other sport", "club"),
    ("no competition", "club"),
    ("friendlies only", "club"),
    ("double club", "club"),
    ("club removed", "player"),
    ("no name of a person", "player"),
    ("placeholder", "player"),
    ("double player", "player"),
    ("no players", "club"),
]
_IDS = "array<bigint>"


def allowed_of_league(nodes: DataFrame, league_id: int) -> DataFrame:
    """(id): the groups above a league, itself too if it is one; nodes classified."""
    chain = nodes.where(F.col("id") == league_id).select(F.explode("path").alias("id"))
    return chain.join(nodes.where("kind = 'group'").select("id"), "id", "left_semi")


def place_clubs(clubs: DataFrame, nodes: DataFrame, league_id: int | None = None) -> DataFrame:
    """clubs(id, name, node_ids, ord) as (id, name, competition_ids, group_ids, home, nation, ord).

    Groups are kept if they are the root or the club's home country; with ``league_id`` those above that league, whatever the club. A club that holds no
    group but the root, and has the name of a country, is a national team: ``nation`` is that country, which joins its groups.
    """
    root = F.col("depth") == 0
    at = clubs.select("id", F.posexplode("node_ids").alias("ord", "node"))
    known = at.join(nodes.select(F.col("id").alias("node"), "kind", root.alias("is_root")), "node")
    if league_id is None:
        home = etl.home_country(known.where("kind = 'competition'").select("id", F.col("node").alias("competition_id"), "ord"), nodes)
        placed, group = known.join(home, "id", "left"), F.col("is_root") | (F.col("node") == F.col("country"))
    else:
        fixed = allowed_of_league(nodes, league_id).select(F.col("id").alias("node"), F.lit(True).alias("fixed"))
        placed, group = known.join(fixed, "node", "left").withColumn("country", F.lit(None).cast("long")), F.col("fixed")
    of = lambda kept: F.array_sort(F.collect_set(F.when(kept, F.col("node"))))
    found = placed.groupBy("id").agg(
        of(F.col("kind") == "competition").alias("competition_ids"), of((F.col("kind") == "group") & group).alias("group_ids"), F.max("country").alias("home"), F.array_sort(F.collect_set(F.when(F.col("is_root"), F.col("node")))).alias("roots")
    )
    none = F.array().cast(_IDS)
    rows = clubs.select("id", "name", "ord").join(found, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("competition_ids", "group_ids", "roots")})
    named = etl.countries_of(nodes).groupBy("name").agg(F.max("id").alias("nation"))
    rows = rows.join(named, "name", "left").withColumn("nation", F.when(F.size(F.array_except("group_ids", "roots")) == 0, F.col("nation")))
    joined = F.when(F.col("nation").isNotNull(), F.array_sort(F.array_union("group_ids", F.array("nation")))).otherwise(F.col("group_ids"))
    return rows.select("id", "name", "competition_ids", joined.alias("group_ids"), "home", "nation", "ord")


def place_players(players: DataFrame, clubs: DataFrame, nodes: DataFrame, league_id: int | None = None) -> DataFrame:
    """players(id, name, club_id, node_ids, ord), a row for each team, as one row for each player: the first name and club, the competitions and groups of all rows.

    Groups are kept as those of the club (of place_clubs()), whose nation joins them.
    """
    own = clubs.select(F.col("id").alias("club_id"), "home", "nation")
    rows = players.join(own, "club_id", "left").select("id", "name", "club_id", "ord", "nation", "home", F.explode_outer("node_ids").alias("node"))
    rows = rows.join(nodes.select(F.col("id").alias("node"), "kind", (F.col("depth") == 0).alias("is_root")), "node", "left")
    if league_id is None:
        group = F.col("is_root") | (F.col("node") == F.col("home"))
    else:
        rows = rows.join(allowed_of_league(nodes, league_id).select(F.col("id").alias("node"), F.lit(True).alias("fixed")), "node", "left")
        group = F.col("fixed")
    of = lambda kept: F.collect_set(F.when(kept, F.col("node")))
    found = rows.groupBy("id").agg(
        F.min_by("name", "ord").alias("name"), F.min_by("club_id", "ord").alias("club_id"), F.array_sort(of(F.col("kind") == "competition")).alias("competition_ids"), of((F.col("kind") == "group") & group).alias("groups"), F.collect_set("nation").alias("nations")
    )
    return found.select("id", "name", "club_id", "competition_ids", F.array_sort(F.array_union("groups", "nations")).alias("group_ids"))


def place_individuals(rows: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """rows(id, node_ids, ...) of an individual sport: all groups but the root count as competitions too, and none as groups."""
    kept = nodes.where("kind = 'competition' OR (kind = 'group' AND depth > 0)").select(F.col("id").alias("node"))
    found = rows.select("id", F.explode("node_ids").alias("node")).join(kept, "node", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("node")).alias("competition_ids"))
    none = F.array().cast(_IDS)
    return rows.join(found, "id", "left").select(*columns, F.coalesce("competition_ids", none).alias("competition_ids"), none.alias("group_ids"))


def judge_clubs(clubs: DataFrame, friendlies: DataFrame) -> DataFrame:
    """clubs(id, name, competition_ids, group_ids) with removed_by, the rule that removes a club, or null; friendlies(id).

    Of clubs with one name and the same groups that of the lowest id stays, with the competitions of all.
    """
    played = clubs.select("id", F.explode("competition_ids").alias("c")).join(friendlies.select(F.col("id").alias("c")), "c", "left_anti").select("id").distinct()
    rows = clubs.join(played.withColumn("played", F.lit(True)), "id", "left")
    early = F.when(F.col("id").isin(etl.OTHER_SPORTS), RULES[0][0]).when(F.size("competition_ids") == 0, RULES[1][0]).when(F.col("played").isNull(), RULES[2][0])
    return _keepers(rows.withColumn("removed_by", early).drop("played"), ["name", "group_ids"], ["competition_ids"], RULES[3][0])


def _keepers(rows: DataFrame, keys: list[str], unions: list[str], rule: str) -> DataFrame:
    """rows with removed_by: of those that nothing removes yet and whose keys are equal all but the lowest id fall to a rule, and its arrays take in those of the others."""
    open_rows = rows.where("removed_by IS NULL")
    merged = etl.united(open_rows, keys, unions, F.min("id").alias("keeper"), F.max("id").alias("last")).where("keeper < last")
    merged = merged.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(u).alias(f"__{u}") for u in unions], "keeper")
    same = F.col("removed_by").isNull()
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = rows.join(merged, same, "left")
    is_keeper = F.col("id") == F.col("keeper")
    new = {u: F.when(is_keeper, F.col(f"__{u}")).otherwise(F.col(u)) for u in unions}
    new["removed_by"] = F.when(F.col("keeper").isNotNull() & ~is_keeper, rule).otherwise(F.col("removed_by"))
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns])


def is_placeholder(name: Column, club: Column) -> Column:
    """Whether a name is its club's with a number behind it."""
    tail = F.when((club != "") & name.startswith(club), F.substring(name, F.length(club) + 1, F.length(name)))
    return F.coalesce(tail.rlike(etl.PLACEHOLDER), F.lit(False))


def judge_players(players: DataFrame, clubs: DataFrame, individual: bool = False) -> DataFrame:
    """players(id, name, club_id, competition_ids, group_ids) with removed_by; clubs of judge_clubs().

    A player without a club stays in an individual sport alone. Of players of one name and club that of the lowest id stays, with all competitions and groups.
    """
    left = clubs.where("removed_by IS NULL").select(F.col("id").alias("club_id"), F.col("name").alias("__club"), F.lit(True).alias("__kept"))
    rows = players.join(left, "club_id", "left")
    gone = F.col("__kept").isNull() & ~(F.col("club_id").isNull() & F.lit(individual))
    rule = F.when(gone, RULES[4][0]).when(etl.noise_name(F.col("name")), RULES[5][0]).when(is_placeholder(F.col("name"), F.col("__club")), RULES[6][0])
    return _keepers(rows.select(*players.columns, rule.alias("removed_by")), ["name", "club_id"], ["competition_ids", "group_ids"], RULES[7][0])


def sweep_clubs(clubs: DataFrame, players: DataFrame) -> DataFrame:
    """clubs with removed_by: those that nothing removed and no player is left of."""
    held = players.where("removed_by IS NULL").select(F.col("club_id").alias("id")).distinct().withColumn("__held", F.lit(True))
    rows = clubs.join(held, "id", "left")
    return rows.withColumn("removed_by", F.when(F.col("removed_by").isNull() & F.col("__held").isNull(), RULES[8][0]).otherwise(F.col("removed_by"))).drop("__held")


def counts_by_rule(clubs: DataFrame, players: DataFrame) -> DataFrame:
    """(step, rule, clubs, players): what is left after every rule, from step 0, all that was read."""
    each = clubs.select(F.lit("club").alias("kind"), "removed_by").unionByName(players.select(F.lit("player").alias("kind"), "removed_by"))
    gone = F.coalesce(F.array_position(F.array(*[F.lit(r) for r, _ in RULES]), F.col("removed_by")), F.lit(len(RULES) + 1))
    known = each.groupBy("kind", gone.alias("gone")).agg(F.count("*").alias("n"))
    steps = clubs.sparkSession.createDataFrame([(k, r) for k, r in enumerate(["read", *[r for r, _ in RULES]])], "step int, rule string")
    left = steps.join(known, F.col("gone") > F.col("step"), "left")  # a handful of rows on either side
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(f"{kind}s")
    return left.groupBy("step", "rule").agg(of("club"), of("player"))


def prepare(build: Build, feed: DataFrame, nodes: DataFrame, individual: bool = False, league_id: int | None = None) -> dict[str, DataFrame]:
    """clubs, players (each with removed_by) and counts of a sport, as tables of a build.

    feed(participants[, page]) as readers.FEED, nodes(id, name, parent) of one sport with its node as the root. With ``league_id`` groups are
    kept as that league has them; else by each club's home country.
    """
    tree = build.table("tree", lambda: etl.classify(trees.walk(nodes)))
    friendlies = tree.where(F.contains(F.lower("name"), F.lit("friendly"))).select("id")
    raw_clubs = build.table("raw_clubs", lambda: etl.flatten_feed(feed, individual)[0])
    raw_players = build.table("raw_players", lambda: etl.flatten_feed(feed, individual)[1])
    if individual:
        placed = build.table("placed_clubs", lambda: place_individuals(raw_clubs, tree, ["id", "name"]))
        united = build.table("placed_players", lambda: place_individuals(raw_players, tree, ["id", "name", "club_id"]))
    else:
        placed = build.table("placed_clubs", lambda: place_clubs(raw_clubs, tree, league_id))
        united = build.table("placed_players", lambda: place_players(raw_players, placed, tree, league_id))
    judged = build.table("judged_clubs", lambda: judge_clubs(placed.select("id", "name", "competition_ids", "group_ids"), friendlies))
    players = build.table("players", lambda: judge_players(united, judged, individual))
    clubs = build.table("clubs", lambda: judged if individual else sweep_clubs(judged, players))
    return {"clubs": clubs, "players": players, "counts": build.table("counts", lambda: counts_by_rule(clubs, players))}
