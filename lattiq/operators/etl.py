"""Preparation of the catalog: group trees, participants, and the index that queries use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions import offering
from lattiq.operators import planner, trees
from lattiq.operators.planner import first_of

# Names of market buckets, roots of other languages' copies, group nodes that are no countries, ids of other sports.
MARKET_NAMES = ["Specials", "Trophies", "Transfers", "Managers", "Grand Salami", "Club Tournaments", "Cross-Sport Specials", "Enhanced Accas"]
ALIAS_ROOTS = ["Marcatore"]
NOT_COUNTRIES = [
    "International Tournaments",
    "International Tournaments (W)",
    "International Youth Tournaments",
    "International Youth Friendlies",
    "International Youth Friendlies (W)",
    "Club Youth Tournaments",
]
OTHER_SPORTS = [1000011657, 1000005250, 1000432757, 1000246859, 1004030675, 1001402569]
# Patterns of names that are bets or placeholders.
PERIOD_SUFFIX = r"\s(?:Penalties|Extra Time|Regular Time)$"
BET_EXPRESSION = r"win\s*&|&\s*(?:Over|Under)\s"
PLACEHOLDER = r"^\s*#\d+$"


def is_test_node(name: Column) -> Column:
    """Whether a node is a test or a request for a bet."""
    return name.rlike(r"(?i)^(?:test|testing)$") | F.contains(name, F.lit("(TEST")) | F.contains(name, F.lit("Request a Bet"))


def concat_feeds(feeds: list[DataFrame], key: str = "id") -> DataFrame:
    """All rows of feeds in their order; of an id the first."""
    tagged = [f.withColumn("__feed", F.lit(k)) for k, f in enumerate(feeds)]
    every = tagged[0]
    for more in tagged[1:]:
        every = every.unionByName(more)
    return first_of(every, [key], ["__feed"]).drop("__feed")


def walk_tree(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """nodes(id, name, parent) with depth (roots 0), path (ids from the root) and child_count; see trees.walk()."""
    return trees.walk(nodes)


def branch_of(path: Column) -> Column:
    """The node below the root that a path goes through."""
    return F.try_element_at(path, F.lit(2))


def classify(walked: DataFrame) -> DataFrame:
    """walked (of one sport, whose node is the root) with kind: group (the root, and countries: nodes just below it that have children), market (tests,
    buckets, and other languages' copies with all below them), else competition."""
    name = F.trim(F.coalesce("name", F.lit("")))
    copies = walked.where(name.isin(ALIAS_ROOTS)).select(F.col("id").alias("__node"))
    below = walked.select("id", F.explode("path").alias("__node")).join(copies, "__node", "left_semi").select("id").distinct().withColumn("__copy", F.lit(True))
    market = F.coalesce("__copy", F.lit(False)) | is_test_node(name) | name.isin(MARKET_NAMES) | name.endswith(" Specials")
    kind = F.when(F.col("depth") == 0, "group").when(market, "market").when((F.col("depth") == 1) & (F.col("child_count") > 0), "group").otherwise("competition")
    return walked.join(below, "id", "left").withColumn("kind", kind).drop("__copy")


def countries_of(classified: DataFrame) -> DataFrame:
    """The countries among classified nodes: groups below the root that aren't headings of tournaments."""
    return classified.where((F.col("depth") == 1) & (F.col("kind") == "group") & ~F.coalesce(F.col("name").isin(NOT_COUNTRIES), F.lit(False)))


def home_country(members: DataFrame, classified: DataFrame) -> DataFrame:
    """(id, country): the country that most of an entity's competitions are under; a tie takes the first counted. members(id, competition_id, ord)."""
    counted = members.groupBy("id", "competition_id").agg(F.count("*").alias("votes"), F.min("ord").alias("first"))
    up = classified.where("kind = 'competition' AND depth > 1").select(F.col("id").alias("competition_id"), F.try_element_at("path", F.lit(2)).alias("country"))
    up = up.join(countries_of(classified).select(F.col("id").alias("country")), "country", "left_semi")
    votes = counted.join(up, "competition_id").groupBy("id", "country").agg(F.sum("votes").alias("votes"), F.min("first").alias("first"))
    return first_of(votes, ["id"], [F.desc("votes"), "first", "country"]).select("id", "country")


def united(rows: DataFrame, keys: list[str], arrays: list[str], *more: Column) -> DataFrame:
    """(keys, arrays, more): the union of the arrays of equal keys, each sorted; the sets are merged before the shuffle. ``more`` are aggregates that repeated rows don't change."""
    none = F.array().cast("array<bigint>")

    def marked(array: str, k: int) -> Column:
        return F.transform(F.coalesce(array, none), lambda x: F.struct(F.lit(k).alias("of"), x.alias("item")))

    items = [marked(a, k) for k, a in enumerate(arrays)]
    each = rows.withColumn("__i", F.explode_outer(F.concat(*items)))
    return each.groupBy(*keys).agg(*[F.array_sort(F.collect_set(F.when(F.col("__i.of") == k, F.col("__i.item")))).alias(a) for k, a in enumerate(arrays)], *more)


def merge_keepers(rows: DataFrame, keys: list[Column], unions: list[str]) -> DataFrame:
    """Of rows with equal keys that with the lowest id, its ``unions`` arrays joined with those of the others, sorted."""
    names = [f"__k{k}" for k in range(len(keys))]
    keyed = rows.withColumns(dict(zip(names, keys)))
    merged = united(keyed, names, unions, F.min("id").alias("id"))
    own = keyed.select(*[c for c in rows.columns if c not in unions])
    return merged.join(first_of(own, ["id"], ["id"]), "id").select(*rows.columns)


def union_players(rows: DataFrame) -> DataFrame:
    """Players over all teams: first club and name seen (ord), arrays joined. rows(id, name, club_id, competition_ids, group_ids, ord)."""
    first = [F.min_by(c, "ord").alias(c) for c in ("name", "club_id")]
    return united(rows, ["id"], ["competition_ids", "group_ids"], *first).select("id", "name", "club_id", "competition_ids", "group_ids")


def backfill_countries(clubs: DataFrame, countries: DataFrame, sport_root: int) -> DataFrame:
    """National teams that hold only the sport's root get the country node of their name. countries(id, name)."""
    match = countries.select(F.col("name").alias("name"), F.col("id").alias("__country")).dropDuplicates(["name"])
    only_root = F.size(F.array_except("group_ids", F.array(F.lit(sport_root)))) == 0
    joined = clubs.join(match, "name", "left")
    added = F.when(only_root & F.col("__country").isNotNull(), F.array_sort(F.array_union("group_ids", F.array("__country")))).otherwise(F.col("group_ids"))
    return joined.withColumn("group_ids", added).select(*clubs.columns)


def noise_name(name: Column) -> Column:
    """Whether a player's name is too short, has a double space, or is a bet."""
    n = F.coalesce(name, F.lit(""))
    return (F.length(n) <= 1) | F.contains(n, F.lit("  ")) | n.rlike(PERIOD_SUFFIX) | n.rlike(BET_EXPRESSION)


def flatten_feed(feed: DataFrame, individual: bool = False) -> tuple[DataFrame, DataFrame]:
    """(clubs(id, name, node_ids, ord), players(id, name, club_id, node_ids, ord)) of a raw feed(participants), of which a team listed twice counts once.

    Clubs are teams with members, players their members; of individual sports clubs are all teams and players the participants at the top. A feed of several
    rows has a column ``page`` that orders them.
    """
    page = F.col("page").cast("long") if "page" in feed.columns else F.lit(0).cast("long")
    rows = feed.select(page.alias("page"), F.posexplode("participants").alias("at", "p")).select(F.struct("page", "at").alias("ord"), "p.*").withColumn("english", offering.english_name(F.col("names")))
    teams = rows.where("type = 'TEAM'")
    teams = first_of(teams if individual else teams.where(F.coalesce(F.size("teamMembers"), F.lit(0)) > 0), ["id"], ["ord"])
    clubs = teams.select("id", F.col("english").alias("name"), F.col("groupIds").alias("node_ids"), "ord")
    if individual:
        top = planner.last_of(rows.where("type = 'PARTICIPANT'"), ["id"], ["ord"])
        own = top.select("id", offering.player_name(F.col("english")).alias("name"), F.lit(None).cast("long").alias("club_id"), F.col("groupIds").alias("node_ids"), F.struct("ord.page", "ord.at", F.lit(0).alias("member")).alias("ord"))
        return clubs, own
    member = teams.select("ord", F.col("id").alias("club_id"), F.posexplode("teamMembers").alias("member", "m")).where("m.type = 'PARTICIPANT'")
    name = offering.player_name(offering.english_name(F.col("m.names")))
    return clubs, member.select(F.col("m.id").alias("id"), name.alias("name"), "club_id", F.col("m.groupIds").alias("node_ids"), F.struct("ord.page", "ord.at", "member").alias("ord"))


def whitelist(walked: DataFrame, referenced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, branches): the nodes that entities refer to, and the branches above them. referenced(id)."""
    groups = walked.join(referenced.select("id"), "id", "left_semi").withColumn("branch", branch_of(F.col("path")))
    branches = walked.join(groups.select(F.col("branch").alias("id")).distinct(), "id", "left_semi").select("id", "name")
    return groups, branches


def twins(nodes: DataFrame) -> DataFrame:
    """(men, women): nodes whose name is another's with `` women``, where that other doesn't hold the word."""
    plain = nodes.select(F.col("id").alias("men"), F.concat(F.lower("name"), F.lit(" women")).alias("key")).where(~F.contains(F.lower(F.col("key")), F.lit("women women")))
    plain = plain.where(~F.regexp_replace("key", " women$", "").contains("women"))
    return plain.join(nodes.select(F.col("id").alias("women"), F.lower("name").alias("key")), "key").select("men", "women")


def provenance(memberships: DataFrame, feeds: dict[str, str]) -> DataFrame:
    """(id, gender) by the feeds that hold an id: women's only, men's only; both: that of the main tours. memberships(id, feed)."""
    is_in = lambda kind: F.bool_or(F.col("feed").isin([f for f, g in feeds.items() if g.startswith(kind)]))
    main = lambda kind: F.bool_or(F.col("feed").isin([f for f, g in feeds.items() if g == f"{kind} main"]))
    seen = memberships.groupBy("id").agg(is_in("men").alias("m"), is_in("women").alias("w"), main("men").alias("mm"), main("women").alias("wm"))
    gender = F.when(F.col("w") & ~F.col("m"), "women").when(F.col("m") & ~F.col("w"), "men").when(F.col("wm") & ~F.col("mm"), "women").when(F.col("mm") & ~F.col("wm"), "men")
    return seen.select("id", gender.alias("gender"))


def prune_gender(players: DataFrame, gender: DataFrame, pairs: DataFrame) -> DataFrame:
    """Players without the other gender's twin among their competitions."""
    wrong = pairs.select(F.lit("women").alias("gender"), F.col("men").alias("__c")).unionByName(pairs.select(F.lit("men").alias("gender"), F.col("women").alias("__c"))).distinct()
    held = players.select("id", F.explode("competition_ids").alias("__c")).join(gender, "id").join(wrong, ["gender", "__c"])
    drop = held.groupBy("id").agg(F.collect_set("__c").alias("__drop"))
    joined = players.join(drop, "id", "left")
    pruned = F.when(F.col("__drop").isNotNull(), F.array_except("competition_ids", "__drop")).otherwise(F.col("competition_ids"))
    return joined.withColumn("competition_ids", pruned).select(*players.columns)


def mirror_individuals(players: DataFrame) -> DataFrame:
    """Players of an individual sport as team rows that only lookups see, by full and by last name."""
    base = players.select("id", "name", "competition_ids", F.array().cast("array<bigint>").alias("group_ids"), F.lit(None).cast("string").alias("variant"), F.lit(False).alias("listed"))
    last = base.withColumn("name", F.element_at(F.split("name", " "), -1)).where(F.col("name") != "")
    return base.unionByName(last).distinct()


def rosters(players: DataFrame) -> DataFrame:
    """(owner_id, player_id): competitions and national teams with their players."""
    return players.select("id", F.explode(F.array_union("competition_ids", F.filter(F.array("country_team_id"), lambda x: x.isNotNull()))).alias("owner_id")).select("owner_id", F.col("id").alias("player_id")).distinct()


def index_version(rows: DataFrame) -> DataFrame:
    """(version): 12 hex digits of the hash of all (id, name), a line each in the order of ids.

    Lines are hashed in groups of 65,536 ids first and the groups' hashes together, so no task holds all lines.
    """
    part = F.floor(F.col("id") / 65536)
    line = F.concat_ws("\t", F.col("id").cast("string"), F.col("name"))
    groups = rows.select(part.alias("part"), "id", line.alias("line")).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("lines"))
    hashes = groups.select("part", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), 256).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n")
    return hashes.agg(F.left(F.sha2(joined, 256), F.lit(12)).alias("version"))


def counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of each table."""
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def build_index(walked: DataFrame, clubs: DataFrame, players: DataFrame, gender: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a sport's index: groups and branches that clubs and players refer to, teams, players (of an unknown or known gender, without
    the other's twin competitions), rosters, and counts and version of it all.

    walked as of walk_tree(); clubs(id, name, competition_ids, group_ids, variant), players(id, name, club_id, country_team_id, competition_ids).
    """
    if gender is not None:
        players = prune_gender(players, gender, twins(walked.select("id", "name")))
    each = lambda df, c: df.select(F.explode(c).alias("id"))
    referenced = each(clubs, "competition_ids").unionByName(each(clubs, "group_ids")).unionByName(each(players, "competition_ids")).distinct()
    groups, branches = whitelist(walked, referenced)
    tables = {"groups": groups.select("id", "name", "parent", "branch"), "branches": branches, "teams": clubs, "players": players, "rosters": rosters(players)}
    names = tables["groups"].select("id", "name").unionByName(clubs.select("id", "name")).unionByName(players.select("id", "name"))
    return {**tables, "version": index_version(names), "counts": counts(**{k: tables[k] for k in ("groups", "branches", "teams", "players")})}
