"""Names of a query matched to catalog entities, for many queries at once.

Texts are grounded once per distinct context and joined back. Exact lookups are equi joins on folded names; fuzzy
ones join on content tokens (an inverted index), so no text meets all names. Each function returns one row for
every text: tier, and candidates (array of id, score in their order).

Catalog tables: groups(id, name, branch), branches(id, name), teams(id, name, competition_ids, group_ids, variant),
players(id, name, club_id, country_team_id, competition_ids), rosters(owner_id, player_id).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions import text
from lattiq.operators.matching import covers, holding_all
from lattiq.sources.written import stage, whole

#: Candidates of a text; covers from which a name holds (almost) all or enough of it; how many times larger a rival's roster must be.
TOP_K = 5
FULL_COVER, SOME_COVER, MAJOR_RATIO = 0.99, 0.45, 3
TIE = 1e-6
# National team variants by marker.
VARIANTS = {"u23": "youth_men_u23", "u21": "youth_men_u21", "u20": "youth_men_u20"}
DEFAULT_VARIANT = "senior_men"

_EMPTY = "array<struct<id:bigint,score:double>>"


def clear_lead(score: Column, keys: list[str], order: list[str | Column]) -> Column:
    """Whether a row leads the next one of its keys by more than a tie, or has none after it."""
    after = F.lead(score).over(Window.partitionBy(*keys).orderBy(*order))
    return after.isNull() | (score - after > TIE)


def _candidates(rows: DataFrame, keys: list[str], place: str = "place", most: int = TOP_K) -> DataFrame:
    """keys and candidates: the first ``most`` (id, score) by place."""
    kept = rows.where(F.col(place) <= most)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"))))
    return kept.groupBy(*keys).agg(ordered.alias("found")).select(
        *keys, F.transform("found", lambda c: F.struct(c["id"].alias("id"), c["score"].alias("score"))).alias("candidates")
    )


def _finish(texts: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """A row for every text; none where nothing was found."""
    return texts.select(*keys).distinct().join(found, keys, "left").select(
        *keys, F.coalesce("tier", F.lit("none")).alias("tier"), F.coalesce("candidates", F.array().cast(_EMPTY)).alias("candidates")
    )


def _aliased(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """texts(text) with wording: the alias of the folded text, else the text. aliases(key, value) is a lexicon of a few hundred rows."""
    lookup = aliases.select(text.fold(F.col("key")).alias("__key"), F.col("value").alias("__value")).dropDuplicates(["__key"])
    return texts.withColumn("__key", text.fold(F.col("text"))).join(lookup, "__key", "left").withColumn("wording", F.coalesce("__value", "text")).drop("__key", "__value")


def ground_regions(texts: DataFrame, branches: DataFrame, aliases: DataFrame) -> DataFrame:
    """texts(text) to branches: an exact name behind aliases, else the best cover."""
    own = _aliased(texts.select("text").distinct(), aliases).withColumn("key", text.fold(F.col("wording")))
    exact = own.join(branches.select("id", text.fold(F.col("name")).alias("key")), "key").withColumn("score", F.lit(1.0))
    by_text = Window.partitionBy("text")
    exact = exact.withColumn("place", F.row_number().over(by_text.orderBy("id"))).withColumn("n", F.count("*").over(by_text))
    hit = _candidates(exact, ["text"]).join(exact.groupBy("text").agg(F.max("n").alias("n")), "text")
    hit = hit.select("text", F.when(F.col("n") == 1, "confident").otherwise("ambiguous").alias("tier"), "candidates")
    rest = own.join(exact.select("text").distinct(), "text", "left_anti").withColumn("wording", F.col("key"))
    fuzzy = covers(rest, ["text"], branches, least=SOME_COVER).withColumn("score", F.col("cover"))
    order = by_text.orderBy(F.round("cover", 9).desc(), "id")
    fuzzy = fuzzy.withColumns({"place": F.row_number().over(order), "next": F.lead("cover").over(order)})
    first = fuzzy.where("place = 1").select(
        "text", (F.col("next").isNull() | (F.col("cover") - F.col("next") > TIE)).alias("clear"), (F.col("cover") >= FULL_COVER).alias("full")
    )
    near = fuzzy.join(first, "text").where(~F.col("clear") | (F.col("place") == 1))
    tiers = first.select("text", F.when(F.col("clear") & F.col("full"), "confident").otherwise("shortlist").alias("tier"))
    return _finish(texts, ["text"], hit.unionByName(_candidates(near, ["text"]).join(tiers, "text").select("text", "tier", "candidates")))


def ground_competitions(texts: DataFrame, groups: DataFrame, rosters: DataFrame, aliases: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """texts(context, text, branch, bound) to groups.

    A region's branch cuts the pool unless that leaves nothing; allowed(context, id) cuts the pool of bound contexts, and may leave
    nothing. Full covers rank by roster size; a single exact name wins unless a full cover has a roster more
    than three times as large.
    """
    keys = ["context", "text"]
    own = _aliased(texts.select(*keys, "branch", "bound").distinct(), aliases).withColumn("key", text.fold(F.col("wording")))
    size = rosters.groupBy(F.col("owner_id").alias("id")).agg(F.count("*").alias("size"))
    # the branch cut binds where any group is under the branch
    branches = groups.select(F.col("branch").alias("own_branch")).where("own_branch IS NOT NULL").distinct().withColumn("real", F.lit(True))
    cut = own.join(branches, F.col("branch") == F.col("own_branch"), "left").drop("own_branch")
    facts = groups.select("id", F.col("branch").alias("own_branch"), text.fold(F.col("name")).alias("folded"))
    inside = None if allowed is None else allowed.select("context", "id").distinct().withColumn("inside", F.lit(True))

    def pool_of(asked: DataFrame, least: float) -> DataFrame:
        pool = covers(asked, keys, groups, least=least).join(whole(facts), "id").join(asked, keys)
        pool = pool.where(F.col("real").isNull() | (F.col("own_branch") == F.col("branch")))
        if inside is not None:
            pool = pool.join(inside, ["context", "id"], "left").where(~F.coalesce("bound", F.lit(False)) | F.coalesce("inside", F.lit(False))).drop("inside")
        return pool.join(whole(size), "id", "left").withColumns({"size": F.coalesce("size", F.lit(0)), "full": F.col("cover") >= FULL_COVER, "score": F.col("cover")})

    # names of SOME_COVER decide; only a text that has some, but none in full and fewer than are shown, has its list filled with lesser ones
    cut = stage(cut)
    near = stage(pool_of(cut, SOME_COVER))
    held = near.groupBy(*keys).agg(F.sum(F.col("full").cast("int")).alias("n_full"), F.count("*").alias("n"))
    few = (F.col("n_full") == 0) & (F.col("n") < TOP_K)
    kept = near.join(held.where(~few).select(*keys, "n_full"), keys).where((F.col("n_full") == 0) | F.col("full"))
    short = stage(cut.join(held.where(few).select(*keys), keys, "left_semi"))
    pool = kept
    if not short.isEmpty():
        pool = kept.unionByName(pool_of(short, 0.0).withColumn("n_full", F.lit(0).cast("long")).select(*kept.columns))
    pool = stage(pool)
    exact = F.col("full") & (F.col("folded") == F.col("key"))
    pool = pool.withColumn("exact", exact)
    facts_of = pool.groupBy(*keys).agg(F.sum(F.col("exact").cast("int")).alias("n_exact"), F.max(F.when(F.col("exact"), F.col("size"))).alias("exact_size"), F.max(F.when(~F.col("exact"), F.col("size"))).alias("rival"))
    pool = pool.join(facts_of, keys)
    leg = Window.partitionBy(*keys)
    clear = (F.col("n_exact") == 1) & ~F.coalesce(F.col("rival") > MAJOR_RATIO * F.col("exact_size"), F.lit(False))
    tier = (
        F.when(F.col("n_full") == 0, "shortlist")
        .when(F.col("n_full") == 1, "confident")
        .when(clear, "confident")
        .otherwise("ambiguous")
    )
    pool = pool.withColumn("tier", tier).where((F.col("tier") != "confident") | (F.col("n_full") == 1) | F.col("exact"))
    by_size = F.when(F.col("n_full") > 0, F.col("size")).otherwise(F.round("cover", 9))
    then = F.when(F.col("n_full") > 0, F.round("cover", 9)).otherwise(F.col("size"))
    pool = pool.withColumn("place", F.row_number().over(leg.orderBy(by_size.desc(), then.desc(), "id")))
    tiers = pool.groupBy(*keys).agg(F.first("tier").alias("tier"))
    return _finish(texts, keys, _candidates(pool, keys).join(tiers, keys).select(*keys, "tier", "candidates"))


def ground_teams(texts: DataFrame, teams: DataFrame, markers: Column) -> DataFrame:
    """texts(text) to teams: the exact name (among national teams the marked variant), else all content tokens.

    teams may hold rows that only lookups see (``listed`` false), which the token search skips.
    """
    own = texts.select("text").distinct().withColumn("key", text.fold(F.col("text")))
    mark = text.first_marker(F.col("text"), markers)
    variant = reduce(lambda o, k: F.when(mark == k, VARIANTS[k]).otherwise(o), VARIANTS, F.lit(DEFAULT_VARIANT))
    by_text = Window.partitionBy("text")
    exact = own.withColumn("wanted", variant).join(whole(teams.select("id", "variant", text.fold(F.col("name")).alias("key"))), "key")
    exact = exact.withColumn("fits", F.coalesce(F.col("variant") == F.col("wanted"), F.lit(False)))
    exact = exact.withColumn("any_fit", F.max(F.col("fits").cast("int")).over(by_text) == 1).where(~F.col("any_fit") | F.col("fits"))
    exact = exact.withColumns({"score": F.lit(1.0), "place": F.row_number().over(by_text.orderBy("id")), "n": F.count("*").over(by_text)})
    tier = F.when(F.max("n") == 1, "confident").otherwise("ambiguous").alias("tier")
    hit = _candidates(exact, ["text"]).join(exact.groupBy("text").agg(tier), "text")
    rest = own.join(exact.select("text").distinct(), "text", "left_anti")
    listed = teams.where("listed") if "listed" in teams.columns else teams
    part = stage(holding_all(rest, ["text"], listed, "text")).withColumns({"score": F.lit(0.8), "place": F.row_number().over(by_text.orderBy("id"))})
    part = part.join(part.groupBy("text").agg(F.count("*").alias("n")), "text")
    near_tier = F.when(F.max("n") == 1, "confident").otherwise("shortlist").alias("tier")
    near = _candidates(part, ["text"]).join(part.groupBy("text").agg(near_tier), "text")
    return _finish(texts, ["text"], hit.unionByName(near))


def ground_players(texts: DataFrame, players: DataFrame, scopes: DataFrame | None = None, competitions: DataFrame | None = None) -> DataFrame:
    """texts(context, text) to players: the full name, else the last name; cut to the context's teams where that leaves any.

    scopes(context, team_id) are confident teams, competitions(context, competition_id) a confident competition.
    """
    keys = ["context", "text"]
    own = texts.select(*keys).distinct().withColumn("key", text.fold(F.col("text"))).withColumn("last", text.last_token(F.col("key")))
    names = players.select("id", "club_id", "country_team_id", "competition_ids", text.fold(F.col("name")).alias("full"))
    full = own.join(names, F.col("key") == F.col("full")).withColumn("weak", F.lit(False))
    rest = own.join(full.select(*keys).distinct(), keys, "left_anti")
    surname = rest.join(names.withColumn("surname", text.last_token(F.col("full"))), F.col("last") == F.col("surname")).withColumn("weak", F.lit(True))
    found = full.drop("full").unionByName(surname.drop("full", "surname"))
    inside = F.lit(False)
    if scopes is not None:
        own_teams = scopes.groupBy("context").agg(F.collect_set("team_id").alias("own_teams"))
        found = found.join(own_teams, "context", "left")
        member = F.array_contains("own_teams", F.col("club_id")) | F.array_contains("own_teams", F.col("country_team_id"))
        inside = inside | F.coalesce(F.array_contains("own_teams", F.col("club_id")), F.lit(False)) | F.coalesce(member, F.lit(False))
        inside = inside | F.coalesce(F.array_contains("own_teams", F.col("country_team_id")), F.lit(False))
    if competitions is not None:
        found = found.join(competitions.groupBy("context").agg(F.first("competition_id").alias("own_competition")), "context", "left")
        inside = inside | F.coalesce(F.array_contains("competition_ids", F.col("own_competition")), F.lit(False))
    leg = Window.partitionBy(*keys)
    found = found.withColumn("inside", inside).withColumn("scoped", F.max(F.col("inside").cast("int")).over(leg) == 1)
    found = found.where(~F.col("scoped") | F.col("inside"))
    soft = F.col("weak") & ~F.col("scoped")
    found = found.withColumns({"score": F.when(soft, 0.7).otherwise(1.0), "soft": soft, "n": F.count("*").over(leg), "place": F.row_number().over(leg.orderBy("id"))})
    tier = F.when(F.first("soft"), "shortlist").when(F.max("n") == 1, "confident").otherwise("ambiguous").alias("tier")
    return _finish(texts, keys, _candidates(found, keys).join(found.groupBy(*keys).agg(tier), keys))


def allow_set(found: DataFrame, entities: DataFrame, context: str = "context") -> DataFrame:
    """(context, id): the competitions of all candidates. found(context, candidates), entities(id, competition_ids)."""
    each = found.select(context, F.explode("candidates").alias("c")).select(context, F.col("c.id").alias("__id"))
    joined = each.join(whole(entities.select(F.col("id").alias("__id"), "competition_ids")), "__id")
    return joined.select(context, F.explode("competition_ids").alias("id")).distinct()


def ground_legs(legs: DataFrame, catalog: dict[str, DataFrame], markers: Column, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The cascade for legs(query_id, leg_idx, region, competition, teams, players, subject_player): regions, teams, players under
    the confident teams, then competitions among the players' (else the teams') leagues.

    Gives one row for each (query_id, leg_idx, cell, text): tier and candidates. ``stage`` may write each step's rows away.
    """
    leg = ["query_id", "leg_idx"]
    context = F.concat_ws("/", *leg)
    rows = legs.withColumn("context", context)
    regions = rows.where("region IS NOT NULL AND region <> ''").select(*leg, "context", F.col("region").alias("text"))
    region_found = stage(regions.join(ground_regions(regions, catalog["branches"], catalog["region_aliases"]), "text"))
    team_texts = rows.select(*leg, "context", F.explode("teams").alias("text"))
    team_found = stage(team_texts.join(ground_teams(team_texts, catalog["teams"], markers), "text"))
    sure = team_found.where("tier = 'confident'").select("context", F.explode("candidates").alias("c")).select("context", F.col("c.id").alias("team_id"))
    named = rows.select(*leg, "context", F.explode(F.array_distinct(F.concat("players", F.when(F.col("subject_player").isNotNull(), F.array("subject_player")).otherwise(F.array().cast("array<string>"))))).alias("text"))
    player_found = stage(named.join(ground_players(named, catalog["players"], sure), ["context", "text"]))
    by_players, by_teams = allow_set(player_found, catalog["players"]), allow_set(team_found, catalog["teams"])
    allowed = by_players.unionByName(by_teams.join(by_players.select("context").distinct(), "context", "left_anti"))
    branch = region_found.where("tier = 'confident'").select("context", F.element_at("candidates", 1)["id"].alias("branch"))
    bound = allowed.select("context").distinct().withColumn("bound", F.lit(True))
    asked = rows.where("competition IS NOT NULL AND competition <> ''").select(*leg, "context", F.col("competition").alias("text"))
    asked = asked.join(branch, "context", "left").join(bound, "context", "left").withColumn("bound", F.coalesce("bound", F.lit(False)))
    groups = ground_competitions(asked, catalog["groups"], catalog["rosters"], catalog["competition_aliases"], allowed)
    comp_found = stage(asked.select(*leg, "context", "text").join(groups, ["context", "text"]))
    cells = [("region", region_found), ("team", team_found), ("player", player_found), ("competition", comp_found)]
    each = [df.select(*leg, F.lit(cell).alias("cell"), "text", "tier", "candidates") for cell, df in cells]
    return reduce(lambda a, b: a.unionByName(b), each)
