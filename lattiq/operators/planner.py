"""From settled legs to what is fetched, and the gates before it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions.offering import truncated
from lattiq.functions.timewin import within
from lattiq.operators.scope import right_state

#: Events of one request for offers: fewer if no offer types bound the answer.
BATCH_TYPED, BATCH_UNTYPED = 3, 2
#: Members of a team that are fetched for a competition-wide question.
SQUAD = 5


def incomplete(legs: DataFrame) -> DataFrame:
    """(query_id, incomplete): whether no leg of the query names a team, player, competition, region or player subject.

    Columns: teams, players, competition, region, subject_player.
    """
    names = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    said = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    anything = names("teams") | names("players") | said("competition") | said("region") | said("subject_player")
    return legs.groupBy("query_id").agg((~F.bool_or(anything)).alias("incomplete"))


def unsupported(plans: DataFrame, sports: DataFrame) -> DataFrame:
    """The plans whose sport isn't in sports(sport)."""
    return plans.join(sports.select("sport"), "sport", "left_anti")


def doubtful(cells: DataFrame) -> DataFrame:
    """The cells that a decider has to settle."""
    return cells.where(F.col("tier").isin("ambiguous", "shortlist", "none"))


def valid_picks(picks: DataFrame, candidates: DataFrame, keys: list[str], shown: int = 5) -> DataFrame:
    """The picks(keys, id) that are among the first ``shown`` candidates(keys, id, place)."""
    return picks.join(candidates.where(F.col("place") <= shown).select(*keys, "id"), [*keys, "id"], "left_semi")


def squads(members: DataFrame, team: str = "owner_id", player: str = "player_id", most: int = SQUAD) -> DataFrame:
    """(team, player) of each team's first members by id."""
    place = F.row_number().over(Window.partitionBy(team).orderBy(player))
    return members.withColumn("__place", place).where(F.col("__place") <= most).select(team, player)


def recall_inputs(legs: DataFrame) -> DataFrame:
    """One row for each query: distinct participants, groups (of legs without participants), levels; the play state if all legs
    agree on one; main_only if every leg asks for the main market.

    Columns: participant_ids, competition_id, level, play_state, concept.
    """
    free = F.coalesce(F.size("participant_ids"), F.lit(0)) == 0
    one = (F.count_distinct("play_state") == 1) & (F.count("play_state") == F.count("*"))
    return legs.groupBy("query_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("participant_ids", F.array().cast("array<bigint>")))))).alias("participant_ids"),
        F.array_sort(F.collect_set(F.when(free, F.col("competition_id")))).alias("group_ids"),
        F.array_sort(F.collect_set("level")).alias("levels"),
        F.when(one, F.max("play_state")).alias("play_state"),
        F.bool_and(F.coalesce(F.col("concept") == "main", F.lit(False))).alias("main_only"),
    )


def recall(inputs: DataFrame, offers: DataFrame, members: DataFrame) -> DataFrame:
    """The offers of each query: by event ids if it names any, else by participants and by groups together.

    inputs(query_id, event_ids, participant_ids, group_ids), offers(offer_id, event_id, group_id, ...), members(event_id, participant_id). Each way is an
    equi join; an offer that several ways fetch counts once. The column ``route`` names the way that came first.
    """
    ways = [("event", "event_ids", "event_id"), ("participant", "participant_ids", "participant_id"), ("group", "group_ids", "group_id")]
    found = []
    for rank, (route, ids, key) in enumerate(ways):
        asked = inputs if route == "event" else inputs.where(F.coalesce(F.size("event_ids"), F.lit(0)) == 0)
        wanted = asked.select("query_id", F.explode(ids).alias(key)).distinct()
        if route == "participant":
            wanted = wanted.join(members, key).select("query_id", "event_id").distinct()
            key = "event_id"
        rows = offers.join(wanted, key).select("query_id", *offers.columns, F.lit(rank).alias("__rank"), F.lit(route).alias("route"))
        found.append(rows)
    every = reduce(lambda a, b: a.unionByName(b), found)
    return first_of(every, ["query_id", "offer_id"], ["__rank"]).drop("__rank")


def events_of_groups(events: DataFrame, groups: DataFrame) -> DataFrame:
    """groups(query_id, group_id, ...) with every event of the group: a list that is never cut."""
    return groups.join(events, "group_id")


def fan_out(groups: DataFrame, events: DataFrame, typed: bool = False, most_events: int | None = None) -> DataFrame:
    """The requests that complete a cut answer of a group: its events that may fit, dealt into batches.

    groups(query_id, group_id, levels, play_state, window_start, window_end); events(event_id, group_id, level, state, start). Events of
    an unknown level, and without a start, stay. Gives query_id, group_id, event_id, batch (from 0, by event_id) and capped: whether
    ``most_events`` left events of the group out.
    """
    rows = events_of_groups(events, groups)
    level = F.col("level").isNull() | (F.size("levels") == 0) | F.array_contains("levels", F.col("level"))
    kept = rows.where(level & right_state(F.col("state"), F.col("play_state")) & within(F.col("start"), F.col("window_start"), F.col("window_end")))
    own = Window.partitionBy("query_id", "group_id")
    placed = kept.withColumn("__at", F.row_number().over(own.orderBy("event_id")))
    if most_events is not None:
        placed = placed.withColumn("__n", F.count("*").over(own)).where(F.col("__at") <= most_events)
    size = BATCH_TYPED if typed else BATCH_UNTYPED
    capped = F.lit(False) if most_events is None else F.col("__n") > most_events
    return placed.select("query_id", "group_id", "event_id", F.floor((F.col("__at") - 1) / size).cast("int").alias("batch"), capped.alias("capped"))


def fetch_flags(tasks: DataFrame) -> DataFrame:
    """(query_id, truncated, failed) from what each request reported: tasks(query_id, route, total, returned, failed).

    A cut answer of a group is completed by its fan-out (route ``fanout``, whose own cuts count), so it alone is no cut; any failed
    request makes the query's data incomplete.
    """
    cut = (F.col("route") != "group") & truncated(F.col("total"), F.col("returned"))
    return tasks.groupBy("query_id").agg(F.bool_or(F.coalesce(cut, F.lit(False))).alias("truncated"), F.bool_or(F.coalesce("failed", F.lit(False))).alias("failed"))


def first_of(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__first", place).where("__first = 1").drop("__first")


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a later task or batch overwrites."""
    return first_of(rows, keys, [F.col(c).desc() for c in order])


def signature(legs: DataFrame, fields: list[str], arrays: list[str]) -> DataFrame:
    """Legs with leg_group: legs of one query whose fields, and arrays in any order, are equal share one."""
    shape = F.to_json(F.struct(*fields, *[F.array_sort(c).alias(c) for c in arrays]))
    return legs.withColumn("leg_group", F.sha2(shape, 256))
