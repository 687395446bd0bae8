"""Which events and offers a leg of a query may use.

Rows are (leg, event) pairs, made by an equi join on what recall fetched for the query, so that many legs are
narrowed in one job. Every predicate keeps rows whose data is missing, as the data model asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions import timewin


def right_grain(level: Column, wanted: Column) -> Column:
    """The event's level is the leg's, or unknown."""
    return level.isNull() | (level == wanted)


def right_competition(group: Column, competition: Column) -> Column:
    """The event is in the leg's competition; either unknown keeps it."""
    return competition.isNull() | group.isNull() | (group == competition)


def right_state(state: Column, wanted: Column) -> Column:
    """prematch: not started (an unknown state is dropped); live: any other, finished and unknown ones too."""
    fresh = state.eqNullSafe(F.lit("NOT_STARTED"))
    return F.when(wanted == "prematch", fresh).when(wanted == "live", ~fresh).otherwise(True)


def all_teams(named: Column, present: Column) -> Column:
    """Every team that the leg names takes part; an event without teams is kept."""
    none = F.coalesce(F.size(present), F.lit(0)) == 0
    return none | (F.coalesce(F.size(F.array_except(named, present)), F.lit(0)) == 0)


def right_hour_of_day(start: Column, relative: Column, keys: list[str]) -> Column:
    """late or early: the last or first hour at which any of the leg's events of that day starts."""
    day = Window.partitionBy(*keys, F.to_date(start))
    h = F.hour(start)
    return start.isNull() | F.when(relative == "late", h == F.max(h).over(day)).when(relative == "early", h == F.min(h).over(day)).otherwise(True)


def pick_fixtures(pairs: DataFrame, keys: list[str], order: str = "pick_order", count: str = "pick_count") -> DataFrame:
    """The first or last ``count`` started events of each leg by start and event_id; without an order all."""
    first = Window.partitionBy(*keys).orderBy(F.col("start").asc_nulls_last(), F.col("event_id").asc())
    last = Window.partitionBy(*keys).orderBy(F.col("start").desc_nulls_last(), F.col("event_id").desc())
    place = F.when(F.col(order) == "earliest", F.row_number().over(first)).when(F.col(order) == "latest", F.row_number().over(last))
    kept = F.col(order).isNull() | (F.col("start").isNotNull() & (F.col("__place") <= F.col(count)))
    return pairs.withColumn("__place", place).where(kept).drop("__place")


def scope_events(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The (leg, event) pairs that fit.

    Leg columns: leg_level, competition_id, play_state, team_ids, window_start, window_end, after_hour, before_hour, relative,
    pick_order, pick_count. Event columns: event_id, level, group_id, state, start, teams. Time and teams bind
    only legs of the level fixture.
    """
    fixture = F.col("leg_level") == "fixture"
    start = F.col("start")
    broad = pairs.where(right_grain(F.col("level"), F.col("leg_level"))).where(right_competition(F.col("group_id"), F.col("competition_id")))
    broad = broad.where(right_state(F.col("state"), F.col("play_state"))).where(~fixture | all_teams(F.col("team_ids"), F.col("teams")))
    hour = ~fixture | right_hour_of_day(start, F.col("relative"), keys)
    timed = broad.withColumn("__hour", hour).where("__hour").drop("__hour")
    timed = timed.where(~fixture | timewin.within(start, F.col("window_start"), F.col("window_end")))
    timed = timed.where(~fixture | timewin.in_hours(start, F.col("after_hour"), F.col("before_hour")))
    picked = timed.withColumn("__order", F.when(fixture, F.col("pick_order")))
    return pick_fixtures(picked, keys, "__order").drop("__order")


def offers_of_events(offers: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """The offers (keys, event_id, ...) whose event is kept, and those without an event."""
    kept = events.select(*keys, "event_id").distinct()
    with_event = offers.where(F.col("event_id").isNotNull()).join(kept, [*keys, "event_id"], "left_semi")
    return with_event.unionByName(offers.where(F.col("event_id").isNull()))
