"""One answer for each query, from the selected outcomes of its legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.operators.planner import last_of

#: Suggestions that a query shows at most, counted in places that show anything.
BUDGET = 3
#: Counted rows of related markets up to which they are broadcast.
BROADCAST_ROWS = 200_000


def place_outcomes(picks: DataFrame, outcomes: DataFrame, events: DataFrame) -> DataFrame:
    """picks(query_id, leg_idx, outcome_id, is_selected) with their outcome, offer and event; without a known event a pick isn't placed.

    Of an outcome id that repeats in outcomes(outcome_id, offer_id, event_id, ord, ...) the last counts.
    """
    return picks.join(last_of(outcomes, ["outcome_id"], ["ord"]), "outcome_id").join(events, "event_id")


def suggestions(related: DataFrame, offers: DataFrame, shown: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Offers of related markets: rank by rank over the legs, until ``budget`` places have shown something.

    related(query_id, leg_idx, rank, label), offers(query_id, leg_idx, label, offer_id): the offers of the leg's events; shown(query_id,
    offer_id). An offer is shown once, at its first place; a place whose offers are all shown already spends nothing.
    So an offer belongs to its first place, and the first places that own any are the budget's.
    """
    few = F.broadcast if related.count() <= BROADCAST_ROWS else lambda df: df
    rows = offers.join(few(related), ["query_id", "leg_idx", "label"]).join(shown, ["query_id", "offer_id"], "left_anti")
    first = Window.partitionBy("query_id", "offer_id").orderBy("rank", "leg_idx")
    own = rows.withColumn("__at", F.row_number().over(first)).where("__at = 1").drop("__at")
    # a query has at most as many places as related markets, and any number of offers
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy("rank", "leg_idx"))
    places = own.select("query_id", "rank", "leg_idx").distinct().withColumn("place", place).where(F.col("place") <= budget)
    return own.join(few(places), ["query_id", "rank", "leg_idx"])


def notes(legs: DataFrame) -> DataFrame:
    """(query_id, kind, leg_idx, code): what the answer has to say besides its results.

    Columns: query_id, leg_idx, match, had_fixture, fallback, found, placed, time_unresolved, has_window, other_sports, truncated, failed. A code is
    said once for a query where it isn't about one leg.
    """
    rules = [
        ("clarification", "no_fixture", (F.col("match") == "none") & ~F.col("had_fixture"), True),
        ("clarification", "no_market", (F.col("match") == "none") & F.col("had_fixture"), True),
        ("note", "subject_absent", F.col("fallback") == "subject-absent", True),
        ("note", "line_absent", F.col("fallback") == "line-absent", True),
        ("note", "odds_absent", F.col("fallback") == "odds-absent", True),
        ("note", "nothing_found", (F.col("match") != "none") & F.col("fallback").isNull() & ~F.col("found"), True),
        ("note", "no_event", F.col("found") & ~F.col("placed"), True),
        ("note", "time_partly_understood", F.col("time_unresolved") & F.col("has_window"), False),
        ("note", "time_not_understood", F.col("time_unresolved") & ~F.col("has_window"), False),
        ("note", "other_sports", F.coalesce(F.size("other_sports"), F.lit(0)) > 0, False),
        ("note", "truncated", F.col("truncated"), False),
        ("note", "partly_failed", F.col("failed"), False),
    ]
    each = F.array(
        *[
            F.when(F.coalesce(fits, F.lit(False)), F.struct(F.lit(kind).alias("kind"), (F.col("leg_idx") if own else F.lit(None).cast("int")).alias("leg_idx"), F.lit(code).alias("code")))
            for kind, code, fits, own in rules
        ]
    )
    found = legs.select("query_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("n"))
    return found.select("query_id", "n.kind", "n.leg_idx", "n.code").distinct()


def referenced(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows(query_id, event_id, ...) of events that hold a placed outcome of the query."""
    return rows.join(placed.select("query_id", "event_id").distinct(), ["query_id", "event_id"], "left_semi")


def envelopes(
    placed: DataFrame, additional: DataFrame | None, said: DataFrame, combinations: DataFrame | None = None, queries: DataFrame | None = None, other_events: DataFrame | None = None
) -> DataFrame:
    """One row for each query: events, results (highlighted offers with their outcomes, by event), additional, notes, clarification, combinations
    and combination_events (of ``other_events``: what combinations name and the results don't show).

    placed(query_id, event_id, event, offer_id, offer, outcome_id, outcome, is_selected, leg_idx). With queries(query_id) each of these has a row, others
    none.
    """
    outcome = F.struct("outcome_id", "outcome", "is_selected")
    offers = placed.groupBy("query_id", "event_id", "offer_id").agg(
        F.min("leg_idx").alias("leg_idx"), F.first("event").alias("event"), F.first("offer").alias("offer"), F.array_sort(F.collect_list(outcome)).alias("outcomes")
    )
    results = offers.groupBy("query_id", "event_id").agg(
        F.first("event").alias("event"), F.array_sort(F.collect_list(F.struct("leg_idx", "offer_id", "offer", "outcomes"))).alias("highlighted")
    )
    body = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("event_id", "event"))).alias("events"), F.array_sort(F.collect_list(F.struct("event_id", "highlighted"))).alias("results")
    )
    lines = said.groupBy("query_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "note", F.col("code")))).alias("notes"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "clarification", F.col("code")))), " ").alias("clarification"),
    )
    out = body.join(lines, "query_id", "full")
    extras = [("additional", additional), ("combinations", combinations), ("combination_events", other_events)]
    for name, extra in extras:
        if extra is not None:
            columns = [c for c in extra.columns if c != "query_id"]
            out = out.join(extra.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name)), "query_id", "full")
    if queries is not None:
        out = queries.select("query_id").distinct().join(out, "query_id", "left")
    lists = {f.name: F.coalesce(f.name, F.array().cast(f.dataType)) for f in out.schema if f.dataType.typeName() == "array"}
    return out.withColumns({**lists, "clarification": F.nullif(F.col("clarification"), F.lit(""))})


#: Bytes of an answer's part, and what a row has besides its text.
PART_BYTES, ROW_BYTES = 4 << 20, 40


def row_bytes(*texts: Column) -> Column:
    """About how many bytes a row takes: a fixed part, and its texts."""
    return sum((F.coalesce(F.octet_length(x), F.lit(0)) for x in texts), F.lit(ROW_BYTES)).cast("long")


def in_parts(rows: DataFrame, size: Column, bound: int = PART_BYTES) -> DataFrame:
    """rows(query_id, event_id, outcome_id, ...) with part: from 0, in the order of event and outcome, each of ``bound`` bytes or less and one row.

    Sizes are summed by event first, and the sums in front of an event are counted over events alone, so that no task holds the rows of a
    query; only those of one event are put in order together.
    """
    sized = rows.withColumn("__size", size)
    events = sized.groupBy("query_id", "event_id").agg(F.sum("__size").alias("__all"))
    ahead = F.sum("__all").over(Window.partitionBy("query_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    events = events.select(F.col("query_id").alias("__q"), F.col("event_id").alias("__e"), F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    within = F.sum("__size").over(Window.partitionBy("query_id", "event_id").orderBy("outcome_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.withColumn("__within", F.coalesce(within, F.lit(0))).join(events, (F.col("query_id") == F.col("__q")) & (F.col("event_id") == F.col("__e")))
    return placed.withColumn("part", F.floor((F.col("__ahead") + F.col("__within")) / bound)).drop("__q", "__e", "__ahead", "__within", "__size")


def answer_parts(rows: DataFrame, size: Column, bound: int = PART_BYTES) -> DataFrame:
    """(query_id, part, rows): the rows of each query's answer as arrays of bounded size, which only a writer joins."""
    fields = [c for c in rows.columns if c != "query_id"]
    ordered = F.struct("event_id", "outcome_id", *[c for c in fields if c not in ("event_id", "outcome_id")])
    return in_parts(rows, size, bound).groupBy("query_id", "part").agg(F.array_sort(F.collect_list(ordered)).alias("rows"))
