"""Fetching offers from a source whose answers are capped: rounds of ever finer requests until nothing is cut.

The first round asks by group, by participants, or by events that are named. What an answer holds and what there is (``total``) are written as
a log of the round; the next round is planned from that log alone. A cut group becomes batches of its events (a list that is never cut), a cut batch
single events, a cut event its offer types. A request that was refined counts no more. An answer by participants, and one of a single type of an event,
can't be refined: it stays as it is, and the log shows that it is cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions.offering import truncated
from lattiq.operators import planner
from lattiq.sources.written import few, stage

#: What a cut request of a route is refined to.
FINER = {"group": "batch", "batch": "event", "event": "typed"}
_OFFER = ["offer_id", "event_id", "group_id", "offer_type"]
_TASK = ["task_id", "query_id", "route", "group_id", "participant_id", "event_id", "offer_type"]


def _tasks(rows: DataFrame, route: str, *parts: str) -> DataFrame:
    """Requests of a route, a row for each id that they ask for; ``parts`` name one within its query."""
    task_id = F.concat_ws("|", "query_id", F.lit(route), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts])
    named = rows.withColumns({"task_id": task_id, "route": F.lit(route)})
    kinds = {"group_id": "long", "participant_id": "long", "event_id": "long", "offer_type": "int"}
    return named.select(*[c if c in named.columns else F.lit(None).cast(kinds[c]).alias(c) for c in _TASK]).distinct()


def _batched(rows: DataFrame, size: int) -> DataFrame:
    """rows(query_id, event_id) with batch: ``size`` events each, by event_id."""
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("event_id"))
    return rows.distinct().withColumn("batch", F.floor((at - 1) / size))


def first_tasks(inputs: DataFrame, size: int) -> DataFrame:
    """The first round of inputs(query_id, event_ids, participant_ids, group_ids): events that are named, else all participants in one request and each group in its own."""
    said = F.coalesce(F.size("event_ids"), F.lit(0)) > 0
    named = _batched(inputs.where(said).select("query_id", F.explode("event_ids").alias("event_id")), size)
    people = inputs.where(~said).select("query_id", F.explode("participant_ids").alias("participant_id"))
    groups = inputs.where(~said).select("query_id", F.explode("group_ids").alias("group_id"))
    return _tasks(named, "batch", "batch").unionByName(_tasks(people, "participant")).unionByName(_tasks(groups, "group", "group_id"))


def reachable_events(inputs: DataFrame, events: DataFrame) -> DataFrame:
    """event_id, each once, of the events that planner.recall() or fetch() may return offers of: named ones, a participant's, or a group's.

    inputs(query_id, event_ids, participant_ids, group_ids), events(event_id, group_id, members).
    """
    said, asked = F.coalesce(F.size("event_ids"), F.lit(0)) > 0, []
    for way, ids, fits in (("event", "event_ids", said), ("participant", "participant_ids", ~said), ("group", "group_ids", ~said)):
        asked.append(inputs.where(fits).select(F.lit(way).alias("way"), F.explode(F.col(ids).cast("array<bigint>")).alias("id")))
    asked = stage(reduce(DataFrame.unionByName, asked).distinct())
    key = lambda way, x: F.struct(F.lit(way).alias("way"), x.cast("long").alias("id"))
    people = F.transform(F.coalesce("members", F.array().cast("array<bigint>")), lambda m: key("participant", m))
    keys = F.concat(F.array(key("event", F.col("event_id")), key("group", F.col("group_id"))), people)
    found = events.select("event_id", F.explode(keys).alias("key")).select("event_id", "key.*")
    return found.join(few(asked), ["way", "id"], "left_semi").select("event_id").distinct()


def reachable(tasks: DataFrame, offers: DataFrame, events: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of offers that a request of the first round, or any that takes its place, may get: by their own group, or by an event that is named, listed for a group or a participant's."""
    routes = _routes(tasks)
    asked = lambda route, key: tasks.where(F.col("route") == route).select(key).distinct()
    ids = [asked("batch", "event_id")]
    if "group" in routes:
        groups = few(asked("group", "group_id"))
        ids.append(events.select("event_id", "group_id").join(groups, "group_id", "left_semi").select("event_id"))
    if "participant" in routes:
        ids.append(members.join(asked("participant", "participant_id"), "participant_id", "left_semi").select("event_id"))
    wanted = reduce(DataFrame.unionByName, ids).distinct().withColumn("__event", F.lit(True))
    near, fits = offers.select(*_OFFER).join(wanted, "event_id", "left"), F.col("__event")
    if "group" in routes:
        near, fits = near.join(groups.withColumn("__group", F.lit(True)), "group_id", "left"), fits | F.col("__group")
    return near.where(fits).select(*_OFFER)


def _routes(tasks: DataFrame) -> set[str]:
    """The routes that occur."""
    return {r.route for r in tasks.select("route").distinct().collect()}


def _held(tasks: DataFrame, routes: set[str], offers: DataFrame, members: DataFrame) -> DataFrame:
    """(task_id, query_id, route, offer_id, event_id): all that there is for each request of the routes."""
    asked, found = tasks.withColumnRenamed("offer_type", "only"), []
    own = ["task_id", "query_id", "route"]
    if "group" in routes:
        groups = asked.where("route = 'group'").select(*own, "group_id")
        found.append(few(groups).join(offers, "group_id"))
    if routes & {"batch", "event", "typed"}:
        events = asked.where("route IN ('batch', 'event', 'typed')").select(*own, "event_id", "only")
        found.append(events.join(offers, "event_id").where("only IS NULL OR only = offer_type"))
    if "participant" in routes:
        people = asked.where("route = 'participant'").select(*own, "participant_id").join(members, "participant_id").select(*own, "event_id").distinct()
        found.append(people.join(offers, "event_id"))
    return reduce(DataFrame.unionByName, [x.select(*own, "offer_id", "event_id") for x in found])


def count_answers(tasks: DataFrame, routes: set[str], offers: DataFrame, members: DataFrame, cap: int) -> DataFrame:
    """log(task_id, query_id, route, total, returned) of requests, of which each gets ``cap`` offers at most.

    offers(offer_id, event_id, group_id, offer_type), members(event_id, participant_id). Offers are counted before rows move, so that a group that has most
    of them isn't gathered.
    """
    own = ["task_id", "query_id", "route"]
    every = _held(tasks, routes, offers, members).select(*own, F.lit(1).alias("n")).unionByName(tasks.select(*own, F.lit(0).alias("n")))
    return every.groupBy(*own).agg(F.sum("n").alias("total")).withColumn("returned", F.least("total", F.lit(cap).cast("long")))


def answer(tasks: DataFrame, routes: set[str], offers: DataFrame, members: DataFrame, cap: int | None) -> DataFrame:
    """rows(task_id, query_id, offer_id, event_id) of requests: each gets its first ``cap`` offers by id; all if cap is None, for requests that are known to hold no more.

    offers and members as in count_answers(). The cap holds within a task before rows move.
    """
    every = _held(tasks, routes, offers, members).drop("route")
    if cap is None:
        return every
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("offer_id"))
    return every.withColumn("place", place).where(F.col("place") <= cap).drop("place")


def finer_tasks(cut: DataFrame, routes: set[str], tasks: DataFrame, inputs: DataFrame, offers: DataFrame, events: DataFrame, size: int, most_events: int | None) -> tuple[DataFrame, DataFrame | None]:
    """(the requests that take the place of cut(task_id), which are of the routes; query_id of those that ``most_events`` cuts short, None if it can't)."""
    own = tasks.join(cut.select("task_id"), "task_id", "left_semi")
    every, short = [], None
    if "group" in routes:
        none = F.lit(None).cast("timestamp_ntz")
        groups = own.where("route = 'group'").select("query_id", "group_id").join(inputs.select("query_id", "levels", "play_state"), "query_id").withColumns({"window_start": none, "window_end": none})
        fanned = planner.fan_out(few(groups), events, typed=size == planner.BATCH_TYPED, most_events=most_events)
        every.append(_tasks(fanned, "batch", "group_id", "batch"))
        if most_events is not None:
            short = fanned.where("capped").select("query_id").distinct()
    if "batch" in routes:
        every.append(_tasks(own.where("route = 'batch'").select("query_id", "event_id"), "event", "event_id"))
    if "event" in routes:
        kinds = own.where("route = 'event'").select("query_id", "event_id").join(offers.select("event_id", "offer_type"), "event_id")
        every.append(_tasks(kinds, "typed", "event_id", "offer_type"))
    return reduce(DataFrame.unionByName, every), short


def fetch(inputs: DataFrame, offers: DataFrame, events: DataFrame, members: DataFrame, cap: int, most_events: int | None = None, typed: bool = False) -> dict[str, DataFrame]:
    """offers(query_id, offer_id, event_id), each once, and log(round, task_id, query_id, route, total, returned, refined, failed) of all requests.

    inputs as of planner.recall_inputs() with event_ids; events(event_id, group_id, level, state, start) lists the groups' events. A group that ``most_events`` cuts short
    shows in the log as a request by fan-out that returned less than there is. Offers are read once, for those that requests may reach; what a refined request returned isn't made.
    """
    size = planner.BATCH_TYPED if typed else planner.BATCH_UNTYPED
    tasks = stage(first_tasks(inputs, size))
    near = stage(reachable(tasks, offers, events, members))
    found, logs = [], []
    routes = _routes(tasks)
    for step in range(len(FINER) + 1):
        if not routes:
            break
        is_cut = truncated(F.col("total"), F.col("returned"))
        log = stage(count_answers(tasks, routes, near, members, cap).withColumns({"refined": is_cut & F.col("route").isin(*FINER), "cut": is_cut}))
        logs.append(log.drop("cut").withColumn("round", F.lit(step + 1)))
        seen = log.groupBy("route").agg(F.bool_or("refined").alias("refined"), F.bool_or(~F.col("cut")).alias("whole"), F.bool_or(F.col("cut") & ~F.col("refined")).alias("short")).collect()
        for kept, state, most in (("whole", "NOT cut", None), ("short", "cut AND NOT refined", cap)):
            of = {r.route for r in seen if r[kept]}
            if of:
                own = tasks.join(log.where(state).select("task_id"), "task_id", "left_semi")
                found.append(answer(own, of, near, members, most))
        cut = {r.route for r in seen if r.refined}
        if not cut:
            break
        more, short = finer_tasks(log.where("refined"), cut, tasks, inputs, near, events, size, most_events)
        if short is not None:
            left_out = short.select(F.concat_ws("|", "query_id", F.lit("left out")).alias("task_id"), "query_id", F.lit("fanout").alias("route"), F.lit(1).cast("long").alias("total"), F.lit(0).cast("long").alias("returned"), F.lit(False).alias("refined"), F.lit(step + 2).alias("round"))
            logs.append(stage(left_out))
        tasks = stage(more)
        routes = _routes(tasks)
    none = tasks.limit(0)
    found = found or [none.withColumn("offer_id", F.lit(None).cast("long"))]
    every = reduce(DataFrame.unionByName, [x.select("query_id", "offer_id", "event_id") for x in found]).distinct()
    logs = logs or [none.select("task_id", "query_id", "route", *[F.lit(None).cast(k).alias(c) for c, k in (("total", "long"), ("returned", "long"), ("refined", "boolean"), ("round", "int"))])]
    log = reduce(DataFrame.unionByName, logs).withColumn("failed", F.lit(False))
    return {"offers": stage(every), "log": log.select("round", "task_id", "query_id", "route", "total", "returned", "refined", "failed")}


def flags(log: DataFrame) -> DataFrame:
    """The requests of a log that still count, as planner.fetch_flags() wants them: a group that was not refined is whole."""
    return log.where("NOT refined").select("query_id", F.when(F.col("route") == "batch", "fanout").otherwise(F.col("route")).alias("route"), "total", "returned", "failed")
