"""Decisions that were recorded, in place of a model: hits are joined, misses are listed and never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.functions.offering import cache_key
from lattiq.operators.menu import guard_pick, lexical_pick
from lattiq.operators.planner import first_of
from lattiq.sources.written import stage


def request_key(kind: str, *fields: Column) -> Column:
    """The key of a request: its kind, and a hash of its fields as JSON."""
    return cache_key(F.lit(kind), F.to_json(F.struct(*fields)))


def market_key(phrase: Column, labels: Column) -> Column:
    """The key of a market request: the phrase and the menu's labels in any order, so that another menu asks anew."""
    return request_key("market", phrase.alias("phrase"), F.array_sort(labels).alias("menu"))


def entity_key(query: Column, cell: Column, text: Column, candidates: Column) -> Column:
    """The key of an entity request: the query, the cell's kind and text, and the candidates that are shown."""
    shown = F.transform(F.slice(candidates, 1, 5), lambda c: c["id"])
    return request_key("entity", query.alias("query"), cell.alias("cell"), text.alias("text"), shown.alias("candidates"))


def answer(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """requests(key, ...) with output, and pending where none is recorded. recorded(key, output)."""
    found = recorded.groupBy("key").agg(F.min("output").alias("output"))
    return requests.join(found, "key", "left").withColumn("pending", F.col("output").isNull())


def misses(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """(key, kind, input): each request without a record once, as it is written to the ledger."""
    return requests.join(recorded.select("key"), "key", "left_anti").groupBy("key").agg(F.min("kind").alias("kind"), F.min("input").alias("input"))


LEDGER = "key string, kind string, input string, output string"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(batch, key, kind, input, output) of a ledger, each key once: a decision comes before a request without one, then the first batch counts."""
    rows = _batches(spark, path)
    return first_of(rows, ["key"], [F.col("output").isNull(), "batch"])


def _batches(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(f"{LEDGER}, batch long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], f"{LEDGER}, batch long")
        raise


def record(spark: SparkSession, path: str, rows: DataFrame, batch: int) -> None:
    """Add rows(key, kind, input[, output]) to a ledger as a batch: the keys that no other batch holds, and decisions of those that hold none.

    A batch is a folder that is written whole, so that the same batch again replaces itself, and a run that repeats adds nothing. What
    was once decided stays, whatever a later batch says.
    """
    given = rows if "output" in rows.columns else rows.withColumn("output", F.lit(None).cast("string"))
    own = given.groupBy("key").agg(F.min("kind").alias("kind"), F.min("input").alias("input"), F.min("output").alias("output"))
    others = _batches(spark, path).where(F.col("batch") != batch)
    known = others.groupBy("key").agg(F.max(F.col("output").isNotNull()).alias("decided"))
    fresh = own.join(known, "key", "left").where(F.col("decided").isNull() | (~F.col("decided") & F.col("output").isNotNull())).drop("decided")
    stage(fresh).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def pick_markets(phrases: DataFrame, labels: DataFrame, recorded: DataFrame, keys: list[str], menu_keys: list[str]) -> DataFrame:
    """A market for each phrase: the recorded pick, else the lexical one; both only if the menu allows them.

    phrases(keys, menu_keys, phrase, key), labels(menu_keys, label, outcome_labels), recorded(key, label, match, outcome_label, related).
    """
    lexical = lexical_pick(phrases, labels.select(*menu_keys, "label"), keys, menu_keys)
    lexical = lexical.select(*keys, F.col("label").alias("l_label"), F.col("match").alias("l_match"))
    menus = labels.groupBy(*menu_keys).agg(F.collect_set("label").alias("menu_labels"))
    own = first_of(recorded, ["key"], ["label"]).withColumn("recorded", F.lit(True))
    rows = phrases.join(own, "key", "left").join(lexical, keys, "left").join(menus, menu_keys, "left")
    hit = F.coalesce("recorded", F.lit(False))
    rows = rows.withColumns(
        {
            "source": F.when(hit, "recorded").otherwise("lexical"),
            "label": F.when(hit, F.col("label")).otherwise(F.col("l_label")),
            "match": F.when(hit, F.col("match")).otherwise(F.coalesce("l_match", F.lit("none"))),
            "related": F.coalesce("related", F.array().cast("array<string>")),
        }
    )
    outs = labels.select(*menu_keys, "label", F.col("outcome_labels").alias("menu_outcomes"))
    guarded = guard_pick(rows.join(outs, [*menu_keys, "label"], "left"))
    return guarded.select(*keys, *menu_keys, "label", "match", "outcome_label", "related", "source")


def settle_entities(cells: DataFrame, decisions: DataFrame, reground: DataFrame | None = None) -> DataFrame:
    """Doubtful cells settled by recorded decisions in two passes.

    cells(key, tier, candidates), decisions(key, pass, action (pick, reexpress or clarify), id, phrase, question), reground(phrase, tier, candidates; and
    key, if a phrase's grounding depends on its cell): the phrases of pass 1 grounded again. A pick among the first five settles; a phrase that grounds confidently settles;
    then a valid pick of pass 2; else the cell is to be clarified. Without any record the first candidate
    is taken, and a cell without candidates clarified, both marked as fallback.
    """
    sure = F.col("tier") == "confident"
    first = F.try_element_at("candidates", F.lit(1))["id"]
    step = lambda n: first_of(decisions.where(F.col("pass") == n), ["key"], ["action", "id"]).select(
        "key", *[F.col(c).alias(f"{c}_{n}") for c in ("action", "id", "phrase", "question")]
    )
    rows = cells.join(step(1), "key", "left").join(step(2), "key", "left")
    if reground is not None:
        own = ["key"] if "key" in reground.columns else []
        again = first_of(reground, [*own, "phrase"], ["tier", "candidates"]).select(*own, F.col("phrase").alias("phrase_1"), F.when(sure, first).alias("again"))
        rows = rows.join(again, [*own, "phrase_1"], "left")
    else:
        rows = rows.withColumn("again", F.lit(None).cast("bigint"))
    shown = F.transform(F.slice("candidates", 1, 5), lambda c: c["id"])
    valid = lambda n: F.when((F.col(f"action_{n}") == "pick") & F.array_contains(shown, F.col(f"id_{n}")), F.col(f"id_{n}"))
    recorded = F.col("action_1").isNotNull() | F.col("action_2").isNotNull()
    settled = F.when(sure, first).otherwise(F.coalesce(valid(1), F.when(F.col("action_1") == "reexpress", F.col("again")), valid(2)))
    settled = F.coalesce(settled, F.when(~recorded, first))
    how = F.when(sure, "confident").when(recorded, "recorded").otherwise("fallback")
    question = F.when(settled.isNull(), F.coalesce("question_2", "question_1", F.lit("which one is meant?")))
    return rows.select("key", settled.alias("id"), how.alias("settled_by"), question.alias("question"))
