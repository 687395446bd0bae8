"""The menu of markets that a group of legs can choose from, and what a chooser may pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions import text
from lattiq.functions.offering import is_meaningful

#: Cover from which a lexical match is close; suggestions of a pick at most.
CLOSE_COVER = 0.45
MOST_RELATED = 3


def build_menu(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each market label of a group: its first event, and its telling outcome labels if there are two or more.

    Columns: keys, label, criterion_id, event_id, ord (order of offers), kind, participant, english_label, outcome_label. Offers without
    a criterion are no markets.
    """
    told = is_meaningful(F.col("kind"), F.col("participant"), F.col("english_label"), F.col("outcome_label"))
    shown = F.trim(F.coalesce("english_label", "outcome_label"))
    grouped = (
        outcomes.where(F.col("criterion_id").isNotNull())
        .groupBy(*keys, "label")
        .agg(
            F.min_by("event_id", F.when(F.col("event_id").isNotNull(), F.col("ord"))).alias("event_id"),
            F.min("ord").alias("ord"),
            F.array_sort(F.collect_set(F.when(told, shown))).alias("labels"),
        )
    )
    return grouped.withColumn("outcome_labels", F.when(F.size("labels") >= 2, F.col("labels"))).drop("labels")


def guard_pick(picks: DataFrame) -> DataFrame:
    """Picks that the menu allows.

    Columns: label, match, outcome_label, related, menu_labels, menu_outcomes (of the label). A label that isn't on the menu, or a match
    ``none``, is no pick; an outcome must stand in the menu as it is; related labels are distinct, on the menu, other
    than the pick, and three at most.
    """
    known = F.array_contains("menu_labels", F.col("label")) & (F.col("match") != "none")
    taken = F.coalesce(known, F.lit(False))
    related = F.filter(F.array_distinct("related"), lambda r: F.array_contains("menu_labels", r) & (r != F.col("label")))
    held = F.coalesce(F.array_contains("menu_outcomes", F.col("outcome_label")), F.lit(False))
    return picks.withColumns(
        {
            "label": F.when(taken, F.col("label")),
            "match": F.when(taken, F.col("match")).otherwise("none"),
            "outcome_label": F.when(taken & held, F.col("outcome_label")),
            "related": F.when(taken, F.slice(related, 1, MOST_RELATED)).otherwise(F.array().cast("array<string>")),
        }
    )


def token_table(names: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(keys, token): the content tokens of each name, one row each."""
    return names.select(*keys, F.explode(text.content_tokens(F.col(name))).alias("token")).distinct()


def lexicon(names: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """(token, df): in how many names each token stands."""
    return token_table(names, name, keys).groupBy("token").agg(F.count("*").alias("df"))


def lexical_pick(phrases: DataFrame, labels: DataFrame, phrase_keys: list[str], menu_keys: list[str]) -> DataFrame:
    """The market that words alone suggest for each phrase: used where no recorded decision exists.

    phrases(phrase_keys, menu_keys, phrase), labels(menu_keys, label). exact if both have the same tokens, close from a cover of CLOSE_COVER,
    else none; BM25 breaks ties, then the label.
    """
    label_keys = [*menu_keys, "label"]
    held = token_table(labels, "label", label_keys)
    size = held.groupBy(*label_keys).agg(F.count("*").alias("size"))
    corpus = size.groupBy(*menu_keys).agg(F.count("*").alias("names"), F.avg("size").alias("average"))
    weights = held.groupBy(*menu_keys, "token").agg(F.count("*").alias("df"))
    wanted = token_table(phrases, "phrase", [*phrase_keys, *menu_keys])
    weighed = wanted.join(corpus, menu_keys).join(weights, [*menu_keys, "token"], "left").withColumn("w", text.idf(F.col("names"), F.col("df")))
    whole = weighed.groupBy(*phrase_keys, *menu_keys).agg(F.sum("w").alias("whole"), F.count("*").alias("wanted"))
    matched = (
        weighed.join(held, [*menu_keys, "token"])
        .join(size, label_keys)
        .groupBy(*phrase_keys, *label_keys)
        .agg(
            F.sum("w").alias("part"),
            F.count("*").alias("shared"),
            F.first("size").alias("size"),
            F.sum(text.bm25(F.col("w"), F.col("size"), F.col("average"))).alias("bm25"),
        )
        .join(whole, [*phrase_keys, *menu_keys])
        .withColumn("cover", F.col("part") / F.col("whole"))
    )
    best = Window.partitionBy(*phrase_keys).orderBy(F.round("cover", 9).desc(), F.round("bm25", 9).desc(), F.col("label"))
    top = matched.withColumn("place", F.row_number().over(best)).where("place = 1")
    same = (F.col("shared") == F.col("wanted")) & (F.col("size") == F.col("wanted"))
    match = F.when(same, "exact").when(F.col("cover") >= CLOSE_COVER, "close").otherwise("none")
    found = top.select(*phrase_keys, match.alias("match"), "label", "cover")
    return phrases.select(*phrase_keys).distinct().join(found, phrase_keys, "left").select(
        *phrase_keys,
        F.when(F.col("match") != "none", F.col("label")).alias("label"),
        F.coalesce("match", F.lit("none")).alias("match"),
        F.coalesce("cover", F.lit(0.0)).alias("cover"),
    )
