"""Ready-made combinations ranked by what they share with the answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Combinations of an answer.
LIMIT = 3


def score_coupons(refs: DataFrame, outcomes: DataFrame, picked: DataFrame) -> DataFrame:
    """(query_id, coupon_id, exact, same_offer, shown_event, same_market) of the coupons' outcomes.

    refs(coupon_id, outcome_id, offer_id), outcomes(outcome_id, offer_id, event_id, criterion_id), picked(query_id, outcome_ids, offer_ids, event_ids, criterion_ids, coupon_id):
    the picks of the query that the coupon was fetched for.
    """
    known = outcomes.select("outcome_id", F.col("offer_id").alias("own_offer"), "event_id", "criterion_id")
    rows = picked.join(refs, "coupon_id").join(known, "outcome_id", "left")
    has = lambda ids, c: F.count_if(F.coalesce(F.array_contains(ids, F.col(c)), F.lit(False)))
    rows = rows.withColumn("any_offer", F.coalesce("offer_id", "own_offer"))
    return rows.groupBy("query_id", "coupon_id").agg(
        has("outcome_ids", "outcome_id").alias("exact"),
        has("offer_ids", "any_offer").alias("same_offer"),
        has("event_ids", "event_id").alias("shown_event"),
        has("criterion_ids", "criterion_id").alias("same_market"),
    )


def rank_coupons(scores: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The first coupons of each query: more shared first, own ones before automatic, then the lower price, then id.

    Columns: query_id, coupon_id, the scores, on_shown_event (a row's event is shown), custom, price. Coupons that share nothing go.
    """
    kept = scores.where((F.col("exact") > 0) | (F.col("same_offer") > 0) | (F.col("same_market") > 0) | F.col("on_shown_event"))
    order = Window.partitionBy("query_id").orderBy(
        F.desc("exact"), F.desc("same_offer"), F.desc("shown_event"), F.desc("same_market"), F.col("custom").cast("int").desc(), "price", "coupon_id"
    )
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def shape_coupons(ranked: DataFrame, refs: DataFrame, outcomes: DataFrame, picked: DataFrame) -> DataFrame:
    """(query_id, coupon_id, place, price, tag, legs): legs are labelled outcomes in their order, with matched for picked ones.

    Outcomes without a label of their own are left out; a coupon without a tag is AUTO.
    """
    named = outcomes.select("outcome_id", "market_label", "outcome_label")
    rows = ranked.join(refs, "coupon_id").join(named, "outcome_id").join(picked.select("query_id", "coupon_id", "outcome_ids"), ["query_id", "coupon_id"])
    leg = F.struct("ord", "market_label", "outcome_label", F.array_contains("outcome_ids", F.col("outcome_id")).alias("matched"))
    return rows.groupBy("query_id", "coupon_id", "place", "price", F.coalesce("tag", F.lit("AUTO")).alias("tag")).agg(F.array_sort(F.collect_list(leg)).alias("legs"))


def combination_events(shaped: DataFrame, refs: DataFrame, outcomes: DataFrame, shown: DataFrame) -> DataFrame:
    """(query_id, event_id): the events that a query's combinations name and that it doesn't show. shaped(query_id, coupon_id), shown(query_id, event_id)."""
    named = shaped.select("query_id", "coupon_id").join(refs, "coupon_id").join(outcomes.select("outcome_id", "event_id"), "outcome_id")
    return named.where("event_id IS NOT NULL").select("query_id", "event_id").distinct().join(shown, ["query_id", "event_id"], "left_anti")
