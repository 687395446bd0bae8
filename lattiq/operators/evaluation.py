"""Grading of plans, groundings and answers against what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.functions import text


def pair_selectors(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """(query_id, gold_idx, pred_idx): each expected selector, in order, takes the first free predicted one whose market matches.

    gold(query_id, idx, accept: array of texts), predicted(query_id, idx, market). The greedy choice depends on earlier ones, so each query's
    fitting pairs, which its plan bounds, are walked in order within one row.
    """
    pairs = gold.select("query_id", F.col("idx").alias("gold_idx"), "accept").join(
        predicted.select("query_id", F.col("idx").cast("long").alias("pred_idx"), "market"), "query_id"
    )
    fits = pairs.where(text.any_loosely_equal(F.col("accept"), F.col("market")))
    pair = F.struct(F.col("gold_idx").cast("long").alias("g"), F.col("pred_idx").alias("p"))
    ordered = fits.groupBy("query_id").agg(F.array_sort(F.collect_list(pair)).alias("fits"))
    free = lambda taken, x: ~F.exists(taken, lambda t: (t["g"] == x["g"]) | (t["p"] == x["p"]))
    none = F.array().cast("array<struct<g:bigint,p:bigint>>")
    taken = F.aggregate("fits", none, lambda taken, x: F.when(free(taken, x), F.array_append(taken, x)).otherwise(taken))
    matched = ordered.select("query_id", F.explode(taken).alias("t")).select("query_id", F.col("t.g").alias("gold_idx"), F.col("t.p").alias("pred_idx"))
    return gold.select("query_id", F.col("idx").alias("gold_idx")).join(matched, ["query_id", "gold_idx"], "left")


def facet(expected: Column, got: Column) -> Column:
    """Whether a facet agrees; both missing agree."""
    return expected.eqNullSafe(got)


def same_ids(expected: Column, got: Column) -> Column:
    """Whether two arrays hold the same ids; null is none."""
    none = F.array().cast("array<bigint>")
    sorted_ids = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, none)))
    return sorted_ids(expected) == sorted_ids(got)


def grade_records(pairs: DataFrame, hard: list[str], soft: list[str], grounded: list[str] | None = None) -> DataFrame:
    """(query_id, hard_misses, soft_misses, passed). Each facet f has columns gold_f and pred_f; an unpaired selector misses ``pairing``.

    Facets in ``grounded`` are compared by what they were grounded to, whatever their wording: arrays gold_f_ids and pred_f_ids.
    """
    unpaired = F.col("pred_idx").isNull()
    agrees = lambda f: same_ids(F.col(f"gold_{f}_ids"), F.col(f"pred_{f}_ids")) if f in (grounded or []) else facet(F.col(f"gold_{f}"), F.col(f"pred_{f}"))
    miss = lambda names: F.filter(F.array(*[F.when(~unpaired & ~agrees(f), f) for f in names]), lambda x: x.isNotNull())
    rows = pairs.withColumns({"__hard": F.concat(F.when(unpaired, F.array(F.lit("pairing"))).otherwise(F.array().cast("array<string>")), miss(hard)), "__soft": miss(soft)})
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = rows.groupBy("query_id").agg(together("__hard").alias("hard_misses"), together("__soft").alias("soft_misses"))
    return out.withColumn("passed", F.size("hard_misses") == 0)


def tag_rates(results: DataFrame) -> DataFrame:
    """(tag, total, passed, percent) of results(tags, passed)."""
    each = results.select(F.explode("tags").alias("tag"), "passed")
    out = each.groupBy("tag").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))
    return out.withColumn("percent", text.percent(F.col("passed"), F.col("total")))


def ship_gate(results: DataFrame, soft_floor: float = 0.9) -> DataFrame:
    """One row: critical_ok (all critical tags pass wholly), soft_rate, soft_ok. results(tag, critical, passed); grouping sets give tags and tiers at once."""
    grouped = results.groupingSets([["tag", "critical"], ["critical"]], "tag", "critical").agg(
        F.grouping("tag").alias("__tier"), F.count("*").alias("total"), F.count_if("passed").alias("passed")
    )
    critical = F.bool_and(F.when((F.col("__tier") == 0) & F.col("critical"), F.col("passed") == F.col("total")))
    rate = F.max(F.when((F.col("__tier") == 1) & ~F.col("critical"), F.col("passed") / F.col("total")))
    out = grouped.agg(F.coalesce(critical, F.lit(True)).alias("critical_ok"), rate.alias("soft_rate"))
    return out.withColumn("soft_ok", F.coalesce(F.col("soft_rate") >= soft_floor, F.lit(True)))


def entity_rates(cells: DataFrame) -> DataFrame:
    """(kind, total, recalled, confident, confident_right) of cells(kind, gold_ids, candidate_ids, tier)."""
    held = F.size(F.array_except("gold_ids", "candidate_ids")) == 0
    sure = F.col("tier") == "confident"
    return cells.groupBy("kind").agg(
        F.count("*").alias("total"), F.count_if(held).alias("recalled"), F.count_if(sure).alias("confident"), F.count_if(sure & held).alias("confident_right")
    )


def scoreboard(results: DataFrame) -> DataFrame:
    """(category, scored, pending, passed) of results(category, status, passed)."""
    return results.groupBy("category").agg(
        F.count_if(F.col("status") == "scored").alias("scored"), F.count_if(F.col("status") == "pending").alias("pending"), F.count_if("passed").alias("passed")
    )


def repeated(results: DataFrame) -> DataFrame:
    """(query_id, passed): only what passes in all runs passes."""
    return results.groupBy("query_id").agg(F.bool_and("passed").alias("passed"))


def grade_answer(targets: Column, highlighted: Column, odds: Column, low: Column, high: Column) -> Column:
    """Whether each leg's targets hold one of the highlighted outcomes, and all selected prices lie in the bounds.

    targets: array of arrays of ids; odds: array of thousandths.
    """
    legs = F.coalesce(F.forall(targets, lambda t: F.arrays_overlap(t, highlighted)), F.lit(True))
    fits = lambda o: F.coalesce(o / 1000.0 >= low, F.lit(True)) & F.coalesce(o / 1000.0 <= high, F.lit(True))
    return legs & F.coalesce(F.forall(odds, fits), F.lit(True))


def drift(captured: DataFrame, live: DataFrame) -> DataFrame:
    """(query_id, verdict) from captured and live(query_id, ids): equal as sets, changed, appeared, vanished, or empty on both sides."""
    a = captured.select("query_id", F.array_sort(F.array_distinct("ids")).alias("was"))
    b = live.select("query_id", F.array_sort(F.array_distinct("ids")).alias("is"))
    both = a.join(b, "query_id", "full")
    none = F.array().cast("array<bigint>")
    was, now = F.coalesce("was", none), F.coalesce("is", none)
    verdict = (
        F.when((F.size(was) == 0) & (F.size(now) == 0), "BOTH_EMPTY")
        .when(F.size(was) == 0, "EMPTY_TO_RESULT")
        .when(F.size(now) == 0, "RESULT_TO_EMPTY")
        .when(was == now, "MATCH")
        .otherwise("DRIFT")
    )
    return both.select("query_id", verdict.alias("verdict"))



def reaches(picks: DataFrame, labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, reached): whether a picked label stands for one of the wanted criteria. picks(query_id, label), labels(label, criterion_id), wanted(query_id, criterion_ids)."""
    known = picks.join(labels.where("criterion_id IS NOT NULL").groupBy("label").agg(F.collect_set("criterion_id").alias("__own")), "label")
    own = known.groupBy("query_id").agg(F.flatten(F.collect_list("__own")).alias("__all"))
    return wanted.join(own, "query_id", "left").select("query_id", F.coalesce(F.size(F.array_intersect("criterion_ids", "__all")) > 0, F.lit(False)).alias("reached"))


def grade_scope(cells: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, cell, recalled, tier, right): grounded cells(query_id, cell, tier, candidates) against gold(query_id, cell, ids).

    recalled: every expected id is a candidate of some cell of that kind; tier is the surest of them (none without one); right: it is sure, and recalled.
    """
    rank = F.when(F.col("tier") == "confident", 0).when(F.col("tier") == "ambiguous", 1).when(F.col("tier") == "shortlist", 2).otherwise(3)
    found = cells.groupBy("query_id", "cell").agg(F.flatten(F.collect_list(F.transform("candidates", lambda c: c["id"]))).alias("__ids"), F.min_by("tier", rank).alias("tier"))
    rows = gold.join(found, ["query_id", "cell"], "left")
    recalled = F.coalesce(F.size(F.array_except("ids", "__ids")) == 0, F.size("ids") == 0)
    tier = F.coalesce("tier", F.lit("none"))
    return rows.select("query_id", "cell", recalled.alias("recalled"), tier.alias("tier"), (recalled & (tier == "confident")).alias("right"))
