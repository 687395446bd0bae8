"""Trees of nodes(id, name, parent) by pointer doubling: as many joins as the depth has binary digits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.sources.written import stage


def ancestry(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs(id, ancestor, distance), looped(id)) of nodes(id, parent).

    Each round joins the pairs of the longest distance so far, a power of two, to all pairs, which doubles what is known. A node that is its own
    ancestor lies on a cycle: it is listed in ``looped``, and pairs that meet it go, so that the rounds end. A parent that is no node is an
    ancestor without ancestors. Of a node with several parents the smallest counts.
    """
    pairs = stage(nodes.where("parent IS NOT NULL").groupBy("id").agg(F.min("parent").alias("ancestor")).withColumn("distance", F.lit(1)))
    looped, reach = pairs.select("id").limit(0), 1
    while True:
        own = pairs.where("id = ancestor").select("id")
        if not own.isEmpty():
            looped = stage(looped.unionByName(own).distinct())
            pairs = stage(without(pairs, looped))
        far = pairs.where(F.col("distance") == reach).select(F.col("id").alias("from"), F.col("ancestor").alias("by"))
        if far.isEmpty():
            return pairs, looped
        further = far.join(pairs, F.col("by") == F.col("id")).select(F.col("from").alias("id"), "ancestor", (F.col("distance") + reach).alias("distance"))
        pairs, reach = stage(pairs.unionByName(further)), reach * 2


def without(pairs: DataFrame, looped: DataFrame) -> DataFrame:
    """Pairs of which neither end is on a cycle."""
    either = looped.select(F.col("id").alias("x"))
    return pairs.join(either, F.col("id") == F.col("x"), "left_anti").join(either, F.col("ancestor") == F.col("x"), "left_anti")


def walk(nodes: DataFrame) -> DataFrame:
    """nodes(id, name, parent) below a root (a node without parent) with depth (roots 0), path (ids from the root) and child_count.

    Orphans, whose line ends at a parent that is no node, nodes on a cycle and nodes below either are no part of a tree: see faults().
    """
    pairs, _ = ancestry(nodes)
    up = pairs.groupBy("id").agg(F.max("distance").alias("depth"), F.sort_array(F.collect_list(F.struct((-F.col("distance")).alias("at"), "ancestor"))).alias("up"))
    roots = nodes.where("parent IS NULL").select(F.col("id").alias("top"))
    own = F.array("id")
    path = F.coalesce(F.concat(F.transform("up", lambda x: x["ancestor"]), own), own)
    walked = nodes.join(up, "id", "left").select("id", "name", "parent", F.coalesce("depth", F.lit(0)).alias("depth"), path.alias("path"))
    children = nodes.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("child_count"))
    rooted = walked.withColumn("top", F.element_at("path", 1)).join(roots.distinct(), "top", "left_semi").drop("top")
    return stage(rooted.join(children, "id", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0))))


def faults(nodes: DataFrame) -> DataFrame:
    """(id, fault) of the nodes that walk() leaves out: ``cycle`` for those on or below a cycle, ``orphan`` for those below a missing parent."""
    pairs, looped = ancestry(nodes)
    top = pairs.groupBy("id").agg(F.max_by("ancestor", "distance").alias("top"))
    lines = nodes.select("id", "parent").join(top, "id", "left").withColumn("top", F.coalesce("top", "id"))
    known = nodes.groupBy(F.col("id").alias("top")).agg(F.min("parent").alias("above"), F.lit(True).alias("known"))
    on = looped.select(F.col("id").alias("above"), F.lit(True).alias("on_cycle"))
    told = lines.join(known, "top", "left").join(on, "above", "left")
    itself = told.join(looped.select(F.col("id").alias("own"), F.lit(True).alias("itself")), F.col("id") == F.col("own"), "left")
    fault = F.when(F.col("itself") | F.col("on_cycle"), "cycle").when(F.col("known").isNull() | F.col("above").isNotNull(), "orphan")
    return itself.select("id", fault.alias("fault")).where("fault IS NOT NULL").distinct()
