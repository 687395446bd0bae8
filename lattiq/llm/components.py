"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm._common import cut

#: Rounds after which the search gives up; each about halves the longest path.
MOST_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links(a, b): label is the smallest node it is connected to.

    Large-star and small-star steps alternate until nothing changes. Every step is a minimum for each node
    (pre-aggregated map side) and a join, so a node with very many links is not gathered in one task. Rows of
    each round are written to the checkpoint folder. Links with a null or from a node to itself link nothing; an
    empty table gives no rows.
    """
    both = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = cut(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(MOST_ROUNDS):
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # each node's smaller neighbours, and itself, point to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        small = cut(small)
        changed = small.exceptAll(edges).limit(1).count() + edges.exceptAll(small).limit(1).count()
        edges = small
        if not changed:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
