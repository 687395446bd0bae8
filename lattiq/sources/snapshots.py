"""Captured answers as documents: VARIANT columns keep every field, known or not, and drift is a keyed diff of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Both grains of a capture, and the kinds of documents in each.
GRAINS, KINDS = ["competition", "match"], ["offer", "event"]


def capture(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows(grain, kind, id, doc), faults(grain, kind, json)) of documents(grain, kind, json): doc is the JSON as a variant; what is no JSON
    object with a whole number as id is a fault. Of an id captured twice the largest text counts."""
    parsed = documents.select("grain", "kind", "json", F.try_parse_json("json").alias("doc"))
    known = parsed.withColumn("id", F.try_variant_get("doc", "$.id", "bigint"))
    faults = known.where("id IS NULL").select("grain", "kind", "json")
    kept = known.where("id IS NOT NULL").groupBy("grain", "kind", "id").agg(F.max("json").alias("json"))
    return kept.select("grain", "kind", "id", F.parse_json("json").alias("doc")), faults


def write(rows: DataFrame, path: str) -> None:
    """A capture as Parquet, in folders by grain and kind."""
    rows.write.mode("overwrite").partitionBy("grain", "kind").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a capture; a missing path gives none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).select("grain", "kind", "id", "doc")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.sql("SELECT '' AS grain, '' AS kind, 0L AS id, parse_json('{}') AS doc WHERE false")
        raise


def typed(rows: DataFrame, grain: str, kind: str, schema: str) -> DataFrame:
    """The documents of a grain and kind with the columns of a schema; fields that it doesn't name stay in the capture alone, and a value of
    another type is null."""
    from pyspark.sql import types as T

    fields = T.StructType.fromDDL(schema).fields
    own = rows.where((F.col("grain") == grain) & (F.col("kind") == kind))
    return own.select(*[F.try_variant_get("doc", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in fields])


def fields(rows: DataFrame) -> DataFrame:
    """(grain, kind, id, field, value): each field of each document at its top, the value as JSON with sorted keys."""
    names = F.expr("map_keys(cast(doc AS map<string, variant>))")
    each = rows.select("grain", "kind", "id", "doc", F.explode(names).alias("field"))
    return each.select("grain", "kind", "id", "field", F.coalesce(F.to_json(F.expr("cast(doc AS map<string, variant>)")[F.col("field")]), F.lit("null")).alias("value"))


def drift(was: DataFrame, now: DataFrame) -> DataFrame:
    """(grain, kind, id, field, verdict, was, now) of two captures: documents that APPEARED or VANISHED, in one row with a null field, and
    of the others each field that was ADDED, REMOVED or CHANGED. What is equal gives no row."""
    keys = ["grain", "kind", "id"]
    ids = was.select(*keys, F.lit(True).alias("a")).join(now.select(*keys, F.lit(True).alias("b")), keys, "full")
    none = F.lit(None).cast("string")
    whole = ids.where("a IS NULL OR b IS NULL").select(*keys, none.alias("field"), F.when(F.col("a").isNull(), "APPEARED").otherwise("VANISHED").alias("verdict"), none.alias("was"), none.alias("now"))
    held = ids.where("a AND b").select(*keys)
    sides = fields(was).withColumnRenamed("value", "was").join(fields(now).withColumnRenamed("value", "now"), [*keys, "field"], "full").join(held, keys, "left_semi")
    verdict = F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").when(F.col("was") != F.col("now"), "CHANGED")
    return whole.unionByName(sides.withColumn("verdict", verdict).where("verdict IS NOT NULL").select(*keys, "field", "verdict", "was", "now"))
