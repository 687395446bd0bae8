"""Tables that grow with the catalog are not broadcast, whatever their files' size."""

import re

from pyspark.sql import functions as F

from lattiq.operators import matching
from lattiq.plans import bindings, pipeline
from lattiq.sources.written import whole
from tests.conftest import DATA


def broadcasts(df):
    """The broadcasts of the plan before it runs."""
    return re.findall("BroadcastExchange", df._jdf.queryExecution().executedPlan().toString())


def test_names_are_not_broadcast(spark):
    names = bindings.read(spark, DATA, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    texts = spark.createDataFrame([("a", "red widget"), ("b", "nothing")], "context string, wording string")
    held, _, hot = matching.postings(names)
    wanted = texts.select("context", F.explode(F.split("wording", " ")).alias("token"))
    # the two joins with the hot tokens, which are at most one row for 10,000
    assert len(broadcasts(matching.meet(wanted, held, hot, ["context"]))) == 2
    plan = whole(names).join(texts.withColumn("name", F.col("wording")), "name")
    assert not broadcasts(plan)


def test_tables_of_the_pipeline_are_not_broadcast(spark):
    _, known, offered = pipeline.table_inputs(spark, DATA)
    assert not broadcasts(known) and not broadcasts(offered)
