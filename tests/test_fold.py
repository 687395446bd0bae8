"""Folding of names with and without characters of several bytes, against Python's own decomposition."""

import re
import unicodedata

from pyspark.sql import functions as F

from lattiq.functions import text


def test_fold_of_plain_and_accented_names(spark):
    names = ["Supplier#000000017", "  A--b  C ", "", "Málaga CF", "Café No. 1", "ÉÀÜ", "日本 7", "x’y", "İzmir", None]
    found = [r.f for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", text.fold(F.col("n")).alias("f")).orderBy("k").collect()]

    def plain(name):
        bare = "".join(c for c in unicodedata.normalize("NFD", name) if not 0x300 <= ord(c) <= 0x36F)
        return re.sub("[^a-z0-9]+", " ", bare.lower()).strip(" ")

    assert found == [None if n is None else plain(n) for n in names]
