"""The compression classifier: its differences by plain compression, held-out accuracy, odd rows."""

import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from lattiq.llm import compressed_quality, queries

WORDS = ["river", "mountain", "walking", "quiet", "evening", "light", "over", "and", "the", "of", "a", "people", "found", "their", "way"]


def good(r):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(5, 120))) + "."


def bad(r):
    return " ".join(r.choice(["BUY", "N0W", "$$$", "!!", "CLICK", "win"]) + str(r.randint(0, 99)) for _ in range(r.randint(5, 120)))


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(2)
    texts = [(k, good(r) if k % 3 else bad(r)) for k in range(900)]
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    return compressed_quality.fit(documents, spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(900)], "doc_id long, quality int"))


def test_scores(spark, model):
    r = random.Random(9)
    rows = [(k, good(r) if k % 2 else bad(r)) for k in range(200)] + [(None, None), (300, ""), (300, ""), (301, "the " * 100_000), (302, "é"), (303, "x")]
    frame = spark.createDataFrame([(*x, "clash", "dot") for x in rows], "doc_id long, text string, score string, `a.b` string")
    found = compressed_quality.score_quality(frame.repartition(3), model, ["doc_id", "a.b"]).collect()
    assert len(found) == len(rows) and all(0 <= x.score <= 1 for x in found) and {x["a.b"] for x in found} == {"dot"}
    right = [(x.score >= 0.5) == (x.doc_id % 2 == 1) for x in found if x.doc_id is not None and x.doc_id < 200]
    assert sum(right) >= 0.98 * len(right)
    empty = [x.score for x in found if x.doc_id in (None, 300)]
    assert len(empty) == 3 and len(set(empty)) == 1
    # the differences by one compressor call a block
    coders = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in model.dictionaries]
    texts = {k: t.encode() for k, t in rows if k is not None}
    for x in found:
        if x.doc_id in (3, 4, 301, 302):
            own = texts[x.doc_id]
            a, b = (sum(len(c.compress(own[i : i + 1024])) for i in range(0, len(own), 1024)) for c in coders)
            assert x.difference == (a - b) / len(own)


def test_without_labels(spark):
    documents = spark.createDataFrame([(1, "some text"), (1, "another"), (2, None), (3, "third")], "doc_id long, text string")
    labels = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, quality int")
    for own, wanted in ((labels(), 0.5), (labels((1, 1), (3, 1)), 1.0), (labels((1, 0)), 0.0), (labels((1, 1), (1, 0), (None, 1), (3, None), (9, 1)), 0.5)):
        model = compressed_quality.fit(documents, own)
        assert {r.score for r in compressed_quality.score_quality(documents, model).collect()} == {wanted}
    few = compressed_quality.fit(documents, labels((1, 1), (1, 1), (3, 0)))
    assert compressed_quality.score_quality(documents, few).count() == 4
    assert compressed_quality.score_quality(documents.limit(0), few).count() == 0


def test_sample_is_bounded(spark):
    documents = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("text of it").alias("text"))
    hot = documents.where("doc_id = 5").crossJoin(spark.range(3000).select())
    labels = documents.union(hot).select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    sample = compressed_quality.labelled_sample(documents.union(hot), labels, sample=100)
    assert 120 < len(sample) < 280 and len({r[2] for r in sample}) == 1


def test_shared_lines_teach_nothing():
    kept = compressed_quality.without_shared_lines([["a\nshared\nb", "shared"], ["c\nshared"]])
    assert kept == [["a\nb", ""], ["c"]]


def test_curve_is_calibrated():
    import numpy as np

    r = np.random.default_rng(4)
    x, lengths = r.normal(0, 1, 8000), r.choice([30, 500, 9000], 8000)
    chance = 1 / (1 + np.exp(-(2 * x + np.where(lengths == 30, 1.5, -0.5))))
    own = compressed_quality.features(x, lengths)
    found = 1 / (1 + np.exp(-own @ compressed_quality.logistic(own, (r.random(8000) < chance).astype(float), np.ones(8000))))
    assert np.abs(found - chance).mean() < 0.03


def test_held_out_accuracy(spark):
    where = "/root/testdata/sf0.1"
    found = queries.QUERIES["op13_compressed_quality"](spark, where)
    rows = found.join(spark.read.parquet(f"{where}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 700 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    good = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in good) >= 0.99 * len(good)
