"""Five stages from raw documents to encoded ones; each is one of the corpus operators on all that the last one kept.

For all stages: an empty table gives no rows; rows that repeat a doc_id and text fare alike (near copies excepted, of which one
stays); other columns of any name are passed on untouched by all but the last stage; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm import decontamination, jaccard_join, language_id, line_dedup, pieces
from lattiq.llm._common import cut, table

#: Share of a document's words in its language from which the document stays.
MIN_LANGUAGE_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; undetermined and thoroughly mixed ones go.

    A null or empty text, or one without letters, is undetermined. Rows without doc_id or lang are judged, but nothing is learned from them.
    """
    model = language_id.fit(docs.where(language_id.remainder() != 1))
    return language_id.identify_languages(docs, model, docs.columns, min_score=MIN_LANGUAGE_SCORE)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on many sites; what loses all its lines goes.

    Null and empty texts lose nothing and stay; a null source is no site; a line stays in the document of smallest doc_id, null first.
    """
    cleaned = line_dedup.remove_boilerplate(docs)
    text = F.col("__lines.text")
    kept = cleaned.where((F.col("__lines.n_removed") == 0) | (F.trim(text, F.lit(" \t\r\n")) != ""))
    new = {"text": text, "n_chars": F.when(F.col("__lines.n_removed") == 0, F.col("n_chars")).otherwise(F.length(text).cast("long"))}
    return kept.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the smallest doc_id, null last, and of rows alike one. Texts without words all stay."""
    return jaccard_join.keep_one(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages. Null and empty texts hold none; items without text or id are none."""
    return decontamination.find_contamination(docs, table(spark, sf_dir, "benchmark"), docs.columns, clean_rows=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The n best piece sequences of each document, as counts, scores and hashes; a null text is encoded as the empty one, which has no pieces."""
    return pieces.encode_digest(docs, ["doc_id"])


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_boilerplate),
    ("jaccard_join", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("sentencepiece", encode),
]

#: SQL can't express the stages' models; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the checkpoint folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
