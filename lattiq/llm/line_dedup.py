"""Cross-site boilerplate removal by the spread of lines over sites, in DataFrame operations alone.

A HyperLogLog sketch of the sites (documents.source) is aggregated for each line's hash; Spark merges the
partial sketches map side and after the shuffle, so a line that a third of all rows holds is a
few sketches. Estimates clearly above or below the threshold decide; the lines near it get an exact
count of distinct sites. A line on ``min_sites`` sites or more is boilerplate: it stays where it
is first (smallest doc_id, then position) and goes from everywhere else, so no content is lost.

Lines meet boilerplate by a broadcast of fixed-width rows where those are few by count; beyond that a bitmap of their hashes (64 MB at
most) leaves few lines, which are joined by hash and salt. Only the documents that lose a line are moved, by an exact
join after such a bitmap of theirs.

Lines are compared without spaces, tabs and carriage returns at their ends, by two 64-bit hashes.

Defined results: null text stays null and has no lines; blank lines are never boilerplate; a document that
loses all its lines has the empty text; a null source is no site; a null doc_id comes before
all others; rows that repeat a doc_id and text are treated alike; an empty table gives no rows; other columns
of any name are passed on untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm._common import cut, split_by_keys, table

#: Distinct sites from which a line is boilerplate: what a passage in some 15 documents reaches when one of 20 sites holds a third of all.
MIN_SITES = 8
#: Estimates this close to the threshold (as a share of it, and in sites) are counted exactly.
NEAR_SHARE, NEAR_SITES = 0.1, 2
#: log2 of a sketch's buckets: a standard error of 1.6 %.
SKETCH_LG_K = 12
#: Counted rows of fixed width (two hashes and a place, some 100 bytes) up to which lines' keys are broadcast; tasks that share a line beyond.
BROADCAST_ROWS, SALTS = 200_000, 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> list[Column]:
    bare = F.trim(line, F.lit(" \t\r"))
    return [F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit(1), bare).alias("h2")]


def _exploded(documents: DataFrame) -> DataFrame:
    """(id, mark, site, pos, h1, h2) of each line that isn't blank; mark tells texts of one id apart."""
    lines = documents.select(
        F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("mark"),
        F.col("source").alias("site"),
        F.posexplode(_lines(F.col("text"))).alias("pos", "line"),
    )
    return lines.where(F.length(F.trim("line", F.lit(" \t\r"))) > 0).select("id", "mark", "site", "pos", *_key(F.col("line")))


def _matched(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """lines(id, mark, pos, h1, h2, ...) of the keys(h1, h2, ...), with the keys' columns; keys are written already.

    A line that a third of all rows holds is dealt over ``SALTS`` tasks where keys are too many to be broadcast.
    """
    if keys.count() <= BROADCAST_ROWS:
        return lines.join(F.broadcast(keys), ["h1", "h2"])
    maybe, _ = split_by_keys(lines, F.xxhash64("h1", "h2"), keys, F.xxhash64("h1", "h2"))
    salted = maybe.withColumn("__salt", F.pmod(F.xxhash64("id", "mark", "pos"), F.lit(SALTS)))
    spread = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, ["h1", "h2", "__salt"]).drop("__salt")


def boilerplate_lines(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first) of the lines on at least ``min_sites`` sites; first is (id, pos) of the occurrence that stays."""
    lines = _exploded(documents)
    spread = (
        lines.groupBy("h1", "h2")
        .agg(F.hll_sketch_agg("site", SKETCH_LG_K).alias("sites"), F.min(F.struct("id", "pos")).alias("first"))
        .select("h1", "h2", "first", F.hll_sketch_estimate("sites").alias("estimate"))
    )
    margin = max(NEAR_SITES, NEAR_SHARE * min_sites)
    # estimates far below are most of all lines, and go before anything is kept
    spread = cut(spread.where(F.col("estimate") >= min_sites - margin))
    near = spread.where(F.col("estimate") <= min_sites + margin)
    exact = (
        _matched(lines, cut(near.select("h1", "h2")))
        .where("site IS NOT NULL")
        .select("h1", "h2", "site")
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_sites)
    )
    far = spread.where(F.col("estimate") > min_sites + margin)
    return far.select("h1", "h2", "first").unionByName(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))


def remove_boilerplate(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """documents(doc_id, text, source, ...) with its columns and (last) a struct ``__lines``: text, n_lines, n_removed."""
    boilerplate = cut(boilerplate_lines(documents, min_sites))
    removed = (
        _matched(_exploded(documents), boilerplate)
        .where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("pos") == F.col("first.pos"))))
        .groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark"))
        .agg(F.collect_set("pos").alias("__removed"))
    )
    removed = cut(removed)
    mark = F.xxhash64(documents["text"])
    maybe, whole = split_by_keys(documents, F.xxhash64(documents["doc_id"], mark), removed, F.xxhash64("__id", "__mark"))
    met = maybe.join(removed, maybe["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(maybe["text"]) == F.col("__mark")), "left")
    return _without(met, documents.columns, F.col("__removed")).unionByName(_without(whole, documents.columns, F.lit(None).cast("array<int>")))


def _without(documents: DataFrame, columns: list[str], removed: Column) -> DataFrame:
    """The columns, and ``__lines``: the text without the lines at the removed places, and the counts; removed is null where none goes."""
    text = F.col("text")
    lines = _lines(text)
    kept = F.filter(lines, lambda _, k: ~F.array_contains(removed, k))
    result = F.struct(
        F.when(removed.isNull(), text).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(removed), F.lit(0)).cast("long").alias("n_removed"),
    )
    return documents.select(*[F.col(f"`{c}`") for c in columns], result.alias("__lines"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, removed lines, and the text that is left as its length and hash."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return remove_boilerplate(documents).select(
        "doc_id",
        F.col("__lines.n_lines").alias("n_lines"),
        F.col("__lines.n_removed").alias("n_removed"),
        F.length("__lines.text").cast("long").alias("n_chars"),
        F.md5("__lines.text").alias("text_md5"),
    )


#: The same with exact counts of sites throughout.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, source, unnest(ls) AS ln, unnest(generate_series(1, len(ls))) AS pos FROM d),
k AS (SELECT *, trim(ln, ' ' || chr(9) || chr(13)) AS key FROM l),
b AS (SELECT key, min(doc_id) AS first_id FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= {MIN_SITES}),
f AS (SELECT b.key, b.first_id, min(k.pos) AS first_pos FROM b JOIN k ON k.key = b.key AND k.doc_id = b.first_id GROUP BY b.key, b.first_id),
m AS (SELECT k.r, k.pos, k.ln, f.key IS NOT NULL AND NOT (k.doc_id = f.first_id AND k.pos = f.first_pos) AS gone FROM k LEFT JOIN f ON f.key = k.key),
t AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(ln, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM m GROUP BY r)
SELECT d.doc_id, CAST(coalesce(len(d.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(length(coalesce(t.text, d.text)) AS BIGINT) AS n_chars, md5(coalesce(t.text, d.text)) AS text_md5
FROM d LEFT JOIN t ON t.r = d.r
"""
