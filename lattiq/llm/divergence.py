"""How far the sources of a language differ in their terms, and by which terms.

Sort-based streaming. Tasks cut documents into terms, sort (lang, term, source, document) in chunks of bounded size, and scan the
runs: each gives its documents and occurrences, as a document never lies in two chunks. These partial runs are repartitioned by
language and term, sorted by source, and scanned again: a term's document frequency decides whether it is kept, and its counts by
source go on. The kept terms are dealt into buckets; each bucket adds up the differences of all pairs of sources and gives
partial pairs, which are summed. Top terms come from one aggregate and a ranked window.

Sources of a language beyond BLOCK are hashed into blocks, and a bucket meets two blocks at a time, so that no task
holds the differences of more than (2 * BLOCK) squared pairs (about). A chunk, a bucket and the rows of a term that is in fewer than MIN_DOCUMENTS
documents are all that is held at once. A term has at most one row for each chunk and source to be sorted.

All arithmetic is exact: chances are whole billionths, from decimals.

Defined results: null text, lang and source are read as ''; each row is a document of its own, even if it repeats another or its id;
a group or language without terms has all its chances from counts of 0, and differences of 0 where no term is kept; ties of a value
fall to the smaller item by its UTF-8 bytes; an empty table gives no rows; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.llm._common import cut, spread, table

#: Documents of its language that a kept term is in at least; terms reported for each group.
MIN_DOCUMENTS, TOP_TERMS = 30, 50
#: What is added to each count, and the whole of which chances are parts.
PRIOR, WHOLE = 5, 1_000_000_000
#: Tokens that a task sorts at once.
CHUNK_TOKENS = 3_000_000
#: Sources of a language that a block holds (about).
BLOCK = 512
#: Counts of a bucket (about), terms whose chances it holds at once, and bytes of an Arrow batch.
BUCKET_ROWS, TERMS_AT_ONCE, BATCH_BYTES = 20_000, 1024, 4 << 20
RUNS = "lang string, term string, source string, documents long, n long"
COUNTS = "lang string, term string, source string, n long"
PAIRS = "lang string, source string, other string, value long, terms long, floor long, kept long"

#: Bytes to bytes: A-Z to a-z, other ASCII that is no letter to a blank.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text: runs of ASCII letters, lower-cased, and of all that is beyond ASCII."""
    return text.encode("utf-8", "replace").translate(_TERMS).split()


class Chunk:
    """Tokens of whole documents until they are sorted."""

    def __init__(self):
        self.tokens: list[pa.Array] = []
        self.sizes: list[int] = []
        self.groups: list[tuple[str, str]] = []
        self.held = 0

    def add(self, langs: list[str], sources: list[str], texts: list[str]) -> None:
        own = [terms(t) for t in texts]
        self.tokens.append(pa.array([w for ws in own for w in ws], pa.binary()))
        self.sizes += map(len, own)
        self.groups += zip(langs, sources)
        self.held += len(self.tokens[-1])

    def runs(self) -> list[pa.Array]:
        """(lang, term, source, documents, n) of each run of sorted (lang, term, source, document); there is a token."""
        coded = pa.chunked_array(self.tokens, pa.binary()).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        names = sorted(set(self.groups))
        at = {g: k for k, g in enumerate(names)}
        document = np.repeat(np.arange(len(self.sizes)), self.sizes)
        group = np.array([at[g] for g in self.groups], np.int64)[document]
        langs = {x: k for k, x in enumerate(sorted({g[0] for g in names}))}
        lang_of = np.array([langs[g[0]] for g in names], np.int64)
        term = place[coded.indices.to_numpy()]
        # groups are sorted by language and source, so (language, term, group) is the order wanted
        first = (lang_of[group] * len(order) + term) * len(names) + group
        sort = np.argsort(first, kind="stable")  # documents stay in order
        first, document = first[sort], document[sort]
        new_run = np.append(True, first[1:] != first[:-1])
        new_document = new_run | np.append(True, document[1:] != document[:-1])
        starts = np.flatnonzero(new_run)
        n = np.diff(np.append(starts, len(first)))
        documents = np.add.reduceat(new_document.astype(np.int64), starts)
        key = first[starts]
        group, term = key % len(names), key // len(names) % len(order)
        words = coded.dictionary.take(pa.array(order[term])).cast(pa.string())
        own = [pa.array([x[k] for x in names], pa.string()).take(pa.array(group)) for k in (0, 1)]
        return [own[0], words, own[1], pa.array(documents, pa.int64()), pa.array(n, pa.int64())]


def partial_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, source, text) to partial runs (lang, term, source, documents, n)."""
    chunk = Chunk()
    for batch in batches:
        chunk.add(*(batch.column(k).to_pylist() for k in range(3)))
        if chunk.held >= CHUNK_TOKENS:
            yield from _sliced(chunk.runs())
            chunk = Chunk()
    if chunk.held:
        yield from _sliced(chunk.runs())


def _sliced(arrays: list[pa.Array], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(arrays, names=["lang", "term", "source", "documents", "n"])
    for a in range(0, len(whole), rows):
        yield whole.slice(a, rows)


def _starts(batch: pa.RecordBatch, columns: list[int]) -> np.ndarray:
    """Rows at which one of the columns differs from the row before; the first is always one."""
    new = np.zeros(len(batch), bool)
    new[:1] = True
    for k in columns:
        own = batch.column(k)
        new[1:] |= pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def keep_frequent(least: int):
    """A scan of sorted partial runs that gives (lang, term, source, n) of terms in ``least`` documents or more.

    Runs of a batch are merged; one that goes on in the next batch gives a row there too. Of a term that goes on only rows are held
    back that may still have to be dropped.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the open term, while it has too few documents
        open_term, seen = None, 0
        for batch in batches:
            if not len(batch):
                continue
            runs = _starts(batch, [0, 1, 2])
            documents, n = (np.add.reduceat(batch.column(k).to_numpy(), runs) for k in (3, 4))
            names = [batch.column(k).take(pa.array(runs)) for k in range(3)]
            rows = pa.RecordBatch.from_arrays([*names, pa.array(n)], names=["lang", "term", "source", "n"])
            starts = _starts(rows, [0, 1])
            sums = np.add.reduceat(documents, starts)
            name = lambda at: (rows.column(0)[at].as_py(), rows.column(1)[at].as_py())  # noqa: B023, E731
            if name(0) == open_term:
                sums[0] += seen
                if sums[0] >= least:
                    yield from held
                    held = []
            else:
                held = []
            yield rows.filter(pa.array(np.repeat(sums >= least, np.diff(np.append(starts, len(rows))))))
            last = int(starts[-1])
            open_term, seen = name(last), int(sums[-1])
            held = held if last == 0 else []
            if seen < least:
                held.append(rows.slice(last))

    return scan


def chance(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (count + PRIOR) / (total + PRIOR * kept)), in decimals; 0 where no term is kept."""
    whole = lambda c: c.cast("decimal(19,0)")
    below = whole(total) + whole(kept) * F.lit(PRIOR).cast("decimal(2,0)")
    above = F.lit(WHOLE).cast("decimal(10,0)") * (whole(count) + F.lit(PRIOR).cast("decimal(2,0)"))
    return F.when(kept > 0, F.call_function("div", above, below) + 1).otherwise(0).cast("long")


def pair_sums(rows: pa.Table) -> pa.Table:
    """The rows (bucket, lang, a, b, term, source, block, p, kept) of a bucket and two blocks of sources to partial pairs.

    A row without term is a source, with its chance of an absent term. A pair's differences are summed over
    the terms that occur here; floor is its difference in a term that neither has.
    """
    schema = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in PAIRS.split(", ")])
    own = rows.filter(pc.is_null(rows["term"])).combine_chunks()
    held = rows.filter(pc.is_valid(rows["term"])).combine_chunks()
    bucket, lang, a, b, kept = (own[c][0].as_py() for c in ("bucket", "lang", "a", "b", "kept"))
    if bucket and not len(held):
        return schema.empty_table()  # the first bucket gives each pair a row
    names, z, block = own["source"].combine_chunks(), own["p"].to_numpy(), own["block"].to_numpy()
    source = pc.index_in(held["source"], value_set=names).to_numpy()
    coded = held["term"].combine_chunks().dictionary_encode()
    sort = np.argsort(coded.indices.to_numpy(), kind="stable")
    term, source, p = coded.indices.to_numpy()[sort], source[sort], held["p"].to_numpy()[sort]
    terms, sums = len(coded.dictionary), np.zeros((len(z), len(z)), np.int64)
    for low in range(0, terms, TERMS_AT_ONCE):
        step = slice(*np.searchsorted(term, [low, low + TERMS_AT_ONCE]))
        dense = np.tile(z, (min(TERMS_AT_ONCE, terms - low), 1))
        dense[term[step] - low, source[step]] = p[step]
        for k in range(len(z) - 1):
            sums[k, k + 1 :] += np.abs(dense[:, k + 1 :] - dense[:, k : k + 1]).sum(axis=0)
    first, second = np.triu_indices(len(z), 1)
    if a != b:
        apart = block[first] != block[second]
        first, second = first[apart], second[apart]
    every = lambda x, kind: pa.array([x] * len(first), kind)
    arrays = [every(lang, pa.string()), names.take(pa.array(first)), names.take(pa.array(second)), pa.array(sums[first, second])]
    arrays += [every(terms, pa.int64()), pa.array(np.abs(z[first] - z[second])), every(kept, pa.int64())]
    return pa.Table.from_arrays(arrays, schema=schema)


def source_divergence(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents(text, lang, source): all pairs of a language's sources, and each one's top terms."""
    spark = documents.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    runs = spread(rows).mapInArrow(partial_runs, RUNS).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    counts = cut(runs.mapInArrow(keep_frequent(min_documents), COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n")))

    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    by_lang = by_term.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    by_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct()
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    groups = groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").join(blocks, "lang")
    groups = cut(groups.select("lang", "source", "blocks", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "lang_total")]))
    known = counts.join(groups, ["lang", "source"]).withColumn("p", chance(F.col("n"), F.col("total"), F.col("kept")))

    buckets = max(1, -(-counts.count() // BUCKET_ROWS))
    block, each = F.pmod(F.xxhash64("source"), "blocks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = lambda bucket, term, p: ["lang", bucket.alias("bucket"), term.alias("term"), "source", block.alias("block"), p.alias("p"), "kept", each.alias("other")]
    of_terms = known.select(*placed(F.pmod(F.xxhash64("lang", "term"), F.lit(buckets)), F.col("term"), F.col("p")))
    spread_groups = groups.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)).cast("array<bigint>")))
    of_groups = spread_groups.select(*placed(F.col("at"), F.lit(None).cast("string"), chance(F.lit(0), F.col("total"), F.col("kept"))))
    tiles = of_terms.union(of_groups).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("other")
    pairs = (
        tiles.groupBy("bucket", "lang", "a", "b")
        .applyInArrow(pair_sums, PAIRS)
        .groupBy("lang", "source", "other")
        .agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"), F.max("floor").alias("floor"), F.max("kept").alias("kept"))
        .withColumn("value", F.col("value") + (F.col("kept") - F.col("terms")) * F.col("floor"))
    )
    both = F.explode(F.array(F.struct(F.col("source").alias("x"), F.col("other").alias("y")), F.struct(F.col("other").alias("x"), F.col("source").alias("y"))))
    pairs = pairs.select("lang", "value", both.alias("of")).select("lang", F.col("of.x").alias("source"), F.lit("pair").alias("part"), F.col("of.y").alias("item"), "value")

    q = chance(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    found = known.join(by_term, ["lang", "term"]).withColumn("value", F.col("p") - q).where("value > 0")
    found = found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(found.withColumn("rank", rank).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by language and source."""
    return source_divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


_TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

#: The same by all terms of all groups.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS_SQL} AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {MIN_DOCUMENTS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
p AS (SELECT a.*, 1 + (CAST({WHOLE} AS HUGEINT) * (n + {PRIOR})) // (sum(n) OVER (PARTITION BY a.lang, source) + {PRIOR} * v.v) AS p,
   1 + (CAST({WHOLE} AS HUGEINT) * (lang_n + {PRIOR})) // (v.lang_total + {PRIOR} * v.v) AS q FROM a JOIN v ON v.lang = a.lang),
s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0) AS value FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source
   LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
found AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM found))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM every WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
