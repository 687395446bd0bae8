"""Benchmark decontamination by winnowing.

Both sides keep the smallest k-gram hash of each sliding window of w k-grams. Two texts that share
k + w - 1 consecutive words then share a fingerprint, so with k = 6 and w = 8 no shared run of 13
words is missed. Shared fingerprints are only candidates: each is extended word by word along
its alignment, and what counts is the exact run of equal words.

Defined results: a null or empty text has no words and is clean; an item with a null id or no words
takes no part; items that repeat an id count once; repeated documents each get their row; a text
is always read whole; other columns are ignored, whatever their names. An empty benchmark
leaves every document clean.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm._common import WordHashes, gram_hashes, map_columns, small_batches, spread, table, words

#: Words of a contamination window; a shorter item is one window of its own length.
SPAN = 13
#: Words of a fingerprinted k-gram; a window of SPAN - GRAM + 1 of them keeps its smallest.
GRAM = 6
#: Tasks that share a fingerprint in the join of a larger benchmark.
SALTS = 8
#: Code points of all benchmark texts up to which their index is broadcast; beyond, fingerprints are joined.
BROADCAST_CHARS = 8_000_000

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


def _sliding(values: np.ndarray, width: int, reduce) -> np.ndarray:
    out = values[: len(values) - width + 1].copy()
    for j in range(1, width):
        reduce(out, values[j : j + len(out)], out=out)
    return out


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions whose hash is the smallest of some window (all of them in a tie)."""
    if len(grams) <= window:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.empty(0, np.int64)
    lowest = _sliding(grams, window, np.minimum)
    edge = np.zeros(window - 1, np.uint64)
    highest = _sliding(np.concatenate([edge, lowest, edge]), window, np.maximum)
    return np.flatnonzero(grams == highest)


class Index:
    """Fingerprints of benchmark items, and the exact check of what they hit."""

    def __init__(self, items: list[tuple[str, str]], span: int = SPAN, gram: int = GRAM):
        self.span, self.gram = span, gram
        hashes = WordHashes()
        self.items = [(item, tokens) for item, text in items if item is not None and (tokens := words(text))]
        grams: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, tokens) in enumerate(self.items):
            own = hashes.array(tokens)
            if len(tokens) < span:
                self.short[len(tokens)][int(gram_hashes(own, len(tokens))[0])].append(k)
                continue
            own = gram_hashes(own, gram)
            for at in winnow(own, span - gram + 1):
                grams[int(own[at])].append((k, int(at)))
        self.grams = dict(grams)
        self.short = {n: dict(x) for n, x in self.short.items()}
        self.keys = np.sort(np.fromiter(self.grams, np.uint64, len(self.grams)))
        self.short_keys = {n: np.sort(np.fromiter(x, np.uint64, len(x))) for n, x in self.short.items()}

    @staticmethod
    def _found(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        if not len(keys) or not len(values):
            return np.empty(0, np.int64)
        at = np.searchsorted(keys, values)
        at[at == len(keys)] = 0
        return np.flatnonzero(keys[at] == values)

    def scan(self, tokens: list[str], hashes: WordHashes) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and which items (by position in the index) occur."""
        hit, found = np.zeros(len(tokens), bool), set()
        if not tokens or not self.items:
            return hit, found
        own = hashes.array(tokens)
        if len(self.keys) and len(tokens) >= self.span:
            grams = gram_hashes(own, self.gram)
            chosen = winnow(grams, self.span - self.gram + 1)
            done = set()
            for p in chosen[self._found(grams[chosen], self.keys)].tolist():
                for k, q in self.grams[int(grams[p])]:
                    if (k, p - q) not in done:
                        done.add((k, p - q))
                        self._extend(tokens, hit, found, k, p - q)
        for n, keys in self.short_keys.items():
            if len(tokens) < n:
                continue
            grams = gram_hashes(own, n)
            for p in self._found(grams, keys).tolist():
                for k in self.short[n][int(grams[p])]:
                    if tokens[p : p + n] == self.items[k][1]:
                        hit[p : p + n] = True
                        found.add(k)
        return hit, found

    def _extend(self, tokens: list[str], hit: np.ndarray, found: set[int], k: int, offset: int) -> None:
        """Mark each run of at least ``span`` equal words of item k laid at ``offset``."""
        item = self.items[k][1]
        low, high = max(0, offset), min(len(tokens), offset + len(item))
        equal = np.array([a == b for a, b in zip(tokens[low:high], item[low - offset : high - offset])], bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= self.span:
                hit[low + start : low + end] = True
                found.add(k)

    def judge(self, text: str | None, hashes: WordHashes) -> tuple:
        """The row of one document."""
        tokens = words(text)
        hit, found = self.scan(tokens, hashes)
        n, total = len(tokens), int(hit.sum())
        ids = sorted({str(self.items[k][0]) for k in found})
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        return n, total, len(ids), digest, total > 0 and 20 * total >= n


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL"
    )


def _fits(benchmark: DataFrame, limit: int) -> bool:
    """Whether all item texts are below the broadcast bound; ids count too."""
    size = _items(benchmark).agg(F.sum(F.length("text") + F.length("item_id") + 16)).first()[0] or 0
    return size <= limit


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    broadcast_chars: int = BROADCAST_CHARS,
    clean_rows: bool = False,
) -> DataFrame:
    """Judge each document against all benchmark items.

    documents(text, ...) and benchmark(item_id, text) give the ``keep`` columns of documents and
    n_words, n_hit, n_items, items_sha256, contaminated. With ``clean_rows`` the clean documents
    come back unchanged instead. A benchmark below ``broadcast_chars`` (summed in Spark first) goes to
    each task whole; a larger one is joined by its fingerprints, so neither side is collected.
    """
    keep = ["doc_id"] if keep is None else keep
    if _fits(benchmark, broadcast_chars):
        index = Index([(r.item_id, r.text) for r in _items(benchmark).toLocalIterator()])
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def make():
            hashes = WordHashes()

            def judge(texts):
                rows = [shared.value.judge(t, hashes) for t in texts]
                return [not r[4] for r in rows] if clean_rows else rows

            return judge

        return map_columns(documents, ["text"], keep, RESULT, make, keep_row=clean_rows)
    return _joined(documents, benchmark, keep, clean_rows)


def _joined(documents: DataFrame, benchmark: DataFrame, keep: list[str], clean_rows: bool) -> DataFrame:
    """The same through a join of fingerprints; each document then gets just the items it shares one with."""
    small_batches(documents.sparkSession)
    # two hashes are a text's key: texts that collide in one of them don't share candidates
    both = lambda *c: F.struct(F.xxhash64(*c), F.xxhash64(F.lit(1), *c))
    items = _items(benchmark).withColumn("item_key", both("item_id", "text"))
    lengths = _short_lengths(items)
    prints = _prints(items.select(F.col("item_key").alias("row_key"), "text"), [], True)
    prints = prints.select("size", "print", F.col("row_key").alias("item_key"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = documents.select(both("text").alias("row_key"), "text").where("text IS NOT NULL")
    # a fingerprint that a third of the documents hold is dealt over several tasks
    held = _prints(own.dropDuplicates(["row_key"]), lengths, False).withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int"))
    shared = held.join(prints, ["size", "print", "salt"]).select("row_key", "item_key").distinct()
    candidates = (
        shared.join(items.select("item_key", "item_id", F.col("text").alias("item_text")), "item_key")
        .groupBy("row_key")
        .agg(F.collect_list(F.struct("item_id", "item_text")).alias("__items"))
        .withColumnRenamed("row_key", "__key")
    )
    paired = documents.withColumn("__key0", both("text")).join(candidates, F.col("__key0") == F.col("__key"), "left")

    def make():
        hashes = WordHashes()

        def judge(texts, items):
            rows = [
                Index([(x["item_id"], x["item_text"]) for x in own or []]).judge(t, hashes)
                for t, own in zip(texts, items)
            ]
            return [not r[4] for r in rows] if clean_rows else rows

        return judge

    return map_columns(paired, ["text", "__items"], keep, RESULT, make, keep_row=clean_rows)


def _short_lengths(items: DataFrame) -> list[int]:
    """The word counts below SPAN that occur among the items: at most SPAN - 1 numbers."""
    schema = T.StructType([T.StructField("size", T.IntegerType())])
    counted = map_columns(items, ["text"], [], schema, lambda: lambda texts: [(len(words(t)),) for t in texts])
    return [r.size for r in counted.where(f"size BETWEEN 1 AND {SPAN - 1}").distinct().collect()]


def _prints(rows: DataFrame, lengths: list[int], of_items: bool) -> DataFrame:
    """(row_key, size, print): winnowed k-grams under size 0; whole short items, or all grams of their lengths."""
    schema = T.StructType([T.StructField("prints", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType()))])

    def make():
        hashes = WordHashes()

        def one(text):
            tokens = words(text)
            own, found = hashes.array(tokens), {}
            sizes = ([len(tokens)] if 0 < len(tokens) < SPAN else []) if of_items else lengths
            for n in sizes:
                found[n] = np.unique(gram_hashes(own, n))
            if len(tokens) >= SPAN:
                grams = gram_hashes(own, GRAM)
                found[0] = np.unique(grams[winnow(grams, SPAN - GRAM + 1)])
            prints = [x for values in found.values() for x in values.view(np.int64).tolist()]
            return prints, [n for n, values in found.items() for _ in range(len(values))]

        return lambda texts: [one(t) for t in texts]

    return (
        map_columns(rows, ["text"], ["row_key"], schema, make)
        .select("row_key", F.explode(F.arrays_zip("prints", "sizes")).alias("x"))
        .select("row_key", F.col("x.sizes").alias("size"), F.col("x.prints").alias("print"))
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged against the whole benchmark."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return find_contamination(documents, table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The same by brute force over all windows.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bi AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
m AS (SELECT di.r, di.i, di.n, bw.item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM di) di JOIN bw ON bw.n = di.n AND bw.g = di.g),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hits ON hits.r = d.r LEFT JOIN ids ON ids.r = d.r
"""
