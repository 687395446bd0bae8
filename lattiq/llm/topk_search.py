"""Exact top-k search by inner product, with a three-phase uniform threshold.

A vector is split into ``lists`` runs of components. Each run has a local score, and a candidate's score
is the sum of its local scores.

1. Every task gathers, for each query and run, its k best local scores and adds up the full scores of
   those few entries. The k-th best full score of all tasks is a safe lower bound t.
2. t goes to all tasks. A candidate that reaches t reaches t / lists in some run, and what it lacks after the first run must
   fit under the product of the lengths of the rest. The first run's scores and these bounds leave the sufficient entries.
3. Run by run the remaining local scores are worked out for the entries that still suffice, and no others; each
   task passes on its k best for each query, and a ranking of these few gives the result.

Queries go through in blocks of bounded size that are broadcast; candidates are never shuffled.

Defined results: vectors that are null, hold null or non-finite components, or have a null id take no part;
a query and a candidate of different lengths don't meet; equal scores rank by the smaller id; a row that is
repeated counts once; of an id with several vectors each is a candidate, and the smallest is
the query; fewer than k candidates are all returned; an empty table gives no rows. Scores are exact
(wide integers where needed) and held to the range of a long. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattiq.llm._common import cut, small_batches, table

#: Components become floor(SCALE * x).
SCALE = 256
#: Queries of one broadcast block: 16 MB at 128 components.
BLOCK = 16384
#: Runs of components, the lists of the threshold: fewer give a higher cutoff t / LISTS.
LISTS = 2
_LONG = 2**63


def valid_vectors(df: DataFrame) -> DataFrame:
    """(vec_id long, embedding array of double) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(finite)
    )


def _whole(matrix: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact: a double that holds a whole number."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(SCALE * matrix), posinf=np.finfo(float).max, neginf=np.finfo(float).min)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, exact: in doubles where all sums fit 53 bits, else in wide integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return a @ b.T
    wide = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return wide[0] @ wide[1].T


def _best(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query, score, id) columns: the k best distinct entries of each query."""
    query, score, ids = rows
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    if len(query):
        fresh = np.ones(len(query), bool)
        fresh[1:] = (query[1:] != query[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        query, score, ids = query[fresh], score[fresh], ids[fresh]
        first = np.searchsorted(query, query)
        near = np.arange(len(query)) - first < k
        query, score, ids = query[near], score[near], ids[near]
    return [query, score, ids]


def _lengths(m: np.ndarray) -> np.ndarray:
    """The euclidean length of each row, rounded up."""
    with np.errstate(over="ignore"):
        return np.sqrt((m.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9)


def sufficient(queries: np.ndarray, own: np.ndarray, t: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, candidate, score) of all entries that reach their query's t, and how many remaining local scores that took.

    The runs lie between the cuts. After each run an entry goes on only if its score so far and the product of the lengths of the remaining
    runs reach t, and if some run reaches t / runs or may still do so.
    """
    runs = list(zip(cuts[:-1], cuts[1:]))
    share = t[:, None] / len(runs)
    low = np.where(np.isfinite(t), t - np.abs(t) * 1e-12, t)
    own_lengths = [(_lengths(queries[:, a:b]), _lengths(own[:, a:b])) for a, b in runs]
    first = _dot(queries[:, : runs[0][1]], own[:, : runs[0][1]])
    # an infinite product bounds nothing, and zero times infinity is such a one
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = [np.nan_to_num(x[:, None] * y[None, :], nan=np.inf, posinf=np.inf) for x, y in own_lengths[1:]]
    listed = first.astype(float) >= share - np.abs(share) * 1e-12
    for bound in bounds:
        listed |= bound >= share
    rest = sum(bounds) if bounds else np.zeros(first.shape)
    q, c = np.nonzero(listed & (first.astype(float) + rest >= low[:, None]))
    total, worked = first[q, c], 0
    for k, (a, b) in enumerate(runs[1:], 1):
        worked += len(q)
        more = np.empty(len(q), object if total.dtype == object else float)
        # in pieces of bounded size
        for at in range(0, len(q), 65536):
            x, y = queries[q[at : at + 65536], a:b], own[c[at : at + 65536], a:b]
            wide = x.size and np.abs(x).max() * np.abs(y).max() * (b - a) >= 2.0**53
            part = [sum(int(i) * int(j) for i, j in zip(m, n)) for m, n in zip(x, y)] if wide else np.einsum("ij,ij->i", x, y)
            if wide and more.dtype != object:
                more, total = more.astype(object), np.array([int(i) for i in total], object)
            more[at : at + 65536] = part
        total = total + more
        ahead = sum(bounds[k:])[q, c] if bounds[k:] else 0.0
        left = total.astype(float) + ahead >= low[q]
        q, c, total = q[left], c[left], total[left]
    return q, c, total, worked


def _task(block, k: int, lists: int, cutoff):
    """A function from Arrow batches of candidates to the k best entries of each query.

    Without a cutoff: of the entries on the local lists (phase 1). With it: of the sufficient entries (2, 3).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = block.value
        best = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)]
        for batch in batches:
            ids_all = np.array(batch.column(0).to_pylist(), np.int64)
            vectors = batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for length in np.unique(sizes).tolist():
                if length not in by_length:
                    continue
                at = np.flatnonzero(sizes == length)
                ids = ids_all[at]
                own = _whole(np.stack([flat[starts[i] : starts[i] + length] for i in at]))
                number, query_ids, queries = by_length[length]
                cuts = np.linspace(0, length, lists + 1).astype(int)
                same = query_ids[:, None] == ids[None, :]
                if cutoff is None:
                    local = [_dot(queries[:, a:b], own[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                    near = np.zeros(same.shape, bool)
                    for scores in local:
                        scores = np.where(same, -np.inf, scores.astype(float))
                        m = min(k, scores.shape[1])
                        chosen = np.argpartition(-scores, m - 1, axis=1)[:, :m]
                        np.put_along_axis(near, chosen, True, axis=1)
                    q, c = np.nonzero(near & ~same)
                    total = sum(scores[q, c] for scores in local)
                else:
                    t = cutoff.value[number]
                    q, c, total, _ = sufficient(queries, own, t, cuts)
                    keep = ~same[q, c] & (total >= t[q])
                    q, c, total = q[keep], c[keep], total[keep]
                best = _best([np.concatenate(x) for x in zip(best, (number[q], total, ids[c]))], k)
        limit = lambda x: max(-_LONG, min(_LONG - 1, int(x)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(best[0], pa.int64()), pa.array(best[2], pa.int64()), pa.array([limit(x) for x in best[1]], pa.int64())],
            names=["number", "vec_id", "score"],
        )

    return run


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, lists: int = LISTS, block_rows: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of highest integer inner product for each query.

    Both frames have vec_id and embedding. A candidate with the query's own id is left out.
    """
    spark = candidates.sparkSession
    small_batches(spark)
    candidates = valid_vectors(candidates)
    queries = valid_vectors(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = -(-queries.count() // block_rows)
    schema = "number long, vec_id long, score long"
    parts = []
    for number in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).collect()
        by_length = {}
        for length in {len(r.embedding) for r in rows}:
            own = [(i, r.vec_id, r.embedding) for i, r in enumerate(rows) if len(r.embedding) == length]
            matrix = _whole(np.array([x[2] for x in own], float).reshape(len(own), length))
            by_length[length] = (np.array([x[0] for x in own]), np.array([x[1] for x in own], np.int64), matrix)
        if not by_length:
            continue
        ids = spark.createDataFrame([(i, r.vec_id) for i, r in enumerate(rows)], "number long, query_id long")
        block = spark.sparkContext.broadcast(by_length)
        first = candidates.mapInArrow(_task(block, k, lists, None), schema).distinct()
        kth = F.try_element_at(F.reverse(F.sort_array(F.collect_list("score"))), F.lit(k))
        bound = {r.number: r.t for r in first.groupBy("number").agg(kth.alias("t")).collect()}
        whole = np.array([-np.inf if bound.get(i) is None else float(bound[i]) for i in range(len(rows))])
        # a double can lie above a wide long: step below it, which keeps the cutoff safe
        whole = np.where(np.abs(whole) >= 2.0**53, np.nextafter(whole, -np.inf), whole)
        shared = spark.sparkContext.broadcast(whole)
        found = candidates.mapInArrow(_task(block, k, lists, shared), schema)
        part = found.join(F.broadcast(ids), "number").select("query_id", "vec_id", "score")
        # of many blocks each one's few rows are written, so that the plan stays small
        parts.append(cut(part) if blocks > 1 else part)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all rows for every row whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id) q
      JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT DISTINCT * FROM s))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
