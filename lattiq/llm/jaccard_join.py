"""Near-duplicate classes by a chosen-path join on five-word shingles.

1. A document's shingles are hashed; documents with the same set are one node. A node gets a sketch: for each
   run the minhash it is split on first, and 64 more minhashes of 8 bits.
2. Every run splits the nodes on one sampled shared token (a minhash value). Buckets of at most ``LIMIT``
   nodes are compared by brute force. Larger ones first link their nodes to a pivot, drop those so close to
   it that all their partners must be linked to it as well, and split again on two sampled tokens
   each; what is still too large after ``DEPTH`` splits is compared block by block. As many runs are made
   as the target recall asks for.
3. Nodes whose sketches agree enough are candidates. Each bucket passes on one link for each node it
   connects, never its pairs; connected components of these give groups in which all similar pairs lie.
4. Within each group the whole shingle sets are compared exactly. Groups beyond ``LIMIT`` nodes are dealt into blocks
   by size and hash, and a block meets only those whose sizes still allow a link. That gives the links, their number
   for each document, and the final classes.

A class is a connected component of links with Jaccard similarity of at least 4/5; its id is its smallest
doc_id. n_links is the number of other documents linked to a document, copies among them.

Defined results: words are those of ``words()``; a text of one to four words is a single shingle; null, empty and
wordless texts have no shingles and are alone (class their own doc_id, no links); rows that repeat a doc_id
and text count as separate documents of one class; a null doc_id is never a class's id unless all
members' are null; whole texts are read; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm._common import WordHashes, cut, gram_hashes, map_columns, small_batches, split_by_keys, spread, table, words
from lattiq.llm.components import connected_components

#: Words of a shingle, and the similarity of a link as a fraction.
SHINGLE, SIMILARITY = 5, (4, 5)
#: Share of the linked pairs that the runs together must bring into one bucket.
TARGET_RECALL = 0.999999
#: Nodes that are compared by brute force at once.
LIMIT = 1024
#: Splits on two more tokens before a bucket is compared block by block.
DEPTH = 3
#: Bytes of a sketch; share of equal bytes from which nodes are candidates.
SKETCH, CANDIDATE = 64, 0.55
#: The same for a large bucket's pivot: from NEAR on a node is linked to it, from CLOSE on it need not be compared with
#: others. 1 - J is a metric, so a partner of a node with J 0.8 to the pivot has J 0.6 to it, far above NEAR.
NEAR, CLOSE = 0.4, 0.8
#: Rows up to which a counted side of a join is broadcast (some 100 bytes each).
BROADCAST_ROWS = 100_000

_random = np.random.default_rng(20)
_FACTORS = _random.integers(1, 2**63, SKETCH + 64, np.uint64) | np.uint64(1)
_MASKS = _random.integers(0, 2**63, SKETCH + 64, np.uint64)

PRINT = T.StructType(
    [
        T.StructField("n_shingles", T.IntegerType()),
        T.StructField("node", T.BinaryType()),
        T.StructField("roots", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def runs_for(recall: float, similarity: float = SIMILARITY[0] / SIMILARITY[1], depth: int = DEPTH) -> int:
    """Runs after which a pair of the given similarity has shared a bucket with the given probability."""
    one = similarity * (1 - (1 - similarity) ** 2) ** depth
    return math.ceil(math.log(1 - recall) / math.log(1 - one))


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The distinct 64-bit shingle hashes of a text, sorted."""
    own = hashes.array(words(text))
    return np.unique(gram_hashes(own, min(SHINGLE, len(own)))) if len(own) else np.empty(0, np.uint64)


def minhashes(found: np.ndarray, n: int) -> np.ndarray:
    """The first n minhashes of a set."""
    low = np.full(n, np.iinfo(np.uint64).max)
    for a in range(0, len(found), 2048):
        part = (found[a : a + 2048, None] ^ _MASKS[None, :n]) * _FACTORS[None, :n]
        np.minimum(low, part.min(axis=0), out=low)
    return low


def _print_of(text: str | None, hashes: WordHashes, runs: int) -> tuple:
    found = shingles(text, hashes)
    if not len(found):
        return 0, None, None, None
    low = minhashes(found, SKETCH + runs)
    sketch = ((low[:SKETCH] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)
    return len(found), hashlib.md5(found.tobytes()).digest(), low[SKETCH:].view(np.int64).tolist(), sketch.tobytes()


def fingerprints(documents: DataFrame, runs: int) -> DataFrame:
    """(doc_id, mark, n_shingles, node, roots, sketch) of each document; mark tells texts of one id apart."""

    def make():
        hashes = WordHashes()
        return lambda texts: [_print_of(t, hashes, runs) for t in texts]

    marked = documents.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return map_columns(marked, ["text"], ["doc_id", "mark"], PRINT, make)


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int = 1) -> Iterator[dict[str, list]]:
    """The runs of at least two rows with equal first columns, as lists of the columns; rows come sorted."""
    held: list[pa.RecordBatch] = []

    def flush():
        rows = pa.Table.from_batches(held)
        if rows.num_rows > 1:
            yield {name: rows.column(name).to_pylist() for name in rows.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.array(batch.column(k).to_pylist()) for k in range(n_keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for key in keys:
            change |= key[1:] != key[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in range(n_keys)):
            yield from flush()
            held = []
        for a, b in zip(edges[:-1], edges[1:]):
            if b < batch.num_rows:
                if held or b - a > 1:
                    held.append(batch.slice(a, b - a))
                    yield from flush()
                held = []
            else:
                held.append(batch.slice(a, b - a))
    if held:
        yield from flush()


class _Union:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _join_rows(union: _Union, equal: np.ndarray, first: int) -> None:
    """Join row i (from ``first``) with the columns set in it."""
    for i in np.flatnonzero(equal.any(axis=1)).tolist():
        for j in np.flatnonzero(equal[i]).tolist():
            union.join(first + i, j)


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of a bucket against each other: one link for each node that is connected to a smaller one.

    Columns: key, side (null: all pairs; else 0 and 1 meet), node, sketch.
    """
    for group in _groups(batches):
        nodes, sides = group["node"], group["side"]
        sketches = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(nodes), SKETCH)
        union, need = _Union(len(nodes)), math.ceil(CANDIDATE * SKETCH)
        left = range(len(nodes)) if sides[0] is None else [k for k, s in enumerate(sides) if s == 0]
        right = left if sides[0] is None else [k for k, s in enumerate(sides) if s == 1]
        left, right = np.array(left, np.int64), np.array(right, np.int64)
        if not len(left) or not len(right):
            continue
        for a in range(0, len(left), 64):
            same = (sketches[left[a : a + 64], None, :] == sketches[None, right, :]).sum(axis=2, dtype=np.uint8)
            for i, j in zip(*(x.tolist() for x in np.nonzero(same >= need))):
                union.join(int(left[a + i]), int(right[j]))
        roots = [union.find(k) for k in range(len(nodes))]
        found = [(nodes[k], nodes[r]) for k, r in enumerate(roots) if k != r]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], names=["a", "b"]
            )


def _agreement(a: Column, b: Column) -> Column:
    """How many bytes of two sketches are equal."""
    places = F.sequence(F.lit(1), F.lit(SKETCH))
    equal = F.filter(places, lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))
    return F.size(equal)


def _bounded(df: DataFrame) -> DataFrame:
    """Marked for a broadcast if its counted rows are few; df is written already."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _candidate_links(nodes: DataFrame, limit: int, depth: int) -> DataFrame:
    """(a, b): links that connect all nodes of one bucket with similar sketches. nodes(node, roots, sketch) is written."""
    rows = nodes.select(F.posexplode("roots").alias("run", "token"), "node", "sketch").select(
        F.xxhash64("run", "token").alias("key"), "node", "sketch"
    )
    links, buckets = [], []
    for level in range(depth + 1):
        # a bucket's size, and the node with its lowest hash as its pivot: fixed-width sums for every key
        sizes = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.xxhash64("node")).alias("low")).where(F.col("n") > limit)
        large = cut(sizes.select("key", "low"))
        if large.isEmpty():
            buckets.append(rows.select("key", F.lit(None).cast("int").alias("side"), "node", "sketch"))
            break
        hashed = nodes.select(F.xxhash64("node").alias("low"), F.struct("node", "sketch").alias("pivot"))
        pivots = cut(hashed.join(_bounded(large), "low").dropDuplicates(["key"]).select("key", "pivot"))
        marked = cut(rows.join(_bounded(pivots), "key", "left"))
        light = marked.where(F.col("pivot").isNull())
        buckets.append(light.select("key", F.lit(None).cast("int").alias("side"), "node", "sketch"))
        near = marked.where(F.col("pivot").isNotNull()).withColumn("equal", _agreement(F.col("sketch"), F.col("pivot.sketch")))
        links.append(
            near.where((F.col("equal") >= math.ceil(NEAR * SKETCH)) & (F.col("node") != F.col("pivot.node")))
            .select(F.col("node").alias("a"), F.col("pivot.node").alias("b"))
        )
        rest = near.where(F.col("equal") < math.ceil(CLOSE * SKETCH)).select("key", "node", "sketch")
        if level == depth:
            sizes = cut(rest.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
            count = F.ceil(F.col("n") / limit).cast("int")
            own = F.pmod(F.xxhash64("node"), F.col("count")).cast("int")
            placed = rest.join(_bounded(sizes), "key").withColumn("count", count).withColumn("own", own)
            pair = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
            buckets.append(
                pair.select(
                    F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"),
                    F.when(F.col("own") != F.col("other"), (F.col("own") > F.col("other")).cast("int")).alias("side"),
                    "node",
                    "sketch",
                )
            )
            break
        places = F.array(*[F.pmod(F.xxhash64("key", F.lit(c)), F.lit(SKETCH)).cast("int") + 1 for c in (1, 2)])
        rows = rest.select("key", "node", "sketch", F.explode(places).alias("place")).select(
            F.xxhash64("key", "place", F.substring("sketch", F.col("place"), F.lit(1))).alias("key"), "node", "sketch"
        )
        rows = cut(rows)
    for bucket in buckets:
        ordered = bucket.repartition("key").sortWithinPartitions("key", "side", "node")
        links.append(ordered.mapInArrow(_bucket_links, "a binary, b binary"))
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    return found


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links within blocks. Columns: group, a, b (the blocks that meet), side, node, n_copies, shingles.

    Gives for each node its links in copies (links) and a smaller node that it is connected to (parent).
    """
    num, den = SIMILARITY
    for group in _groups(batches, 3):
        nodes, sides, copies = group["node"], group["side"], np.array(group["n_copies"], np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        n = len(nodes)
        sizes = np.array(list(map(len, sets)), np.int64)
        owner = np.repeat(np.arange(n), sizes)
        _, place, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = held[place] > 1  # what one document alone has meets nothing
        owner, place = owner[shared], place[shared]
        _, place = np.unique(place, return_inverse=True)
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        common = np.zeros((n, n), np.float32)
        width = max(64, 4_000_000 // n)
        for a in range(0, int(place[-1]) + 1 if len(place) else 0, width):
            low, high = np.searchsorted(place, [a, a + width])
            block = np.zeros((n, min(width, int(place[-1]) + 1 - a)), np.float32)
            block[owner[low:high], place[low:high] - a] = 1
            common += block @ block.T
        common = common.astype(np.int64)
        linked = common * (num + den) >= num * (sizes[:, None] + sizes[None, :])
        np.fill_diagonal(linked, False)
        if sides[0] is not None:
            side = np.array(sides)
            linked &= side[:, None] != side[None, :]
        union = _Union(n)
        for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked)))):
            union.join(i, j)
        parents = [nodes[union.find(k)] for k in range(n)]
        links = linked @ copies
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(group["group"], pa.binary()),
                pa.array(nodes, pa.binary()),
                pa.array(parents, pa.binary()),
                pa.array(links.tolist(), pa.int64()),
            ],
            names=["group", "node", "parent", "links"],
        )


def _shingle_sets(texts: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and ``shingles``, the sorted hashes of a text as bytes: each text is read once, however many blocks it meets."""

    def make():
        hashes = WordHashes()
        return lambda found: [(shingles(t, hashes).tobytes(),) for t in found]

    return map_columns(texts, ["text"], keep, T.StructType([T.StructField("shingles", T.BinaryType())]), make)


def _blocks(sets: DataFrame, bands: DataFrame) -> DataFrame:
    """Rows of groups of more than one block, once for each block that they meet.

    A band holds sizes within a factor of 1 / similarity, so that linked nodes are in one band or in two next to each other. bands(group,
    band, parts) says into how many blocks a band is dealt.
    """
    own = F.col("band") * (1 << 32) + F.pmod(F.xxhash64("node"), F.col("parts"))
    placed = sets.join(bands, ["group", "band"]).withColumn("own", own).drop("parts")
    near = placed.withColumn("near", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    met = near.join(bands.withColumnsRenamed({"band": "near"}), ["group", "near"])
    return met.withColumn("other", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: F.col("near") * (1 << 32) + k)))


def _classified(documents: DataFrame, recall: float, limit: int, depth: int) -> DataFrame:
    """The columns of near_duplicate_classes(), and ``chosen``: the first key (no_id, doc_id, mark) of the class, null without words."""
    small_batches(documents.sparkSession)
    prints = cut(fingerprints(documents, runs_for(recall, depth=depth)))
    shaped = prints.where("node IS NOT NULL")
    # of the rows of one node, all are alike but for their document
    nodes = cut(
        shaped.groupBy("node").agg(
            F.min("doc_id").alias("first_id"),
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("one"),
            F.min("roots").alias("roots"),
            F.min("sketch").alias("sketch"),
            F.min("n_shingles").alias("size"),
            F.count("*").alias("n_copies"),
        )
    )
    candidates = connected_components(_candidate_links(nodes.select("node", "roots", "sketch"), limit, depth))
    band = F.floor(F.log("size") / math.log(SIMILARITY[1] / SIMILARITY[0])).alias("band")
    members = nodes.select("node", "one", "n_copies", band).join(candidates.withColumnRenamed("label", "group"), "node")
    members = cut(members)
    sizes = cut(members.groupBy("group").agg(F.ceil(F.count("*") / limit).cast("int").alias("count")))
    members = cut(members.join(sizes, "group").select("group", "count", "band", "node", "n_copies", F.col("one.doc_id").alias("id"), F.col("one.mark").alias("own_mark")))
    marked = documents.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    maybe, _ = split_by_keys(marked, F.xxhash64("doc_id", "mark"), members, F.xxhash64("id", "own_mark"))
    texts = maybe.join(members, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("own_mark"))).dropDuplicates(["node"])
    carried = ["group", "count", "band", "node", "n_copies"]
    sets = cut(_shingle_sets(texts, carried))
    none = F.lit(0).cast("long")
    blocks = sets.where("count = 1").select("group", none.alias("a"), none.alias("b"), F.lit(None).cast("int").alias("side"), "node", "n_copies", "shingles")
    split = cut(sizes.where("count > 1"))
    several = not split.isEmpty()
    if several:
        bands = cut(members.where("count > 1").groupBy("group", "band").agg(F.ceil(F.count("*") / limit).alias("parts")))
        apart = F.when(F.col("own") != F.col("other"), (F.col("own") > F.col("other")).cast("int"))
        met = _blocks(sets.where("count > 1"), bands)
        blocks = blocks.unionByName(met.select("group", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), apart.alias("side"), "node", "n_copies", "shingles"))
    ordered = blocks.repartition("group", "a", "b").sortWithinPartitions("group", "a", "b", "side", "node")
    verified = cut(ordered.mapInArrow(_verified, "group binary, node binary, parent binary, links long"))
    links = verified.where("node <> parent").select("group", F.col("node").alias("a"), F.col("parent").alias("b"))
    if several:
        # groups of one block are settled; the blocks of the others are put together
        apart = links.join(split, "group", "left_semi")
        whole = verified.join(split, "group", "left_anti").select("node", F.col("parent").alias("label"))
        labels = whole.unionByName(connected_components(apart))
    else:
        labels = verified.select("node", F.col("parent").alias("label"))
    counted = verified.groupBy("node").agg(F.sum("links").alias("links"))
    placed = (
        nodes.select("node", "first_id", "one", "n_copies")
        .join(labels, "node", "left")
        .join(counted, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    placed = cut(placed)
    ids = placed.groupBy("label").agg(F.min("first_id").alias("class_id"), F.min("one").alias("chosen"))
    known = placed.join(ids, "label").select(
        F.col("node").alias("own_node"), "class_id", "chosen", (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links")
    )
    return prints.join(known, F.col("node") == F.col("own_node"), "left").select(
        "doc_id",
        "mark",
        F.col("n_shingles").cast("long").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "chosen",
    )


def near_duplicate_classes(
    documents: DataFrame, recall: float = TARGET_RECALL, limit: int = LIMIT, depth: int = DEPTH
) -> DataFrame:
    """(doc_id, mark, n_shingles, class_id, n_links) for each row of documents(doc_id, text, ...); mark is xxhash64(text)."""
    return _classified(documents, recall, limit, depth).drop("chosen")


def keep_one(documents: DataFrame) -> DataFrame:
    """One row of each class (the first by doc_id, null last, then mark), and all documents without words, with all their columns.

    Of rows that repeat the first's doc_id and text, one stays. Only rows that may go are moved (``split_by_keys``).
    """
    classes = cut(_classified(documents, TARGET_RECALL, LIMIT, DEPTH))
    own = [F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")]
    first = F.col("chosen.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("chosen.mark") == F.col("mark"))
    worded = classes.where("chosen IS NOT NULL")
    go = worded.where(~first).select(*own).distinct().withColumn("__once", F.lit(False))
    repeated = worded.where(first).groupBy(*own).count().where("count > 1").select("__id", "__mark", F.lit(True).alias("__once"))
    keys = cut(go.unionByName(repeated))
    mark = F.xxhash64(documents["text"])
    maybe, stay = split_by_keys(documents, F.xxhash64(documents["doc_id"], mark), keys, F.xxhash64("__id", "__mark"))
    met = maybe.join(keys, maybe["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(maybe["text"]) == F.col("__mark")), "left")
    columns = [maybe[f"`{c}`"] for c in documents.columns]
    once = met.where("__once").dropDuplicates(["__id", "__mark"])
    return stay.unionByName(met.where("__once IS NULL").select(*columns)).unionByName(once.select(*columns))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and number of links."""
    classes = near_duplicate_classes(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return classes.select("doc_id", "n_shingles", "class_id", "n_links")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: All pairs that share a shingle, counted; classes by a recursive walk.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT r, array_to_string(w[k:k + 4], ' ') AS g FROM i),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS nb FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 9 * nb >= 4 * (x.n + y.n)),
walk(a, b) AS (SELECT r, r FROM d UNION SELECT walk.a, l.b FROM walk JOIN l ON l.a = walk.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.class_id, CAST(coalesce(m.n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n ON n.r = d.r
LEFT JOIN (SELECT walk.a AS r, min(o.doc_id) AS class_id FROM walk JOIN d o ON o.r = walk.b GROUP BY 1) k ON k.r = d.r
LEFT JOIN (SELECT a AS r, count(*) AS n_links FROM l GROUP BY 1) m ON m.r = d.r
"""
