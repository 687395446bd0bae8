"""Quality of texts by compression with two dictionaries.

A zstandard dictionary is trained from good and one from bad labelled text, without the lines that both kinds hold. A text is cut into blocks, each compressed with
either dictionary on its own, so that the dictionaries and not the text's own repeats decide, however long it is. The bytes
that the bad dictionary needs more than the good one, for each byte of text, are its difference. A logistic curve, fitted on
labelled texts that no dictionary was trained from, turns the difference into the chance of the label 1; texts of like
length have an offset and a slope of their own, as far as their number supports one.

Labels of one id are averaged and count as 1 above, as 0 below one half; ids with as many of either are not learned from, nor are rows
without id, text or label. Of documents that repeat an id the smallest text is taken.

Defined results: a null text scores as the empty one, by the curve of shortest texts; a lone surrogate can't occur in Spark's strings; repeated
rows each get their row; without labels of one kind all texts get the share of the label 1, without any labels one half; whole texts are read, however long;
other columns are ignored, or passed on if asked for, whatever their names.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm._common import map_columns, spread, table

#: Labelled documents of each kind that are read at most (about; chosen by a hash of their id), and the longest of them in characters.
SAMPLE_DOCUMENTS, SAMPLE_CHARS = 4000, 40_000
#: Bytes of sampled text that a dictionary is trained from at most, and of a piece of it.
TRAIN_BYTES, PIECE_BYTES = 8 << 20, 512
#: Bytes of a dictionary, and of the blocks that it compresses.
DICTIONARY_BYTES, BLOCK_BYTES = 64 << 10, 1024
LEVEL = 3
#: Every fourth sampled document fits the curve, the others the dictionaries.
FOLDS = 4
#: Lengths in bytes at which another offset and slope begin.
BANDS = (64, 256, 1024, 4096)
#: From this chance of the label 1 on a text is predicted to be good.
GOOD_FROM = 0.3

RESULT = T.StructType([T.StructField("difference", T.DoubleType()), T.StructField("score", T.DoubleType())])


def train(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from whole texts in pieces; of too little text the text itself."""
    pieces, total = [], 0
    for text in texts:
        own = text.encode("utf-8", "replace")
        pieces += [own[a : a + PIECE_BYTES] for a in range(0, len(own), PIECE_BYTES)]
        total += len(own)
        if total > TRAIN_BYTES:
            break
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b"".join(pieces)[-size:]


def without_shared_lines(kinds: list[list[str]]) -> list[list[str]]:
    """The texts of either kind without lines that both kinds hold: passages that go round say nothing about either."""
    shared = set.intersection(*({line for t in texts for line in t.split("\n")} for texts in kinds))
    return [["\n".join(line for line in t.split("\n") if line not in shared) for t in texts] for texts in kinds]


class Sizes:
    """Compressed sizes of a text under each of the dictionaries."""

    def __init__(self, dictionaries: list[bytes]):
        self.compressors = []
        for own in dictionaries:
            shared = zstandard.ZstdCompressionDict(own) if len(own) >= 8 else None
            if shared is not None:
                shared.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

    def of(self, text: bytes) -> list[int]:
        blocks = [text[a : a + BLOCK_BYTES] for a in range(0, len(text), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]

    def difference(self, text: bytes) -> float:
        """Bytes that the first dictionary needs more than the second, for each byte of text; 0 for none."""
        first, second = self.of(text)
        return (first - second) / max(1, len(text))


def features(differences: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One and the difference, for all texts and again for those of each band of length."""
    base = np.stack([np.ones(len(differences)), differences], axis=1)
    band = np.searchsorted(np.array(BANDS), lengths, side="right")
    own = [base * (band == k)[:, None] for k in range(len(BANDS) + 1)]
    return np.concatenate([base, *own], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Coefficients of most likelihood by Newton's steps; those of bands are held back by a ridge."""
    ridge = np.array([1e-3, 1e-3] + [1.0] * (x.shape[1] - 2))
    found = np.zeros(x.shape[1])

    def loss(c: np.ndarray) -> float:
        z = x @ c
        return float((weights * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * c * c).sum())

    now = loss(found)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -40, 40)))
        slope = x.T @ (weights * (y - p)) - ridge * found
        step = np.linalg.solve(x.T @ (x * (weights * p * (1 - p))[:, None]) + np.diag(ridge), slope)
        size = 1.0
        while size > 1e-6 and loss(found + size * step) > now:
            size /= 2
        found, before, now = found + size * step, now, loss(found + size * step)
        if before - now < 1e-9 * max(1.0, abs(now)):
            break
    return found


class Model:
    """Two dictionaries (bad, good) and the curve's coefficients; without dictionaries a fixed score."""

    def __init__(self, dictionaries: list[bytes], scale: float, coefficients: np.ndarray | None, share: float):
        self.dictionaries, self.scale, self.coefficients, self.share = dictionaries, scale, coefficients, share

    def scores(self, differences: list[float], lengths: list[int]) -> list[float]:
        if self.coefficients is None:
            return [self.share] * len(differences)
        z = features(np.array(differences) / self.scale, np.array(lengths)) @ self.coefficients
        return (1 / (1 + np.exp(-np.clip(z, -40, 40)))).tolist()


def labelled_sample(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS, chars: int = SAMPLE_CHARS) -> list[tuple[int, bool, float, str]]:
    """(label, whether it fits the curve, how many labelled documents it stands for, text) of about ``sample`` documents of each label, in an order of their own."""
    counted = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("share"))
        .where("share <> 0.5")
        .select("doc_id", (F.col("share") > 0.5).cast("int").alias("label"))
    )
    held = {r.label: r.n for r in counted.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, sample / n) for k, n in held.items()}
    place = F.xxhash64(F.col("doc_id"), F.lit(13))
    bound = F.when(F.col("label") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)) * (1 << 30)
    chosen = counted.where(F.pmod(place, F.lit(1 << 30)) < bound)  # about 2 * sample rows, so their ids may be broadcast
    texts = documents.where(F.col("doc_id").isNotNull() & (F.length("text") <= chars)).select("doc_id", "text")
    rows = (
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .select("doc_id", "label", "text", place.alias("place"), (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0).alias("curve"))
        .collect()
    )
    rows.sort(key=lambda r: (r.place, r.doc_id))
    return [(r.label, r.curve, 1 / share[r.label], r.text) for r in rows]


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS, chars: int = SAMPLE_CHARS) -> Model:
    """Learn from documents(doc_id, text) and labels(doc_id, quality); both hold nothing but what may be learned from."""
    rows = labelled_sample(documents, labels, sample, chars)
    good, every = (sum(w for label, _, w, _ in rows if label >= least) for least in (1, 0))
    share = float(good / every) if every else 0.5
    if len({label for label, _, _, _ in rows}) < 2:
        return Model([b"", b""], 1.0, None, share)
    kinds = [[t for label, curve, _, t in rows if label == k and not curve] or [t for label, _, _, t in rows if label == k] for k in (0, 1)]
    dictionaries = [train(own) for own in without_shared_lines(kinds)]
    curve = [r for r in rows if r[1]]
    if len({r[0] for r in curve}) < 2:
        curve = rows
    sizes = Sizes(dictionaries)
    own = [r[3].encode("utf-8", "replace") for r in curve]
    found = np.array([sizes.difference(t) for t in own])
    scale = float(found.std()) or 1.0
    x = features(found / scale, np.array([len(t) for t in own]))
    y, w = np.array([float(r[0]) for r in curve]), np.array([r[2] for r in curve])
    return Model(dictionaries, scale, logistic(x, y, w / w.mean()), share)


def score_quality(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of documents(text, ...) with difference and score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value
        sizes = Sizes(own.dictionaries)

        def run(texts):
            whole = [(t or "").encode("utf-8", "replace") for t in texts]
            differences = [sizes.difference(t) for t in whole]
            return list(zip(differences, own.scores(differences, [len(t) for t in whole])))

        return run

    return map_columns(documents, ["text"], keep or ["doc_id"], RESULT, make)


def held_out() -> Column:
    """Whether crc32 of the id's text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op13_compressed_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document; the model learns from labelled documents that aren't held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents.where(~held_out()), table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality"))
    return score_quality(spread(documents), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"), "difference"
    )
