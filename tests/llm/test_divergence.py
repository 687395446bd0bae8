"""Source divergence against exact arithmetic over all terms, on odd rows and in small chunks, blocks and buckets."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from lattiq.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_divergence(rows, least, top):
    counts, documents = defaultdict(Counter), Counter()
    for text, lang, source in rows:
        own = plain_terms(text)
        counts[lang or "", source or ""].update(own)
        documents.update((lang or "", t) for t in set(own))
    found = set()
    for lang in {g[0] for g in counts}:
        kept = sorted(t for x, t in documents if x == lang and documents[x, t] >= least)
        groups = {s: c for (x, s), c in counts.items() if x == lang}

        def chances(c):
            whole = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // whole for t in kept}

        q, p = chances(sum(groups.values(), Counter())), {s: chances(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(q[t] - p[s][t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, own in (("pair", pairs), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                found |= {(lang, s, part, item, -v, rank) for rank, (v, item) in enumerate(sorted(own, key=lambda x: (x[0], x[1].encode())), 1)}
    return found


def rows_of(seed, n):
    r = random.Random(seed)
    some = ["the", "The", "of", "é", "Ünder", "a1b", "x_y", "\x7f", "日本", "zz"]
    rows = [(" ".join(r.choice(some) + r.choice(["", "", ".", "q"]) for _ in range(r.randint(0, 12))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", None, "S1", "é"])) for _ in range(n)]
    return rows + [(None, "en", "silent"), ("", "none", "a"), ("1 2", "none", "b"), ("once", "few", "a"), ("twice", "few", "b")] + rows[:5]


@pytest.mark.parametrize("block,bucket", [(512, 20_000), (2, 10)])
def test_divergence(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "BUCKET_ROWS", bucket)
    rows = rows_of(3, 80)
    frame = spark.createDataFrame([(*x, "clash", 1) for x in rows], "text string, lang string, source string, term string, value int").repartition(3)
    found = divergence.source_divergence(frame, min_documents=4, top=3)
    assert {tuple(r) for r in found.collect()} == plain_divergence(rows, 4, 3)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_chunks_and_scan():
    """Partial runs of chunks of any size, cut into batches anywhere, keep the frequent terms with all their counts."""
    rows = [(t or "", x or "", s or "") for t, x, s in rows_of(5, 120)]
    wanted, documents = Counter(), Counter()
    for text, lang, source in rows:
        wanted.update((lang, t, source) for t in plain_terms(text))
        documents.update((lang, t) for t in set(plain_terms(text)))
    wanted = {k: n for k, n in wanted.items() if documents[k[:2]] >= 6}
    for size in (1, 7, 125):
        runs = []
        for a in range(0, len(rows), size):
            chunk = divergence.Chunk()
            chunk.add([r[1] for r in rows[a : a + size]], [r[2] for r in rows[a : a + size]], [r[0] for r in rows[a : a + size]])
            if chunk.held:
                runs += zip(*(x.to_pylist() for x in chunk.runs()))
        runs.sort(key=lambda r: tuple(x.encode() for x in r[:3]))
        table = pa.table([list(x) for x in zip(*runs)], names=["lang", "term", "source", "documents", "n"])
        for batch in (1, 3, 50, 10_000):
            found = Counter()
            for out in divergence.keep_frequent(6)(iter(table.to_batches(max_chunksize=batch))):
                for r in out.to_pylist():
                    found[r["lang"], r["term"], r["source"]] += r["n"]
            assert found == wanted


def test_large_chances(spark):
    """Counts beyond what 64 bits hold once multiplied stay exact."""
    from pyspark.sql import functions as F

    n, total = 10**12 + 7, 3 * 10**12 + 11
    frame = spark.createDataFrame([(n, total, 9)], "n long, total long, kept long")
    assert frame.select(divergence.chance(F.col("n"), F.col("total"), F.col("kept"))).first()[0] == 1 + 10**9 * (n + 5) // (total + 45)
