"""Language identification with spans, learned from labelled texts.

Each word's script, found from code point ranges, leaves the languages that are written in it.
Among these a word scores by its learned frequency, or, if it wasn't learned, by its character
trigrams. Viterbi over the word scores, with a penalty for each switch, labels spans of one
language. A text's language is the one whose spans hold the most words; its score is the share of the
text's words that stand in them and speak for some language.

Viterbi is skipped only where it provably gives one span: if no other language gains more than half the
penalty over any stretch of words, a path with r foreign stretches pays at least r - 1 or r switches and
cannot win.

Defined results: null text and text without a letter give ``und``, score 0 and no spans; a text in scripts
that were never learned gives the language with most labelled documents, with score 0; a tie goes to
the language with more labelled documents, then the smaller name; without labelled documents all is
``und``; repeated rows each get their row; a null id is never learned from and not held out; whole
texts are read, however long; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm._common import map_columns, spread, table

#: Labelled documents that the model is fitted on at most, chosen by a hash of their id.
SAMPLE_DOCUMENTS = 8000
#: Learned words and trigrams that are kept at most (the most frequent), which bounds the broadcast model.
MODEL_FEATURES = 40_000
#: Log-probability that a switch between languages costs.
SWITCH_PENALTY = 12.0
#: The most that one word can speak against a language.
WORD_CAP = 8.0
UNDETERMINED = "und"

# First code points of script blocks; a block lasts to the next start, "" holds no script.
SCRIPT_STARTS = [
    (0x0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xAA, "latin"), (0xAB, ""), (0xB5, ""),
    (0xBA, "latin"), (0xBB, ""), (0xC0, "latin"), (0xD7, ""), (0xD8, "latin"), (0xF7, ""), (0xF8, "latin"), (0x2B0, ""),
    (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, ""),
    (0x750, "arabic"), (0x780, ""), (0x8A0, "arabic"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"),
    (0xA80, "gujarati"), (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"),
    (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, ""), (0x1780, "khmer"), (0x1800, ""), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, ""), (0x2C60, "latin"), (0x2C80, ""), (0x3040, "kana"), (0x3100, ""), (0x3400, "han"),
    (0x4DC0, ""), (0x4E00, "han"), (0xA000, ""), (0xAC00, "hangul"), (0xD7B0, ""), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB13, ""), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFF00, ""), (0xFF21, "latin"), (0xFF5B, ""),
    (0xFF66, "kana"), (0xFFA0, ""), (0x20000, "han"), (0x32000, ""),
]
_STARTS = [x[0] for x in SCRIPT_STARTS]
_LETTERS = re.compile(r"[^\W\d_]+")

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("lang", T.StringType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("n_words", T.LongType()),
        ]
    )
)
RESULT = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)]
)


def script(word: str) -> str:
    """The script of a word's first letter."""
    for c in word:
        if c.isalpha():
            return SCRIPT_STARTS[bisect_right(_STARTS, ord(c)) - 1][1]
    return ""


def _trigrams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


class Model:
    """Log-probabilities of learned words and trigrams for each language."""

    def __init__(self, documents: dict[str, int], counts: list[tuple[str, str, str, int]]):
        self.languages = sorted(documents, key=lambda x: (-documents[x], x))
        place = {x: k for k, x in enumerate(self.languages)}
        of: dict[str, dict[str, np.ndarray]] = {"word": {}, "gram": {}, "script": {}}
        for kind, lang, feature, n in counts:
            of[kind].setdefault(feature, np.zeros(len(place)))[place[lang]] += n
        self.words, self.grams = self._logs(of["word"]), self._logs(of["gram"])
        total = sum(of["script"].values(), np.zeros(len(place)))
        self.scripts = {s: x >= 0.01 * np.maximum(total, 1) for s, x in of["script"].items()}

    @staticmethod
    def _logs(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        total = sum(found.values(), np.zeros(1))
        return {f: np.log((x + 0.2) / (total + 0.2 * len(found) + 1)) for f, x in found.items()}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        keys = {self._key(g): x for g, x in self.grams.items()}
        self.gram_keys = np.sort(np.fromiter(keys, np.int64, len(keys)))
        rows = [keys[k] for k in self.gram_keys.tolist()]
        self.gram_rows = np.array([*rows, np.zeros(len(self.languages))])

    @staticmethod
    def _key(gram: str) -> int:
        return (ord(gram[0]) << 42) | (ord(gram[1]) << 21) | ord(gram[2])

    def score(self, words: list[str]) -> np.ndarray:
        """How each word (it has a letter) speaks against each language: 0 for the best, less for others."""
        if not hasattr(self, "gram_keys"):
            self.__setstate__({})
        found = self._by_grams(words)
        known = [k for k, w in enumerate(words) if w in self.words]
        if known:
            found[known] = [self.words[words[k]] for k in known]
        scripts = [script(w) for w in words]
        for name in set(scripts):
            at = np.array([s == name for s in scripts])
            fits = self.scripts.get(name)
            if fits is None or not fits.any():
                found[at] = 0
            elif not fits.all():
                found[np.ix_(at, ~fits)] = -np.inf
        return np.maximum(found - found.max(axis=1, keepdims=True), -WORD_CAP)

    def _by_grams(self, words: list[str]) -> np.ndarray:
        """The sum over the trigrams of ^word$ that were learned. Words of like length go together."""
        found = np.zeros((len(words), len(self.languages)))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        for a in range(0, len(order), 4096):
            own = order[a : a + 4096]
            width = int(sizes[own[-1]]) + 2
            codes = np.array([f"^{words[k]}$" for k in own], f"U{width}").view(np.uint32).reshape(len(own), width).astype(np.int64)
            keys = (codes[:, :-2] << 42) | (codes[:, 1:-1] << 21) | codes[:, 2:]
            at = np.searchsorted(self.gram_keys, keys)
            last = len(self.gram_keys)
            at[at == last] = max(0, last - 1)
            rows = np.where(self.gram_keys[at] == keys, at, last) if last else np.zeros_like(at)
            total = np.zeros((len(own), len(self.languages)))
            for j in range(rows.shape[1]):
                total += self.gram_rows[rows[:, j]]
            found[own] = total
        return found


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; on a tie it stays, then takes the first label."""
    return viterbi_many([scores], penalty)[0]


def viterbi_many(texts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """viterbi() of several texts, step by step together."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = [len(texts[i]) for i in order]
    k = texts[0].shape[1]
    every = np.zeros((len(order), sizes[0], k))
    for row, i in enumerate(order):
        every[row, : sizes[row]] = texts[i]
    back = np.zeros((sizes[0], len(order), k), np.int8 if k < 128 else np.int32)
    best = every[:, 0].copy()
    labels, live = np.arange(k), len(order)
    for t in range(1, sizes[0]):
        while sizes[live - 1] <= t:
            live -= 1
        now = best[:live]
        top = now.argmax(axis=1)
        reach = now[np.arange(live), top][:, None] - penalty
        switch = reach > now
        back[t, :live] = np.where(switch, top[:, None], labels)
        best[:live] = np.where(switch, reach, now) + every[:live, t]
    found: list = [None] * len(texts)
    for row, i in enumerate(order):
        path = np.empty(sizes[row], np.int64)
        label = path[-1] = int(best[row].argmax())
        own = back[:, row].tolist() if sizes[row] > 1 else []
        for t in range(sizes[row] - 1, 0, -1):
            label = path[t - 1] = own[t][label]
        found[i] = path
    return found


def label_texts(texts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """The labels of each text's words as by viterbi(), without it where one span is certain."""
    found, open_texts = [], []
    for k, scores in enumerate(texts):
        top = int(scores.sum(axis=0).argmax())
        gain = np.cumsum(scores - scores[:, top : top + 1], axis=0)
        low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
        found.append(np.full(len(scores), top))
        if (gain - low).max() > penalty / 2:
            open_texts.append(k)
    # texts of like length together, in groups of bounded size
    open_texts.sort(key=lambda k: len(texts[k]))
    group: list[int] = []
    for place, k in enumerate(open_texts):
        group.append(k)
        after = open_texts[place + 1] if place + 1 < len(open_texts) else None
        if after is None or (len(group) + 1) * len(texts[after]) > 400_000:
            for i, path in zip(group, viterbi_many([texts[i] for i in group], penalty)):
                found[i] = path
            group = []
    return found


class _Scores(dict):
    """Row of each word in a growing table of scores; 0 stands for what has no letter."""

    limit = 200_000

    def __init__(self, model: Model):
        self.model, self.rows = model, np.zeros((1, len(model.languages)))

    def learn(self, texts: list[list[str]]) -> None:
        """Score what is new in these texts, all at once."""
        if len(self) > self.limit:
            self.clear()
            self.rows = self.rows[:1].copy()
        new = list({w for own in texts for w in own if w not in self})
        lettered = [w for w in new if w.isalpha() or any(c.isalpha() for c in w)]
        self.update(dict.fromkeys(new, 0))
        if lettered:
            self.update(zip(lettered, range(len(self.rows), len(self.rows) + len(lettered))))
            self.rows = np.concatenate([self.rows, self.model.score(lettered)])


def identify(texts: list[str | None], scores: _Scores, penalty: float) -> list[tuple[str, float, list]]:
    """Language, share of words in its spans, and the spans, of each text."""
    languages = scores.model.languages
    rows: list = [(UNDETERMINED, 0.0, [])] * len(texts)
    if not languages:
        return rows
    tokens = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
    scores.learn(tokens)
    found = []
    for k, own in enumerate(tokens):
        at = np.fromiter(map(scores.__getitem__, own), np.int64, len(own))
        at = at[at > 0]
        if len(at):
            found.append((k, scores.rows[at]))
    for (k, own), path in zip(found, label_texts([x for _, x in found], penalty)):
        held = np.bincount(path, minlength=len(languages))
        top = int(held.argmax())
        sure = np.count_nonzero(own[path == top].any(axis=1))  # words that speak for some language
        edges = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1, [len(path)]])
        spans = [(languages[path[a]], a, b - a) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        rows[k] = (languages[top], float(sure / len(path)), spans)
    return rows


def fit(labelled: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, features: int = MODEL_FEATURES) -> Model:
    """Learn from labelled(doc_id, text, lang). Rows with a null in any of them are left out."""
    rows = labelled.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    documents = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = sample_documents / max(1, sum(documents.values()))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    schema = T.StructType([T.StructField("counts", T.ArrayType(T.StringType()))])

    def make():
        def count(texts, langs):
            kinds: dict[tuple[str, str], Counter] = {}
            for text, lang in zip(texts, langs):
                own = kinds.setdefault(("word", lang), Counter())
                own.update(w for w in _LETTERS.findall(text.lower()) if any(c.isalpha() for c in w))
            for (_, lang), own in list(kinds.items()):
                grams, scripts = Counter(), Counter()
                for w, n in own.items():
                    scripts[script(w)] += n
                    for g in _trigrams(w):
                        grams[g] += n
                kinds["gram", lang], kinds["script", lang] = grams, scripts
            found = [f"{kind}\t{n}\t{lang}\t{x}" for (kind, lang), own in kinds.items() for x, n in own.items()]
            return [(found if i == 0 else [],) for i in range(len(texts))]

        return count

    parts = F.split("x", "\t", 4)
    counted = (
        map_columns(rows, ["text", "lang"], [], schema, make)
        .select(F.explode("counts").alias("x"))
        .select(parts[0].alias("kind"), parts[1].cast("long").alias("n"), parts[2].alias("lang"), parts[3].alias("x"))
        .groupBy("kind", "lang", "x")
        .agg(F.sum("n").alias("n"))
    )
    # the most frequent features of either kind; each is a few rows, so the model stays bounded
    top = counted.groupBy("kind", "x").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "kind", "x").limit(features)
    kept = counted.join(top.select("kind", "x"), ["kind", "x"], "left_semi")
    counts = [(r.kind, r.lang, r.x, r.n) for r in kept.select("kind", "lang", "x", "n").collect()]
    return Model(documents, counts)


def identify_languages(
    documents: DataFrame, model: Model, keep: list[str] | None = None, penalty: float = SWITCH_PENALTY, min_score: float | None = None
) -> DataFrame:
    """``keep`` columns of documents(text, ...) with lang_pred, score and spans.

    With ``min_score``, the documents that are ``und`` or score less are left out, and the rest come back
    unchanged.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        scores = _Scores(shared.value)

        def run(texts):
            rows = identify(texts, scores, penalty)
            return rows if min_score is None else [r[0] != UNDETERMINED and r[1] >= min_score for r in rows]

        return run

    return map_columns(documents, ["text"], keep or ["doc_id"], RESULT, make, keep_row=min_score is not None)


def remainder() -> F.Column:
    """crc32 of the id's text, mod 3: 1 is held out."""
    return F.crc32(F.col("doc_id").cast("string")) % 3


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document; the model learns from the documents that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents.where(remainder() != 1))
    return identify_languages(spread(documents.select("doc_id", "text")), model).select(
        "doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
