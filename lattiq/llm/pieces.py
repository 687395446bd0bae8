"""SentencePiece encoding and decoding with the N best segmentations.

The lattice of a text has an edge for each piece of the vocabulary that matches at a place. Forward Viterbi
gives the best score of every prefix. Walking back from the end, A-star takes the hypothesis with
the best sum of prefix and suffix score; as the prefix scores are exact, segmentations leave the queue in
order of their scores.

No piece but runs of spaces has a space after its start, and few have marks, so a text falls into
segments that no piece crosses; their lattices are independent. Forward and backward Viterbi scores of
all new segments of a batch come from one vectorised pass, which also gives what the second choice
loses: the best path through any edge off the best one. The N best texts differ from the best
in at most N - 1 segments, all among the N - 1 that lose least. Only for these does the A-star
search list the N best, and a best-first search over their choices gives the texts.

The vocabulary's scores are merge ranks, whose sums would favour short pieces; so a piece costs ``PIECE_COST`` besides its rank:
fewer pieces come first, then the lower sum of ranks.

A character that no piece covers alone costs 10 less than the lowest score and is written as its bytes.

Defined results: null is encoded as the empty text, which has one segmentation without pieces; U+2581 is
the vocabulary's space and comes back as a space; any other text decodes to itself; equal scores
come in a fixed order; fewer than N segmentations are all returned; whole texts are encoded;
repeated rows each get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lattiq.llm._common import map_columns, spread, table

#: The vocabulary file; the driver reads it and its pieces are broadcast.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations of each text.
N_BEST = 3
#: What a piece costs besides its rank, which is below 32,000 for pieces that merges make.
PIECE_COST = 10_000_000
SPACE = "▁"
_SPACED = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_BASE, _MASK = 0x100000001B3, 2**64 - 1

Hypothesis = tuple[int, tuple[int, ...]]

RESULT = T.StructType(
    [
        T.StructField("scores", T.ArrayType(T.LongType())),
        T.StructField("ids", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)
DIGEST = T.StructType(
    [
        T.StructField("n_pieces", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("n_best", T.IntegerType()),
        T.StructField("scores", T.ArrayType(T.LongType())),
        T.StructField("n_best_sha256", T.StringType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
)


def _runs(values: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values from first[k] to first[k + 1] of each k in ``at``, one after the other."""
    counts = first[at + 1] - first[at]
    ends = np.cumsum(counts)
    return values[np.arange(counts.sum()) + np.repeat(first[at] - ends + counts, counts)]


class Vocabulary:
    """Pieces with whole-number scores, and the bytes each stands for."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """(piece, score, kind) by id; kind is normal, byte or other."""
        self.ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == "normal"}
        self.scores = [round(s) - PIECE_COST for _, s, _ in pieces]
        self.byte_ids = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        self.bytes = [
            bytes([int(p[3:5], 16)]) if kind == "byte" else p.replace(SPACE, " ").encode() if kind == "normal" else b""
            for p, _, kind in pieces
        ]
        self.all_bytes = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.first_byte = np.cumsum([0, *map(len, self.bytes)])
        self.longest = max(map(len, self.ids), default=1)
        self.digest = hashlib.sha256(repr(pieces).encode()).digest()
        self.unknown = min((self.scores[k] for k in self.ids.values()), default=0) - 10
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.segments = self._segments()
        if any(b == SPACE and a != SPACE for p in self.ids for a, b in zip(p, p[1:])):
            raise ValueError("pieces with a space after another character aren't supported")

    def _segments(self) -> str:
        """A pattern whose matches no piece crosses.

        A text is cut before the space or an ASCII mark wherever no piece has the two characters at the
        cut next to each other.
        """
        marks = {c for p in self.ids for c in p if c.isascii() and not c.isalnum()} | {SPACE}
        before: dict[str, set[str]] = {}
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                if b in marks:
                    before.setdefault(b, set()).add(a)
        own = lambda chars: "".join(map(re.escape, sorted(chars)))
        held = "".join(f"|(?<=[{own(before[c])}]){re.escape(c)}" for c in sorted(before))
        return f"(?s:.)(?:[^{own(marks)}]+{held})*"

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        kind = lambda k: "byte" if p.is_byte(k) else "other" if p.is_control(k) or p.is_unknown(k) or p.is_unused(k) else "normal"
        return cls([(p.id_to_piece(k), p.get_score(k), kind(k)) for k in range(p.get_piece_size())])

    def spelled(self, c: str) -> tuple[int, ...]:
        """The byte pieces of a character without a piece."""
        return tuple(self.byte_ids[b] for b in c.encode("utf-8", "surrogatepass"))

    def edges(self, text: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For each end: (start, score, ids) of what can stand there."""
        found: list[list] = [[] for _ in range(len(text) + 1)]
        for start in range(len(text)):
            alone = False
            for end in range(start + 1, min(len(text), start + self.longest) + 1):
                piece = text[start:end]
                if piece not in self.starts:
                    break
                k = self.ids.get(piece)
                if k is not None:
                    found[end].append((start, self.scores[k], (k,)))
                    alone |= end == start + 1
            if not alone:
                found[start + 1].append((start, self.unknown, self.spelled(text[start])))
        return found

    def n_best(self, text: str, n: int) -> list[Hypothesis]:
        """The n best (score, ids) of one lattice."""
        edges = self.edges(text)
        prefix = [0] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            prefix[end] = max(prefix[start] + score for start, score, _ in edges[end])
        queue: list[tuple] = [(-prefix[-1], len(text), 0, 0, None)]
        made, found = 0, []
        while queue and len(found) < n:
            _, at, _, suffix, tail = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while tail is not None:
                    ids.extend(tail[0])
                    tail = tail[1]
                found.append((suffix, tuple(ids)))
                continue
            for start, score, own in edges[at]:
                made += 1
                total = suffix + score
                heapq.heappush(queue, (-(prefix[start] + total), start, made, total, (own, tail)))
        return found

    def spelling(self, ids) -> bytes:
        """The bytes that piece ids stand for."""
        return _runs(self.all_bytes, self.first_byte, np.asarray(ids, np.int64)).tobytes()

    def decode(self, ids) -> str:
        """The text of piece ids."""
        text = self.spelling(ids).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class _Matcher:
    """Viterbi over many short segments at once: the best pieces, their score, the loss of the second choice."""

    widths = (6, 10, 16, 32)

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        # by length: the sorted hashes of all pieces' starts, and the piece that is that start (-1: none)
        by_length: dict[int, dict[int, int]] = {}
        for piece, k in vocabulary.ids.items():
            key = 0
            for length, c in enumerate(piece, 1):
                key = (key * _BASE + ord(c) + 1) & _MASK
                by_length.setdefault(length, {}).setdefault(key, -1)
            by_length[len(piece)][key] = k
        self.tables = {}
        for length, found in by_length.items():
            keys = sorted(found)
            self.tables[length] = (np.array(keys, np.uint64), np.array([found[x] for x in keys], np.int32))
        self.scores = np.array(vocabulary.scores, np.int64)

    def solve(self, segments: list[str]) -> list[tuple[int, bytes, float]]:
        """(score, ids as int32 bytes, loss) of each. Long segments, and those with U+0000, are solved alone."""
        found: list = [None] * len(segments)
        groups: dict[int, list[int]] = {}
        for k, segment in enumerate(segments):
            width = next((w for w in self.widths if len(segment) <= w), 0)
            groups.setdefault(0 if "\0" in segment else width, []).append(k)
        for width, places in groups.items():
            own = [segments[k] for k in places]
            for k, x in zip(places, self._many(own, width) if width else map(self._one, own)):
                found[k] = x
        return found

    def _one(self, segment: str) -> tuple[int, bytes, float]:
        best = self.vocabulary.n_best(segment, 2)
        return best[0][0], np.array(best[0][1], np.int32).tobytes(), best[0][0] - best[1][0] if len(best) > 1 else np.inf

    def _many(self, segments: list[str], width: int) -> list[tuple[int, bytes, float]]:
        n = len(segments)
        # half the memory wherever sums of scores, and of two that are too low, fit in 32 bits
        low, whole = (-700_000_000, np.int32) if -width * self.vocabulary.unknown < 345_000_000 else (-(2**60), np.int64)
        codes = np.array(segments, f"U{width}").view(np.uint32).reshape(n, width).astype(np.uint64)
        sizes = np.fromiter(map(len, segments), np.int64, n)
        rows = np.arange(n)
        # grow the starts of pieces that match at each place, until none does
        row, start = np.nonzero(np.arange(width) < sizes[:, None])
        key, found = np.zeros(len(row), np.uint64), []
        for length in range(1, min(width, self.vocabulary.longest) + 1):
            key = key * np.uint64(_BASE) + codes[row, start + length - 1] + np.uint64(1)
            known, known_ids = self.tables[length]
            at = np.searchsorted(known, key)
            at[at == len(known)] = 0
            same = known[at] == key
            own, own_row, own_start = known_ids[at[same]], row[same], start[same]
            piece = own >= 0
            found.append((own_row[piece], own_start[piece], own[piece]))
            more = own_start + length < sizes[own_row]
            row, start, key = own_row[more], own_start[more], key[same][more]
            if not len(row):
                break
        longest = len(found)
        # by start and length, and by end and falling length: the score of the piece there
        ids = np.full((n, width, longest), -1, np.int32)
        ending = np.full((n, width + 1, longest), low, whole)
        starting = np.full((n, width, longest), low, whole)
        starting[:, :, 0] = ending[:, 1:, longest - 1] = self.vocabulary.unknown
        for length, (row, start, own) in enumerate(found, 1):
            ids[row, start, length - 1] = own
            ending[row, start + length, longest - length] = starting[row, start, length - 1] = self.scores[own]
        ahead = np.full((n, longest + width + 1), low, whole)
        ahead[:, longest] = 0
        last = np.zeros((n, width + 1), np.int64)
        for end in range(1, width + 1):
            score = ahead[:, end : end + longest] + ending[:, end]
            best = score.argmax(axis=1)  # the longer piece on a tie, as in n_best()
            last[:, end] = longest - best
            ahead[:, longest + end] = score[rows, best]
        total = ahead[rows, longest + sizes]
        taken, steps, at = np.zeros((n, width), np.int64), [], sizes.copy()
        while (own := np.flatnonzero(at > 0)).size:
            length = last[own, at[own]]
            start = at[own] - length
            taken[own, start] = length
            step = np.full(n, -2, np.int64)
            step[own] = ids[own, start, length - 1]
            at[own] = start
            steps.append((step, at.copy()))
        behind = np.full((n, width + 1 + longest), low, whole)
        behind[rows, sizes] = 0
        second = np.full(n, low, whole)
        for start in range(width - 1, -1, -1):
            score = starting[:, start] + behind[:, start + 1 : start + 1 + longest]
            inside = start < sizes
            behind[inside, start] = score[inside].max(axis=1)
            on = np.flatnonzero(taken[:, start])
            score[on, taken[on, start] - 1] = low
            np.maximum(second, ahead[:, longest + start] + score.max(axis=1), out=second)
        loss = np.where(second > low // 2, total - second, np.inf).tolist()
        table = np.stack([x[0] for x in steps[::-1]], axis=1)
        plain = (table != -1).all(axis=1).tolist()
        counts = (table >= 0).sum(axis=1)
        flat = table[table >= 0].astype(np.int32).tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        result, begin = [], 0
        for k, (score, end) in enumerate(zip(total.tolist(), ends)):
            own_ids = flat[begin:end]
            begin = end
            if not plain[k]:
                spelled: list[int] = []
                for x, where in zip(table[k].tolist(), [int(step[1][k]) for step in steps[::-1]]):
                    spelled.extend((x,) if x >= 0 else self.vocabulary.spelled(segments[k][where]) if x == -1 else ())
                own_ids = np.array(spelled, np.int32).tobytes()
            result.append((score, own_ids, loss[k]))
        return result


class _Segments(dict):
    """Place of each solved segment in arrays: its best ids, best score, loss of the second choice.

    A text is first cut at spaces only. What isn't known of that is cut at marks too, and solved. Beyond ``limit`` segments
    those that most texts held stay, half as many at most; the others are solved again when they come back.
    """

    limit = 600_000

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.matcher, self.pattern = _Matcher(vocabulary), re.compile(vocabulary.segments)
        self.ids, self.first = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.scores, self.losses, self.used = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32)

    def best(self, at: np.ndarray) -> np.ndarray:
        """The best ids of the segments at these places, one after the other."""
        return _runs(self.ids, self.first, at)

    def _add(self, names: list[str], ids: np.ndarray, counts, scores, losses) -> None:
        self.update(zip(names, range(len(self), len(self) + len(names))))
        self.ids = np.concatenate([self.ids, ids])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts, dtype=np.int64)])
        self.scores, self.losses = np.concatenate([self.scores, scores]), np.concatenate([self.losses, losses])
        self.used = np.concatenate([self.used, np.zeros(len(names), np.int32)])

    def _forget(self) -> None:
        most = np.argsort(-self.used, kind="stable")[: self.limit // 2]
        keep = np.sort(most[self.used[most] > 1])
        names = list(self)  # in the order of their places
        ids, counts = self.best(keep), np.diff(self.first)[keep]
        self.clear()
        self.update(zip(map(names.__getitem__, keep.tolist()), range(len(keep))))
        self.ids, self.first = ids, np.concatenate([[0], np.cumsum(counts)])
        self.scores, self.losses, self.used = self.scores[keep], self.losses[keep], self.used[keep] // 2

    def learn(self, texts: list[list[str]]) -> None:
        """Solve what is new in these texts, all at once."""
        if len(self) > self.limit:
            self._forget()
        # asked one by one: difference() would walk all that is solved, for every batch
        new = [x for x in set().union(*texts) if x not in self]
        if not new:
            return
        cut = list(map(self.pattern.findall, new))
        fresh = list({x for own in cut for x in own if x not in self})
        for a in range(0, len(fresh), 8192):
            names = fresh[a : a + 8192]
            scores, ids, losses = zip(*self.matcher.solve(names))
            self._add(names, np.frombuffer(b"".join(ids), np.int32), [len(x) // 4 for x in ids], np.array(scores, np.int64), np.array(losses, float))
        joined = [k for k, own in enumerate(cut) if len(own) > 1]
        if joined:
            parts = [cut[k] for k in joined]
            at = np.fromiter(map(self.__getitem__, chain.from_iterable(parts)), np.int64)
            starts = np.cumsum([0, *map(len, parts[:-1])])
            total = lambda x: np.add.reduceat(x[at], starts)
            self._add([new[k] for k in joined], self.best(at), total(np.diff(self.first)), total(self.scores), np.minimum.reduceat(self.losses[at], starts))


def _choices(best: int, losses: np.ndarray, solve, n: int) -> list[tuple[int, dict[int, tuple[int, ...]]]]:
    """(score, {segment: its ids}) of the n best texts; segments not named take their best.

    best is the best text's score and losses what each segment's second choice loses; solve(k) gives the
    n best (score, ids) of segment k, from the A-star search.
    """
    near, active = min(n - 1, len(losses)), []
    if near > 0:
        kth = np.partition(losses, near - 1)[near - 1]
        below, level = np.flatnonzero(losses < kth), np.flatnonzero(losses == kth)
        active = sorted([*below.tolist(), *level[: near - len(below)].tolist()])
        active = [k for k in active if losses[k] < np.inf]
    choices = [solve(k) for k in active]
    queue: list[tuple] = [(0, (0,) * len(active), 0)]
    found = []
    while queue and len(found) < n:
        lost, ranks, first = heapq.heappop(queue)
        found.append((best - lost, {k: own[r][1] for k, own, r in zip(active, choices, ranks) if r}))
        for j in range(first, len(active)):
            own = choices[j]
            if ranks[j] + 1 < len(own):
                more = lost + own[ranks[j]][0] - own[ranks[j] + 1][0]
                heapq.heappush(queue, (more, ranks[:j] + (ranks[j] + 1,) + ranks[j + 1 :], j))
    return found


class Encoder:
    """N-best encoding of whole texts; solved segments, and listed ones, are kept up to a bound."""

    most_listed = 20_000

    def __init__(self, vocabulary: Vocabulary, n: int = N_BEST):
        self.vocabulary, self.n = vocabulary, n
        self.solved = _Segments(vocabulary)
        self.listed: dict[str, list[Hypothesis]] = {}

    def split(self, texts: list[str | None]) -> list[list[str]]:
        """The segments of each text, all of them solved."""
        found = [_SPACED.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.solved.learn(found)
        return found

    def _n_best(self, segment: str) -> list[Hypothesis]:
        found = self.listed.get(segment)
        if found is None:
            if len(self.listed) >= self.most_listed:
                self.listed.clear()
            found = self.listed[segment] = self.vocabulary.n_best(segment, self.n)
        return found

    def choices(self, segments: list[str]) -> tuple[np.ndarray, list[tuple[int, dict[int, tuple[int, ...]]]]]:
        """The places of the segments, and (score, {segment: its other ids}) of the n best."""
        solved = self.solved
        at = np.fromiter(map(solved.__getitem__, segments), np.int64, len(segments))
        solved.used[at] += 1  # once for a text, however often it holds the segment
        return at, _choices(int(solved.scores[at].sum()), solved.losses[at], lambda k: self._n_best(segments[k]), self.n)

    def hypotheses(self, segments: list[str]) -> list[Hypothesis]:
        """The n best (score, ids) of a text's segments."""
        at, choices = self.choices(segments)
        best = [self.solved.best(at[k : k + 1]).tolist() for k in range(len(at))]
        return [(score, tuple(chain.from_iterable(changed.get(k, x) for k, x in enumerate(best)))) for score, changed in choices]

    def encode(self, text: str | None) -> list[Hypothesis]:
        """The n best (score, ids) of a text."""
        return self.hypotheses(self.split([text])[0])

    def digest(self, text: str | None, segments: list[str]) -> tuple:
        """The row of one text: counts, hashes, scores, and whether every encoding decodes to the text."""
        at, choices = self.choices(segments)
        ids = self.solved.best(at)
        same = self.vocabulary.decode(ids) == (text or "").replace(SPACE, " ")
        every = hashlib.sha256(ids.tobytes())
        one = every.hexdigest()
        for score, changed in choices:
            for k, other in changed.items():
                same &= self.vocabulary.spelling(other) == segments[k].replace(SPACE, " ").encode()
                every.update(f"{score} {k} {other}".encode())
        return len(ids), one, len(choices), [s for s, _ in choices], every.hexdigest(), same


#: Encoders of this process, so that the tasks of a Python worker share what they have solved.
_ENCODERS: dict[tuple[bytes, int], Encoder] = {}


def _encoder(vocabulary: Vocabulary, n: int) -> Encoder:
    key = (vocabulary.digest, n)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary, n)
    return _ENCODERS[key]


def _encoded(texts: DataFrame, keep: list[str], schema: T.StructType, n: int, model_file: str, row) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))

    def make():
        encoder = _encoder(shared.value, n)
        return lambda column: [row(encoder, t, own) for t, own in zip(column, encoder.split(column))]

    return map_columns(texts, ["text"], keep, schema, make)


def encode(texts: DataFrame, keep: list[str], n: int = N_BEST, model_file: str = MODEL_FILE) -> DataFrame:
    """``keep`` columns of texts(text, ...) with scores and ids (one list for each segmentation, best first)."""

    def row(encoder, _, segments):
        found = encoder.hypotheses(segments)
        return [s for s, _ in found], [list(ids) for _, ids in found]

    return _encoded(texts, keep, RESULT, n, model_file, row)


def encode_digest(texts: DataFrame, keep: list[str], n: int = N_BEST, model_file: str = MODEL_FILE) -> DataFrame:
    """As encode(), but with counts and hashes in place of the ids, and a check that they decode."""
    return _encoded(texts, keep, DIGEST, n, model_file, lambda e, t, own: e.digest(t, own))


def decode(pieces: DataFrame, keep: list[str], model_file: str = MODEL_FILE) -> DataFrame:
    """``keep`` columns of pieces(ids array of int, ...) with their text; null ids give null."""
    shared = pieces.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))
    schema = T.StructType([T.StructField("text", T.StringType())])
    make = lambda: lambda rows: [(None if ids is None else shared.value.decode(ids),) for ids in rows]
    return map_columns(pieces, ["ids"], keep, schema, make)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's best segmentations, as counts, scores and hashes."""
    return encode_digest(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"])
