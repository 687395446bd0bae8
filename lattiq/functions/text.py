"""Text functions as columns: two name normalisers, content tokens, and the scores built on them."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without content, compound spellings, and BM25's constants.
STOP_WORDS = ["the", "a", "an", "to", "of", "in", "on", "at", "by", "for", "and", "or", "with", "is", "are", "be", "s", "any", "all", "their"]
COMPOUNDS = {"goalscorer": "goal scorer", "goalscorers": "goal scorer"}
BM25_K1, BM25_B = 1.5, 0.75
# Words that mark an outcome label as a stage of a contest, and labels that only give a direction.
STAGE_WORDS = "in|of|round|last|group|quarter|semi|final|eliminated|winner|runner|up|same|amount"
DIRECTION_LABELS = ["yes", "no", "over", "under", "1", "x", "2"]


def _accents() -> tuple[str, str]:
    """Composed letters whose decomposition starts with an ASCII letter or digit, and that character."""
    pairs = {}
    for code in range(0xC0, 0x2100):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        rest = base[1:]
        if len(base) > 1 and base[0].isascii() and base[0].isalnum() and all(0x300 <= ord(x) <= 0x36F for x in rest):
            pairs[c] = base[0]
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _accents()


def spaced(x: Column) -> Column:
    """Runs of anything but a-z and 0-9 as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def fold(x: Column) -> Column:
    """Names for exact lookup: accents removed, lower case, other characters as single spaces.

    Only texts with characters of several bytes can have accents; looking up each character of all others took most of the time.
    """
    bare = F.regexp_replace(F.translate(x, _FROM, _TO), "[\\u0300-\\u036F]", "")
    return spaced(F.lower(F.when(F.octet_length(x) == F.length(x), x).otherwise(bare)))


def plain(x: Column) -> Column:
    """Text for token scores: lower case, apostrophes dropped, other characters as single spaces."""
    return spaced(F.regexp_replace(F.lower(x), "[\\u2019']", ""))


def normalize(x: Column) -> Column:
    """Lower case, other characters as single spaces."""
    return spaced(F.lower(x))


def strip_settlement(x: Column) -> Column:
    """Without remarks such as (settled ...)."""
    return F.regexp_replace(x, r"(?i)\(settled[^)]*\)", "")


def stem(token: Column) -> Column:
    """A token of more than three letters without its closing s."""
    return F.when((F.length(token) > 3) & token.endswith("s"), F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token)


def tokens(x: Column) -> Column:
    """array of the words, compounds split."""
    text = plain(strip_settlement(x))
    for word, parts in COMPOUNDS.items():
        text = F.regexp_replace(text, rf"\b{word}\b", parts)
    return F.filter(F.split(text, " "), lambda t: t != "")


def content_tokens(x: Column) -> Column:
    """array of the distinct stemmed words that carry content."""
    return F.array_distinct(F.transform(F.filter(tokens(x), lambda t: ~t.isin(STOP_WORDS)), stem))


def last_token(x: Column) -> Column:
    """The last word of a folded text; null if it has none."""
    return F.nullif(F.element_at(F.split(x, " "), -1), F.lit(""))


def first_marker(x: Column, markers: Column) -> Column:
    """The value of the first word of the folded text that is a key of the map ``markers``."""
    found = F.filter(F.split(fold(x), " "), lambda t: F.map_contains_key(markers, t))
    return F.try_element_at(markers, F.try_element_at(found, F.lit(1)))


def loosely_equal(a: Column, b: Column) -> Column:
    """Equal, or one within the other, once normalised; an empty text equals nothing."""
    x, y = normalize(a), normalize(b)
    return (x != "") & (y != "") & ((x == y) | F.contains(x, y) | F.contains(y, x))


def any_loosely_equal(options: Column, x: Column) -> Column:
    """Whether any text of an array is loosely equal to x."""
    return F.exists(options, lambda o: loosely_equal(o, x))


def combo(x: Column) -> Column:
    """Lower case without white space, in which result tokens are compared."""
    return F.regexp_replace(F.lower(x), r"\s+", "")


def is_bare_value(x: Column) -> Column:
    """A number, one letter, or a pair written ``A - B``."""
    return x.rlike(r"^\d+(?:\.\d+)?$") | x.rlike("^[A-Za-z]$") | x.rlike(r"^.+\s-\s.+$")


def is_stage_label(x: Column) -> Column:
    """Whether a label names a stage of a contest."""
    return x.rlike(rf"(?i)\b(?:{STAGE_WORDS})\b")


def reverse_score(x: Column) -> Column:
    """``a-b`` as ``b-a``; anything else as it is."""
    return F.regexp_replace(x, r"^(\d+)-(\d+)$", "$2-$1")


def result_tokens(x: Column, side: Column) -> Column:
    """win, draw and loss, joined by ``/``, as 1, x and 2 for a side (home or away); null if there is another word."""
    home, away = {"win": "1", "draw": "x", "loss": "2"}, {"win": "2", "draw": "x", "loss": "1"}
    parts = F.split(combo(x), "/")
    known = F.forall(parts, lambda p: p.isin(list(home)))
    as_side = lambda table: F.transform(parts, lambda p: reduce(lambda o, w: F.when(p == w, table[w]).otherwise(o), table, F.lit(None)))
    return F.when(known & (side == "home"), F.array_join(as_side(home), "/")).when(known & (side == "away"), F.array_join(as_side(away), "/"))


def append_missing(text: Column, names: Column) -> Column:
    """The text, followed by the names of an array if none of them has its first word in it."""
    held = F.exists(names, lambda n: F.contains(fold(text), F.element_at(F.split(fold(n), " "), 1)))
    return F.when(held | (F.size(names) == 0), text).otherwise(F.concat(text, F.lit(" "), F.array_join(names, " ")))


def idf(n: Column, df: Column) -> Column:
    """Weight of a token in df of n names; df null or 0: unseen, the highest weight."""
    seen = F.coalesce(df, F.lit(0)).cast("double")
    return F.ln((n.cast("double") + 1.0) / (seen + 0.5))


def bm25(weight: Column, length: Column, average: Column) -> Column:
    """What one shared token adds; each token counts once."""
    return weight * (BM25_K1 + 1) / (F.lit(1.0) + BM25_K1 * (F.lit(1 - BM25_B) + BM25_B * (length / average)))


def percent(part: Column, whole: Column) -> Column:
    """Rounded to whole per cent; 0 of nothing."""
    return F.when(whole > 0, F.round(part * 100.0 / whole)).otherwise(0).cast("long")


def to_number(x: Column) -> Column:
    """The number a text holds, else null."""
    return F.trim(x).try_cast("double")
