"""Main text of web pages by the maximum-scoring subsequence.

A page is read as tags and words. A word scores positive and a tag negative; a linear scan finds the
contiguous run with the highest sum, and its blocks are the text. The weights come from pages whose
markup names their article (one closed <article> or <main>): a structured perceptron lowers the
weight of each tag and word that the scan took wrongly, and raises that of each it missed. A word's
weight depends on its block's tag and stays above zero, a tag's stays below; a tag that no mistake has
taught has the mean weight of its class (block or inline). A word within a link is priced like a tag, by its block: menus and lists of links
count against a run, a link in running text hardly does. The weights are learned from pages as they are, with their menus, so that what
isn't article has to be told by them. The labelling tags score nothing. On a
page that marks its article, the mark counts: tags inside cost nothing and words outside count against a run.

Elements that never hold article text (scripts, menus, headers, also the article's own, footers, forms and the like by tag; containers whose whole class, id or
role names an advert, notice, comments and the like, or a usual compound of these; hidden ones) give no
words. They are never paragraphs, headings or inline text by such a name, nor what holds the marked article.

Defined results: null or empty html, and a page without words, give the empty text; character references
are decoded once, broken ones stay; a quote in a tag counts only after an equals sign; a tag that is never closed ends with the page; a removed element
without an end tag counts as an ordinary tag; <br> is white space; a removed inline element (a button, a script) doesn't end its block; equal sums
take the earliest and then the longest run; whole pages are read; repeated rows each get their row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattiq.llm._common import map_columns, spread, table

#: Labelled pages that the weights are fitted on at most, chosen by a hash of the page, and characters of each: longer ones are no samples.
SAMPLE_PAGES, SAMPLE_CHARS = 400, 200_000
#: Passes of the perceptron over them.
ROUNDS = 5

# Elements without article text, those of them that stand in running text; elements that names can remove.
REMOVED_TAGS = frozenset(
    "head title script style noscript template nav header footer aside form button select textarea menu dialog iframe object svg canvas".split()
)
INLINE_REMOVED = frozenset("script style noscript template button select textarea iframe object svg canvas".split())
CONTAINERS = frozenset("div section ul ol dl table center details fieldset figure custom".split())
# Whole names (class, id, role) of elements without article text, and compounds of them.
REMOVED_NAMES = frozenset(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header footer
    masthead sidebar aside cookie cookies consent notice alert popup modal newsletter subscribe share sharing social related recommended comment comments commentlist disqus replies login
    search contentinfo complementary""".split()
)
REMOVED_COMPOUNDS = re.compile(
    r"(?:site|page|top|main|global|bottom|left|right|mobile)[_-](?:header|footer|nav|navigation|menu|sidebar|banner|ads?)|"
    r"(?:ads?|advert|cookies?|consent|sidebar|nav|menu|footer|comments?|share|social|newsletter|subscribe|breadcrumbs?|promo|sponsored)[_-]"
    r"(?:slot|box|container|wrapper|wrap|banner|notice|bar|list|links|buttons|icons|form|signup|section|area|block|widget|unit|thread|popup|left|right|inner)|"
    r"(?:user|reader)[_-]comments|related[_-](?:posts|articles|stories|links|news)"
)
RAW_TAGS = ("script", "style", "noscript", "template", "textarea", "title", "iframe")
BLOCK_TAGS = REMOVED_TAGS - INLINE_REMOVED | frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr html "
    "legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LABEL_TAGS = frozenset(["article", "main"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*(?:\"[^\"]*\"|'[^']*')|[=\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|=\s*(?:\"[^\"]*\"|'[^']*')")
_NOT_SHOWN = re.compile(r"(?i)display\s*:\s*none")
_RAW_ENDS = {tag: re.compile(rf"(?i)</{tag}(?=[\s/>])") for tag in RAW_TAGS}

RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

#: (kind, tag, payload): kind is tag, text or removed. payload is the text of a run.
Event = tuple[str, str, str]


def attributes_of(text: str) -> dict[str, str]:
    """The attributes of a tag by lower-cased name; of a repeated one the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        if m[1]:
            found.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
    return found


def _unwanted(tag: str, attributes: str) -> bool:
    """Whether an element gives no words."""
    if tag in REMOVED_TAGS:
        return True
    if not attributes or tag in ("html", "body") or tag in LABEL_TAGS:
        return False
    own = attributes_of(attributes)
    if "hidden" in own or _NOT_SHOWN.search(own.get("style", "")):
        return True
    if tag not in CONTAINERS:
        return False
    names = " ".join(own.get(k, "") for k in ("class", "id", "role")).lower().split()
    return any(n in REMOVED_NAMES or REMOVED_COMPOUNDS.fullmatch(n) for n in names)


def events(page: str, whole: bool = False) -> list[Event]:
    """The tags and texts of a page, without the inside of removed elements; ``whole``: of none but those that are never shown as text."""
    found: list[Event] = []
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            found.append(("text", "", page[at:]))
            break
        if m.start() > at:
            found.append(("text", "", page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        found.append(("close" if closing else "open", tag, attributes))
        if not closing and tag in _RAW_ENDS and not attributes.rstrip().endswith("/"):
            end = _RAW_ENDS[tag].search(page, at)
            at = end.start() if end else n
    return _without_removed(found, (lambda tag, _: tag in RAW_TAGS) if whole else _unwanted)


def _without_removed(found: list[Event], unwanted: Callable[[str, str], bool]) -> list[Event]:
    """Each removed element with its inside as one event."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for k, (kind, tag, _) in enumerate(found):
        if kind == "open" and tag not in VOID_TAGS:
            opened.setdefault(tag, []).append(k)
        elif kind == "close" and opened.get(tag):
            ends[opened[tag].pop()] = k
    label = article_run(found)
    out: list[Event] = []
    k = 0
    while k < len(found):
        kind, tag, payload = found[k]
        if kind == "open" and unwanted(tag, payload):
            end = ends.get(k, len(found) - 1 if tag in RAW_TAGS else None)
            if end is not None and not (label and k <= label[0] and label[1] - 1 <= end):
                out.append(("removed", tag, ""))
                k = end + 1
                continue
        out.append(found[k])
        k += 1
    return out


def features(found: list[Event], mark: tuple[int, int] | None = None) -> list[tuple[str, int]]:
    """(feature, count) of each event: words, or linked words, by their block's tag, or one tag. ``mark`` is the run of a marked article."""
    block, linked, out = "", False, []
    for k, (kind, tag, payload) in enumerate(found):
        inside = mark is not None and mark[0] <= k < mark[1]
        if kind == "text":
            own = "link" if linked and mark is None else "word"
            out.append((f"{own} {block}" if mark is None or inside else "outside", len(payload.split())))
            continue
        if tag == "a":
            linked = kind == "open"
        if inside:
            out.append((f"{kind} {tag}", 0))
            continue
        if kind == "open" and tag in BLOCK_TAGS:
            block = tag
        elif kind == "close" and tag == block:
            block = ""
        out.append((f"{kind} {tag}", 0 if tag in LABEL_TAGS else 1))
    return out


class Weights:
    """Scores of words (above 0) and tags (below 0)."""

    #: The least size of a tag's weight, and of a word's, so that long texts in any block count; the first weight of a tag before anything is
    #: learned (half of it for inline ones).
    LEAST, LEAST_WORD = 0.01, 0.1
    FIRST = {"open": -0.5, "close": -0.5, "link": -1.0}

    def __init__(self) -> None:
        self.of: dict[str, float] = {}

    def get(self, feature: str) -> float:
        known = self.of.get(feature)
        if known is not None:
            return known
        kind, _, tag = feature.partition(" ")
        if kind == "word":
            return 1.0
        block = tag in BLOCK_TAGS
        seen = [w for f, w in self.of.items() if f.startswith(f"{kind} ") and (f.partition(" ")[2] in BLOCK_TAGS) == block]
        if seen:
            return sum(seen) / len(seen)
        return self.FIRST.get(kind, -1.0) * (1.0 if block else 0.5)

    def move(self, feature: str, step: float) -> None:
        now = self.get(feature) + step
        self.of[feature] = max(self.LEAST_WORD, now) if feature.startswith("word") else min(-self.LEAST, now)

    def best_run(self, found: list[tuple[str, int]]) -> tuple[int, int]:
        """The run [start, end) with the highest sum; (0, 0) if none is above 0."""
        best, run, start, region = 0.0, 0.0, 0, (0, 0)
        weight = {feature: self.get(feature) for feature, _ in found}
        for k, (feature, n) in enumerate(found):
            if run < 0:
                run, start = 0.0, k
            run += n * weight[feature]
            if run > best or (run == best and region[0] == start and region[1]):
                best, region = run, (start, k + 1)
        return region

    def fit(self, pages: list[str], rounds: int = ROUNDS) -> Weights:
        """Learn from the pages whose markup names one article."""
        labelled = []
        for page in pages:
            own = events(page, whole=True)
            gold = article_run(own)
            if gold:
                labelled.append((features(own), gold))
        for r in range(rounds):
            wrong = 0
            for own, (a, b) in labelled:
                c, d = self.best_run(own)
                if not self._same(own, (a, b), (c, d)):
                    wrong += 1
                    delta: Counter = Counter()
                    for k in {*range(a, b)} ^ {*range(c, d)}:
                        delta[own[k][0]] += own[k][1] if a <= k < b else -own[k][1]
                    size = sum(map(abs, delta.values())) or 1
                    for feature, n in delta.items():
                        self.move(feature, n / size * 4 / (r + 1))
            if not wrong:
                break
        return self

    @staticmethod
    def _same(own: list[tuple[str, int]], gold: tuple[int, int], found: tuple[int, int]) -> bool:
        """Whether both runs hold the same words."""
        missed = {*range(*gold)} ^ {*range(*found)}
        return not any(own[k][0].startswith("word") and own[k][1] for k in missed)


def article_run(found: list[Event]) -> tuple[int, int] | None:
    """The inside of a page's only article (or else main) element."""
    for tag in ("article", "main"):
        starts = [k for k, e in enumerate(found) if e[:2] == ("open", tag)]
        ends = [k for k, e in enumerate(found) if e[:2] == ("close", tag)]
        if len(starts) == len(ends) == 1 and starts[0] < ends[0]:
            return starts[0], ends[0] + 1
    return None


def blocks(found: list[Event]) -> list[str]:
    """The texts of the blocks, decoded, with single spaces; empty ones are left out."""
    out, parts = [], []
    for kind, tag, payload in [*found, ("close", "p", "")]:
        if kind == "text":
            parts.append(html.unescape(payload))
        elif tag == "br":
            parts.append(" ")
        elif tag not in INLINE_REMOVED if kind == "removed" else tag in BLOCK_TAGS:
            text = " ".join("".join(parts).split())
            if text:
                out.append(text)
            parts = []
    return out


def main_text(page: str | None, weights: Weights) -> str:
    """The main text of one page."""
    if not page:
        return ""
    found = events(page)
    start, end = weights.best_run(features(found, article_run(found)))
    return "\n\n".join(blocks(found[start:end]))


def fit_weights(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Weights:
    """Weights from a bounded sample of pages(url, html) with a marked article."""
    marked = pages.where(F.length("html") <= SAMPLE_CHARS).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    marked = marked.select("html", F.xxhash64("url", "html").alias("hashed"))
    # a share by hash first, so that no task gathers each partition's first pages
    share = min(1.0, 4 * sample_pages / max(1, marked.count()))
    rows = marked.where(F.pmod("hashed", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("hashed", "html").limit(sample_pages)
    return Weights().fit([r.html for r in rows.toLocalIterator()])


def extract_text(pages: DataFrame, keep: list[str], weights: Weights) -> DataFrame:
    """``keep`` columns of pages(html, ...) with text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def make():
        def run(column):
            texts = [main_text(x, shared.value) for x in column]
            return [(t, len(t)) for t in texts]

        return run

    return map_columns(pages, ["html"], keep, RESULT, make)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract_text(spread(pages.select("page_id", "url", "html")), ["page_id", "url"], fit_weights(pages))


#: By plain patterns, which these pages allow: what stands in <article>, cut at its block tags.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(?:p|h1)>'),
      lambda s: trim(regexp_replace(regexp_replace(replace(s, '<br>', ' '), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) AS s FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(s, lambda z: z <> ''), chr(10) || chr(10)) AS x FROM b)
SELECT page_id, url, replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS text,
       CAST(length(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS BIGINT) AS n_chars
FROM t
"""
