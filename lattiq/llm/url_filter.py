"""URL filter: rules first, then gradient-boosted trees on lexical features, in DataFrame operations alone.

A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with the rule's path; of
several the longest (host and path together) wins. Urls that no rule fits get the verdict of boosted trees
on length, depth, digit ratio, entropy, parameter counts and the labelled share of the host's suffixes.
The trees are fitted on a bounded sample of labelled urls. Where no labels are given, the urls that rules settle are
the labelled ones: blocked is 1, allowed 0; urls without a rule teach nothing. A sampled url's suffix shares leave its own fold out.
The chance from which a url is blocked is the one that tells blocked from allowed best on a held-out fold.

Defined results: a null url, or one without ``://``, has an empty host and path; the host keeps its port;
an empty rule path fits all paths; with nothing to learn from, or labels of one kind only, every url without a rule is
allowed; of rules of one length the alphabetically first wins; repeated rows each get their row, and count once in the sample;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm import trees
from lattiq.llm._common import cut, table

#: (verdict, host, path).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Distinct labelled urls that the trees are fitted on at most, in the order of a hash.
SAMPLE_URLS = 6000
#: Folds of the sample: each one's suffix shares come from the others, and the last one chooses the chance to block from.
FOLDS = 5

FEATURES = ["f_length", "f_host_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_last", "f_last_two"]


def lower_ascii(x: Column) -> Column:
    """A-Z lower-cased."""
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows ``://``: up to the first of / ? #, lower-cased; and from there up to the first of ? #."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    empty = F.lit("")
    return F.coalesce(lower_ascii(host), empty), F.coalesce(F.regexp_extract(after, r"(?s)^[^?#]*", 0), empty)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    distinct = F.array_distinct(F.split(text, ""))
    each = F.filter(distinct, lambda c: c != "")
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))).otherwise(0.0)


def _lexical(df: DataFrame) -> DataFrame:
    """df(url, host, path) with the lexical features and the host's suffixes."""
    url = F.coalesce("url", F.lit(""))
    count = lambda pattern: F.length(F.regexp_replace(url, pattern, ""))
    n = F.greatest(F.length(url), F.lit(1))
    labels = F.split("host", r"\.")
    return df.withColumns(
        {
            "f_length": F.length(url).cast("double"),
            "f_host_length": F.length("host").cast("double"),
            "f_depth": F.length(F.regexp_replace("path", "[^/]", "")).cast("double"),
            "f_digits": count("[^0-9]") / n,
            "f_entropy": F.round(entropy(url), 6),
            "f_params": count("[^&=]").cast("double"),
            "f_labels": F.size(labels).cast("double"),
            "f_hyphens": count("[^-]").cast("double"),
            "s_last": F.element_at(labels, -1),
            "s_last_two": F.array_join(F.slice(F.reverse(labels), 1, 2), "."),
        }
    )


class UrlModel:
    """Boosted trees, the labelled share of each host suffix of the sample (at most two for a sampled url), and the chance to block from.

    ``held_out`` holds, for each hundredth of a chance, the (allowed, blocked) urls of the fold that the trees haven't seen.
    """

    def __init__(self, share: float = 0.0):
        self.trees: list[trees.Node] | None = None
        self.suffixes: dict[str, DataFrame] = {}
        self.share, self.block_from, self.held_out = share, 1.1, {}

    def features(self, df: DataFrame) -> DataFrame:
        """df(url, host, path) with all features. The suffix tables are bounded by the sample, hence broadcast."""
        joined = _lexical(df)
        for name, table_of in self.suffixes.items():
            joined = joined.join(F.broadcast(table_of), f"s_{name}", "left")
        return joined.withColumns({f"f_{name}": F.coalesce(f"f_{name}", F.lit(self.share)) for name in self.suffixes})

    def chance(self, df: DataFrame) -> DataFrame:
        """df(url, host, path) with the column chance of a block."""
        if self.trees is None:
            return df.withColumn("chance", F.lit(0.0))
        return self.features(df).withColumn("chance", 1.0 / (1.0 + F.exp(-trees.score(self.trees))))

    def held_out_auc(self) -> float:
        """Share of the held-out pairs of a blocked and an allowed url in which the blocked one has the higher chance; ties count half."""
        below = won = blocked = 0
        for _, (allowed, own) in sorted(self.held_out.items()):
            won += own * (below + allowed / 2)
            below, blocked = below + allowed, blocked + own
        return won / (below * blocked) if below * blocked else 0.5


def _smooth(total: Column, n: Column, share: float) -> Column:
    return F.round((total + 5 * share) / (n + 5), 6)


def _suffix_shares(rows: DataFrame, name: str, share: float) -> tuple[DataFrame, DataFrame]:
    """(suffix, f) over all rows(label, fold, suffix), and (suffix, fold, f) over the other folds: both bounded by the sample."""
    suffix, f = f"s_{name}", f"f_{name}"
    by_fold = cut(rows.groupBy(suffix, "fold").agg(F.sum("label").alias("a"), F.count("*").alias("n")))
    whole = by_fold.groupBy(suffix).agg(F.sum("a").alias("all_a"), F.sum("n").alias("all_n"))
    others = by_fold.join(whole, suffix).select(suffix, "fold", _smooth(F.col("all_a") - F.col("a"), F.col("all_n") - F.col("n"), share).alias(f))
    return cut(whole.select(suffix, _smooth(F.col("all_a"), F.col("all_n"), share).alias(f))), cut(others)


def _best_cut(held_out: dict[int, tuple[int, int]]) -> float:
    """The chance from which blocking does best on held-out urls: share of blocked caught less share of allowed lost; of equals the middle."""
    allowed, blocked = (sum(x[k] for x in held_out.values()) for k in (0, 1))
    if not allowed or not blocked:
        return 0.5
    gains = []
    for at in range(1, 101):
        above = [x for k, x in held_out.items() if k >= at]
        gains.append(sum(x[1] for x in above) / blocked - sum(x[0] for x in above) / allowed)
    best = [k for k, gain in enumerate(gains, 1) if gain > max(gains) - 1e-9]
    return best[len(best) // 2] / 100


def fit(labelled: DataFrame, sample_urls: int = SAMPLE_URLS) -> UrlModel:
    """Learn from labelled(url, label): 1 is to be blocked. Rows with a null are left out."""
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").select("url", F.col("label").cast("double").alias("label"), F.xxhash64("url").alias("hashed"))
    part = min(1.0, 4 * sample_urls / max(1, rows.count()))
    some = rows.where(F.pmod("hashed", F.lit(1 << 30)) < int(part * (1 << 30))).distinct().orderBy("hashed", "url", "label").limit(sample_urls)
    host, path = host_and_path(F.col("url"))
    fold = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS))
    sample = cut(_lexical(some.withColumns({"host": host, "path": path, "fold": fold})))
    low, high, share = sample.agg(F.min("label"), F.max("label"), F.avg("label")).first()
    if low is None or low == high:
        return UrlModel(share or 0.0)
    model = UrlModel(share)
    crossed = sample
    for name in ("last", "last_two"):
        model.suffixes[name], others = _suffix_shares(sample, name, share)
        crossed = crossed.join(F.broadcast(others), [f"s_{name}", "fold"], "left")
    full = cut(crossed.select("label", "fold", *[F.coalesce(f, F.lit(share)).alias(f) for f in FEATURES]))
    taught = trees.boosted(full.where(F.col("fold") < FOLDS - 1), FEATURES)
    chance = F.floor(100.0 / (1.0 + F.exp(-trees.score(taught)))).cast("int")
    tested = full.where(F.col("fold") == FOLDS - 1).groupBy(chance.alias("at")).agg(F.count_if(F.col("label") == 0).alias("allowed"), F.count_if(F.col("label") == 1).alias("blocked"))
    model.trees, model.held_out = taught, {r["at"]: (r.allowed, r.blocked) for r in tested.collect()}
    model.block_from = _best_cut(model.held_out)
    return model


def judge_urls(
    pages: DataFrame,
    keep: list[str],
    rules: list[tuple[str, str, str]] = RULES,
    labelled: DataFrame | None = None,
    block_from: float | None = None,
) -> DataFrame:
    """``keep`` columns of pages(url, ...) with host, path, rule, verdict and the model's chance of a block; ``block_from`` stands for the chosen chance."""
    own = pages.select(F.struct(*keep).alias("__kept"), F.col("url"))
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = own.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        labelled = own.where("ruled IS NOT NULL").select("url", (F.col("ruled") == "block").cast("int").alias("label"))
    model = fit(labelled)
    least = model.block_from if block_from is None else block_from
    decided = F.coalesce("ruled", F.when(F.col("chance") >= least, "block").otherwise("allow"))
    return model.chance(own).select("__kept.*", "host", "path", "rule", decided.alias("verdict"), "chance")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), ["page_id"])
