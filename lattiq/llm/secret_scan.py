"""Secret scan: patterns find candidates, a random forest removes false positives; DataFrame operations alone.

Candidates are tokens of known formats, values assigned to names with a part such as token or password, bearer
tokens, and passwords in urls. The forest
looks at a candidate's length, transitions between character classes, coverage by dictionary words, share of vowels, digits
and entropy, at marks of code, ids and paths in it and next to it, and at the words before it. The dictionary is the corpus's own: words
of at least ``MIN_DOCUMENTS`` documents, counted over all of them. The forest is fitted on labelled
findings; without any given, on a fixed set generated by rule: random tokens and assigned random values
are secrets; placeholders, words, repeated and counting characters, expressions and names of code, paths, types, dates,
versions, ids and hashes in paths are not.

Defined results: null and empty texts have no findings; every occurrence is a finding, so repeated rows repeat
them; U+0001 in a text counts as a space; whole texts are scanned; offsets count code points
from 0; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.llm import trees
from lattiq.llm._common import cut, table
from lattiq.llm.url_filter import entropy

# Public token formats, names that secrets are assigned to, and words of placeholders.
# What precedes a value in the formats with free values. A name is a run of letters, digits, _ and -, in which one of the words
# ends a part (snake, kebab or camel case); the lookahead and the possessive run keep this linear in the run's length.
_SCHEME = r"(?:(?:bearer|basic)[ \t]+)?"
_NAME = (
    r"(?<![a-z0-9_-])(?=[a-z0-9_-]*?(?:token|secret|passwd|password|passphrase|pwd|authorization|credential|(?:api|access|auth|private|secret|signing|encryption|account)[_-]?key)"
    r"s?(?-i:(?![a-z])))[a-z0-9_-]++"
)
HEADS = {
    "assigned": rf"(?i:{_NAME}[\"']?[ \t]{{0,4}}[:=][ \t]{{0,4}}[\"']?{_SCHEME})",
    "bearer": r"(?i:\bbearer[ \t]+)",
    "url_password": r"(?i:\b[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"'<>]*:)",
}
FORMATS = {
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\b(?:gh[pousr]_[A-Za-z0-9]{36}\b|github_pat_[A-Za-z0-9_]{22,})",
    "gitlab_token": r"\bglpat-[A-Za-z0-9_-]{20,}",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe_key": r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "sk_key": r"\bsk-[A-Za-z0-9_-]{20,}",
    "npm_token": r"\bnpm_[A-Za-z0-9]{36}\b",
    "hf_token": r"\bhf_[A-Za-z0-9]{30,}",
    "sendgrid_key": r"\bSG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    "google_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----",
    "assigned": HEADS["assigned"] + r"[^\s\"',;<>]{6,}",
    "bearer": HEADS["bearer"] + r"[A-Za-z0-9._~+/=-]{16,}",
    "url_password": HEADS["url_password"] + r"[^\s/@\"'<>]{3,}(?=@)",
}
DICTIONARY = (
    "password|passwd|changeme|example|sample|secret|token|dummy|placeholder|default|admin|root|user|test|your|here|insert|"
    "enter|none|null|true|false|string|value|public|private|access|config|letmein|welcome|qwerty|master|demo|fake|todo|key|api"
)
NAMES = r"(?i)(?:token|secret|passw|passphrase|pwd|key|credential|auth|bearer|://[^\s/]*:$)"
CALM = r"(?i)(?:example|sample|dummy|placeholder|commit|sha1|sha256|checksum|digest|uuid|revision|e\.g|docs?)"

#: Documents that hold a word of the dictionary, at least; lengths of its words.
MIN_DOCUMENTS, WORD_LENGTHS = 5, (3, 24)
#: Frequent words of the dictionary that generated findings are made of, at most.
SAMPLE_WORDS = 500
#: Characters kept on either side of a candidate.
CONTEXT = 48
#: Share of the forest from which a candidate is a secret.
SECRET_FROM = 0.5
FEATURES = ["f_length", "f_transitions", "f_words", "f_vowels", "f_lower", "f_digits", "f_entropy", "f_distinct", "f_code", "f_id", "f_path", "f_named", "f_calm", "f_format"]
_ANY = "|".join(FORMATS.values())
_MARK = "\u0001"


def find_candidates(documents: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of documents(text, ...) with start, kind, value, before and after of each candidate."""
    text = F.translate("text", _MARK, " ")
    hints = ["AKIA", "ASIA", "gh", "github_pat_", "glpat-", "xox", "k_live_", "k_test_", "sk-", "npm_", "hf_", "SG.", "AIza", "eyJ", "-----BEGIN", "=", ":"]
    hinted = F.lit(False)
    for hint in hints:
        hinted = hinted | F.contains(F.col("text"), F.lit(hint))
    hinted = hinted | F.contains(F.lower("text"), F.lit("bearer"))
    rows = documents.where(hinted).select(F.struct(*keep).alias("__kept"), text.alias("text")).where(F.col("text").rlike(_ANY))
    parts = F.split(F.regexp_replace("text", f"({_ANY})", f"{_MARK}$1{_MARK}"), _MARK, -1)
    cut_up = rows.select("__kept", parts.alias("parts"))
    # odd places hold the matches; what precedes them gives the offset
    found = cut_up.select("__kept", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1, F.lit(2))).alias("k"))
    match, before = F.element_at("parts", F.col("k") + 1), F.element_at("parts", F.col("k"))
    after = F.element_at("parts", F.col("k") + 2)
    ahead = F.aggregate(F.slice("parts", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    kind = F.lit("assigned")
    for name, pattern in FORMATS.items():
        if name not in HEADS:
            kind = F.when(F.col("match").rlike(f"^(?:{pattern})$"), name).otherwise(kind)
        elif name != "assigned":
            kind = F.when(F.col("match").rlike("^" + HEADS[name]), name).otherwise(kind)
    head = F.lit("")
    for name, pattern in HEADS.items():
        head = F.when(F.col("kind") == name, F.regexp_extract("match", "^" + pattern, 0)).otherwise(head)
    spread = found.select(
        "__kept", match.alias("match"), ahead.alias("ahead"), F.right(before, F.lit(CONTEXT)).alias("left"), F.left(after, F.lit(CONTEXT)).alias("after")
    ).withColumn("kind", kind).withColumn("head", head)
    name_length = F.length("head")
    return spread.select(
        "__kept.*",
        (F.col("ahead") + name_length).alias("start"),
        "kind",
        F.substring("match", name_length + 1, F.length("match")).alias("value"),
        F.concat("left", "head").alias("before"),
        "after",
    )


def corpus_words(documents: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """(word, n): a-z words of documents(text), and how many documents hold them, from ``least`` on."""
    bare = F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")
    words = documents.select(F.explode(F.array_distinct(bare)).alias("word")).where(F.length("word").between(*WORD_LENGTHS))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _runs(value: Column) -> Column:
    """The words of a value, as snake, kebab and camel case part them, lower-cased."""
    return F.transform(F.regexp_extract_all(value, F.lit("[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), F.lit(0)), lambda w: F.lower(w))


def with_coverage(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """found(value, ...), which is written already, with ``covered``: characters of the value in words of dictionary(word).

    Placeholder words count wherever they stand. Only the words that values hold are looked up, each once.
    """
    numbered = found.withColumn("__n", F.monotonically_increasing_id())
    each = cut(numbered.select("__n", F.explode(_runs(F.col("value"))).alias("word")))
    known = dictionary.select("word").join(each.select("word").distinct(), "word", "left_semi")
    sums = each.join(known, "word").groupBy("__n").agg(F.sum(F.length("word")).alias("__words"))
    placed = F.length("value") - F.length(F.regexp_replace("value", f"(?i)(?:{DICTIONARY})", ""))
    joined = numbered.join(sums, "__n", "left").withColumn("covered", F.greatest(placed.cast("long"), F.coalesce("__words", F.lit(0))))
    return joined.drop("__n", "__words")


def _features(value: Column, before: Column, after: Column, kind: Column, covered: Column) -> dict[str, Column]:
    n = F.greatest(F.length(value), F.lit(1))
    steady = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[a-z]", "1"), "[A-Z]", "2"), r"(.)\1+", "$1")
    letters = F.regexp_replace(value, "[^A-Za-z]", "")
    only = lambda pattern: F.length(F.regexp_replace(value, pattern, ""))
    uuid = r"^\{?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    number = r"^v?\d{1,4}([.:T/-]\d{1,4})+"
    code = r"[(\[{)\]}]|^[A-Za-z_]\w*(\.|::|->)[A-Za-z_]\w*"
    return {
        "f_length": F.length(value).cast("double"),
        "f_transitions": (F.length(steady) - 1) / n,
        "f_words": covered / n,
        "f_vowels": F.length(F.regexp_replace(letters, "(?i)[^aeiou]", "")) / F.greatest(F.length(letters), F.lit(1)),
        "f_lower": only("[^a-z]") / n,
        "f_digits": only("[^0-9]") / n,
        "f_entropy": F.round(entropy(value), 6),
        "f_distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "f_code": (value.rlike(code) | after.rlike(r"^[(\[]")).cast("double"),
        "f_id": (value.rlike(uuid) | value.rlike(number)).cast("double"),
        "f_path": (before.rlike(r"[/\\]$") | after.rlike(r"^[/\\]") | value.rlike(r"[/\\].*[/\\]|^[a-z]+/[a-z]|^~?[/\\]|\$\{|\{\{|^<|\.\.\.")).cast("double"),
        "f_named": before.rlike(NAMES).cast("double"),
        "f_calm": (before.rlike(CALM) | value.rlike(CALM)).cast("double"),
        "f_format": (~kind.isin(*HEADS)).cast("double"),
    }


def generated_findings(spark: SparkSession, n: int = 3400, first: int = 0, words: list[str] | None = None) -> DataFrame:
    """(value, before, after, kind, label): n labelled findings by rule, the same on every run; other numbers than ``first``'s give others.

    words are of the dictionary; they and made-up ones of syllables stand in the values that are no secrets.
    """
    draw = lambda k, m: F.pmod(F.xxhash64("h", F.lit(k)), F.lit(m)).cast("int")
    pick = lambda k, options: F.element_at(F.array(*map(F.lit, options)), draw(k, len(options)) + 1)
    placeholders = DICTIONARY.split("|")
    listed = list(words or [])[:SAMPLE_WORDS] or placeholders
    heads, vowels, tails = list("bcdfglmnprstvw") + ["st", "tr", "ch"], list("aeiou") + ["ea", "ai"], ["", "", "n", "r", "l"]

    def any_word(k: str) -> Column:
        made = F.concat(*[pick(f"{k}{j}{part}", options) for j in range(3) for part, options in enumerate((heads, vowels, tails))])
        known = F.element_at(F.split(F.lit("|".join(listed)), r"\|"), draw(f"{k} known", len(listed)) + 1)
        return F.when(draw(f"{k} which", 2) == 0, known).otherwise(made)

    rows = spark.range(first, first + n, numPartitions=1).withColumn("h", F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 256))
    drawn = {
        "name": pick("name", ["token = \"", "password=", "api_key: ", "secret = '", "access_key=", "aws_secret_access_key = ", "clientSecret: \"", "auth_token="]),
        "plain": pick("plain", ["password = ", "token=", "secret: ", "api_key = ", "authToken = ", "credential: "]),
        "end": pick("end", ["\" and", "", " then", "' in", "\n"]),
        "sign": pick("sign", list("!$%&*-_")),
        "number": draw("number", 24),
        "upper": F.upper(F.translate("h", "012345678", "GHJKMNPQR")),
        "mixed": F.translate(F.base64(F.unhex("h")), "+/=", "xYz"),
        "word": pick("word", placeholders),
        "other": pick("other", placeholders),
        "a": any_word("a"),
        "b": any_word("b"),
        "c": any_word("c"),
    }
    # written, so that each draw is worked out once
    rows = cut(rows.withColumns(drawn))
    name, plain, end, sign, number, upper, mixed, word, other, a, b, c = map(F.col, drawn)
    hexes, cap = F.col("h"), F.initcap
    uuid = F.concat_ws("-", F.left("h", F.lit(8)), *[F.substring("h", at, 4) for at in (9, 13, 17)], F.substring("h", 21, 12))
    kinds = [
        # (value, before, after, kind, label)
        (F.concat(F.lit("AKIA"), F.left(upper, F.lit(16))), "the key ", " of", "aws_key", 1),
        (F.left(hexes, number + 12), name, end, "assigned", 1),
        (F.left(mixed, number + 12), name, end, "assigned", 1),
        (F.concat(F.lit("ghp_"), F.left(mixed, F.lit(36))), "use ", " in", "github_token", 1),
        (F.left(hexes, F.lit(40)), name, end, "assigned", 1),
        (F.concat(pick("format", ["sk_live_", "rk_live_"]), F.left(mixed, F.lit(24))), "", "", "stripe_key", 1),
        (F.concat(F.lit("glpat-"), F.left(mixed, F.lit(20))), "with ", " in", "gitlab_token", 1),
        (F.left(mixed, number + 18), "Authorization: Bearer ", end, "bearer", 1),
        (F.left(mixed, number % 12 + 8), "postgres://admin:", "@host", "url_password", 1),
        (F.concat(F.left(mixed, number % 8 + 7), sign, F.right(mixed, F.lit(5))), name, end, "assigned", 1),
        (F.concat(F.left(upper, number % 10 + 12)), name, end, "assigned", 1),
        (F.concat(cap(a), F.left(mixed, F.lit(3)), sign, F.substring("h", 1, 5)), name, end, "assigned", 1),
        (F.concat(F.lit("AKIA"), F.left(upper, F.lit(9)), F.lit("EXAMPLE")), "for example ", " of", "aws_key", 0),
        (F.concat(word, other), name, end, "assigned", 0),
        (F.concat(word, F.lit("-"), other, F.lit("-here")), name, end, "assigned", 0),
        (F.repeat(pick("one", list("x0*a1")), number + 6), name, end, "assigned", 0),
        (F.concat(F.lit("${"), F.upper(word), F.lit("_"), F.upper(other), F.lit("}")), name, end, "assigned", 0),
        (F.left(F.lit("1234567890123456789012345678"), number + 6), name, end, "assigned", 0),
        (F.concat(F.lit("/objects/"), F.left(hexes, F.lit(2)), F.lit("/"), F.left(hexes, F.lit(30))), "commit token=", "/raw", "assigned", 0),
        (F.concat(a, b), plain, end, "assigned", 0),
        (c, plain, end, "assigned", 0),
        (F.concat(a, F.lit("."), c, F.lit("()")), plain, "", "assigned", 0),
        (F.concat(a, pick("dot", [".", "::", "->"]), b, pick("open", ["[", "(", "", ""])), plain, "", "assigned", 0),
        (F.concat_ws("_", a, b, word), plain, end, "assigned", 0),
        (F.concat(c, cap(a), cap(word)), plain, end, "assigned", 0),
        (F.concat(b, F.lit("("), c, F.lit(")")), plain, "", "assigned", 0),
        (uuid, name, end, "assigned", 0),
        (F.concat(a, F.lit("/"), c), name, end, "assigned", 0),
        (F.concat(F.lit("/"), b, F.lit("/"), c, F.lit(".pem")), name, end, "assigned", 0),
        (F.concat(F.lit("v"), draw("v1", 20), F.lit("."), draw("v2", 30), F.lit("."), draw("v3", 90)), plain, end, "assigned", 0),
        (F.concat(F.lit("20"), draw("y", 80) + 10, F.lit("-"), draw("mo", 3) + 10, F.lit("-"), draw("da", 18) + 10, F.lit("T00:00")), plain, end, "assigned", 0),
        (F.concat_ws("-", a, b, c), plain, end, "assigned", 0),
        (F.concat(F.lit("<"), word, F.lit("-"), other), name, ">", "assigned", 0),
        (c, "postgres://user:", "@localhost", "url_password", 0),
    ]
    case = F.pmod(F.col("id"), F.lit(len(kinds)))
    columns = {}
    for place, column in enumerate(("value", "before", "after", "kind", "label")):
        chosen = None
        for k, row in enumerate(kinds):
            own = row[place] if isinstance(row[place], Column) else F.lit(row[place])
            chosen = F.when(case == k, own) if chosen is None else chosen.when(case == k, own)
        columns[column] = chosen
    return rows.select(*[c.alias(k) for k, c in columns.items()])


def fit(labelled: DataFrame, dictionary: DataFrame) -> list[trees.Node]:
    """The forest for labelled(value, before, after, kind, label); the caller bounds the rows. Nulls are left out."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = cut(labelled.where("value IS NOT NULL AND label IS NOT NULL").select("value", text("before"), text("after"), "kind", "label"))
    shaped = with_coverage(rows, dictionary).select(
        F.xxhash64("value", "before", "after").alias("row"),
        "label",
        *[c.alias(k) for k, c in _features(F.col("value"), F.col("before"), F.col("after"), F.col("kind"), F.col("covered")).items()],
    )
    return trees.forest(cut(shaped), FEATURES, depth=6)


def scan_secrets(documents: DataFrame, keep: list[str], labelled: DataFrame | None = None, secret_from: float = SECRET_FROM, dictionary: DataFrame | None = None) -> DataFrame:
    """``keep`` columns of documents(text, ...) with start, kind, value, score and is_secret of each candidate.

    dictionary(word, n) stands for the corpus's own words.
    """
    words = cut(corpus_words(documents)) if dictionary is None else dictionary
    if labelled is None:
        frequent = words.where(F.length("word") > 4).orderBy(F.desc("n"), "word").limit(SAMPLE_WORDS).select("word")
        labelled = generated_findings(documents.sparkSession, words=[r.word for r in frequent.collect()])
    grown = fit(labelled, words)
    # the values alone go through the dictionary's joins, not the documents' other columns
    found = with_coverage(cut(find_candidates(documents, keep)), words)
    shaped = found.withColumns(_features(F.col("value"), F.col("before"), F.col("after"), F.col("kind"), F.col("covered")))
    score = F.round(trees.score(grown) / len(grown), 6)
    return shaped.select(*keep, "start", "kind", "value", score.alias("score"), (score >= secret_from).alias("is_secret"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in every document; the value as its length and hash."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select(
        "doc_id", "start", "kind", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"), "score", "is_secret"
    )
