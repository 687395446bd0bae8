"""Which outcomes of the picked market answer a leg.

What holds for a leg's outcomes together is one aggregate, joined back to them; then one choice among the rules in their
order. The pool is returned whole; the choice is only a flag in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lattiq.functions import offering, text
from lattiq.operators.subject import holds, typed_side


def nearest_line(line: Column, wanted: Column, keys: list[str], order: list[str]) -> Column:
    """Place by an exactly equal line first, then by distance; outcomes without a line come last."""
    own = Window.partitionBy(*keys).orderBy(
        F.when(line.isNull(), 2).when(line == wanted, 0).otherwise(1), F.abs(line - wanted).asc_nulls_last(), *[F.col(c) for c in order]
    )
    return F.row_number().over(own)


def by_price(odds: Column, sort: Column, keys: list[str], order: list[str]) -> Column:
    """Place by price: low or high first, prices that are missing last either way; without a sort by order."""
    key = F.when(sort == "low", odds).when(sort == "high", -odds)
    own = Window.partitionBy(*keys).orderBy(F.when(key.isNull() & sort.isNotNull(), 1).otherwise(0), key.asc_nulls_last(), *[F.col(c) for c in order])
    return F.row_number().over(own)


def home_lines(own: WindowSpec | None = None) -> Column:
    """Whether the two sides of an offer have one line, which is then the home side's: an aggregate over its outcomes (kind, line), or over a window of them."""
    sided = F.when(F.col("kind").isin("OT_ONE", "OT_TWO"), F.col("line"))
    n, low, high = (c if own is None else c.over(own) for c in (F.count(sided), F.min(sided), F.max(sided)))
    return F.coalesce((n >= 2) & (low == high), F.lit(False))


def within_odds(odds: Column, low: Column, high: Column) -> Column:
    """Whether a price lies in the bounds; a missing price or bound keeps it."""
    price = offering.decimal(odds)
    return price.isNull() | (F.coalesce(price >= low, F.lit(True)) & F.coalesce(price <= high, F.lit(True)))


#: What wishes() adds to legs.
_WISHES = ["__want", "__home_want", "__away_want", "__reversed", "__label_want", "__number", "__folded"]


def wishes(legs: DataFrame) -> DataFrame:
    """Legs with the texts that their outcomes are compared to, worked out once a leg if select_outcomes() is given outcomes that were joined to them."""
    want = text.combo(F.col("line_value"))
    return legs.withColumns(
        {
            "__want": want,
            "__home_want": text.result_tokens(F.col("line_value"), F.lit("home")),
            "__away_want": text.result_tokens(F.col("line_value"), F.lit("away")),
            "__reversed": text.reverse_score(want),
            "__label_want": text.combo(F.col("outcome_wanted")),
            "__number": text.to_number(F.col("line_value")),
            "__folded": text.fold(F.coalesce("subject", F.lit(""))),
        }
    )


def _facts(outcomes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Outcomes with what each says by itself of its leg's wishes, however the leg's other outcomes look.

    Each text is made in one place and named by a column, and the window over an offer's lines stands between those of the outcome alone and the rest: the code of
    a stage that holds all of them, or repeats one, is too long for the JVM to compile.
    """
    sure = lambda c: F.coalesce(c, F.lit(False))
    outcomes = outcomes.withColumns(
        {
            "__dir": offering.direction(F.col("kind"), F.col("english_label"), F.col("outcome_label")),
            "__shown": text.combo(F.coalesce("english_label", "outcome_label", F.lit(""))),
            "__named": sure(offering.is_named(F.col("participant"), F.col("english_label"), F.col("outcome_label"))),
        }
    ).withColumn("__same", home_lines(Window.partitionBy(*keys, "offer_id")))
    subject = F.col("subject")
    side, by_id = subject.isin("home", "away"), sure(F.col("participant_id") == F.col("subject_id"))
    team = F.when(subject == "home", F.col("home_name")).when(subject == "away", F.col("away_name"))
    texts = outcomes.withColumns(
        {
            "__sided": F.when(F.col("subject_on") == "home", F.col("__home_want")).when(F.col("subject_on") == "away", F.col("__away_want")),
            "__turned_want": F.when(F.col("subject_on") == "away", F.col("__reversed")),
            "__score": F.concat(F.col("home_score"), F.lit("-"), F.col("away_score")),
            "__line": offering.decimal(F.col("line")),
            "__name": F.when(side, text.fold(F.coalesce(team, F.lit("")))).otherwise(F.col("__folded")),
        }
    )
    # only a subject without an id is looked for by name
    texts = texts.withColumn("__held", sure(F.when(F.col("subject_id").isNull() & (subject != ""), holds(F.col("participant"), F.col("__name")))))
    is_wanted = lambda x: sure(x == F.col("__want")) | sure(x == F.col("__sided")) | sure(x == F.col("__turned_want"))
    on = typed_side(subject, F.col("kind"), F.col("english_label"), F.col("outcome_label")) | ((F.col("__name") != "") & F.col("__named") & F.col("__held"))
    mine = F.when(F.col("subject_id").isNotNull(), by_id).when(side, on).when(subject != "", F.col("__held")).otherwise(True)
    return texts.withColumns(
        {
            "__place": F.struct(*order),
            "__token": is_wanted(F.col("__score")) | is_wanted(F.col("__shown")),
            "__label": sure(F.col("__shown") == F.col("__label_want")),
            "__id": by_id,
            "__mine": sure(mine),
            "__within": within_odds(F.col("odds"), F.col("odds_min"), F.col("odds_max")),
            "__turned": F.when(sure((F.col("kind") == "OT_TWO") | (F.coalesce("english_label", "outcome_label") == "2")), -F.col("__line")).otherwise(F.col("__line")),
            "__price": F.when(F.col("odds_sort") == "low", F.col("odds")).when(F.col("odds_sort") == "high", -F.col("odds")),
        }
    )


#: The pools that a leg may turn out to have: the outcomes that are its subject's, or all.
_POOLS = ("mine", "all")
#: What a leg's rule depends on besides its outcomes.
_ASKS = ["line_value", "subject", "subject_id", "direction", "pick_n", "__number"]


def _summary(facts: DataFrame, keys: list[str]) -> DataFrame:
    """One row a leg: its wishes, what holds for any of its outcomes, and the first place of each kind, in either pool.

    Sums, maxima and minima alone, so that most of it happens before rows move and no task holds a leg of very many outcomes. Only the outcomes of
    an offer meet before that, because its two sides may share the home side's line, which settles how its lines count.
    """
    place, yes = F.col("__place"), F.coalesce(F.col("__dir") == "yes", F.lit(False))
    has = lambda c: F.max(F.coalesce(c, F.lit(False)))
    first = lambda flag, what=place: F.min(F.when(flag, what))
    told = {
        "leg": F.first(F.struct(*_ASKS)),
        "type": first(F.col("offer_type").isNotNull(), F.struct(place.alias("place"), "offer_type")),
        "n_id": F.sum(F.col("__id").cast("long")),
        "says_yes": has(yes),
        "named": has(F.col("__named")),
        "token": first(F.col("__token")),
        "label": first(F.col("__label")),
        "bare": has(F.col("__id") & F.col("__dir").isNull()),
    }
    line = F.when(F.col("__same"), F.col("__turned")).otherwise(F.col("__line"))
    for name in _POOLS:
        own = F.col("__mine") if name == "mine" else F.lit(True)
        pool = own & F.col("__within")
        told |= {
            f"{name}_any": has(own),
            f"{name}_first": first(pool),
            f"{name}_yes": first(pool & yes),
            f"{name}_asked": first(pool & (F.col("__dir") == F.col("direction"))),
            f"{name}_turns": has(pool & F.col("__dir").isNotNull()),
            f"{name}_price": first(pool, F.struct(F.col("__price").isNull().alias("none"), F.col("__price").alias("price"), place.alias("place"))),
            f"{name}_near": first(pool & line.isNotNull(), F.struct(F.abs(line - F.col("__number")).alias("far"), place.alias("place"), line.alias("line"))),
        }
    return facts.groupBy(*keys).agg(*[c.alias(f"s_{n}") for n, c in told.items()])


def _decided(summary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, __which, __taken, __near, __few) of a leg: its rule and pool, the place that it takes, its nearest line, and whether only a few of a field are asked for."""
    s = lambda name: F.col(f"s_{name}")
    asks = lambda name: F.col("s_leg")[name]
    sure = lambda c: F.coalesce(c, F.lit(False))
    line_value, subject, subject_id, direction = (asks(c) for c in ("line_value", "subject", "subject_id", "direction"))
    which = (
        F.when(subject_id.isNotNull(), F.when(s("n_id") > 0, "mine").when(s("says_yes"), "all"))
        .when(subject.isin("home", "away"), "mine")
        .when(subject != "", F.when(s("named"), "mine").otherwise("all"))
        .otherwise("all")
    )
    combo = offering.offer_type_names(s("type")["offer_type"]) & line_value.isNotNull()
    legs = summary.withColumns({"__which": which, "__combo": combo})
    of_pool = lambda name: F.when(F.col("__which") == "mine", s(f"mine_{name}")).when(F.col("__which") == "all", s(f"all_{name}"))
    legs = legs.withColumns({"__low": of_pool("price"), **{f"__{name}": of_pool(name) for name in ("any", "first", "yes", "asked", "turns", "near")}})
    asked, turned_to = ~F.col("__combo") & line_value.isNotNull(), direction.isNotNull()
    alone = (s("n_id") == 1) & line_value.isNull() & (direction.isNull() | (direction == "yes"))
    rule = (
        F.when(F.col("__combo"), F.when(s("token").isNotNull(), "token").otherwise("subject-absent"))
        .when(s("label").isNotNull(), "label")
        .when(subject_id.isNotNull() & alone & s("bare"), "outright")
        .when(~sure(F.col("__any")), "subject-absent")
        .when(F.col("__first").isNull(), "odds-absent")
        .when(asked, F.when(asks("__number").isNotNull() & F.col("__near").isNotNull(), "line").otherwise("line-absent"))
        .when(turned_to & F.col("__asked").isNotNull(), "direction")
        .when(turned_to & ~F.col("__turns") & (direction != "no"), "field")
        .when(turned_to, "subject-absent")
        .otherwise("plain")
    )
    # a leg follows one rule, so one place is all that it takes
    legs = legs.withColumn("rule", rule)
    is_rule = lambda *names: F.col("rule").isin(*names)
    taken = (
        F.when(is_rule("token"), s("token"))
        .when(is_rule("label"), s("label"))
        .when(is_rule("line"), F.col("__near")["place"])
        .when(is_rule("direction"), F.col("__asked"))
        .when(is_rule("field"), F.col("__low")["place"])
        .when(is_rule("plain"), F.when(~s("named"), F.coalesce("__yes", "__first")).otherwise(F.col("__first")))
    )
    few = asks("pick_n").isNotNull() & turned_to & is_rule("field")
    return legs.select(*keys, "rule", "__which", taken.alias("__taken"), F.col("__near")["line"].alias("__near_line"), few.alias("__few"))


def select_outcomes(outcomes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The funnel for many legs at once.

    Outcome columns: offer_id, offer_type, outcome_id, kind, english_label, outcome_label, participant, participant_id, odds, line, home_score,
    away_score, home_name, away_name (of the outcome's event). Leg columns: line_value (text), outcome_wanted, subject, subject_id, subject_on
    (home, away or null: the subject's side), odds_min, odds_max, direction, odds_sort, pick_n; all but subject_on are the same for all of a leg's outcomes, and
    may come with those of wishes(), which saves working them out for each outcome. ``order`` columns settle ties and tell a leg's outcomes apart; keys aren't null.

    Adds rule, in_pool, is_selected, chosen_line and fallback (subject-absent, odds-absent, line-absent or null).
    """
    names = [c for c in outcomes.columns if c not in _WISHES]
    facts = _facts(outcomes if "__want" in outcomes.columns else wishes(outcomes), keys, order)
    decided = _decided(_summary(facts, keys), keys)
    sure = lambda c: F.coalesce(c, F.lit(False))
    is_rule = lambda *rules: F.col("rule").isin(*rules)
    rows = facts.select(*names, "__place", "__id", "__mine", "__within", "__line").join(decided, keys)
    pool = sure(F.when(F.col("__which") == "mine", F.col("__mine")).when(F.col("__which") == "all", True)) & F.col("__within")
    rows = rows.withColumn("__pool", pool)
    sided = is_rule("plain") & sure(F.col("subject").isin("home", "away"))
    selected = F.when(is_rule("outright"), F.col("__id")).when(sided, F.col("__pool")).otherwise(sure(F.col("__place") == F.col("__taken")))
    pooled = F.when(is_rule("token", "label", "outright"), F.col("is_selected")).otherwise(is_rule("line", "direction", "plain", "field") & F.col("__pool"))
    line = F.when(is_rule("line"), F.col("__near_line")).otherwise(F.col("__line"))
    rows = rows.withColumn("is_selected", selected).withColumns(
        {"in_pool": pooled, "chosen_line": F.when(F.col("is_selected"), line), "fallback": F.when(F.col("rule").endswith("-absent"), F.col("rule"))}
    )
    # only the first few of a field are a matter of order; legs that don't ask for them have no window
    # (the flag and the pool as one value: apart, the flag would be looked for in the legs' side alone, which would then be worked out twice)
    few = F.col("pick_n").isNotNull() & F.col("direction").isNotNull() & F.least("__few", "__pool")
    place = by_price(F.col("odds"), F.col("odds_sort"), keys, order)
    cut = rows.where(few).withColumn("in_pool", place <= F.col("pick_n"))
    found = rows.where(~few).unionByName(cut)
    return found.select(*names, "rule", "in_pool", "is_selected", "chosen_line", "fallback")


def trim_field(outcomes: DataFrame, keys: list[str], order: list[str], cap: int = 8) -> DataFrame:
    """Outcomes of a suggested market for display.

    With named outcomes and a subject: the subject's, or nothing. A market with lines: whole. Else the ``cap`` shortest prices.
    Columns as in select_outcomes().
    """
    own = Window.partitionBy(*keys)
    some = lambda c: F.max(F.coalesce(c, F.lit(False)).cast("int")).over(own) == 1
    named = offering.is_named(F.col("participant"), F.col("english_label"), F.col("outcome_label"))
    subject = F.col("subject_id").isNotNull() | F.coalesce((F.col("subject") != ""), F.lit(False))
    mine = F.when(F.col("subject_id").isNotNull(), F.coalesce(F.col("participant_id") == F.col("subject_id"), F.lit(False))).when(
        F.col("subject").isin("home", "away"), True
    ).otherwise(holds(F.col("participant"), text.fold(F.coalesce("subject", F.lit("")))))
    price = F.row_number().over(own.orderBy(F.col("odds").asc_nulls_last(), *[F.col(c) for c in order]))
    kept = F.when(some(named) & subject, mine).when(some(F.col("line").isNotNull()), True).otherwise(F.col("__price") <= cap)
    return outcomes.withColumn("__price", price).withColumn("__kept", kept).where("__kept").drop("__price", "__kept")
