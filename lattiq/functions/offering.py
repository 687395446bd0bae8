"""Columns of the offering: labels, levels, prices, directions, and the shapes of the answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattiq.functions import text

# Outcome types with a direction, participant types, locales by language, and order of English locales.
DIRECTIONS = {"OT_OVER": "over", "OT_OVER_EXACT": "over", "OT_UNDER": "under", "OT_YES": "yes", "OT_NO": "no"}
PARTICIPANT_TYPES = ["TEAM", "PARTICIPANT", "UNKNOWN"]
LOCALES = {"english": "en_GB", "swedish": "sv_SE"}
DEFAULT_LOCALE = "en_GB"
ENGLISH_LOCALES = ["en_GB", "en_US", "en_TK", "en_GU"]
#: Offers that one answer of the offering holds at most.
ANSWER_CAP = 2000


def market_label(english: Column, label: Column, description: Column) -> Column:
    """What identifies a market: its English label, and its variant behind a dash."""
    variant = F.trim(F.coalesce(description, F.lit("")))
    name = F.coalesce(english, label, F.lit("?"))
    return F.when(variant != "", F.concat(name, F.lit(" — "), variant)).otherwise(name)


def event_level(tags: Column) -> Column:
    """competition, fixture or null; a competition tag wins."""
    has = lambda t: F.coalesce(F.array_contains(tags, t), F.lit(False))
    return F.when(has("COMPETITION"), "competition").when(has("MATCH"), "fixture")


def is_main(tags: Column) -> Column:
    """Whether an offer has the tag MAIN itself."""
    return F.coalesce(F.array_contains(tags, "MAIN"), F.lit(False))


def decimal(millis: Column) -> Column:
    """Thousandths as a number; null stays null."""
    return millis / F.lit(1000.0)


def direction(kind: Column, english: Column, label: Column) -> Column:
    """over, under, yes or no: by the outcome's type, else, if that says nothing, by its exact English label."""
    out = None
    for name, value in DIRECTIONS.items():
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    named = F.lower(F.coalesce(english, label, F.lit("")))
    silent = kind.isNull() | kind.isin("", "OT_UNTYPED")
    return out.when(silent & named.isin("over", "under", "yes", "no"), named)


def live_state(state: Column) -> Column:
    """LIVE, FINISHED or PREMATCH."""
    return F.when(state == "STARTED", "LIVE").when(state == "FINISHED", "FINISHED").otherwise("PREMATCH")


def is_named(participant: Column, english: Column, label: Column) -> Column:
    """Whether an outcome carries a real participant: not a yes or no, nor its own label."""
    p = F.coalesce(participant, F.lit(""))
    return (p != "") & ~p.eqNullSafe(F.coalesce(english, label)) & ~p.isin("Yes", "No")


def is_meaningful(kind: Column, participant: Column, english: Column, label: Column) -> Column:
    """Whether an outcome's label tells more than a direction, a participant or a bare value."""
    shown = F.trim(F.coalesce(english, label, F.lit("")))
    who = F.trim(F.coalesce(participant, F.lit("")))
    typed = F.coalesce(kind.isin("OT_YES", "OT_NO", "OT_OVER", "OT_UNDER", "OT_ONE", "OT_TWO", "OT_CROSS"), F.lit(False))
    pure = F.lower(F.trim(F.coalesce(english, F.lit("")))).isin(text.DIRECTION_LABELS)
    echo = (who != "") & ~who.isin("Yes", "No") & (who == shown) & ~text.is_stage_label(shown)
    return (shown != "") & ~typed & ~pure & ~echo & ~text.is_bare_value(shown)


def participant_row(p: Column) -> Column:
    """The answer's participant: defaults for missing fields."""
    kind = F.when(p["participantType"].isin(PARTICIPANT_TYPES), p["participantType"]).otherwise("UNKNOWN")
    return F.struct(
        F.coalesce(p["participantId"], F.lit(0)).cast("long").alias("participantId"),
        F.coalesce(p["name"], F.lit("")).alias("name"),
        F.nullif(p["englishName"], F.lit("")).alias("englishName"),
        p["home"].alias("home"),
        kind.alias("participantType"),
    )


def outcome_row(o: Column) -> Column:
    """The answer's outcome: prices and lines in thousandths as they come."""
    return F.struct(
        F.coalesce(o["id"], F.lit(0)).cast("long").alias("id"),
        F.coalesce(o["label"], F.lit("")).alias("label"),
        F.coalesce(o["odds"], F.lit(0)).cast("long").alias("odds"),
        o["line"].alias("line"),
        o["participant"].alias("participant"),
        F.coalesce(o["status"], F.lit("OPEN")).alias("status"),
    )


def offer_row(b: Column) -> Column:
    """The answer's offer."""
    return F.struct(
        F.coalesce(b["id"], F.lit(0)).cast("long").alias("id"),
        F.coalesce(b["eventId"], F.lit(0)).cast("long").alias("eventId"),
        F.coalesce(b["criterion"]["id"], F.lit(0)).cast("long").alias("criterionId"),
        market_label(b["criterion"]["englishLabel"], b["criterion"]["label"], b["description"]).alias("label"),
        F.coalesce(b["tags"], F.array().cast("array<string>")).alias("tags"),
    )


def event_row(e: Column) -> Column:
    """The answer's event."""
    blank = F.lit("")
    return F.struct(
        F.coalesce(e["id"], F.lit(0)).cast("long").alias("id"),
        F.coalesce(e["name"], blank).alias("name"),
        F.coalesce(e["homeName"], blank).alias("homeName"),
        F.coalesce(e["awayName"], blank).alias("awayName"),
        F.coalesce(e["start"], blank).alias("start"),
        F.coalesce(e["group"], blank).alias("group"),
        F.coalesce(e["sport"], blank).alias("sport"),
        F.coalesce(e["tags"], F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.transform(e["participants"], participant_row), F.array()).alias("participants"),
        live_state(e["state"]).alias("state"),
    )


def coupon_refs(rows: Column) -> Column:
    """array of (id, betOfferId): the outcomes of a coupon's rows, single and nested."""
    empty = F.array().cast("array<struct<id:bigint,betOfferId:bigint>>")
    ref = lambda o: F.struct(o["id"].cast("long").alias("id"), o["betOfferId"].cast("long").alias("betOfferId"))
    refs = lambda outs: F.coalesce(F.transform(outs, ref), empty)

    def of(row: Column) -> Column:
        single = F.when(row["outcome"].isNotNull() & row["outcome"]["id"].isNotNull(), F.array(ref(row["outcome"]))).otherwise(empty)
        nested = F.flatten(F.coalesce(F.transform(row["group"]["groups"], lambda g: refs(g["outcomes"])), F.array(empty)))
        return F.concat(single, nested, refs(row["group"]["outcomes"]))

    return F.filter(F.flatten(F.transform(F.coalesce(rows, F.array()), of)), lambda r: r["id"].isNotNull())


def coupon_events(rows: Column) -> Column:
    """The distinct events of a coupon's rows."""
    return F.array_distinct(F.filter(F.transform(rows, lambda r: r["eventId"]), lambda e: e.isNotNull()))


def coupon_price(rows: Column, bets: Column) -> Column:
    """The first bet's price, else the rows' prices multiplied; 0 without rows."""
    first = F.try_element_at(bets, F.lit(1))["odds"]["decimal"]
    product = F.aggregate(rows, F.lit(1.0), lambda s, r: s * F.coalesce(r["odds"]["decimal"], F.lit(1000)) / 1000.0)
    built = F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.round(product * 1000)).otherwise(0)
    return F.coalesce(first, built.cast("long")).cast("long")


def locale(language: Column) -> Column:
    """The locale of a language's name; en_GB for any other."""
    key = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    out = F.lit(DEFAULT_LOCALE)
    for name, value in LOCALES.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def english_name(names: Column) -> Column:
    """The English name in array<struct<locale, name>>: by the order of locales, else any en_, else the first."""
    of = lambda locale: F.filter(names, lambda n: n["locale"] == locale)
    picks = [F.try_element_at(of(x), F.lit(-1))["name"] for x in ENGLISH_LOCALES]
    other = F.try_element_at(F.filter(names, lambda n: n["locale"].startswith("en_")), F.lit(1))["name"]
    return F.coalesce(*picks, other, F.try_element_at(names, F.lit(1))["name"])


def player_name(name: Column) -> Column:
    """Without a closing parenthesis, and ``Last, First`` turned round."""
    bare = F.trim(F.regexp_replace(name, r"\s*\([^)]+\)\s*$", ""))
    return F.when(bare.rlike(r"^[^,]+,\s+\S"), F.regexp_replace(bare, r"^([^,]*[^,\s])\s*,\s+(.+?)\s*$", "$2 $1")).otherwise(bare)


def bet_phrase(concept: Column, subject_kind: Column, individual: Column) -> Column:
    """The market phrase, with a remark if it is about one player of a team sport."""
    return F.when((subject_kind == "player") & ~individual, F.concat(concept, F.lit(" (for one player)"))).otherwise(concept)


def cache_key(kind: Column, payload: Column) -> Column:
    """kind, and 16 hex digits of the payload's SHA-256."""
    return F.concat(kind, F.lit("-"), F.left(F.sha2(payload, 256), F.lit(16)))


def truncated(total: Column, returned: Column) -> Column:
    """Whether an answer holds less than there is: by the known total, else by the cap."""
    return F.coalesce(total > returned, returned >= ANSWER_CAP)


def offer_type_names(value: Column) -> Column:
    """Whether a market's type reads its line as a result token (correct score, half/full time)."""
    return F.coalesce(value.isin(3, 8), F.lit(False))
