"""Time windows as columns, in UTC: date tokens, kick-off phrases, and whether a start falls in them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of days by number of Spark's dayofweek, hour at which a weekend opens, hours of day parts.
WEEKDAYS = ["sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday"]
WEEKEND_HOUR = 18
DAY_PARTS = {"morning": (None, 12), "afternoon": (12, 18), "evening": (17, None), "night": (20, None)}


def day_start(t: Column) -> Column:
    """00:00 of the day."""
    return F.date_trunc("day", t).cast("timestamp_ntz")


def day_end(t: Column) -> Column:
    """23:59:59.999 of the day."""
    return day_start(t) + F.expr("INTERVAL '23:59:59.999' HOUR TO SECOND")


def add_hours(t: Column, n: Column) -> Column:
    """n hours of 3,600 seconds later."""
    return t.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), n)


def add_days(t: Column, n: Column) -> Column:
    """n days of 86,400 seconds later."""
    return t.cast("timestamp_ntz") + F.make_dt_interval(n)


def weekend(base: Column) -> tuple[Column, Column]:
    """Friday evening to the end of Sunday: of the weekend that holds base, else of the next."""
    day = F.dayofweek(base)  # 1 is Sunday
    saturday = day_start(add_days(base, F.when(day == 1, -1).otherwise(7 - day)))
    return add_hours(add_days(saturday, F.lit(-1)), F.lit(WEEKEND_HOUR)), day_end(add_days(saturday, F.lit(1)))


@dataclass
class Window:
    """Columns: known (the phrase is understood), start and end (null: open)."""

    known: Column
    start: Column
    end: Column


def date_window(token: Column, base: Column, now: Column) -> Window:
    """The window of a token: today, tonight, tomorrow, weekend, a day's name, next_N_hours, _days or _weeks."""
    v = F.lower(F.trim(token))
    n = F.regexp_extract(v, r"^next_(\d+)_(?:hour|day|week)s?$", 1).try_cast("int")
    unit = F.regexp_extract(v, r"^next_\d+_(hour|day|week)s?$", 1)
    ahead = F.when(unit == "hour", add_hours(now, n)).when(unit == "week", add_days(now, n * 7)).when(unit == "day", add_days(now, n))
    number = F.array_position(F.array(*map(F.lit, WEEKDAYS)), v).cast("int")
    wait = F.pmod(number - F.dayofweek(now), F.lit(7))
    friday, sunday = weekend(base)
    tomorrow = add_days(now, F.lit(1))
    instant = now.cast("timestamp_ntz")
    start = (
        F.when(unit != "", instant)
        .when(v == "tomorrow", day_start(tomorrow))
        .when(v.isin("today", "tonight"), instant)
        .when(v == "weekend", friday)
        .when((number > 0) & (wait == 0), instant)
        .when(number > 0, day_start(add_days(now, wait)))
    )
    end = (
        F.when(unit != "", ahead)
        .when(v == "tomorrow", day_end(tomorrow))
        .when(v.isin("today", "tonight"), day_end(now))
        .when(v == "weekend", sunday)
        .when(number > 0, day_end(add_days(now, wait)))
    )
    return Window(start.isNotNull(), start, end)


@dataclass
class Kickoff:
    """Columns: known, after and before (hours), relative (late, early or null)."""

    known: Column
    after: Column
    before: Column
    relative: Column


def kickoff(phrase: Column) -> Kickoff:
    """The hour band of a phrase; the first rule that fits counts."""
    v = F.lower(F.trim(phrase))

    def hour(word: str) -> Column:
        n = F.regexp_extract(v, rf"\b{word}\s+(\d{{1,2}})\s*(?:am|pm)?\b", 1).try_cast("int")
        half = F.regexp_extract(v, rf"\b{word}\s+\d{{1,2}}\s*(am|pm)?\b", 1)
        return F.when((half == "pm") & (n < 12), n + 12).when((half == "am") & (n == 12), 0).otherwise(n)

    after, before, none = hour("after"), hour("before"), F.lit(None)
    rules = [(after.isNotNull(), (after, none, none)), (before.isNotNull(), (none, before, none))]
    rules += [(v.rlike(rf"\b{word}\b"), (F.lit(a), F.lit(b), none)) for word, (a, b) in DAY_PARTS.items()]
    rules += [(v.rlike(rf"\b{word}\b"), (none, none, F.lit(word))) for word in ("late", "early")]

    def choose(k: int, kind: str) -> Column:
        out = F.when(rules[0][0], rules[0][1][k])
        for fits, values in rules[1:]:
            out = out.when(fits, values[k])
        return out.cast(kind)

    known = rules[0][0]
    for fits, _ in rules[1:]:
        known = known | fits
    return Kickoff(F.coalesce(known, F.lit(False)), choose(0, "int"), choose(1, "int"), choose(2, "string"))


def start_of(start: Column, original: Column) -> Column:
    """The start, else the original start."""
    return F.coalesce(start, original)


def within(start: Column, low: Column, high: Column) -> Column:
    """Whether a start lies in a window, ends included; a missing start or end keeps the row."""
    return start.isNull() | (F.coalesce(start >= low, F.lit(True)) & F.coalesce(start <= high, F.lit(True)))


def in_hours(start: Column, after: Column, before: Column) -> Column:
    """Whether the hour is at least ``after`` and below ``before``; what is missing keeps the row."""
    h = F.hour(start)
    return start.isNull() | (F.coalesce(h >= after, F.lit(True)) & F.coalesce(h < before, F.lit(True)))
