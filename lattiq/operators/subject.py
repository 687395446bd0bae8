"""Which offers price a subject, and whose outcomes they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.functions.offering import is_named
from lattiq.functions.text import fold


def holds(haystack: Column, folded: Column) -> Column:
    """Whether the folded text holds the folded subject; a missing text is empty."""
    return F.contains(fold(F.coalesce(haystack, F.lit(""))), folded)


def opponent(home: Column, away: Column, folded: Column) -> Column:
    """The folded name of the side that the subject isn't; empty if it is neither."""
    h, a = fold(F.coalesce(home, F.lit(""))), fold(F.coalesce(away, F.lit("")))
    return F.when(F.contains(h, folded), a).when(F.contains(a, folded), h).otherwise("")


def prices_subject(outcomes: Column, label: Column, event_name: Column, home: Column, away: Column, folded: Column, subject_id: Column) -> Column:
    """Whether an offer is about the subject: by an outcome's participant (id if known, else name) or label, the market's
    label, or the event's name. A label that names the opponent alone is not, whatever else holds.

    outcomes: array of (participant, participant_id, label).
    """
    other = opponent(home, away, folded)
    market = fold(F.coalesce(label, F.lit("")))
    rival = (other != "") & F.contains(market, other) & ~F.contains(market, folded)
    own = F.exists(
        outcomes,
        lambda o: F.when(subject_id.isNotNull(), F.coalesce(o["participant_id"] == subject_id, F.lit(False))).otherwise(holds(o["participant"], folded))
        | holds(o["label"], folded),
    )
    return ~rival & (F.coalesce(own, F.lit(False)) | F.contains(market, folded) | holds(event_name, folded))


def keep_priced(offers: DataFrame) -> DataFrame:
    """The offers that price their leg's subject; all of a leg without one.

    Columns: subject_name, subject_side (home or away), subject_id, outcomes, label, event_name, home_name, away_name. A side is
    resolved in each offer's own event; where that is unknown the offer is kept.
    """
    named = F.when(F.col("subject_side") == "home", F.col("home_name")).when(F.col("subject_side") == "away", F.col("away_name")).otherwise(F.col("subject_name"))
    folded = fold(F.coalesce(named, F.lit("")))
    priced = prices_subject(F.col("outcomes"), F.col("label"), F.col("event_name"), F.col("home_name"), F.col("away_name"), folded, F.col("subject_id"))
    return offers.where((folded == "") | priced)


def typed_side(side: Column, kind: Column, english: Column, label: Column) -> Column:
    """Whether an outcome is the home (away) side by its type, else by its label."""
    silent = kind.isNull() | kind.isin("", "OT_UNTYPED")
    shown = F.coalesce(english, label)
    fixed = lambda t, number: F.coalesce((kind == t) | (silent & (shown == number)), F.lit(False))
    return F.when(side == "home", fixed("OT_ONE", "1")).when(side == "away", fixed("OT_TWO", "2")).otherwise(False)


def on_side(side: Column, kind: Column, english: Column, label: Column, participant: Column, home: Column, away: Column) -> Column:
    """Whether an outcome is its own event's home (away) side: by type or label, or by the participant's name."""
    team = fold(F.coalesce(F.when(side == "home", home).when(side == "away", away), F.lit("")))
    named = (team != "") & is_named(participant, english, label) & holds(participant, team)
    return typed_side(side, kind, english, label) | named


def outcome_is_subjects(participant: Column, participant_id: Column, subject_id: Column, subject: Column) -> Column:
    """By id if it is known, else by name if there is one (not a side), else any outcome."""
    by_name = holds(participant, fold(subject))
    return F.when(subject_id.isNotNull(), F.coalesce(participant_id == subject_id, F.lit(False))).when(
        subject.isNotNull() & (subject != "") & ~subject.isin("home", "away"), by_name
    ).otherwise(True)
