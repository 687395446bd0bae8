"""Query plans as they arrive: JSON text, repaired field by field rather than refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the enumerations of a plan hold.
PLAY_STATES = ["live", "prematch"]
SORTS = ["low", "high"]
ORDERS = ["earliest", "latest"]
SUBJECTS = ["player", "team", "either_match_team", "event", "soft"]

#: One selector of a plan. Numbers that may come as texts are read as texts.
SELECTOR = """subject struct<kind:string,name:string,side:string,kinds:array<string>>, market_concept string, line string, odds struct<min:double,max:double>,
 odds_sort string, count double, play_state string, stage string, region string, competition string, level string, teams array<string>, players array<struct<name:string,role:string>>,
 time struct<date_window:string,anchor:string,kickoff_time_of_day:string,fixture_pick:struct<order:string,count:double>>"""
PLAN = "status string, sport string, language string, otherSports array<string>, selectors array<string>"


def blank_is_null(x: Column) -> Column:
    """Null for a text without anything but white space."""
    return F.when(F.trim(x) != "", x)


def one_of(x: Column, options: list[str]) -> Column:
    """Null for what isn't an option."""
    return F.when(x.isin(options), x)


def repair_selectors(rows: DataFrame, json: str) -> DataFrame:
    """The rows with their selector (JSON text in column ``json``) as repaired columns; the text goes.

    Blank texts and unknown options are null; odds keep positive bounds; a count is a whole number from 1; a team without a name is the event; a
    line is a number (line_num) or else a text (line_txt).
    """
    s = F.col("__s")
    positive = lambda x: F.when((x > 0) & (x < float("inf")), x)
    number = F.trim(s["line"]).try_cast("double")
    whole = lambda x: F.when((x >= 1) & (x == F.floor(x)), x.cast("int"))
    kind = F.when((s["subject"]["kind"] == "team") & blank_is_null(s["subject"]["name"]).isNull(), "event").otherwise(one_of(s["subject"]["kind"], SUBJECTS))
    pick = s["time"]["fixture_pick"]
    parsed = rows.withColumn("__s", F.from_json(F.col(json), SELECTOR))
    return parsed.select(
        *[c for c in rows.columns if c != json],
        kind.alias("subject_kind"),
        blank_is_null(s["subject"]["name"]).alias("subject_name"),
        s["subject"]["side"].alias("subject_side"),
        F.coalesce(s["subject"]["kinds"], F.array().cast("array<string>")).alias("subject_kinds"),
        blank_is_null(s["market_concept"]).alias("market_concept"),
        F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number).alias("line_num"),
        F.when(number.isNull(), blank_is_null(s["line"])).alias("line_txt"),
        positive(s["odds"]["min"]).alias("odds_min"),
        positive(s["odds"]["max"]).alias("odds_max"),
        one_of(s["odds_sort"], SORTS).alias("odds_sort"),
        whole(s["count"]).alias("count"),
        one_of(s["play_state"], PLAY_STATES).alias("play_state"),
        blank_is_null(s["stage"]).alias("stage"),
        blank_is_null(s["region"]).alias("region"),
        blank_is_null(s["competition"]).alias("competition"),
        s["level"].alias("level"),
        F.coalesce(s["teams"], F.array().cast("array<string>")).alias("teams"),
        F.coalesce(F.transform(s["players"], lambda p: p["name"]), F.array().cast("array<string>")).alias("players"),
        F.transform(s["players"], lambda p: p["role"]).alias("player_roles"),
        blank_is_null(s["time"]["date_window"]).alias("date_window"),
        s["time"]["anchor"].alias("anchor"),
        blank_is_null(s["time"]["kickoff_time_of_day"]).alias("kickoff"),
        one_of(pick["order"], ORDERS).alias("pick_order"),
        whole(pick["count"]).alias("pick_count"),
    )


def read_plans(rows: DataFrame, json: str = "plan") -> DataFrame:
    """rows(query_id, plan): a row for each leg, repaired, with status, sport, language, other_sports and leg_idx.

    A plan may itself be a JSON text within JSON. Plans without a sport or selector give no legs.
    """
    unwrapped = F.coalesce(F.from_json(F.concat(F.lit('{"x":'), F.col(json), F.lit("}")), "x string")["x"], F.col(json))
    parsed = rows.withColumn("__p", F.from_json(unwrapped, PLAN)).where("__p.sport <> ''")
    each = parsed.select(
        *[c for c in rows.columns if c != json],
        "__p.status",
        "__p.sport",
        "__p.language",
        F.coalesce("__p.otherSports", F.array().cast("array<string>")).alias("other_sports"),
        F.posexplode("__p.selectors").alias("leg_idx", "__json"),
    )
    return repair_selectors(each, "__json")


def plan_schema() -> dict:
    """The JSON schema of a plan, for whoever writes plans."""
    return _json_schema(T.StructType.fromDDL(PLAN.replace("selectors array<string>", f"selectors array<struct<{_one_line(SELECTOR)}>>")))


def _one_line(schema: str) -> str:
    return T.StructType.fromDDL(schema).simpleString()[len("struct<") : -1]


def _json_schema(kind: T.DataType) -> dict:
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: _json_schema(f.dataType) for f in kind.fields}}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _json_schema(kind.elementType)}
    return {"type": "number" if isinstance(kind, T.NumericType) else "string"}


def valid(legs: DataFrame) -> Column:
    """Whether a repaired leg is one that a plan may hold: odds in order, and at least two kinds of a soft subject. A leg without a subject is one."""
    odds = F.coalesce(F.col("odds_min") <= F.col("odds_max"), F.lit(True))
    return odds & (~F.col("subject_kind").eqNullSafe(F.lit("soft")) | (F.size("subject_kinds") >= 2))


def unreadable(rows: DataFrame, legs: DataFrame, json: str = "plan") -> DataFrame:
    """(query_id, code) of the queries that give nothing to answer.

    ``invalid_plan``: no plan, text that isn't one, no sport, or a leg that no plan may hold (the whole plan is refused); ``incomplete``: a plan
    without legs. legs are read_plans() of the rows.
    """
    unwrapped = F.coalesce(F.from_json(F.concat(F.lit('{"x":'), F.col(json), F.lit("}")), "x string")["x"], F.col(json))
    sport = F.from_json(unwrapped, PLAN)["sport"]
    bad = legs.where(~valid(legs)).select("query_id").distinct().withColumn("__bad", F.lit(True))
    some = legs.select("query_id").distinct().withColumn("__legs", F.lit(True))
    every = rows.groupBy("query_id").agg(F.bool_or(F.coalesce(sport != "", F.lit(False))).alias("__read"))
    joined = every.join(bad, "query_id", "left").join(some, "query_id", "left")
    code = F.when(~F.col("__read") | F.col("__bad").isNotNull(), "invalid_plan").when(F.col("__legs").isNull(), "incomplete")
    return joined.select("query_id", code.alias("code")).where("code IS NOT NULL")
