"""Sources and sinks: JSON documents of the catalog, feeds, gold records, snapshots and recorded decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.sources.written import stage

OUTCOME = "struct<id:bigint,label:string,englishLabel:string,participant:string,participantId:bigint,eventParticipantId:bigint,odds:bigint,line:bigint,type:string,homeScore:string,awayScore:string,status:string>"
OFFER = f"id bigint, eventId bigint, closed string, criterion struct<id:bigint,label:string,englishLabel:string,lifetime:string>, betOfferType struct<id:int,name:string,englishName:string>, tags array<string>, description string, outcomes array<{OUTCOME}>"
EVENT = "id bigint, name string, englishName string, homeName string, awayName string, start string, originalStartDate string, state string, tags array<string>, `group` string, groupId bigint, sport string, path array<struct<id:bigint,name:string>>, participants array<struct<participantId:bigint,name:string,englishName:string,termKey:string,home:boolean,participantType:string>>"
COUPON = "id bigint, status string, prePackCouponRows array<struct<id:bigint,eventId:bigint,type:string,odds:struct<decimal:bigint>,outcome:struct<id:bigint,betOfferId:bigint>,`group`:struct<groups:array<struct<outcomes:array<struct<id:bigint,betOfferId:bigint>>>>,outcomes:array<struct<id:bigint,betOfferId:bigint>>>>>, prePackCouponBets array<struct<odds:struct<decimal:bigint>>>, prePackCouponTags array<string>"
_NAMES = "array<struct<locale:string,name:string>>"
FEED = f"participants array<struct<id:bigint,type:string,names:{_NAMES},groupIds:array<bigint>,teamMembers:array<struct<id:bigint,type:string,names:{_NAMES},groupIds:array<bigint>>>>>"
INDEX = """version string, builtAt string, sport string, sportRootId bigint, groups array<struct<id:bigint,name:string,sport:string,parent:bigint,branch:bigint>>, branches array<struct<id:bigint,name:string>>,
 teams array<struct<id:bigint,name:string,competitionIds:array<bigint>,groupIds:array<bigint>,ntVariant:string>>, players array<struct<id:bigint,name:string,clubId:bigint,countryTeamId:bigint,competitionIds:array<bigint>>>"""
ALIASES = "competitions map<string,string>, regions map<string,string>, markers map<string,string>"
GOLD = "id string, query string, tags array<string>, gradeMarket boolean, notes string, expect string"
BATCH = "id string, category string, q string, grade struct<targets:array<array<bigint>>,oddsMin:double,oddsMax:double,timebound:boolean>"
RECORDED = "key string, kind string, output string"


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON documents under a path with a fixed schema; a missing path gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, faults) of files of JSON lines, which people write and so are small: blank lines are skipped, broken ones come with file and number."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "value"))
    text = files.select("file", (F.col("at") + 1).alias("line"), "value").where(F.trim("value") != "")
    parsed = text.withColumn("r", F.from_json("value", f"{schema}, __broken string", {"columnNameOfCorruptRecord": "__broken"}))
    return parsed.where("r.__broken IS NULL").select("r.*").drop("__broken"), parsed.where("r.__broken IS NOT NULL").select("file", "line", "value")


def scope_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a sport's index; all of them empty if there is no file."""
    index = read_json(spark, path, INDEX)
    each = lambda name: index.select(F.explode(name).alias("x")).select("x.*")
    teams = each("teams").select("id", "name", F.col("competitionIds").alias("competition_ids"), F.col("groupIds").alias("group_ids"), F.col("ntVariant").alias("variant"))
    players = each("players").select("id", "name", F.col("clubId").alias("club_id"), F.col("countryTeamId").alias("country_team_id"), F.col("competitionIds").alias("competition_ids"))
    from lattiq.operators.etl import rosters

    return {"groups": each("groups"), "branches": each("branches"), "teams": teams, "players": players, "rosters": rosters(players)}


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, value) of an alias file: kinds competitions, regions and markers."""
    table = read_json(spark, path, ALIASES)
    parts = [table.select(F.lit(k).alias("kind"), F.explode(k).alias("key", "value")) for k in ("competitions", "regions", "markers")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def unwrap_groups(rows: DataFrame, item: str = "struct<id:bigint,name:string>") -> DataFrame:
    """The groups of feeds(json), whether they stand at the top or under ``group``."""
    parsed = rows.select(F.from_json("json", f"groups array<{item}>, `group` struct<groups:array<{item}>>").alias("f"))
    return parsed.select(F.explode(F.coalesce("f.group.groups", "f.groups")).alias("x")).select("x.*")


def flatten_tree(rows: DataFrame) -> DataFrame:
    """(id, name, sport, parent) of all nodes of feeds(json), however deep; of an id the deepest, then last, stays.

    Each level's children stay JSON text until their own turn, so the depth need not be known; the loop ends with the first empty level.
    """
    node = "struct<id:bigint,name:string,sport:string,groups:array<string>>"
    top = rows.select(F.monotonically_increasing_id().alias("feed"), F.from_json("json", "groups array<string>, `group` struct<groups:array<string>>").alias("f"))
    level = top.select("feed", F.lit(None).cast("bigint").alias("parent"), F.posexplode(F.coalesce("f.group.groups", "f.groups")).alias("at", "json"))
    level = level.select(F.array("feed", "at").alias("path"), "parent", F.from_json("json", node).alias("n"))
    found, held = [], []
    while not (level := level.persist()).isEmpty():
        held.append(level)
        found.append(level.select("n.id", "n.name", "n.sport", "parent", F.struct(F.size("path").alias("depth"), "path").alias("__at")))
        below = level.select("path", F.col("n.id").alias("parent"), F.posexplode("n.groups").alias("at", "json"))
        level = below.select(F.array_append("path", F.col("at").cast("bigint")).alias("path"), "parent", F.from_json("json", node).alias("n"))
    every = found[0] if found else level.select("n.id", "n.name", "n.sport", "parent", F.struct(F.size("path").alias("depth"), "path").alias("__at"))
    for more in found[1:]:
        every = every.unionByName(more)
    flat = stage(every.groupBy("id").agg(F.max_by(F.struct("name", "sport", "parent"), "__at").alias("x")).select("id", "x.*"))
    for own in [*held, level]:
        own.unpersist()
    return flat


def offer_filter(kinds: list[int] | None = None, only_main: bool = False, only_competitions: bool = False, live: bool | None = None) -> Column:
    """What a server would filter: offer types, main offers, competition events, live (or else not live) events."""
    out = F.lit(True)
    if kinds:
        out = out & F.col("offer_type").isin(kinds)
    if only_main:
        out = out & F.coalesce(F.array_contains("tags", "MAIN"), F.lit(False))
    if only_competitions:
        out = out & (F.col("level") == "competition")
    if live is not None:
        out = out & ((F.col("state") == "STARTED") == live)
    return out


def flat_outcomes(offers: DataFrame) -> DataFrame:
    """One row for each outcome of offers (OFFER's columns), as the operators want them; offers without outcomes give none."""
    from lattiq.functions.offering import market_label

    label = market_label(F.col("criterion.englishLabel"), F.col("criterion.label"), F.col("description"))
    rows = offers.select(
        F.col("id").alias("offer_id"), F.col("eventId").alias("event_id"), F.col("criterion.id").alias("criterion_id"), F.col("betOfferType.id").alias("offer_type"), "tags", label.alias("label"), F.posexplode("outcomes").alias("ord", "o")
    )
    names = {"id": "outcome_id", "type": "kind", "englishLabel": "english_label", "label": "outcome_label", "participantId": "participant_id", "homeScore": "home_score", "awayScore": "away_score"}
    fields = ["id", "type", "englishLabel", "label", "participant", "participantId", "odds", "line", "homeScore", "awayScore", "status"]
    return rows.select("offer_id", "event_id", "criterion_id", "offer_type", "tags", "label", "ord", *[F.col(f"o.{f}").alias(names.get(f, f)) for f in fields])


def flat_events(events: DataFrame) -> DataFrame:
    """events (EVENT's columns) as the operators want them; starts are read as UTC."""
    from lattiq.functions.offering import event_level

    start = F.coalesce("start", "originalStartDate")
    ids = lambda kind: F.transform(F.filter("participants", kind), lambda p: p["participantId"])
    return events.select(
        F.col("id").alias("event_id"),
        F.col("name").alias("event_name"),
        F.col("homeName").alias("home_name"),
        F.col("awayName").alias("away_name"),
        F.try_to_timestamp(F.regexp_replace(start, "Z$", "")).cast("timestamp_ntz").alias("start"),
        "state",
        event_level(F.col("tags")).alias("level"),
        F.col("groupId").alias("group_id"),
        F.coalesce(ids(lambda p: p["participantType"] == "TEAM"), F.array().cast("array<bigint>")).alias("teams"),
        F.coalesce(ids(lambda p: p["participantId"].isNotNull()), F.array().cast("array<bigint>")).alias("members"),
    )


def read_coupons(spark: SparkSession, path: str, group_ids: list[int]) -> DataFrame:
    """coupons(coupon_id, group_id, event_ids, custom, price, tag) of the groups, and their refs in order: files of JSON lines by folder group_id=N."""
    from lattiq.functions.offering import coupon_events, coupon_price, coupon_refs

    rows = read_json(spark, path, f"{COUPON}, group_id bigint", lines=True).where(F.col("group_id").isin(group_ids))
    tags = F.coalesce("prePackCouponTags", F.array().cast("array<string>"))
    return rows.select(
        F.col("id").alias("coupon_id"),
        "group_id",
        coupon_events(F.col("prePackCouponRows")).alias("event_ids"),
        F.array_contains(tags, "CUSTOM").alias("custom"),
        coupon_price(F.col("prePackCouponRows"), F.col("prePackCouponBets")).alias("price"),
        F.try_element_at(tags, F.lit(1)).alias("tag"),
        coupon_refs(F.col("prePackCouponRows")).alias("refs"),
    )


def valid_query(text: Column) -> Column:
    """Whether a request's text may be asked: 1 to 500 characters, not only white space."""
    return F.coalesce(F.length(text).between(1, 500) & (F.trim(text) != ""), F.lit(False))


def write_envelopes(envelopes: DataFrame, path: str, parts: DataFrame | None = None) -> None:
    """One JSON line for each answer, in folders by batch; of answers in parts (assemble.answer_parts) a line for each part, in folders by query, in ``parts``."""
    envelopes.write.mode("overwrite").partitionBy("batch").json(f"{path}/answers")
    if parts is not None:
        parts.write.mode("overwrite").partitionBy("query_id").json(f"{path}/parts")
