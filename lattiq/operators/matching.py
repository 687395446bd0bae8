"""Texts matched to names by the weight of the tokens that they share, without meeting on tokens that most names hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattiq.functions import text
from lattiq.operators.menu import token_table
from lattiq.sources.written import whole

#: Names that hold a token up to which it is one key of a join; beyond that it is split into salts of about as many.
HOT = 10_000


def postings(names: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(held(id, token), weights(token, df), hot(token, salts)) of names(id, ...); hot has at most one row for HOT rows of held, so it may be broadcast."""
    held = token_table(names, name, ["id"])
    weights = held.groupBy("token").agg(F.count("*").alias("df"))
    hot = weights.where(F.col("df") > HOT).select(F.col("token").alias("__hot"), F.ceil(F.col("df") / HOT).cast("int").alias("salts"))
    return held, weights, hot


def meet(wanted: DataFrame, held: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id) of wanted(keys, token) and held(id, token) that share a token. Names of a hot token are dealt to its salts, texts that want it to all of them."""
    salts = F.coalesce("salts", F.lit(1))
    on = lambda rows: rows.join(F.broadcast(hot), F.col("token") == F.col("__hot"), "left").drop("__hot")
    asked = on(wanted.select(*keys, "token")).select(*keys, "token", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = on(held).select("id", "token", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"))
    return asked.join(whole(dealt), ["token", "salt"]).select(*keys, "id").distinct()


def covers(texts: DataFrame, keys: list[str], names: DataFrame, wording: str = "wording", least: float = 0.0) -> DataFrame:
    """(keys, id, cover) of the names(id, name) that hold at least the share ``least`` of a text's token weight, and share a token.

    A text's tokens are put in order, rarest first. A pair whose first shared token is the i-th covers at most the weight from there on, so that only tokens
    from which on ``least`` can still be reached need to meet: the tail, in which the tokens of most names stand, doesn't. What meets is then weighed exactly.
    """
    held, weights, hot = postings(names)
    n = names.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    wanted = token_table(texts, wording, keys).join(whole(weights), "token", "left").join(F.broadcast(n))  # one row
    weighed = wanted.select(*keys, "token", text.idf(F.col("n"), F.col("df")).alias("w"))
    own = Window.partitionBy(*keys)
    rest = F.sum("w").over(own.orderBy(F.desc("w"), "token").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = weighed.withColumns({"rest": rest, "whole": F.sum("w").over(own)})
    first = ranked.where(F.col("rest") >= F.col("whole") * least * (1 - 1e-9))
    weights_of = ranked.groupBy(*keys).agg(F.collect_list(F.struct("token", "w")).alias("tokens"), F.first("whole").alias("whole"))
    tokens_of = held.groupBy("id").agg(F.collect_list("token").alias("name_tokens"))
    pairs = meet(first, held, hot, keys).join(whole(tokens_of), "id").join(weights_of, keys)
    shared = F.filter("tokens", lambda t: F.array_contains("name_tokens", t["token"]))
    part = F.aggregate(shared, F.lit(0.0), lambda total, t: total + t["w"])
    return pairs.select(*keys, "id", (part / F.col("whole")).alias("cover")).where(F.col("cover") >= least * (1 - 1e-9))


def holding_all(texts: DataFrame, keys: list[str], names: DataFrame, wording: str) -> DataFrame:
    """(keys, id) of the names(id, name) that hold all tokens of a text that has any: they meet on its rarest token alone."""
    held, weights, hot = postings(names)
    wanted = token_table(texts, wording, keys)
    rarest = wanted.join(whole(weights), "token", "left").groupBy(*keys).agg(F.min_by("token", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("token"))
    tokens_of = held.groupBy("id").agg(F.collect_list("token").alias("name_tokens"))
    wants = wanted.groupBy(*keys).agg(F.collect_list("token").alias("tokens"))
    pairs = meet(rarest, held, hot, keys).join(whole(tokens_of), "id").join(wants, keys)
    return pairs.where(F.size(F.array_except("tokens", "name_tokens")) == 0).select(*keys, "id")
