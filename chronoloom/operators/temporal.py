"""Bi-temporal operators: validity (closed intervals) and knowledge (half-open intervals)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _at(t) -> Column:
    return F.to_timestamp(F.lit(t)) if isinstance(t, str) else t


def active_at(edges: DataFrame, t) -> DataFrame:
    """Facts true at ``t``: valid_at <= t <= invalid_at, an absent end being open."""
    return edges.filter((F.col("valid_at") <= _at(t)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") >= _at(t))))


def known_at(edges: DataFrame, t) -> DataFrame:
    """Facts the system held at ``t``: created_at <= t < expired_at."""
    return edges.filter((F.col("created_at") <= _at(t)) & (F.col("expired_at").isNull() | (F.col("expired_at") > _at(t))))


def lifespan_seconds() -> Column:
    """Length of validity; null while it is open."""
    return F.unix_timestamp("invalid_at") - F.unix_timestamp("valid_at")


def consistency(edges: DataFrame, now: str) -> DataFrame:
    """(uuid, level, problem) of every violated rule."""
    rules = F.array(
        F.when(F.col("invalid_at") < F.col("valid_at"), F.struct(F.lit("error").alias("level"), F.lit("ends before it begins").alias("problem"))),
        F.when(F.col("expired_at") <= F.col("created_at"), F.struct(F.lit("warning").alias("level"), F.lit("expired at creation").alias("problem"))),
        F.when(F.col("valid_at") > _at(now) + F.expr("interval 24 hours"), F.struct(F.lit("warning").alias("level"), F.lit("begins in the future").alias("problem"))),
    )
    return edges.select("uuid", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("x")).select("uuid", "x.level", "x.problem")


def invalidate(candidates: DataFrame, fresh: DataFrame) -> DataFrame:
    """Candidates after new facts of the same (src, dst) came in.

    A candidate whose validity overlaps that of a new fact and that began earlier ends where the
    earliest such fact begins. The key of the interval join is (src, dst); what it finds is
    reduced to one minimum a candidate before anything is joined back.
    """
    new = fresh.select(F.col("src").alias("n_src"), F.col("dst").alias("n_dst"), F.col("valid_at").alias("n_from"), F.col("invalid_at").alias("n_to"))
    overlap = (F.col("src") == F.col("n_src")) & (F.col("dst") == F.col("n_dst")) & (F.col("valid_at") < F.col("n_from")) & (F.col("invalid_at").isNull() | (F.col("invalid_at") >= F.col("n_from"))) & (F.col("n_to").isNull() | (F.col("n_to") >= F.col("valid_at")))
    ends = candidates.join(new, overlap).groupBy("uuid").agg(F.min("n_from").alias("new_end")).withColumnRenamed("uuid", "e_uuid")
    out = candidates.join(ends, F.col("uuid") == F.col("e_uuid"), "left")
    return out.withColumn("invalid_at", F.coalesce("new_end", "invalid_at")).withColumn("expired_at", F.coalesce("new_end", "expired_at")).drop("e_uuid", "new_end")


def parse_time(text: Column) -> Column:
    """RFC 3339 or plain ISO text, quotes around it ignored; empty or unreadable: null."""
    bare = F.trim(F.regexp_replace(text, "^[\"']+|[\"']+$", ""))
    return F.coalesce(F.try_to_timestamp(bare, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX")), F.try_to_timestamp(bare, F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def previous_within(episodes: DataFrame, hours: int = 24) -> DataFrame:
    """(uuid, previous): how many episodes of the group began in the hours before each one.

    Rows are counted within spans of that many hours, each row standing in its own span and, for
    others to see, in the next; so a busy group is split by time and never meets in one task.
    """
    width = hours * 3600
    at = F.unix_timestamp("valid_at")
    span = F.floor(at / width)
    rows = episodes.select("uuid", "group_id", at.alias("at"), F.explode(F.array(F.struct(span.alias("span"), F.lit(True).alias("own")), F.struct((span + 1).alias("span"), F.lit(False).alias("own")))).alias("x"))
    w = W.partitionBy("group_id", "x.span").orderBy("at").rangeBetween(-width, -1)
    return rows.withColumn("previous", F.count("*").over(w)).filter("x.own").select("uuid", "previous")


def context_of(episodes: DataFrame, last: int = 10) -> DataFrame:
    """(uuid, context): ids of the last episodes of the group before each one, oldest first."""
    w = W.partitionBy("group_id").orderBy("valid_at", "uuid").rowsBetween(-last, -1)
    return episodes.select("uuid", F.collect_list("uuid").over(w).alias("context"))
