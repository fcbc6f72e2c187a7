"""Resolution of extracted facts against known ones."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import temporal

#: A judge sees a new fact and a known one and says 'duplicate', 'contradicts' or ''.
Judge = Callable[[str, str], str]


def candidates(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """(new_id, old_id, new_fact, old_fact): known facts of the same two nodes, in either direction."""
    n = fresh.select(F.col("uuid").alias("new_id"), F.least("src", "dst").alias("na"), F.greatest("src", "dst").alias("nb"), F.col("name").alias("new_name"), F.col("fact").alias("new_fact"))
    o = known.select(F.col("uuid").alias("old_id"), F.least("src", "dst").alias("oa"), F.greatest("src", "dst").alias("ob"), F.col("name").alias("old_name"), F.col("fact").alias("old_fact"))
    return n.join(o, (F.col("na") == F.col("oa")) & (F.col("nb") == F.col("ob"))).filter("new_id <> old_id").drop("na", "nb", "oa", "ob")


def judged(pairs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """Pairs with ``verdict``. Without a judge, equal normalised facts are duplicates and other facts of the same relation contradict."""
    if judge is None:
        same = tx.normalise_exact(F.col("new_fact")) == tx.normalise_exact(F.col("old_fact"))
        return pairs.withColumn("verdict", F.when(same, "duplicate").when(F.col("new_name") == F.col("old_name"), "contradicts").otherwise(""))

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(verdict=[judge(a, b) for a, b in zip(pdf["new_fact"], pdf["old_fact"], strict=True)])

    return pairs.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", verdict string")


FACT = ("uuid", "src", "dst", "name", "fact", "valid_at", "invalid_at", "expired_at", "episodes")


def stated_again(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """New facts with ``again``: whether the fact of that id is known and still open. One that has ended before begins anew, under an id of its own (``former``: the old one)."""
    ids = known.groupBy(F.col("uuid").alias("s_id")).agg(F.max(F.coalesce("invalid_at", F.lit("9999-01-01").cast("timestamp"))).alias("s_end"))
    out = fresh.join(ids, F.col("uuid") == F.col("s_id"), "left")
    ended = F.col("s_end") <= F.col("valid_at")
    anew = F.substring(F.sha2(F.concat_ws("|", "uuid", F.col("valid_at").cast("string")), 256), 1, 32)
    return out.withColumn("again", F.coalesce(~ended, F.lit(False))).withColumn("former", F.when(ended, F.col("uuid"))).withColumn("uuid", F.when(ended, anew).otherwise(F.col("uuid"))).drop("s_id", "s_end")


def resolve_edges(fresh: DataFrame, known: DataFrame, judge: Judge | None = None, closing: bool = True) -> DataFrame:
    """Known and new facts after resolution, with all columns of ``known`` and ``state``: kept, extended, closed or new.

    A new fact that duplicates a known one, or has the id of an open one, is dropped and its episodes are
    added to the known fact (the least id of several), which stays as it is. Known facts that a new one
    contradicts, and that began earlier, end where it begins. Facts of other meaning are let be, and without
    ``closing`` all are.
    """
    cols = [*FACT, *[c for c in known.columns if c not in FACT]]
    fresh = stated_again(fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(known.schema[c].dataType).alias(c) for c in cols]), known)
    former = fresh.filter("former is not null").select(F.col("uuid").alias("new_id"), F.col("former").alias("old_id"))
    verdicts = judged(candidates(fresh.filter("not again"), known).join(former, ["new_id", "old_id"], "left_anti"), judge)
    if not closing:
        verdicts = verdicts.filter("verdict = 'duplicate'")
    twin = verdicts.filter("verdict = 'duplicate'").groupBy("new_id").agg(F.min("old_id").alias("old_id"))
    twin = twin.unionByName(fresh.filter("again").select(F.col("uuid").alias("new_id"), F.col("uuid").alias("old_id"))).dropDuplicates(["new_id"])
    extra = fresh.join(twin, F.col("uuid") == F.col("new_id")).groupBy(F.col("old_id").alias("x_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("episodes")))).alias("more"))
    new = fresh.join(twin.select("new_id"), F.col("uuid") == F.col("new_id"), "left_anti").dropDuplicates(["uuid"])
    against = verdicts.filter("verdict = 'contradicts'").join(new.select(F.col("uuid").alias("c_id"), F.col("valid_at").alias("c_from"), F.col("invalid_at").alias("c_to")), F.col("new_id") == F.col("c_id"))
    old = known.select(F.col("uuid").alias("k_id"), F.col("valid_at").alias("k_from"), F.col("invalid_at").alias("k_to"))
    overlap = (F.col("old_id") == F.col("k_id")) & (F.col("k_from") < F.col("c_from")) & (F.col("k_to").isNull() | (F.col("k_to") >= F.col("c_from"))) & (F.col("c_to").isNull() | (F.col("c_to") >= F.col("k_from")))
    ends = against.join(old, overlap).groupBy(F.col("k_id").alias("e_id")).agg(F.min("c_from").alias("end"))
    kept = known.select(*cols).join(extra, F.col("uuid") == F.col("x_id"), "left").join(ends, F.col("uuid") == F.col("e_id"), "left")
    kept = kept.withColumn("state", F.when(F.col("end").isNotNull(), "closed").when(F.col("more").isNotNull(), "extended").otherwise("kept"))
    kept = kept.withColumn("episodes", F.when(F.col("more").isNotNull(), F.array_union(F.coalesce("episodes", F.array().cast("array<string>")), "more")).otherwise(F.col("episodes"))).withColumn("invalid_at", F.coalesce("end", "invalid_at")).withColumn("expired_at", F.coalesce("end", "expired_at"))
    return kept.select(*cols, "state").unionByName(new.select(*cols, F.lit("new").alias("state")))


def dated(edges: DataFrame, replies: DataFrame) -> DataFrame:
    """Edges with validity taken from replies (uuid, valid_text, invalid_text) where those can be read."""
    r = replies.select(F.col("uuid").alias("r_id"), temporal.parse_time(F.col("valid_text")).alias("r_from"), temporal.parse_time(F.col("invalid_text")).alias("r_to"))
    out = edges.join(r, F.col("uuid") == F.col("r_id"), "left")
    return out.withColumn("valid_at", F.coalesce("r_from", "valid_at")).withColumn("invalid_at", F.coalesce("r_to", "invalid_at")).drop("r_id", "r_from", "r_to")
