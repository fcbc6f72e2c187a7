"""Sharding by proportional stratified interleaving (operator 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Frame, buckets_for, shuffle_key, source_key, table

SEED = "interleave-1"


def interleave(
    docs: DataFrame, shards: int = 8, *, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text", carry: bool = True
) -> DataFrame:
    """Deal rows into ``shards`` so that each holds every source in proportion.

    Rows are ranked in seeded-shuffled order within their source, sorted by fractional
    rank (rank - 1/2) / (rows of the source) and cut into runs of equal length, so shard
    sizes are at most one row apart (the ``rows`` law). Ranks come from hash buckets with
    prefix sums and positions from range buckets with prefix sums; no task ever holds
    more than one bucket of a source, however large the source is. Positions are worked out
    on ids and sources alone and joined one to one; whole rows are shuffled once.

    Returns ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``law``, ``shard``, ``slot``
    (gapless from 0) and ``grown_shard`` (null under this law), after the input columns
    (``carry``) or the key alone. A null text counts 0 bytes and crc32 0; null sources form
    one stratum, after the others; null and repeated keys are ordered by their content, and
    identical rows are interchangeable. An input column named as an output is replaced. An
    empty table gives an empty result.
    """
    f = Frame(docs)
    rows = docs.count()
    n_buckets = buckets_for(rows)
    hashed = shuffle_key(seed, F.col("id"))
    bucket = F.shiftright(F.col("r"), 60 - (n_buckets.bit_length() - 1))
    given = (source_key(F.col(f.at(source))).alias("src"), F.col(f.at(key)).alias("id"))
    ident = f.df.select(*given, F.col(f.at(source)).isNull().alias("last")).withColumn("r", hashed).withColumn("b", bucket)

    # Rows of each (source, hash bucket), and how many of the source stand before it.
    counts = ident.groupBy("src", "b").agg(F.count("*").alias("n"))
    before = W.partitionBy("src").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("src").alias("o_src"),
        F.col("b").alias("o_b"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"),
        F.sum("n").over(W.partitionBy("src")).alias("n_src"),
    )

    # Ids alone fix which ranks fall where: g is the range bucket of (rank - 1/2) / n_src, in whole numbers.
    ranked = ident.join(offsets, (F.col("src") == F.col("o_src")) & (F.col("b") == F.col("o_b")))
    ranked = ranked.withColumn("rank", F.col("off") + F.row_number().over(W.partitionBy("src", "b").orderBy("r", "id")))
    place = F.expr(f"cast(((2 * rank - 1) * cast({n_buckets} as decimal(20,0))) div (2 * n_src) as bigint)")
    ranked = ranked.select("src", "id", "last", "rank", "n_src", place.alias("g"))
    heights = ranked.groupBy("g").agg(F.count("*").alias("n"))
    upto = W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    starts = heights.select(F.col("g").alias("s_g"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("start"))
    within = W.partitionBy("g").orderBy((2 * F.col("rank") - 1) / (2 * F.col("n_src")), "last", "src", "rank")
    placed = ranked.join(starts, F.col("g") == F.col("s_g")).withColumn("pos", F.col("start") + F.row_number().over(within) - 1)
    # One position for each row of an id: repeated ids take theirs in order of content.
    named = source_key(F.col("id")).alias("name")
    slots = placed.select(F.col("src").alias("p_src"), named.alias("p_name"), "rank", "pos")
    slots = slots.withColumn("p_nth", F.row_number().over(W.partitionBy("p_src", "p_name").orderBy("rank"))).drop("rank")

    body = f.df.select(
        *([F.struct("*").alias("row")] if carry else []),
        *given,
        (F.coalesce(F.octet_length(f.at(text)), F.lit(0)) + 1).cast("long").alias("sz"),
        F.coalesce(F.crc32(f.at(text)), F.lit(0)).cast("long").alias("crc"),
    ).withColumn("name", named)
    body = body.withColumn("nth", F.row_number().over(W.partitionBy("src", "name").orderBy("crc", "sz")))
    # The difference keeps the number out of the join's key, so rows stay where the window has put them.
    same = (F.col("src") == F.col("p_src")) & (F.col("name") == F.col("p_name")) & (F.col("nth") - F.col("p_nth") == 0)
    placed = body.join(slots, same)
    total = max(rows, 1)
    shard = F.expr(f"(pos * {shards}L) div {total}L")
    first = F.expr(f"(((pos * {shards}L) div {total}L) * {total}L + {shards - 1}L) div {shards}L")
    out = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [F.col(f"row.c{i}").alias(n) for i, n in enumerate(f.names) if n.lower() not in out] if carry else [F.col("id").alias(key)]
    return placed.select(
        *kept,
        F.col("sz").alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (F.col("pos") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7; only ids, sizes and checksums are shuffled."""
    return interleave(table(spark, sf_dir, "documents"), 8, carry=False)


#: CRC-32 (reflected polynomial 0xEDB88320) over the text's bytes, then the same ranking in SQL.
OP1_SQL = f"""
WITH tbl AS (
  SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), base AS (
  SELECT doc_id, source, coalesce(strlen(text), 0) AS sz, coalesce(text, '') AS txt,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '~')), 1, 15))::BIGINT AS r
  FROM documents
), summed AS (
  SELECT doc_id, source, r, sz + 1 AS size,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(rtrim(regexp_replace(hex(encode(txt)), '(..)', '\\1 ', 'g')), ' '), lambda h: ('0x' || h)::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c & 255, b) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS crc, sz
  FROM base, tbl
), crcs AS (
  SELECT doc_id, source, r, size, CASE WHEN sz = 0 THEN 0 ELSE crc END AS crc FROM summed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY r, doc_id NULLS FIRST, crc, size) AS rank,
    count(*) OVER (PARTITION BY source) AS n_src FROM crcs
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * rank - 1)::DOUBLE / (2 * n_src), source NULLS LAST, rank) - 1 AS pos,
    count(*) OVER () AS n FROM ranked
)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, ((pos * 8) // n)::INTEGER AS shard,
  (pos - (((pos * 8) // n) * n + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed
"""
