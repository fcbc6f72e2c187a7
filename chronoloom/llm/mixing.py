"""Mixing sources to target weights by weighted fair queueing (operator 2, DataFrame only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Frame, buckets_for, materialise, shuffle_key, source_key, table

SEED = "mix-1"
WEIGHTS = (5, 2, 1)
#: A maximal run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """Target of each source: its weight's part of ``share`` of all sizes, stopping at ``most`` times its size.

    ``sizes`` has ``src`` and ``s``, one row a source. The excess over a stop is shared again
    by weight among the others, which is water filling: target = min(most * s, w * level). The
    sources are taken in order of the level at which they stop, with running sums of stops
    and weights: the level over those left rises up to the first source that does not stop and
    falls after it, so it is the largest among sources that do not stop below it. One row a source is ordered in one task;
    nothing of documents is. A source of size 0 has target 0.
    """
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    df = sizes.withColumn("i", F.row_number().over(W.orderBy(F.col("src").asc_nulls_last())) - 1).withColumn("w", pick)
    df = df.withColumn("cap", (most * F.col("s")).cast("double"))
    ahead = W.orderBy(F.col("cap") / F.col("w"), "i").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    df = df.withColumn("cap_before", F.coalesce(F.sum("cap").over(ahead), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(ahead), F.lit(0.0)))
    level = (F.sum("s").over(every) * F.lit(float(share)) - F.col("cap_before")) / (F.sum("w").over(every) - F.col("w_before"))
    df = df.withColumn("level_here", level)
    df = df.withColumn("level", F.max(F.when(F.col("cap") / F.col("w") >= F.col("level_here"), F.col("level_here"))).over(every))
    return df.select("src", "s", "w", "level", F.least("cap", F.col("w") * F.col("level")).alias("target"))


#: Distinct virtual times that are put in order in one task to find the cut.
ORDERED = 100_000


def schedule(docs: DataFrame, *, seed: str = SEED, weights=WEIGHTS, share: float = 1.5, most: int = 2, key: str = "doc_id", source: str = "source", text: str = "text"):
    """Timed rows (id, sz, cum, s, w, target), bucket offsets, the virtual time of the cut and the number of buckets.

    A document's virtual finish is (words of its source up to it, in seeded order, plus the
    earlier rounds) / weight. The queue is cut at the largest virtual time at which all words
    before it stay within the budget: range buckets of virtual time are summed, the bucket that
    holds the cut is divided again until it is small, and only that one is put in order.
    """
    f = Frame(docs)
    n_buckets = buckets_for(docs.count())
    slim = f.df.select(
        F.col(f.at(key)).alias("id"),
        F.col(f.at(source)).alias("src"),
        F.coalesce(F.regexp_count(f.at(text), F.lit(WORD)), F.lit(0)).cast("long").alias("sz"),
        shuffle_key(seed, F.col(f.at(key))).alias("r"),
    ).withColumn("b", F.shiftright("r", 60 - (n_buckets.bit_length() - 1)))
    slim = materialise(slim, "mix")
    per = materialise(slim.groupBy("src", "b").agg(F.sum("sz").alias("n")), "mix-sums")
    targets = materialise(source_targets(per.groupBy("src").agg(F.sum("n").alias("s")), weights, share, most), "mix-targets")
    before = W.partitionBy("src").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(F.col("src").alias("o_src"), source_key(F.col("src")).alias("o_key"), F.col("b").alias("o_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    offsets = offsets.join(targets.withColumnRenamed("src", "t_src"), F.col("o_src").eqNullSafe(F.col("t_src"))).drop("t_src", "o_src")
    top = targets.agg(F.max(F.lit(float(most)) * F.col("s") / F.col("w")).alias("v"), (F.sum("s") * F.lit(float(share))).alias("budget")).head()
    rows = materialise(finished(slim, offsets).select("id", "sz", "cum", "s", "w", "target"), "mix-timed")
    if not top or not top["v"]:
        return rows, offsets, None, n_buckets
    timed = rows.select("sz", F.explode(F.array(*[F.lit(e) for e in range(most)])).alias("e"), "cum", "s", "w")
    timed = timed.select("sz", ((F.col("cum") + F.col("e") * F.col("s")) / F.col("w")).alias("v"))
    return rows, offsets, cut_time(timed, float(top["v"]), float(top["budget"]), n_buckets), n_buckets


def cut_time(timed: DataFrame, top: float, budget: float, n_buckets: int) -> float:
    """The largest virtual time (v) up to which the sizes (sz) of ``timed`` stay within ``budget``; -1.0 where none does."""
    low, high, spent, best = 0.0, top, 0, -1.0
    while True:
        part = timed.filter((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
        g = F.floor((F.col("v") - F.lit(low)) / F.lit(max(high - low, 1e-300)) * n_buckets)
        heights = part.groupBy(g.alias("g")).agg(F.sum("sz").alias("n"), F.count("*").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        run = heights.withColumn("upto", F.lit(spent) + F.sum("n").over(W.orderBy("g"))).withColumn("before", F.max("hi").over(W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)))
        over = run.filter(F.col("upto") > F.lit(budget)).orderBy("g").limit(1).head()
        if over is None:
            return high
        best = over["before"] if over["before"] is not None else best
        spent = over["upto"] - over["n"]
        if over["rows"] <= ORDERED or over["lo"] == over["hi"] or (over["lo"], over["hi"]) == (low, high):
            break
        low, high = over["lo"], over["hi"]
    inside = timed.filter((F.col("v") >= F.lit(over["lo"])) & (F.col("v") <= F.lit(over["hi"]))).groupBy("v").agg(F.sum("sz").alias("n"))
    run = inside.select("v", (F.lit(spent) + F.sum("n").over(W.orderBy("v"))).alias("spent"))
    last = run.filter(F.col("spent") <= F.lit(budget)).agg(F.max("v").alias("v")).head()["v"]
    return float(last if last is not None else best)


def finished(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Add each row's running words within its source (``cum``) and the source's size, weight and target."""
    rows = rows.withColumn("key", source_key(F.col("src")))
    rows = rows.join(offsets, (F.col("key") == F.col("o_key")) & (F.col("b") == F.col("o_b"))).drop("o_key", "o_b")
    order = W.partitionBy("key", "b").orderBy("r", "id", "sz").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("cum", F.col("off") + F.sum("sz").over(order))


def copies(cut: float | None, most: int = 2):
    """How often a finished row is taken: the rounds whose virtual finish is not after the cut."""
    if cut is None:
        return F.lit(0)
    return sum((((F.col("cum") + e * F.col("s")) / F.col("w") <= F.lit(cut)) & (F.col("sz") > 0)).cast("int") for e in range(most))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target (of its source) and taken (words, repeats counted).

    A null or wordless text has size 0 and is never taken. Null sources form one source, last
    in order. Repeated rows are separate documents. An empty table, or one without words, takes nothing.
    """
    rows, _, cut, _ = schedule(docs, **options)
    return rows.select(F.col("id").alias("doc_id"), F.col("sz").alias("size"), F.col("s").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("sz") * copies(cut)).cast("long").alias("taken"))


def mix(docs: DataFrame, *, seed: str = SEED, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mixture itself: documents with their own columns, each as often as the queue takes it (0, 1 or 2 times).

    Columns may bear any names, also those used inside; null, wordless and repeated rows as in ``mix_report``.
    """
    f = Frame(docs)
    _, offsets, cut, n_buckets = schedule(docs, seed=seed, key=key, source=source, text=text, **options)
    full = f.df.select(
        F.struct("*").alias("row"),
        F.col(f.at(key)).alias("id"),
        F.col(f.at(source)).alias("src"),
        F.coalesce(F.regexp_count(f.at(text), F.lit(WORD)), F.lit(0)).cast("long").alias("sz"),
        shuffle_key(seed, F.col(f.at(key))).alias("r"),
    ).withColumn("b", F.shiftright("r", 60 - (n_buckets.bit_length() - 1)))
    taken = finished(full, offsets).withColumn("k", copies(cut)).filter("k > 0")
    taken = taken.withColumn("e", F.explode(F.expr("sequence(1, k)")))
    return taken.select(*[F.col(f"row.c{i}").alias(n) for i, n in enumerate(f.names)])


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


OP2_SQL = f"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS sz,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '~')), 1, 15))::BIGINT AS r
  FROM documents
), src AS (
  SELECT source, sum(sz)::BIGINT AS s, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)]::DOUBLE AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS i
  FROM base GROUP BY source
), filled AS (
  SELECT *, 2.0::DOUBLE * s AS cap,
    coalesce(sum(2.0::DOUBLE * s) OVER (ORDER BY 2.0::DOUBLE * s / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    coalesce(sum(w) OVER (ORDER BY 2.0::DOUBLE * s / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before,
    sum(s) OVER ()::DOUBLE * 1.5::DOUBLE AS budget, sum(w) OVER () AS w_all
  FROM src
), lvl AS (
  SELECT *, max(CASE WHEN cap / w >= (budget - cap_before) / (w_all - w_before) THEN (budget - cap_before) / (w_all - w_before) END) OVER () AS level FROM filled
), timed AS (
  SELECT doc_id, sz, b.source, l.s, l.w, least(l.cap, l.w * l.level) AS target, budget,
    sum(sz) OVER (PARTITION BY b.source ORDER BY r, doc_id NULLS FIRST, sz ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
  FROM base b JOIN lvl l ON b.source IS NOT DISTINCT FROM l.source
), queue AS (
  SELECT v, sum(sum(sz)) OVER (ORDER BY v) AS spent, any_value(budget) AS budget
  FROM (SELECT sz, budget, (cum + e * s)::DOUBLE / w AS v FROM timed, range(2) t(e)) GROUP BY v
), cut AS (SELECT max(v) AS cut FROM queue WHERE spent <= budget)
SELECT doc_id, sz AS size, s AS source_size, coalesce(target, 0) AS target,
  (sz * ((cum::DOUBLE / w <= cut)::INT + ((cum + s)::DOUBLE / w <= cut)::INT))::BIGINT AS taken
FROM timed, cut
"""
