"""URL filtering against dated lists by a temporal join (operator 4, DataFrame only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Frame, table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def validity(entries: DataFrame) -> DataFrame:
    """Dated list entries (pattern, listed boolean, day) to intervals: listed from ``since`` until ``until`` (open: null).

    The last entry of a pattern on or before a day decides that day. Of entries on one day,
    an addition wins. Entries with a null pattern or day are void.
    """
    days = entries.filter("pattern is not null and day is not null").groupBy("pattern", "day").agg(F.max("listed").alias("listed"))
    spans = days.withColumn("until", F.lead("day").over(W.partitionBy("pattern").orderBy("day")))
    return spans.filter("listed").select("pattern", F.col("day").alias("since"), "until")


def patterns_of(host: Column, path: Column, labels: int, segments: int) -> Column:
    """Every pattern that may cover a URL: its host, each parent domain ('.' before it) and each path prefix, as deep as the list goes."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    domains = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(max(labels, 1)))), lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, n - i + 1, i), ".")))
    segs = F.filter(F.split(path, "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.least(F.size(segs), F.lit(segments))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segs, 1, i), "/")))
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.concat(F.array(host), domains, F.when((F.size(segs) > 0) & F.lit(segments > 0), prefixes).otherwise(none)))


def filter_urls(captures: DataFrame, entries: DataFrame, *, url: str = "url", day: str = "day") -> DataFrame:
    """Every capture with ``host``, ``blocked``, ``matches`` (patterns active at fetch time), ``pattern`` (the longest) and ``since``.

    Patterns: ``host.name`` (that host), ``.domain`` (it and all below it), ``host/path`` (path
    prefixes by whole segments). Lookups run once for each distinct (URL, day); interval and lookup meet on
    pattern and month, then on the exact day, so neither long lists nor a pattern with many
    dates is compared with every capture. A hot host is a skewed equi-join key, which adaptive
    execution splits; matches are counted before their shuffle. A null or malformed URL has host ''
    and, like a null day, never matches. An input column named as an output is replaced.
    """
    f = Frame(captures)
    spans = validity(entries)
    depth = spans.agg(F.max(F.size(F.split("pattern", r"\."))).alias("labels"), F.max(F.size(F.split("pattern", "/"))).alias("segments")).head()
    seen = f.df.select(F.col(f.at(url)).alias("u"), F.col(f.at(day)).cast("date").alias("d"))
    lookups = seen.filter("u is not null and d is not null").distinct()
    last = lookups.agg(F.max("d").alias("d")).head()["d"]
    month = lambda c: F.trunc(c, "month")
    end = F.least(F.coalesce(F.date_sub("until", 1), F.lit(last).cast("date")), F.lit(last).cast("date"))
    spans = spans.filter(F.col("since") <= F.lit(last).cast("date")).withColumn("m", F.explode(F.sequence(month(F.col("since")), month(end), F.expr("interval 1 month"))))
    wanted = lookups.withColumn("host", url_host(F.col("u"))).withColumn("p", F.explode(F.array_distinct(patterns_of(F.col("host"), url_path(F.col("u")), (depth["labels"] or 1), (depth["segments"] or 1) - 1))))
    hits = wanted.join(spans, (wanted["p"] == spans["pattern"]) & (month(F.col("d")) == F.col("m")) & (F.col("d") >= F.col("since")) & (F.col("until").isNull() | (F.col("d") < F.col("until"))))
    best = F.max(F.struct(F.length("pattern").alias("n"), "pattern", "since"))
    verdicts = hits.groupBy("u", "d").agg(F.count("*").alias("k"), best.alias("best")).withColumnsRenamed({"u": "v_u", "d": "v_d"})
    body = f.df.withColumn("u", F.col(f.at(url))).withColumn("d", F.col(f.at(day)).cast("date"))
    out = body.join(verdicts, (F.col("u") == F.col("v_u")) & (F.col("d") == F.col("v_d")), "left")
    return out.select(
        *f.originals("host", "blocked", "matches", "pattern", "since"),
        url_host(F.col("u")).alias("host"),
        F.coalesce(F.col("k") > 0, F.lit(False)).alias("blocked"),
        F.coalesce("k", F.lit(0)).alias("matches"),
        F.col("best.pattern").alias("pattern"),
        F.col("best.since").alias("since"),
    )


def sample_captures(pages: DataFrame) -> DataFrame:
    """Pages carry no fetch time: a rule on page_id gives each a day of 2023 or 2024."""
    return pages.select("page_id", "url", F.expr("date_add(date '2023-01-01', cast(pmod(page_id * 7919, 730) as int))").alias("day"))


#: The rule for the query's dated list, one row for each kind of pattern: (pattern, share, first day, days listed, relisted after).
LIST_RULES = (("host", 3, 20), ("domain", 9, 100), ("prefix", 5, 200))


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list over all hosts, domains and first path segments of the pages, by a rule on their MD5: added, removed, and for some added again."""
    base = pages.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).filter("host <> ''")
    base = base.withColumn("seg", F.regexp_extract("path", "^/([^/]+)", 1))
    made = None
    kinds = {"host": F.col("host"), "domain": F.concat(F.lit("."), F.substring_index("host", ".", -2)), "prefix": F.when(F.col("seg") != "", F.concat("host", F.lit("/"), F.col("seg")))}
    for kind, every, shift in LIST_RULES:
        names = base.select(kinds[kind].alias("pattern")).filter("pattern is not null").distinct()
        h = names.withColumn("h", F.conv(F.substring(F.md5("pattern"), 1, 8), 16, 10).cast("long")).filter(F.expr(f"h % {every} = 0"))
        rows = h.select("pattern", F.explode(F.expr(f"""array(
            named_struct('listed', true, 'day', date_add(date '2023-01-01', cast({shift} + h % 300 as int))),
            named_struct('listed', false, 'day', date_add(date '2023-01-01', cast({shift} + h % 300 + 60 + h % 97 as int))),
            named_struct('listed', h % 2 = 0, 'day', date_add(date '2023-01-01', cast({shift} + h % 300 + 60 + h % 97 + 90 as int))))""")).alias("x"))
        rows = rows.select("pattern", "x.listed", "x.day")
        made = rows if made is None else made.unionByName(rows)
    return made


def op4_urlfilter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = filter_urls(sample_captures(pages), sample_list(pages))
    return out.select("page_id", "url", F.col("day").cast("string").alias("day"), "host", "blocked", "matches", "pattern", F.col("since").cast("string").alias("since"))


def _list_sql(kind: str, every: int, shift: int) -> str:
    pattern = {"host": "host", "domain": "'.' || regexp_extract(host, '([^.]*\\.)?[^.]*$')", "prefix": "CASE WHEN seg <> '' THEN host || '/' || seg END"}[kind]
    names = f"SELECT pattern, ('0x' || substr(md5(pattern), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT {pattern} AS pattern FROM hosts WHERE host <> '') WHERE pattern IS NOT NULL"
    day = f"DATE '2023-01-01' + ({shift} + h % 300"
    return f"""
      SELECT pattern, true AS listed, {day})::INT AS day FROM ({names}) WHERE h % {every} = 0
      UNION ALL SELECT pattern, false, {day} + 60 + h % 97)::INT FROM ({names}) WHERE h % {every} = 0
      UNION ALL SELECT pattern, h % 2 = 0, {day} + 60 + h % 97 + 90)::INT FROM ({names}) WHERE h % {every} = 0"""


OP4_SQL = f"""
WITH hosts AS (
  SELECT page_id, url, DATE '2023-01-01' + ((page_id * 7919) % 730)::INT AS day,
    lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host, regexp_extract(coalesce(url, ''), '{PATH}', 1) AS path,
    regexp_extract(regexp_extract(coalesce(url, ''), '{PATH}', 1), '^/([^/]+)', 1) AS seg
  FROM pages
), entries AS ({" UNION ALL ".join(_list_sql(*r) for r in LIST_RULES)}
), days AS (SELECT pattern, day, bool_or(listed) AS listed FROM entries GROUP BY ALL
), spans AS (SELECT pattern, listed, day AS since, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS until FROM days
), hits AS (
  SELECT h.page_id, s.pattern, s.since FROM hosts h JOIN spans s ON s.listed AND h.day >= s.since AND (s.until IS NULL OR h.day < s.until)
    AND (s.pattern = h.host OR (s.pattern LIKE '.%' AND ends_with('.' || h.host, s.pattern)) OR (contains(s.pattern, '/') AND starts_with(h.host || h.path || '/', s.pattern || '/')))
), best AS (SELECT page_id, count(*) AS k, max({{'n': length(pattern), 'pattern': pattern, 'since': since}}) AS b FROM hits GROUP BY page_id)
SELECT h.page_id, h.url, h.day::VARCHAR AS day, h.host, coalesce(k > 0, false) AS blocked, coalesce(k, 0) AS matches,
  b.pattern AS pattern, b.since::VARCHAR AS since
FROM hosts h LEFT JOIN best USING (page_id)
"""
