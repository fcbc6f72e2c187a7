"""WARC records and Merkle fixity audits of replicas (operator 9)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Frame, materialise, table

#: Records of one archive file, by id range.
FILE_IDS = 500
#: Bytes of a leaf's offset range, and children of an inner node.
RANGE_BYTES = 1 << 16
FANOUT = 16


def record_text(record_id: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.1 response record; null url or payload count as empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


#: Files over which records without an id are spread, by digest.
NAMELESS_FILES = 4_096


def records_of(pages: DataFrame, file_ids: int, *more: Column) -> DataFrame:
    """page_id, file_no, length and digest of every page's record, and columns made of ``rec``."""
    f = Frame(pages)
    rec = record_text(f.col("page_id"), f.col("url"), f.col("html"))
    rows = f.df.select(f.col("page_id").alias("page_id"), rec.alias("rec"))
    digest = F.sha2("rec", 256)
    nameless = -1 - F.conv(F.substring(digest, 1, 3), 16, 10).cast("long") % NAMELESS_FILES
    number = F.coalesce(F.floor(F.col("page_id") / file_ids).cast("long"), nameless).alias("file_no")
    return rows.select("page_id", number, F.octet_length("rec").cast("long").alias("length"), digest.alias("digest"), *more)


def offset_in_file() -> Column:
    before = W.partitionBy("file_no").orderBy("page_id", "digest").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")


def archive(pages: DataFrame, file_ids: int = FILE_IDS) -> DataFrame:
    """Record table of an archive: file_no, offset, length, page_id and digest (SHA-256 of the record's bytes).

    A file holds an id range; records without an id are dealt by digest to files -1 to -4096. A file's records
    stand in id order, then digest order, end to end. Only digests and lengths are shuffled, never
    payloads. Pages may have columns of any other names; repeated pages are records of their own.
    """
    return records_of(pages, file_ids).select("file_no", offset_in_file(), "length", "page_id", "digest")


def leaves(records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Leaf nodes (file_no, idx, hash): the hash over the records that begin in each offset range, in order.

    A range holds at most range_bytes / (bytes of the shortest record) records, so no group grows with the data.
    """
    idx = F.expr(f"offset div {range_bytes}L")
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "digest")))
    joined = F.array_join(F.transform(parts, lambda x: F.concat_ws(":", x["offset"].cast("string"), x["length"].cast("string"), x["digest"])), ";")
    return records.groupBy("file_no", idx.alias("idx")).agg(F.sha2(joined, 256).alias("hash"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level up: a node's hash covers its children's indexes and hashes in order."""
    kids = F.sort_array(F.collect_list(F.struct("idx", "hash")))
    joined = F.array_join(F.transform(kids, lambda x: F.concat_ws(":", x["idx"].cast("string"), x["hash"])), ";")
    return nodes.groupBy("file_no", F.expr(f"idx div {fanout}L").alias("idx")).agg(F.sha2(joined, 256).alias("hash"))


def tree(records: DataFrame, levels: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves up; every level is a written table. The top level's only node of a file (idx 0) is its root."""
    out = [materialise(leaves(records, range_bytes), "merkle")]
    for _ in range(levels - 1):
        out.append(materialise(parents(out[-1], fanout), "merkle"))
    return out


def levels_for(records: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> int:
    """Levels that bring the longest file to one node."""
    n = (records.agg(F.max("offset").alias("x")).head()["x"] or 0) // range_bytes + 1
    levels = 1
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def _mismatched(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select(F.col("file_no").alias("b_file"), F.col("idx").alias("b_idx"), F.col("hash").alias("b_hash"))
    both = a.join(b, (F.col("file_no") == F.col("b_file")) & (F.col("idx") == F.col("b_idx")), "full_outer")
    return both.filter(~F.col("hash").eqNullSafe(F.col("b_hash"))).select(F.coalesce("file_no", "b_file").alias("file_no"), F.coalesce("idx", "b_idx").alias("idx"))


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records on which two replicas' record tables differ: file_no, offset, status, ids, lengths and digests of either side, and r_offset.

    Roots are compared first; on each level down only children of mismatching nodes are read and
    compared, and records only of mismatching ranges. status: ``altered`` (the record's other bytes),
    ``missing`` (only left), ``extra`` (only right) or ``moved`` (the same bytes at another offset of the file, as
    after a record lost before it). Records without an id are told altered by their offset. Equal or
    two empty replicas give no row. Of repeated records the first of one side meets the first of the other.
    """
    levels = max(levels_for(left, range_bytes, fanout), levels_for(right, range_bytes, fanout))
    one, two = tree(left, levels, range_bytes, fanout), tree(right, levels, range_bytes, fanout)
    bad = _mismatched(one[-1], two[-1])
    for a, b in zip(one[-2::-1], two[-2::-1], strict=True):
        up = bad.select(F.col("file_no").alias("p_file"), F.col("idx").alias("p_idx"))
        under = (F.col("file_no") == F.col("p_file")) & (F.expr(f"idx div {fanout}L") == F.col("p_idx"))
        bad = materialise(_mismatched(a.join(up, under, "left_semi"), b.join(up, under, "left_semi")), "merkle-bad")
    up = bad.select(F.col("file_no").alias("p_file"), F.col("idx").alias("p_idx"))
    under = (F.col("file_no") == F.col("p_file")) & (F.expr(f"offset div {range_bytes}L") == F.col("p_idx"))
    columns = ["file_no", "offset", "length", "page_id", "digest"]
    nth = F.row_number().over(W.partitionBy("file_no", "digest").orderBy("offset", "page_id"))
    a = materialise(left.join(up, under, "left_semi").select(*columns, nth.alias("nth")), "merkle-left")
    b = materialise(right.join(up, under, "left_semi").select(*[F.col(c).alias(f"r_{c}") for c in columns], F.row_number().over(W.partitionBy("file_no", "digest").orderBy("offset", "page_id")).alias("r_nth")), "merkle-right")
    same = (F.col("file_no") == F.col("r_file_no")) & (F.col("digest") == F.col("r_digest")) & (F.col("nth") == F.col("r_nth"))
    moved = a.join(b, same).filter("offset <> r_offset").withColumn("status", F.lit("moved"))
    a, b = a.join(b, same, "left_anti"), b.join(a, same, "left_anti")
    name = lambda p: F.coalesce(F.concat(F.lit("id "), F.col(f"{p}page_id").cast("string")), F.concat(F.lit("at "), F.col(f"{p}offset").cast("string")))
    a = a.withColumn("name", name("")).withColumn("which", F.row_number().over(W.partitionBy("file_no", "name").orderBy("offset")))
    b = b.withColumn("r_name", name("r_")).withColumn("r_which", F.row_number().over(W.partitionBy("r_file_no", "r_name").orderBy("r_offset")))
    both = a.join(b, (F.col("file_no") == F.col("r_file_no")) & (F.col("name") == F.col("r_name")) & (F.col("which") == F.col("r_which")), "full_outer")
    both = both.withColumn("status", F.when(F.col("r_file_no").isNull(), "missing").when(F.col("file_no").isNull(), "extra").otherwise("altered"))
    out = [F.coalesce("file_no", "r_file_no").alias("file_no"), F.coalesce("offset", "r_offset").alias("offset"), "status", F.coalesce("page_id", "r_page_id").alias("page_id"), "length", "r_length", "digest", "r_digest", "r_offset"]
    return both.select(*out).unionByName(moved.select(*out))


#: The damage that the query's second replica suffers, as SQL that Spark and DuckDB both read.
ALTERED = "page_id % 37 = 5 AND length(html) > 0"
LOST = "(page_id // 500) % 7 = 3 AND page_id % 500 >= 460"


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with one byte of some payloads altered and the last records of some files lost."""
    f = Frame(pages)
    pages = f.df.select(*[f.col(c).alias(c) for c in ("page_id", "url", "html")])
    lost = LOST.replace("page_id // 500", "page_id div 500")
    html = F.when(F.expr(ALTERED), F.expr("concat(substring(html, 1, length(html) - 1), if(endswith(html, '!'), '?', '!'))")).otherwise(F.col("html"))
    return pages.filter(f"NOT coalesce({lost}, false)").withColumn("html", html)


def op9_fixity(spark, sf_dir: str) -> DataFrame:
    """Pages as an archive against a replica damaged by a fixed rule: every altered or lost record, located by descent."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return audit(materialise(archive(pages), "warc-a"), materialise(archive(damaged(pages)), "warc-b")).drop("r_offset")


def _archive_sql(src: str) -> str:
    return f"""
  SELECT *, coalesce(sum(length) OVER (PARTITION BY file_no ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM (SELECT page_id, page_id // {FILE_IDS} AS file_no, strlen(rec)::BIGINT AS length, sha256(rec) AS digest
    FROM (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM {src}))"""


OP9_SQL = f"""
WITH spoilt AS (
  SELECT page_id, url, CASE WHEN {ALTERED} THEN html[:-2] || CASE WHEN ends_with(html, '!') THEN '?' ELSE '!' END ELSE html END AS html
  FROM pages WHERE NOT ({LOST})
), a AS ({_archive_sql("pages")}
), b AS ({_archive_sql("spoilt")}
)
SELECT a.file_no, a."offset", CASE WHEN b.file_no IS NULL THEN 'missing' ELSE 'altered' END AS status, a.page_id,
  a.length, b.length AS r_length, a.digest, b.digest AS r_digest
FROM a LEFT JOIN b ON a.file_no = b.file_no AND a."offset" = b."offset"
WHERE b.digest IS DISTINCT FROM a.digest
"""

_HEAD = re.compile(rb"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n")
_MARK = b"WARC/1."


def write_archive(pages: DataFrame, path: str, file_ids: int = FILE_IDS) -> None:
    """Write the archive's bytes as Parquet rows (file_no, offset, record binary), one folder a file."""
    rows = records_of(pages, file_ids, F.col("rec").cast("binary").alias("record"))
    rows.select("file_no", offset_in_file(), "record").write.partitionBy("file_no").parquet(path)


def split_records(raw: bytes) -> Iterator[tuple[int, int, str | None]]:
    """(offset, end, problem) of every record of a WARC file's bytes; together they cover the whole file.

    A record that cannot be read runs on to the next one that begins as a record does. problem: null,
    ``no record`` (bytes that begin none), ``cut header``, ``no length``, ``cut payload`` or ``bad end``.
    """
    at = 0
    while at < len(raw):
        head = raw.find(b"\r\n\r\n", at)
        found = _HEAD.search(raw, at, head + 2) if head >= 0 else None
        end = head + 4 + int(found[1]) + 4 if found else 0
        if not raw.startswith(_MARK, at):
            problem = "no record"
        elif head < 0:
            problem = "cut header"
        elif not found:
            problem = "no length"
        elif end > len(raw):
            problem = "cut payload"
        else:
            problem = None if raw[end - 4 : end] == b"\r\n\r\n" else "bad end"
        if problem:
            later = raw.find(_MARK, at + 1)
            end = later if later >= 0 else len(raw)
        yield at, end, problem
        at = end


def read_warc(df: DataFrame) -> DataFrame:
    """Records of whole WARC files (``path``, ``content`` as from the binaryFile source): path, offset, length, digest, problem.

    Damaged files are read to their end: what cannot be read is a row with its ``problem``. A null content has no rows.
    """
    f = Frame(df)
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("problem", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = content.as_py() or b""
                rows = [(path.as_py(), a, b - a, hashlib.sha256(raw[a:b]).hexdigest(), problem) for a, b, problem in split_records(raw)]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return f.df.select(f.col("path"), f.col("content")).mapInArrow(run, "path string, offset bigint, length bigint, digest string, problem string")
