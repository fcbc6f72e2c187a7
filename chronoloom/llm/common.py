"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets that one ranking uses, at most: their sums are put in order in one task. Beyond 500 million rows buckets hold
#: more than 500 narrow rows each (100,000 at 10**11); they are only ever sorted, so that costs no more memory.
MAX_BUCKETS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests) is one made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Narrow rows that one written part of an intermediate table may hold where the count is known.
PART_ROWS = 100_000


def materialise(df: DataFrame, name: str = "part", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at durable files.

    ``rows``, if an upper bound is known, keeps a small table from being written in as many
    parts as the session has shuffle partitions; it never makes more parts than there are.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // PART_ROWS)))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Frame:
    """Positional view of a DataFrame, safe against clashing column names.

    Columns are renamed ``c0, c1, ...``; ``col`` finds one by exact name first, then by
    lower-cased name. ``originals`` gives them back under their own names, except those
    that an operator's outputs replace (an output wins over an input of that name).
    """

    def __init__(self, df: DataFrame):
        self.names = list(df.columns)
        self.df = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def at(self, name: str) -> str:
        for fits in (lambda n: n == name, lambda n: n.lower() == name.lower()):
            for i, n in enumerate(self.names):
                if fits(n):
                    return f"c{i}"
        raise ValueError(f"no column {name!r} among {self.names}")

    def col(self, name: str) -> Column:
        return F.col(self.at(name))

    def originals(self, *replaced: str) -> list[Column]:
        gone = {r.lower() for r in replaced}
        return [F.col(f"c{i}").alias(n) for i, n in enumerate(self.names) if n.lower() not in gone]


def buckets_for(rows: int, per_bucket: int = 500) -> int:
    """A power of two near rows / per_bucket, from 16 to MAX_BUCKETS."""
    want = max(1, rows // per_bucket)
    return int(min(MAX_BUCKETS, max(16, 1 << (want - 1).bit_length())))


def shuffle_key(seed: str, *cols: Column) -> Column:
    """A 60-bit seeded key in [0, 2**60), the same in Spark and in plain SQL (from md5)."""
    parts = [F.coalesce(c.cast("string"), F.lit("~")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 15), 16, 10).cast("long")


def first_by_hash(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """At most ``n`` rows of each value of ``by`` (few values), the first in order of a hash of ``key``.

    Counts of the values give each a hash threshold that lets about twice ``n`` rows through, so
    the rows that are put in order are bounded too, whatever the size of the table.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("n")).collect()
    share = shuffle_key("sample", F.col(key)) / float(1 << 60)
    rates = [x for r in counts for x in (F.lit(r[by]), F.lit(min(1.0, (2 * n + 100) / r["n"])))]
    if not rates:
        return rows
    thinned = rows.withColumn("_share", share).filter(F.col("_share") < F.create_map(*rates)[F.col(by)])
    order = W.partitionBy(by).orderBy("_share", key)
    return thinned.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= n).drop("_share", "_place")


def source_key(source: Column) -> Column:
    """A source as a key that is never null, so joins and windows on it share one partitioning."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def text_buffer(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type)
    kind = np.int64 if wide else np.int32
    _, offs, data = arr.buffers()
    if offs is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def give_back() -> None:
    """Return to the system what Arrow and the C library keep of freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run`` for ``mapInArrow``, giving its freed memory back at the end: Spark's Python workers live on from stage to stage."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def slices(offs: np.ndarray, most: int = 1 << 22):
    """Row ranges whose texts hold about ``most`` bytes together; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j
