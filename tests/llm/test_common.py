import re
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronoloom.llm.common import Frame, buckets_for, first_by_hash, lean, materialise, slices, text_buffer


def test_frames_tell_clashing_columns_apart(spark):
    df = spark.createDataFrame([(1, "a", "b", 2)], "Text int, text string, other string, n int").toDF("Text", "text", "other", "Other")
    f = Frame(df)
    assert (f.at("text"), f.at("Text"), f.at("OTHER")) == ("c1", "c0", "c2")
    assert f.df.select(*f.originals("other")).columns == ["Text", "text"]
    try:
        f.at("missing")
        raise AssertionError
    except ValueError:
        pass


def test_samples_are_bounded_and_repeat(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 100 == 0, "rare").when(F.col("id") < 20, "few").otherwise("hot").alias("y"))
    got = first_by_hash(rows, "y", "id", 200)
    sizes = {r.y: r["count"] for r in got.groupBy("y").count().collect()}
    assert sizes == {"rare": 200, "few": 19, "hot": 200} and got.columns == ["id", "y"]
    again = first_by_hash(rows.repartition(3), "y", "id", 200)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
    assert first_by_hash(rows.limit(0), "y", "id", 5).count() == 0


def test_tables_written_in_few_parts(spark):
    df = spark.range(1000).repartition(7)
    assert materialise(df, "t", 1000).count() == 1000 and materialise(df.limit(0), "t", 0).count() == 0


def test_buffers_of_slices_nulls_and_wide_strings():
    arr = pa.array(["skip", "é", None, "", "xyz"])
    for a in (arr.slice(1), arr.cast(pa.large_string()).slice(1), pa.chunked_array([arr.slice(1, 2), arr.slice(3)])):
        data, offs = text_buffer(a)
        assert [data[s:e].tobytes().decode() for s, e in zip(offs, offs[1:], strict=False)] == ["é", "", "", "xyz"]
    assert text_buffer(pa.array([], pa.string()))[1].tolist() == [0]
    assert list(slices(np.array([0, 5, 6, 20, 21]), 7)) == [(0, 2), (2, 3), (3, 4)]
    assert buckets_for(0) == 16 and buckets_for(10**9) == 1 << 20 == buckets_for(10**12)


def test_workers_give_freed_memory_back():
    """Spark's Python workers live on: what a stage has freed must not stay with them while the next one runs."""

    def held():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    pins = []

    def run(batches):
        for batch in batches:
            parts = [np.ones(12_000) for _ in range(2_500)]
            pins.append(np.ones(12_000))
            assert held() > before + 200 and len(parts) == 2_500
            yield batch

    before = held()
    one = pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])
    assert [b.num_rows for b in lean(run)([one])] == [1] and held() < before + 60


def test_kept_documents_leave_in_slices(spark, monkeypatch):
    """Kept documents leave a worker slice by slice, not as one batch; all that are clean are there."""
    from chronoloom.llm import decontam

    sent = []
    monkeypatch.setattr(decontam, "lean", lambda run: sent.append(run) or run)
    text = "plain words that no item holds " * 9_000
    docs = spark.createDataFrame([(i, text) for i in range(10)] + [(10, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "which of these metals melts at the lowest temperature of all")], "item_id long, text string")
    decontam.without_leaks(docs, bench).count()
    batch = pa.RecordBatch.from_arrays([pa.array(range(11)), pa.array([text] * 10 + [None])], names=["c0", "c1"])
    got = list(sent[-1](iter([batch])))
    assert max(b.num_rows for b in got) < 10 and pa.Table.from_batches(got)["c0"].to_pylist() == list(range(11))
