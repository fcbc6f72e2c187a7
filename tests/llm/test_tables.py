import datetime as dt
import hashlib
import os

import duckdb
import numpy as np
import pytest

from chronoloom.llm import ann, fixity, registry, urlfilter

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return con


def flat(rows):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_queries_equal_their_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    rows = want.fetchall()
    assert sorted(names) == cols
    assert flat([[r[names.index(c)] for c in cols] for r in rows]) == flat(df.select(*[f"`{c}`" for c in cols]).collect())


# ---- operator 4

DAY = dt.date


def plain_verdict(url, day, entries):
    import re

    m = re.match(urlfilter.HOST, url or "")
    if not m or day is None:
        return 0
    host = m[1].lower()
    segs = [s for s in re.match(urlfilter.PATH, url)[1].split("/") if s]
    names = {host, *("." + ".".join(host.split(".")[i:]) for i in range(len(host.split(".")))), *(host + "/" + "/".join(segs[: i + 1]) for i in range(len(segs)))}
    hits = 0
    for p in names:
        dated = [(d, on) for q, on, d in entries if q == p and d is not None and d <= day]
        if dated:
            last = max(d for d, _ in dated)
            hits += any(on for d, on in dated if d == last)
    return hits


def test_url_verdicts_against_a_plain_lookup(spark):
    entries = [("a.com", True, DAY(2024, 1, 5)), ("a.com", False, DAY(2024, 3, 1)), ("a.com", True, DAY(2025, 1, 1)), (".b.org", True, DAY(2024, 2, 1)), ("c.net/x/y", True, DAY(2023, 1, 1)), ("c.net/x", True, DAY(2024, 6, 1)), ("c.net/x", False, DAY(2024, 6, 1)), (None, True, DAY(2024, 1, 1)), ("d.de", True, None)]
    urls = ["http://A.com/q?x=1", "https://www.b.org", "https://b.org:8080/", "http://notb.org/", "http://c.net/x/y/z#f", "http://c.net/xy", "ftp://u@c.net//x/", "nonsense", "", None, "http://d.de/", "http://long.example/" + "s/" * 5000]
    days = [DAY(2024, 1, 4), DAY(2024, 1, 5), DAY(2024, 2, 29), DAY(2024, 3, 1), DAY(2024, 7, 1), DAY(2025, 2, 2), None]
    rows = [(i * 10 + j, u, d, "mine") for i, u in enumerate(urls) for j, d in enumerate(days)] * 2
    caps = spark.createDataFrame(rows, "page_id long, url string, day date, blocked string").toDF("page_id", "url", "day", "Host")
    got = urlfilter.filter_urls(caps, spark.createDataFrame(entries, "pattern string, listed boolean, day date")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_verdict(r.url, r.day, entries)
        assert (r.matches, r.blocked) == (want, want > 0), r
    assert urlfilter.filter_urls(caps.limit(0), spark.createDataFrame(entries, "pattern string, listed boolean, day date")).count() == 0
    none = urlfilter.filter_urls(caps, spark.createDataFrame([], "pattern string, listed boolean, day date")).collect()
    assert len(none) == len(rows) and not any(r.blocked for r in none)


# ---- operator 5


def brute(x, ids, queries, k):
    out = {}
    for q in queries:
        qi = ids.index(q)
        s = x @ x[qi]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-s[i], ids[i]))[:k]
        out[q] = [(ids[i], s[i]) for i in order]
    return out


def test_search_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 3000)] + 0.7 * rng.normal(size=(3000, 16))).astype(np.float32).astype(float)
    x[100:1100] = x[100]  # a third of the rows are copies
    ids = list(range(3000))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], "t") for i in ids], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in ann.search(df, leaf_rows=100, fit_rows=1500).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(x, ids, [i for i in ids if i % 20 == 0], 20)
    assert set(got) == set(want)
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and q not in [v for _, v, _ in mine]
        assert [(-s, v) for _, v, s in mine] == sorted((-s, v) for _, v, s in mine)
        for _, v, s in mine:
            assert s == pytest.approx(float(x[q] @ x[v]), abs=1e-12)
        hits += len({v for v, _ in near} & {v for _, v, _ in mine}) if q < 100 or q >= 1100 else 20 * ([v for v, _ in near] == [v for _, v, _ in mine])
    assert hits / (20 * len(want)) >= 0.9


def test_search_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (40, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 2.0]), (1, [1.0, 1.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert ann.search(df.limit(0)).count() == 0
    assert ann.search(df.filter("vec_id = 2")).count() == 0
    more = df.unionByName(spark.createDataFrame([(60, [2.0]), (8, [-3.0])], "vec_id long, embedding array<float>"))
    one = [(r["rank"], r.vec_id, r.score) for r in ann.search(more).filter("query_id = 60").orderBy("rank").collect()]
    assert one == [(1, 6, 2.0), (2, 8, -6.0)]  # vectors of one length are searched among themselves


def test_leaves_that_outgrow_the_sample_are_split(spark, monkeypatch):
    made = []
    graft = ann.Tree.graft
    monkeypatch.setattr(ann.Tree, "graft", lambda self, leaf, sub: (graft(self, leaf, sub), made.append(self))[0])
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2500, 8))
    ids = list(range(2500))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in ids], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, fit_rows=60, leaf_rows=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert made and made[-1].leaves > 60
    assert sorted(set(made[-1].leaf) - {-1}) == list(range(made[-1].leaves))
    assert sorted(made[-1].visit(x[0])) == list(range(made[-1].leaves))
    assert all([r for r, _ in sorted(near)] == list(range(1, 21)) for near in got.values()) and len(got) == 125
    want = brute(x, ids, [i for i in ids if i % 20 == 0], 20)
    assert sum(len({v for _, v in got[q]} & {v for v, _ in near}) for q, near in want.items()) / (20 * len(want)) > 0.5


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_recall(spark, monkeypatch, sf):
    trees = []
    calibrate = ann.calibrate
    monkeypatch.setattr(ann, "calibrate", lambda tree, *a, **o: (trees.append(tree), calibrate(tree, *a, **o))[1])
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    want = brute(x, ids, [i for i in ids if i % 20 == 0], 20)
    got = {}
    for r in ann.op5_ann(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert trees[0].leaves > 4
    assert sum(len(got[q] & {v for v, _ in near}) for q, near in want.items()) / (20 * len(want)) >= 0.9


def test_calibration_widens_until_the_recall_is_reached():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 8))
    tree = ann.Tree(x, 50)
    assert tree.leaves > 10 and sorted(set(tree.assign(x).tolist())) == list(range(tree.leaves))
    few, many = ann.calibrate(tree, x, 10, 0.5), ann.calibrate(tree, x, 10, 0.99)
    assert 1 <= few < many <= tree.leaves
    assert sorted(tree.visit(x[0])) == list(range(tree.leaves))


# ---- operator 9


def test_audit_finds_each_damaged_record_and_no_other(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "b" * (i % 50) if i % 9 else None) for i in range(3000)], "page_id long, url string, html string")
    from pyspark.sql import functions as F

    other = pages.filter("page_id <> 499 and page_id <> 2999").withColumn("html", F.when(F.col("page_id").isin(7, 1200), F.lit("changed!")).otherwise(F.col("html")))
    left, right = fixity.archive(pages), fixity.archive(other)
    got = {(r.file_no, r.offset, r.status) for r in fixity.audit(left, right, range_bytes=2048, fanout=4).collect()}
    a, b = ({r.page_id: (r.file_no, r.offset, r.digest) for r in t.collect()} for t in (left, right))
    want = {(*a[p][:2], "missing" if p not in b else "altered" if a[p][2] != b[p][2] else "moved") for p in a if a[p] != b.get(p)}
    assert got == want and {s for _, _, s in want} == {"missing", "altered", "moved"}
    assert sorted(f for f, _, s in got if s == "missing") == [0, 5]  # lost at the ends of their files: nothing moved there by them
    back = {(r.file_no, r.offset, r.status) for r in fixity.audit(right, left, range_bytes=2048, fanout=4).collect()}
    assert {s for _, _, s in back} == {"extra", "altered", "moved"} and len(back) == len(got)
    assert fixity.audit(left, left).count() == 0
    empty = pages.limit(0)
    assert fixity.audit(fixity.archive(empty), fixity.archive(empty)).count() == 0
    assert fixity.audit(left, fixity.archive(empty)).count() == 3000


def test_a_record_lost_in_mid_file_is_found_as_such(spark):
    pages = spark.createDataFrame([(i, "u", "x" * (i % 7)) for i in range(400)], "page_id long, url string, html string")
    left, right = fixity.archive(pages), fixity.archive(pages.filter("page_id not in (100, 250)"))
    got = {r.page_id: r.status for r in fixity.audit(left, right, range_bytes=1024, fanout=4).collect()}
    assert {p for p, s in got.items() if s == "missing"} == {100, 250}
    assert {p for p, s in got.items() if s == "moved"} == set(range(101, 400)) - {250} and len(got) == 300


def test_damaged_files_are_read_to_their_end(spark):
    rec = lambda i, body: b"WARC/1.1\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(body), body)
    one, two, three = rec(1, b"first\r\n\r\nx"), rec(2, b""), rec(3, b"third")
    files = {
        "whole": (one + two + three, [None, None, None]),
        "cut payload": (one + two + three[:-6], [None, None, "cut payload"]),
        "cut header": (one + two[:20], [None, "cut header"]),
        "no length": (one + two.replace(b"Content-Length", b"Content-Width") + three, [None, "no length", None]),
        "wrong length": (one.replace(b"Length: 10", b"Length: 11") + two, ["bad end", None]),
        "no record": (b"junk" + two, ["no record", None]),
        "empty": (b"", []),
    }
    df = spark.createDataFrame([(k, bytearray(v[0]), 1) for k, v in files.items()] + [("null", None, 1)], "path string, content binary, PATHS int")
    rows = {}
    for r in sorted(fixity.read_warc(df).collect(), key=lambda r: r.offset):
        rows.setdefault(r.path, []).append(r)
    for name, (raw, problems) in files.items():
        own = rows.get(name, [])
        assert [r.problem for r in own] == problems, name
        assert sum(r.length for r in own) == len(raw) and all(x.offset + x.length == y.offset for x, y in zip(own, own[1:], strict=False))
        assert all(r.digest == hashlib.sha256(raw[r.offset : r.offset + r.length]).hexdigest() for r in own)
    assert "null" not in rows


def test_pages_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, "u", "x", 9), (2, "u", None, 9)], "page_id long, url string, html string, other int").withColumnRenamed("other", "PAGE_ID")
    assert sorted(r.page_id for r in fixity.archive(pages).collect()) == [1, 2]
    assert fixity.audit(fixity.archive(pages), fixity.archive(fixity.damaged(pages))).count() == 0


def test_roots_depend_on_every_record_and_its_place(spark):
    base = [(0, 0, 10, 1, "aa"), (0, 10, 10, 2, "bb")]
    roots = set()
    for rows in (base, [(0, 0, 10, 1, "bb"), (0, 10, 10, 2, "aa")], base[:1], [(0, 0, 11, 1, "aa"), base[1]]):
        df = spark.createDataFrame(rows, "file_no long, offset long, length long, page_id long, digest string")
        roots.add(fixity.tree(df, 2)[-1].head().hash)
    assert len(roots) == 4


def test_odd_pages_and_the_bytes_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(None, None, None), (None, None, None), (1, "u", "é" * 70_000), (1, "u", "x\r\n\r\ny")], "page_id long, url string, html string")
    table = fixity.archive(pages)
    assert table.count() == 4
    fixity.write_archive(pages, str(tmp_path / "w"))
    files = {}
    for r in spark.read.parquet(str(tmp_path / "w")).orderBy("file_no", "offset").collect():
        files[r.file_no] = files.get(r.file_no, b"") + bytes(r.record)
        assert len(files[r.file_no]) == r.offset + len(r.record)
    os.makedirs(tmp_path / "raw")
    for k, raw in files.items():
        (tmp_path / "raw" / f"{k}.warc").write_bytes(raw)
    back = fixity.read_warc(spark.read.format("binaryFile").load(str(tmp_path / "raw"))).collect()
    assert sorted((r.offset, r.length, r.digest) for r in back) == sorted((r.offset, r.length, r.digest) for r in table.collect())
    assert all(r.problem is None for r in back)
    nameless = min(files)
    assert nameless < 0 and hashlib.sha256(files[nameless][: len(files[nameless]) // 2]).hexdigest() in {r.digest for r in back}
