"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from chronoloom import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if math.isnan(v) else round(float(v), 9)
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    r = duck.execute(plans.SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    want = sorted(repr([norm(row[names.index(c)]) for c in cols]) for row in r.fetchall())
    got = sorted(repr([norm(x) for x in row]) for row in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got == want


def test_label_propagation_goes_on_until_nothing_changes(spark, tmp_path):
    """A chain of suppliers, each of which shares a part with the next: the largest label takes a round for each link."""
    for t in TABLES:
        if t != "lineitem":
            (tmp_path / f"{t}.parquet").symlink_to(f"{DATA}/{t}.parquet")
    con = duckdb.connect()
    con.execute(f"copy (select * replace (i as l_partkey, i + j as l_suppkey) from (select * from '{DATA}/lineitem.parquet' limit 1), range(12) a(i), range(2) b(j)) to '{tmp_path}/lineitem.parquet'")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    got = {(r.node, r.label) for r in plans.QUERIES["label_propagation"](spark, str(tmp_path)).collect()}
    assert got == {(f"S{i}", "S9") for i in range(13)} == set(con.execute(plans.SQL["label_propagation"]).fetchall())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_but_the_entry_names_the_optional_parts():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "chronoloom")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    text = open(os.path.join(folder, f)).read()
                    assert ".llm" not in text and "corpus_pipeline" not in text, f
