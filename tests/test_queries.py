import duckdb
import pytest
from nearkey.plans import registry
from nearkey.streaming import keystrokes
from nearkey.sources.tables import star_model

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    found = db.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(found.fetchall(), key=key)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_rankings_follow_the_stream(spark):
    m = star_model(spark, SF)
    got = keystrokes.keystroke_rankings(keystrokes.event_keys(spark, SF), m.keywords, m.labels, 7, k=3, tau=1)
    assert set(got.columns) == {"qid", "begun", "step", "text", "rank", "vertex", "dist", "ped", "score", "trigger"}
