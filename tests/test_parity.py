"""Every query against its SQL twin on the smallest tables."""
import datetime
import decimal

import duckdb
import pytest

from feedscope.queries import all_oracles, all_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "events", "labels", "conversations", "benchmark", "orders", "lineitem"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, FOLDER)
    rows, columns = df.collect(), sorted(df.columns)
    assert len(set(columns)) == len(columns)
    sql = all_oracles().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=repr)
    assert got == want


def test_filled_titles_with_tails(spark, tmp_path):
    """Titles that end like a publisher, hold references or are navigation texts: the twin takes them as they are."""
    titles = ["Carbon market report of the week | EPA", "Wind power at sea grows again - Reuters", "Tide &amp; current predictions", "About us", "Photo album",
              "\u2003Blanks around a title\u3000", "\tTabs around a title\t", "Solar parks in the south | ending.in", "", "plain words only"]
    docs = [(i * 40, t + "\nbody", "en", "src1") for i, t in enumerate(titles)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in all_queries()["title_fill_contained"](spark, str(tmp_path)).select("id", "title").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = set(con.execute(f"SELECT id, title FROM ({all_oracles()['title_fill_contained']})").fetchall())
    assert got == want and len(want) == len(titles)
