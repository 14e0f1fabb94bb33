"""Hot keys, plan shapes and joins that must stay whole."""
from pyspark.sql import functions as F

from feedscope.operators import dedup, joins, ranking
from feedscope.plans import corpus as C, health as H


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(spark, n=3000):
    """A third of the rows share one key, another tenth has none."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(n).select("id", key.alias("key"))


def test_group_limit_runs_before_the_shuffle(spark):
    text = plan(dedup.first_per_key(skewed(spark), ["key"], [F.col("id")]))
    assert text.count("WindowGroupLimit") == 2 and text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_salted_join_is_whole(spark):
    rows = skewed(spark)
    facts = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"))
    hot = joins.hot_keys(rows, ["key"], fraction=1.0, least=500)
    assert hot == [("hot",)]
    for how in ("left", "inner", "left_anti", "left_semi"):
        want = rows.join(facts, "key", how)
        got = joins.salted_join(rows, facts, ["key"], how, salts=8, hot=hot)
        assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_lookup_join_goes_by_bytes(spark):
    """No job while the plan is built and no hint for facts of unknown size."""
    rows, facts = skewed(spark), spark.range(50).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.col("id").alias("v"))
    free, stated = joins.lookup_join(rows, facts, ["key"]), joins.lookup_join(rows, facts, ["key"], known_rows=50)
    assert "BroadcastHashJoin" in plan(stated)
    assert sorted(free.collect(), key=repr) == sorted(stated.select(*free.columns).collect(), key=repr)
    spark.sparkContext.setJobGroup("planning", "")
    joined = joins.lookup_join(rows, facts.groupBy("key").agg(F.max("v").alias("v")), ["key"])
    assert "Hint" not in joined._jdf.queryExecution().logical().toString()
    assert not list(spark.sparkContext.statusTracker().getJobIdsForGroup("planning"))


def test_hot_lists_of_many_keys(spark):
    rows = spark.range(100).select(F.col("id").alias("a"), F.col("id").alias("b"))
    hot = [(i, i) for i in range(1000)]
    assert joins.salted_join(rows, rows.withColumn("v", F.lit(1)), ["a", "b"], "inner", hot=hot, salts=2).count() == 100


def test_long_titles_keep_their_own_keys(spark):
    rows = spark.createDataFrame([(1, "a" * 130 + "b"), (2, "a" * 130 + "c"), (3, "a" * 130 + "B")], "id int, title string")
    assert sorted(r["id"] for r in dedup.by_title(rows, [F.col("id")], id_col="id").collect()) == [1, 2]


def test_global_rank_matches_window(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 101).alias("score"))
    ranked = ranking.global_rank(df, [F.col("score").desc(), F.col("id")])
    rows = sorted(ranked.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, 5001))
    assert [(r["score"], r["id"]) for r in rows] == sorted(((r["score"], r["id"]) for r in rows), key=lambda x: (-x[0], x[1]))


def test_deep_page_equals_window_page(spark, monkeypatch):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("score"), F.lit(None).cast("timestamp").alias("published_at"))
    direct = ranking.page(df, ranking.importance_order(), 7, 50)
    monkeypatch.setattr(ranking, "DIRECT_RANK_ROWS", 10)
    deep = ranking.page(df, ranking.importance_order(), 7, 50)
    assert sorted(direct.collect()) == sorted(deep.select(*direct.columns).collect())


def test_filters_and_columns_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = plan(C.thin_notes(df.where("lang = 'en'"), 50, "text").select("doc_id"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in text
    assert "n_chars" not in text.split("ReadSchema")[1]


def test_link_resolution_brute_force(spark):
    names = ["alpha", "alphabet", "2024-01-05 gamma", "delta", "2024-02-01 delta two", "be", "beta"]
    links = ["alpha", "alphab", "gamma", "delt", "beta max", "zeta", "two", "a"]
    files = spark.createDataFrame([(n, "p/" + n) for n in names], "file_name string, note_path string")
    got = {r["target"]: r["resolved_path"] for r in C.resolve_links(spark.createDataFrame([(x,) for x in links], "target string"), files).collect()}

    def brute(x):
        if x in names:
            return "p/" + x
        hits = {n for n in names if (n.startswith(x) and len(n) > len(x)) or x.startswith(n) or (n[:2] == "20" and n.endswith(x))}
        return "p/" + hits.pop() if len(hits) == 1 else None
    assert got == {x: brute(x) for x in links}


def test_streak_stops_at_ok_and_at_gap(spark):
    rows = [(t, s, ok, 1) for s, marks in {"a": "FFFT", "b": "F-FF", "c": "TFFF", "d": "FFFF"}.items()
            for t, ok in [(10 - i, m == "T") for i, m in enumerate(marks) if m != "-"]]
    df = spark.createDataFrame(rows, "t int, site_id string, ok boolean, n int").withColumn("snap", F.timestamp_seconds(F.col("t") * 3600))
    got = {r["site_id"]: (r["streak"], r["last_ok"] and r["last_ok"].hour) for r in H.failure_streaks(df).collect()}
    assert got == {"a": (3, 7), "b": (1, None), "c": (0, 10), "d": (4, None)}


def test_python_workers_get_small_batches(spark):
    """A worker holds a batch of pages; its rows must not depend on the rows of a task."""
    import pyarrow as pa
    from feedscope.queries.base import Data
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    Data(spark, "/root/testdata/sf0.001")
    size = F.arrow_udf(lambda x: pa.array([len(x)] * len(x), pa.int64()), "long")
    assert spark.range(0, 5000, 1, 1).select(size("id").alias("n")).agg(F.max("n")).first()[0] <= 1000
