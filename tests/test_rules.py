"""Classifier cases: regions, topics, short words, tiers."""
import pytest
from pyspark.sql import functions as F

from feedscope.functions import titles as T
from feedscope.plans import fixed_values as V, rules, score as S

REGION_CASES = [
    ("tanpaifang", "欧委会批准某国6000万欧元社会气候计划", "欧盟"), ("tanpaifang", "哥斯达黎加通过联合国技术评审", "国际"),
    ("tanpaifang", "欧盟ETS拟2029扩展航空", "欧盟"), ("tanpaifang", "美国国会重新提出碳移除法案", "美国"),
    ("tanpaifang", "印度拟强制国际航班碳排放报告", "印度"), ("chinaenergy", "天然气库存跌至新低，欧洲能源危机", "欧盟"),
    ("chinaenergy", "中国新能源车震动日本", "中国"), ("chinanecc", "节能研究", "中国"), ("pbc", "两国央行续签协议", "中国"),
    ("radarai", "owner/repo", "国际"), ("huxiu", "Company pays 15亿美元", "中国"), ("us_doe", "Transmission Facility Financing", "美国"),
    ("mongabay", "How plastic infiltrates wildlife", "全球"), ("x", "What does China's plan mean", "中国"),
    ("reuters", "EU weighing options", "欧盟"), ("reuters", "US exit of key climate treaty", "美国"),
    ("reuters", "Focus on tariffs", "美国"),  # "us " inside another word still counts
]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "n int, site_id string, title string, summary string")
    return df.withColumn("url", F.lit("https://a.example/x")).withColumn("published_at", F.lit(None).cast("timestamp"))


def run(spark, rows, pack=rules.RulePack()):
    sites = rules.registry(spark)
    return {r["n"]: r for r in S.classify(S.with_site_facts(frame(spark, rows), sites), pack).collect()}


def test_registry_is_whole(spark):
    reg = rules.registry(spark)
    assert reg.count() == 70 == reg.select("site_id").distinct().count()
    assert reg.where("authority NOT BETWEEN 0 AND 25").count() == 0


def test_regions(spark):
    out = run(spark, [(i, s, t, "") for i, (s, t, _) in enumerate(REGION_CASES)])
    assert [out[i]["region"] for i in range(len(REGION_CASES))] == [w for *_, w in REGION_CASES]


@pytest.mark.parametrize("title,tags", [
    ("AI诉讼仍待解决", ["AI科技"]), ("Education for Climate Day", ["气候变化"]), ("said and tail and Aira", []),
    ("land-use emissions have fallen", ["碳市场"]), ("新ev车", ["电动车"]), ("development level", []), ("COP29", ["气候变化"]), ("copper", []),
])
def test_topics(spark, title, tags):
    assert run(spark, [(0, "x", title, "")])[0]["topics"] == tags


def test_dimension_order(spark):
    rows = [(0, "openai", "plain", ""), (1, "radarai", "repo", "an llm tool"), (2, "radarai", "repo", "a policy framework"),
            (3, "bjx", "某部印发通知，碳价", ""), (4, "bjx", "碳价走高", ""), (5, "bjx", "AI时代稳住碳中和", ""), (6, "bjx", "AI 新趋势", ""),
            (7, "bjx", "He said so", ""), (8, "ndrc", "plain", ""), (9, "bjx", "plain", "white paper"), (10, "bjx", "plain", "big markets")]
    out = run(spark, rows)
    assert [out[i]["dimension"] for i in range(11)] == ["AI", "AI", "产业", "政策", "市场信号", "产业", "AI", "产业", "政策", "政策", "市场信号"]
    strict = run(spark, rows, rules.RulePack(strict_words=True))
    assert strict[10]["dimension"] == "产业"  # ETS no longer hits "markets"


def test_relevance_words_need_borders_in_titles(spark):
    rows = [(0, "caixin", "development of copper", ""), (1, "caixin", "New EV plan", ""), (2, "caixin", "新ev车", ""), (3, "caixin", "（EV）", "")]
    df = rules.lowered(S.with_site_facts(frame(spark, rows).withColumn("url", F.lit("")), rules.registry(spark)))
    got = {r["n"]: r["r"] for r in df.select("n", rules.is_relevant().alias("r")).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True}


def test_strength_default_is_eight(spark):
    df = rules.lowered(frame(spark, [(0, "x", "nothing here", "")]).withColumn("dimension", F.lit(V.DIM_POLICY)))
    assert df.select(rules.strength_score()).first()[0] == 8


def test_deputies(spark):
    df = spark.createDataFrame([(["周海兵"],), (["张玉昕", "林伯强"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(rules.people_score("p")).collect()] == [10, 5, 0]
    assert [r[0] for r in df.select(rules.people_score("p", exact_deputies=True)).collect()] == [7, 5, 0]


def test_freshness_steps(spark):
    now = F.lit("2024-01-10").cast("timestamp")
    df = spark.createDataFrame([("2024-01-11",), ("2024-01-09 00:00:01",), ("2024-01-09",), ("2024-01-08",), ("2024-01-07",), ("2024-01-06",), (None,)], "t string")
    assert [r[0] for r in df.select(rules.freshness_score(F.col("t").cast("timestamp"), now)).collect()] == [10, 10, 8, 6, 4, 2, 0]


@pytest.mark.parametrize("raw,clean", [
    ("How plastic infiltrates wildlife - news - Mongabay", "How plastic infiltrates wildlife"), ("A - in six charts", "A - in six charts"),
    ("标题 - 碳排放交易网", "标题"), ("T - EPA - NOAA - IEA - PIB - DOE", "T"), ("A &quot;b&quot; &#8211; c &#x1F600;", 'A "b" – c 😀'),
    ("正文标题摘要：更多", "正文标题"), ("a | b | reuters.com", "a | b"), ("", ""), ("x - ", "x -"),
])
def test_title_suffix(spark, raw, clean):
    assert spark.range(1).select(T.strip_title_suffix(F.lit(raw))).first()[0] == clean


def test_suffix_fixpoint(spark):
    """One more pass changes nothing."""
    from feedscope.queries.base import Data
    d = Data(spark, "/root/testdata/sf0.001")
    once = d.items().withColumn("t", T.strip_title_suffix(F.concat("title", F.lit(" - news - EPA | reuters.com"))))
    assert once.where(T.strip_title_suffix("t") != F.col("t")).count() == 0
    tails = d.items().withColumn("t", T.strip_agency_tails(F.concat("title", F.lit(" - EPA - NOAA (.gov) - News"))))
    assert tails.where(T.strip_agency_tails("t") != F.col("t")).count() == 0


def test_similarity_against_plain_python(spark):
    import difflib
    pairs = [("Longer wells boost output", "Longer wells boost output and more"), ("abc def", "xyz"), ("", "a"), ("GPT-5 news", "GPT 6 new")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(T.title_similarity("a", "b")).collect()]
    want = [1.0, difflib.SequenceMatcher(None, "abcdef", "xyz").ratio(), 0.0, difflib.SequenceMatcher(None, "gpt5news", "gpt6new").ratio()]
    assert got == pytest.approx(want)


def test_repeated_titles_go_from_summaries(spark):
    from feedscope.functions import text as X
    title = "Carbon market opens in 2024"
    cases = [(title, f"{title} Trading began.", "Trading began"), (title, f"{title} {title}，{title} Trading began.", "Trading began"),
             (title, f"Ab {title} Trading.", "Ab Trading"), (title, f"Abc {title} Trading.", f"Abc {title} Trading."),
             (title, "Carbonmarket opens later", "later"), (title, "Carbon mark", "Carbon mark"), ("abcd", "abcd abcd", "abcd abcd"),
             (title, f"{title} " * 4 + "end", f"{title} end"), (None, "text", "text"), (title, title, ""), (title, "", ""),
             ("长" * 30, "长 " * 40 + "尾", "长 " * 10 + "尾"), ("x" * 5000, "y" * 2 + "x" * 5000, "yy")]
    df = spark.createDataFrame(cases, "t string, s string, w string")
    got = df.select("t", "s", "w", X.without_leading_title(F.col("t"), F.regexp_replace(F.trim("s"), " +", " ")).alias("g")).collect()
    assert [r.g for r in got] == [r.w for r in got]


def test_common_prefixes(spark):
    from feedscope.functions import text as X
    df = spark.createDataFrame([("", "a", 0), ("abc", "abd", 2), ("x" * 1000, "x" * 999 + "y", 999), ("ab", "ab", 2), ("🎉é1", "🎉é2", 2)], "a string, b string, n int")
    assert df.where(X.common_prefix(F.col("a"), F.col("b")) != F.col("n")).count() == 0
    assert df.select(X.place_without_blanks(F.lit("ab c d"), F.lit(2)), X.place_without_blanks(F.lit("ab c d"), F.lit(4))).first()[:] == (3, 7)
