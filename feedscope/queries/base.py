"""Registry of the named queries and their DuckDB twins."""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.joins import spread_if_narrow
from ..plans import fixed_values as V, rules, score as scoring
from ..session import checkpoint_root, keep_batches_small, ship_package, use_utc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TABLES = ("documents", "pages", "events", "labels", "conversations", "benchmark", "orders", "lineitem")
SITE_COUNT = len(V.SITES.strip().splitlines())
AS_OF_TEXT = "2024-01-31 00:00:00"
AS_OF_SQL = f"TIMESTAMP '{AS_OF_TEXT}'"

# phrases that make rule hits and near misses; one is put in front of every title
PHRASES = [
    "碳市场扩围启动，成交破亿元", "关于印发新能源规划的通知", "AI对气候研究的影响", "新ev车投产", "欧盟CBAM碳关税解读",
    "New data center for AI agent", "He said development targets", "The us policy framework", "Focus markets copper",
    "国家能源局储能示范项目", "印度光伏技术突破", "Japan hydrogen battery", "Net-zero roadmap", "郑栅洁谈双碳目标",
    "林伯强：专家解读碳价", "周海兵副主任谈电力市场", "Global climate policy", "EU carbon border", "英伟达芯片大模型",
    "绿色金融债券融资", "哥斯达黎加碳中和", "中国煤炭产量统计数据", "EV charging", "COP29 climate COP", "Copper fund",
    "Wildlife conservation", "数据报告年报", "新闻发布会通报", "张玉昕分析师首席", "傅强：电网消纳", "solar wind power",
    "Emission reduction in Brazil", "LNG oil natural gas", "AIGC taiyang news", "net zero ETS", "Home",
    "循环经济资源循环", "白皮书承诺路线图", "plain words only", "ESG",
]
SITE_IDS = [line.split("|")[0] for line in V.SITES.strip().splitlines()] + ["unlisted", "unknown_site"]

BASE_SQL = {
    # one row per document; the site, phrase and time come from the id
    "items": f"""
SELECT doc_id AS id,
       split_part('{",".join(SITE_IDS)}', ',', CAST(doc_id % {len(SITE_IDS)} + 1 AS INT)) AS site_id,
       concat(split_part('{"|".join(PHRASES)}', '|', CAST(doc_id % {len(PHRASES)} + 1 AS INT)), ' ',
              split_part(text, chr(10), 1)) AS title,
       CASE WHEN doc_id % 9 = 0 THEN '' ELSE
         concat(CASE WHEN doc_id % 6 = 0 THEN
                  concat(split_part('{"|".join(PHRASES)}', '|', CAST(doc_id % 37 + 1 AS INT)), ' ') ELSE '' END,
                text) END AS summary,
       concat('https://', source, '.example.org/', CAST(CAST(floor(doc_id / 40) AS BIGINT) AS VARCHAR(20)),
              CASE WHEN doc_id % 3 = 0 THEN '/' ELSE '' END) AS url,
       CASE WHEN doc_id % 11 = 0 THEN NULL
            ELSE TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' MINUTE * CAST(doc_id % 20000 * 113 AS INT) END AS published_at,
       TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' HOUR * CAST(doc_id % 2000 AS INT) AS first_seen_at,
       lang, text AS body
FROM {{documents}}""",
    # the documents as they are: first line as title, source as site
    "articles": """
SELECT doc_id AS id, source AS site_id, split_part(text, chr(10), 1) AS title,
       text AS summary,
       concat('https://', source, '.example.org/', CAST(CAST(floor(doc_id / 40) AS BIGINT) AS VARCHAR(20)),
              '?ref=', lang) AS url,
       CASE WHEN doc_id % 11 = 0 THEN NULL
            ELSE TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '1' MINUTE * CAST(doc_id % 20000 * 113 AS INT) END AS published_at,
       lang, text AS body
FROM {documents}""",
    "health": """
SELECT date_trunc('hour', ts) AS snap, event_type AS site_id, count(*) AS n, avg(value) >= 25 AS ok
FROM {events} GROUP BY 1, 2""",
}


class Data:
    """The given tables of one folder and what the queries derive from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = keep_batches_small(use_utc(spark)), folder
        ship_package(spark)

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread_if_narrow(df) if name in ("documents", "pages") else df

    def sql(self, text: str) -> DataFrame:
        used = [t for t in TABLES if "{" + t + "}" in text]
        views = [b for b in BASE_SQL if "{" + b + "}" in text]
        frames = {t: self.table(t) for t in used} | {b: self.base(b) for b in views}
        return self.spark.sql(text, **frames)

    def base(self, name: str) -> DataFrame:
        df = self.sql(BASE_SQL[name])
        return df.withColumn("snap", F.col("snap").cast("timestamp")) if name == "health" else df

    @property
    def as_of(self):
        return F.lit(AS_OF_TEXT).cast("timestamp")

    @property
    def sites(self) -> DataFrame:
        return rules.registry(self.spark)

    def items(self) -> DataFrame:
        return self.base("items")

    def articles(self) -> DataFrame:
        return self.base("articles")

    def with_sites(self) -> DataFrame:
        return scoring.with_site_facts(self.items(), self.sites, known_rows=SITE_COUNT)

    def classified(self) -> DataFrame:
        return scoring.classify(self.with_sites())

    def scored(self) -> DataFrame:
        return scoring.score(self.classified(), self.as_of)


def run_folder(d: Data, name: str) -> str:
    """A new folder on the shared store."""
    return f"{checkpoint_root(d.spark).rstrip('/')}/feedscope/{name}-{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None):
    """Register ``fn(data) -> DataFrame`` and, when SQL can say it, its twin."""
    def keep(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Data(spark, folder))
        run.__name__, run.__doc__ = name, fn.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


# ------------------------------------------------------------------ DuckDB side
def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has_any(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quoted(w.lower())})" for w in words) + ")"


def has_any_short_alone(expr: str, words, short: int = 3) -> str:
    tight = [w.lower() for w in words if w.isascii() and w.isalpha() and len(w) <= short]
    free = [w for w in words if w.lower() not in tight]
    parts = [has_any(expr, free)] if free else []
    if tight:
        parts.append(f"regexp_matches({expr}, '(^|[^a-z])({'|'.join(tight)})([^a-z]|$)')")
    return "(" + " OR ".join(parts) + ")"


def ladder(pairs, other) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {other} END"


@lru_cache
def duck_ctes() -> dict[str, str]:
    rows = []
    for rank, line in enumerate(V.SITES.strip().splitlines()):
        s, n, lib, g, sc, r, k, c = line.split("|")
        w = 504 if s in V.SITES_SLOW else 168 if s in V.SITES_WEEKLY else 96
        rows.append(f"({quoted(s)},{quoted(n)},{quoted(lib)},{quoted(g)},{sc},{quoted(r)},{quoted(k)},{quoted(c)},{w},{rank})")
    t, x = "lower(coalesce(title,''))", "lower(concat_ws(' ', coalesce(title,''), coalesce(summary,'')))"
    relevance_tight = [w.lower() for w in V.RELEVANCE if w.isascii() and len(w) <= 4]
    relevance_free = [w for w in V.RELEVANCE if w.lower() not in relevance_tight]
    edge = r"[^\p{L}\p{N}_]"
    strength = {d: ladder([(has_any("xl", ws), p) for p, ws in tiers], V.STRENGTH_DEFAULT)
                for d, tiers in V.STRENGTH_TIERS.items()}
    dim = ladder([
        ("site_class = 'ai'", "'AI'"),
        (f"site_class = 'tech' AND {has_any('xl', V.AI_WORDS)}", "'AI'"), ("site_class = 'tech'", "'产业'"),
        (has_any("tl", V.GOVERNMENT_WORDS), "'政策'"), (has_any("xl", V.FINANCE_WORDS), "'市场信号'"),
        (has_any("xl", V.DUAL_CARBON_WORDS), "'产业'"),
        (has_any("tl", V.AI_WORDS) + " OR regexp_matches(tl, '(^|[^a-z])ai([^a-z]|$)')", "'AI'"),
        (has_any("xl", V.INDUSTRY_WORDS), "'产业'"), ("library = 'policy'", "'政策'"),
        (has_any("xl", V.POLICY_WEAK_WORDS), "'政策'")], "'产业'")
    points = {}
    for n, role in V.PEOPLE:
        points[n] = next((p for p, ws in V.ROLE_TIERS if any(w in role for w in ws)), 0)
    people_points = ladder([("(" + " OR ".join(f"list_contains(people, {quoted(n)})" for n, q in points.items() if q == p)
                             + ")", p) for p in sorted(set(points.values()), reverse=True) if p], 0)
    hours = f"(epoch_us({AS_OF_SQL}) - epoch_us(published_at)) / 3.6e9"
    relevant = ladder([
        ("site_class IN ('green','ai','robot')", "TRUE"),
        ("site_class IN ('tech','ai_media','social')", f"{has_any('xl', V.RELEVANCE)} OR {has_any('xl', V.AI_WORDS)}")],
        f"{has_any('tl', relevance_free)} OR regexp_matches(tl, '(^|{edge})({'|'.join(relevance_tight)})({edge}|$)') "
        f"OR (NOT contains(lower(url), 'news.google.com') AND {has_any('lower(url)', V.RELEVANCE)})")
    return {
        **{k: v.replace("{documents}", "documents").replace("{events}", "events") for k, v in BASE_SQL.items()},
        "registry": "SELECT * FROM (VALUES " + ",".join(rows) + ") AS r(site_id, site_name, library, grp, authority, "
                    "home_region, site_class, category, window_hours, site_rank)",
        "sited": f"""SELECT i.*, coalesce(r.library,'policy') AS library, coalesce(r.grp,'其他') AS grp,
            coalesce(r.authority,10) AS authority, coalesce(r.home_region,'') AS home_region,
            coalesce(r.site_class,'keyword') AS site_class, coalesce(r.category,'other') AS category,
            coalesce(r.window_hours,96) AS window_hours, r.site_name AS site_name,
            {t} AS tl, {x} AS xl FROM items i LEFT JOIN registry r USING (site_id)""",
        "classified": f"""SELECT *, {dim} AS dimension,
            {ladder([(has_any('tl', ws), quoted(n)) for n, ws in V.REGIONS], "coalesce(nullif(home_region,''),'国际')")} AS region,
            list_filter([{", ".join(f"CASE WHEN {has_any_short_alone('tl', ws)} THEN {quoted(tag)} END" for tag, ws in V.TOPIC_TAGS)}],
                        lambda v: v IS NOT NULL) AS topics,
            list_filter([{", ".join(f"CASE WHEN contains(concat_ws(' ', title, summary), {quoted(n)}) THEN {quoted(n)} END" for n, _ in V.PEOPLE)}],
                        lambda v: v IS NOT NULL) AS people,
            {relevant} AS relevant FROM sited""",
        "parts": f"""SELECT *, authority AS src_score,
            CASE dimension WHEN '产业' THEN {strength['产业']} WHEN '市场信号' THEN {strength['市场信号']}
                           WHEN 'AI' THEN {strength['AI']} ELSE {strength['政策']} END AS strength,
            {ladder([(has_any('xl', ws), p) for p, ws in V.TOPIC_TIERS], V.TOPIC_DEFAULT)} AS topic,
            {people_points} AS people_score,
            CASE WHEN published_at IS NULL THEN 0 WHEN {hours} < 24 THEN 10 WHEN {hours} < 48 THEN 8
                 WHEN {hours} < 72 THEN 6 WHEN {hours} < 96 THEN 4 ELSE 2 END AS freshness FROM classified""",
        "scored": """SELECT *, CASE WHEN score >= 85 THEN 'S' WHEN score >= 70 THEN 'A' WHEN score >= 55 THEN 'B'
            WHEN score >= 40 THEN 'C' ELSE 'D' END AS score_level FROM (SELECT *,
            least(100, src_score + strength + topic + people_score + freshness) AS score FROM parts) q""",
    }


def chain(base: str, mark: str) -> str:
    """The shared CTEs from ``sited`` to ``scored`` again, over another base; their names end with the mark."""
    ctes, names = duck_ctes(), ["sited", "classified", "parts", "scored"]

    def own(text):
        text = re.sub(r"\bFROM items i\b", f"FROM {base} i", text)
        return re.sub(rf"\bFROM ({'|'.join(names)})\b", rf"FROM \1{mark}", text)
    return ",\n".join(f"{n}{mark} AS ({own(ctes[n])})" for n in names)


NEEDS = {"sited": ["items", "registry"], "classified": ["sited"], "parts": ["classified"], "scored": ["parts"]}


def duck_sql(text: str) -> str:
    """Put the shared CTEs a twin mentions in front of it."""
    ctes, picked = duck_ctes(), []

    def need(name):
        for dep in NEEDS.get(name, []):
            need(dep)
        if name not in picked:
            picked.append(name)
    for name in ctes:
        if re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text, re.I):
            need(name)
    if not picked:
        return text
    # evaluated once: several of these are read more than once
    head = "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({ctes[n]})" for n in picked)
    body = text.strip()
    return head + (",\n" + body[5:] if body[:5].upper() == "WITH " else "\n" + body)
