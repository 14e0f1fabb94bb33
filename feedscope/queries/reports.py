"""Queries over ranking, digest, graph, analytics and source health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking
from ..plans import analytics, digest, fixed_values as V, health, rank, score as scoring
from ..session import cut_lineage
from ..sources import sinks
from .base import AS_OF_SQL, query, quoted
from .cleaning import digest_summary_sql, digest_title_sql, screen_summary_sql

IMPORTANCE = "score DESC, published_at DESC NULLS LAST, id"


@query("top_items", f"""SELECT rank, id, site_id, title, dimension, region, score, score_level FROM (SELECT *, row_number() OVER (ORDER BY {IMPORTANCE}) AS rank FROM scored) q WHERE rank <= 100""")
def top_items(d):
    """Front page: classify, score, rank; the best hundred."""
    return ranking.top_n(d.scored(), ranking.importance_order(), 100).select(
        "rank", "id", "site_id", "title", "dimension", "region", "score", "score_level")


@query("global_rank", f"SELECT id, row_number() OVER (ORDER BY {IMPORTANCE}) AS rank FROM scored")
def global_rank(d):
    rows = d.scored().select("id", "score", "published_at")
    return ranking.global_rank(rows, ranking.importance_order()).select("id", "rank")


@query("list_page", f"""WITH f AS (SELECT * FROM scored WHERE region <> '中国'), r AS (SELECT id, title, score, row_number() OVER (ORDER BY {IMPORTANCE}) AS rank, count(*) OVER () AS n FROM f)
SELECT rank, id, title, score, 3 AS page, CAST(ceil(n / 20.0) AS INT) AS total_pages FROM r WHERE rank BETWEEN 41 AND 60""")
def list_page(d):
    rows = d.scored().select("id", "title", "score", "published_at", "region", "dimension")
    return rank.list_page(rows, d.as_of, place="abroad", number=3).select("rank", "id", "title", "score", "page", "total_pages")


@query("last_page", f"""WITH r AS (SELECT id, row_number() OVER (ORDER BY published_at DESC NULLS LAST, id) AS rank, count(*) OVER () AS n FROM classified WHERE dimension = 'AI')
SELECT rank, id, CAST(greatest(1, ceil(n / 50.0)) AS INT) AS page, CAST(greatest(1, ceil(n / 50.0)) AS INT) AS total_pages FROM r WHERE rank > 50 * (greatest(1, ceil(n / 50.0)) - 1)""")
def last_page(d):
    """A page number past the end gives the last page."""
    rows = d.classified().select("id", "published_at", "dimension")
    return rank.list_page(rows, d.as_of, dimension=V.DIM_AI, by="newest", number=10**6, size=50).select("rank", "id", "page", "total_pages")


@query("newest_items", "SELECT id, published_at FROM articles ORDER BY published_at DESC NULLS LAST, id LIMIT 50")
def newest_items(d):
    return ranking.top_n(d.articles(), ranking.newest_order(), 50, None).select("id", "published_at")


@query("site_heads", "SELECT id, site_id FROM (SELECT id, site_id, row_number() OVER (PARTITION BY site_id ORDER BY id) AS n FROM articles) q WHERE n <= 15")
def site_heads(d):
    return ranking.per_group_head(d.articles(), ["site_id"], [F.col("id")], 15).select("id", "site_id")


@query("source_union", "SELECT id, site_id, 'doc' AS kind FROM articles UNION ALL SELECT page_id, split_part(url, '/', 3), 'page' FROM pages")
def source_union(d):
    docs = d.articles().select("id", "site_id", F.lit("doc").alias("kind"))
    pages = d.table("pages").select(F.col("page_id").alias("id"), F.split_part("url", F.lit("/"), F.lit(3)).alias("site_id"), F.lit("page").alias("kind"))
    return docs.unionByName(pages)


@query("quota_pick", """WITH q AS (SELECT id, site_id, score, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, id) AS n FROM scored)
SELECT id, site_id, score FROM q WHERE n <= 2 ORDER BY score DESC, id LIMIT 20""")
def quota_pick(d):
    return ranking.quota_then_top(d.scored(), "site_id", [F.col("score").desc(), F.col("id")], 2, 20).select("id", "site_id", "score")


PICK_CTE = f"""WITH c AS (SELECT * FROM scored WHERE score >= 50 AND (published_at IS NULL OR published_at >= {AS_OF_SQL} - INTERVAL 40 DAY)),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rtrim(url, '/') ORDER BY score DESC, id) AS un FROM c) z WHERE un = 1),
s AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, id) AS sn FROM u),
p AS (SELECT * FROM s WHERE sn <= 2 ORDER BY score DESC, id LIMIT 20)"""


def _picked(d):
    named = d.scored().join(F.broadcast(d.sites.select("site_id", "site_name")), "site_id", "left")  # 70 fixed rows
    return digest.pick(named, d.as_of, top=20, min_score=50, per_site=2, max_age_days=40)


@query("digest_candidates", f"SELECT id, score FROM scored WHERE score >= 55 AND (published_at IS NULL OR published_at >= {AS_OF_SQL} - INTERVAL 7 DAY)")
def digest_candidates(d):
    return digest.candidates(d.scored(), d.as_of, min_score=55).select("id", "score")


@query("digest_pick", PICK_CTE + " SELECT id, site_id, dimension, score FROM p")
def digest_pick(d):
    return _picked(d).select("id", "site_id", "dimension", "score")


@query("digest_distribution", PICK_CTE + " SELECT dimension, count(*) AS n FROM p GROUP BY dimension")
def digest_distribution(d):
    return digest.distribution(_picked(d))


DIGEST_SQL = PICK_CTE + f""", t AS (SELECT p.*, {digest_title_sql("coalesce(title,'')")} AS dt FROM p),
ds AS ({digest_summary_sql("SELECT id, dt AS title, summary AS raw FROM t")}),
o AS (SELECT t.*, ds.summary AS sm, row_number() OVER (PARTITION BY dimension ORDER BY score DESC, id) AS no,
  list_position([{", ".join(quoted(x) for x in V.DIMENSIONS)}], dimension) AS dr, CASE dimension {" ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in V.DIMENSION_ICONS.items())} END AS icon FROM t JOIN ds USING (id)),
g AS (SELECT dimension, dr, icon, count(*) AS n, string_agg(concat(no, '. ', dt, '（', coalesce(site_name, ''), CASE WHEN published_at IS NULL THEN '' ELSE concat(' · ', strftime(published_at, '%m-%d')) END, '）⭐', score, chr(10),
  CASE WHEN sm <> '' THEN concat('　　', sm, chr(10)) ELSE '' END, '🔗 ', trim(url), chr(10)), chr(10) ORDER BY no) AS body FROM o GROUP BY 1, 2, 3)
SELECT concat('当日高分浓缩', chr(10), '📅 2024-01-31 ｜ {V.DIGEST_SITES} 个信源 ｜ A级以上精选 ', sum(n), ' 条', chr(10), chr(10),
  string_agg(concat('【', icon, ' ', dimension, ' · ', n, ' 条】', chr(10), body, chr(10), chr(10)), '' ORDER BY dr), '📊 分布：', string_agg(concat(icon, ' ', dimension, ' ', n), ' / ' ORDER BY dr), chr(10)) AS digest FROM g"""


@query("digest_text", DIGEST_SQL)
def digest_text(d):
    return digest.text(_picked(d), "2024-01-31")


@query("clipboard_text", f"""WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY {IMPORTANCE}) AS rank FROM scored) q WHERE rank <= 20),
s AS ({screen_summary_sql("SELECT id, summary AS raw FROM b")})
SELECT rank, concat(rank, '. 【', score, '分】', title, chr(10), '　　', coalesce(site_name, ''), ' · ', dimension, CASE WHEN s.summary <> '' THEN concat(chr(10), '　　', s.summary) ELSE '' END) AS entry FROM b JOIN s USING (id)""")
def clipboard_text(d):
    named = d.scored().join(F.broadcast(d.sites.select("site_id", "site_name")), "site_id", "left")  # 70 fixed rows
    return digest.clipboard(named, ranking.importance_order())


@query("clipboard_heads", f"""SELECT rank, concat(rank, '. 【', score, '分】', title) AS head, concat('　　', coalesce(site_name, ''), ' · ', dimension) AS place
FROM (SELECT *, row_number() OVER (ORDER BY {IMPORTANCE}) AS rank FROM scored) q WHERE rank <= 20""")
def clipboard_heads(d):
    lines = F.split("entry", "\n")
    return clipboard_text(d).select("rank", lines[0].alias("head"), lines[1].alias("place"))


# ---------------------------------------------------------------- graph
@query("topic_nodes", """WITH e AS (SELECT unnest(topics) AS topic FROM classified), c AS (SELECT topic, count(*) AS n FROM e GROUP BY topic)
SELECT topic, n, CAST(22 + floor(n / max(n) OVER () * 38 + 0.5) AS BIGINT) AS size FROM c""")
def topic_nodes(d):
    return rank.topic_nodes(d.classified())


@query("topic_edges", """WITH e AS (SELECT id, unnest(topics) AS t FROM classified)
SELECT a.t AS topic_a, b.t AS topic_b, count(*) AS n FROM e a JOIN e b ON a.id = b.id AND a.t < b.t GROUP BY 1, 2""")
def topic_edges(d):
    return rank.topic_edges(d.classified())


@query("topic_summary", """SELECT (SELECT count(*) FROM classified WHERE len(topics) > 0) AS tagged_items, (SELECT count(DISTINCT t) FROM (SELECT unnest(topics) AS t FROM classified) q) AS topics""")
def topic_summary(d):
    return rank.topic_summary(d.classified())


@query("tag_histogram", "SELECT CAST(len(topics) AS BIGINT) AS tags, count(*) AS n FROM classified GROUP BY 1")
def tag_histogram(d):
    return analytics.tag_count_histogram(d.classified())


# ---------------------------------------------------------------- analytics
@query("site_stats", "SELECT site_id, min(site_name) AS site_name, count(*) AS n FROM sited GROUP BY site_id")
def site_stats(d):
    named = d.items().join(F.broadcast(d.sites.select("site_id", "site_name")), "site_id", "left")  # 70 fixed rows
    return analytics.site_counts(named)


@query("feed_head", f"""WITH k AS (SELECT * FROM classified WHERE relevant AND (published_at IS NULL OR published_at >= {AS_OF_SQL} - INTERVAL 1 HOUR * window_hours)),
r AS (SELECT * FROM sited WHERE published_at IS NULL OR published_at >= {AS_OF_SQL} - INTERVAL 96 HOUR)
SELECT (SELECT count(*) FROM k) AS total_items, (SELECT count(DISTINCT site_id) FROM k) AS site_count, (SELECT count(*) FROM r) AS total_raw, 96 AS window_hours, {AS_OF_SQL} AS generated_at""")
def feed_head(d):
    rows = d.with_sites()
    kept = scoring.in_window(scoring.relevant(rows), d.as_of)
    return sinks.feed_summary(kept, scoring.in_window(rows, d.as_of, F.lit(96)), d.as_of)


@query("dimension_counts", "SELECT dimension, count(*) AS n FROM classified GROUP BY dimension")
def dimension_counts(d):
    return analytics.counts_by(d.classified(), "dimension")


@query("home_region_counts", "SELECT coalesce(nullif(home_region, ''), '未标注') AS home_region, count(*) AS n FROM sited GROUP BY 1")
def home_region_counts(d):
    return analytics.counts_by(d.with_sites(), "home_region", "未标注")


@query("score_histogram", "SELECT CAST(least(19, floor(score / 5.0)) AS BIGINT) AS bin, score_level, count(*) AS n FROM scored GROUP BY 1, 2")
def score_histogram(d):
    return analytics.score_histogram(d.scored())


@query("daily_counts", "SELECT CAST(published_at + INTERVAL 8 HOUR AS DATE) AS day, dimension, count(*) AS n FROM classified WHERE published_at IS NOT NULL GROUP BY 1, 2")
def daily_counts(d):
    return analytics.daily_counts(d.classified())


@query("weekday_counts", "SELECT CAST(isodow(published_at + INTERVAL 8 HOUR) - 1 AS INT) AS weekday, dimension, count(*) AS n FROM classified WHERE published_at IS NOT NULL GROUP BY 1, 2")
def weekday_counts(d):
    return analytics.weekday_counts(d.classified())


@query("top_sources", "SELECT site_id, n, row_number() OVER (ORDER BY n DESC, site_id) AS rank FROM (SELECT site_id, count(*) AS n FROM items GROUP BY 1) q QUALIFY rank <= 15")
def top_sources(d):
    return analytics.top_sources(d.items())


@query("dimension_sources", "SELECT dimension, site_id, n FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, site_id) AS k FROM (SELECT dimension, site_id, count(*) AS n FROM classified GROUP BY 1, 2) q) z WHERE k <= 3")
def dimension_sources(d):
    return analytics.top_sources_per_dimension(d.classified())


@query("score_attainment", """SELECT part, round(rate, 9) AS rate FROM (SELECT avg(src_score / 25.0) AS source, avg(strength / 30.0) AS strength, avg(topic / 25.0) AS topic, avg(people_score / 10.0) AS people, avg(freshness / 10.0) AS freshness FROM parts) q
UNPIVOT (rate FOR part IN (source, strength, topic, people, freshness))""")
def score_attainment(d):
    return analytics.attainment(d.scored()).withColumn("rate", F.round("rate", 9))


@query("strength_spread", "SELECT dimension, min(strength) AS low, quantile_cont(strength, 0.25) AS q1, quantile_cont(strength, 0.5) AS q2, quantile_cont(strength, 0.75) AS q3, max(strength) AS high, count(*) AS n FROM parts GROUP BY dimension")
def strength_spread(d):
    return analytics.strength_spread(d.scored())


@query("authority_scatter", "SELECT dimension, src_score, score, count(*) AS n FROM scored GROUP BY 1, 2, 3")
def authority_scatter(d):
    return analytics.authority_relation(d.scored())


@query("authority_correlation", "SELECT dimension, round(corr(src_score, score), 6) AS corr, count(*) AS n FROM scored GROUP BY 1")
def authority_correlation(d):
    return analytics.authority_correlation(d.scored()).withColumn("corr", F.round("corr", 6))


@query("headline_facts", """SELECT count(*) AS items, round(avg(CASE WHEN score_level IN ('S','A') THEN 1.0 ELSE 0.0 END), 9) AS top_share, round(avg(score), 9) AS mean_score,
 count(DISTINCT CAST(published_at + INTERVAL 8 HOUR AS DATE)) AS days, CAST(median(score) AS DOUBLE) AS median_score, round(count(*) / count(DISTINCT CAST(published_at + INTERVAL 8 HOUR AS DATE)), 9) AS per_day FROM scored""")
def headline_facts(d):
    return analytics.facts(d.scored()).select("items", F.round("top_share", 9).alias("top_share"), F.round("mean_score", 9).alias("mean_score"),
                                              "days", "median_score", F.round("per_day", 9).alias("per_day"))


STOP_SQL = ",".join("'" + w + "'" for w in V.STOP_WORDS)


@query("top_words", rf"""WITH w AS (SELECT dimension, unnest(list_concat(regexp_extract_all(lower(substring(title,1,200)), '[\p{{L}}\p{{N}}]+'), regexp_extract_all(lower(substring(summary,1,200)), '[\p{{L}}\p{{N}}]+'))) AS word FROM classified),
c AS (SELECT dimension, word, count(*) AS n FROM w WHERE length(word) >= 2 AND NOT regexp_matches(word, '^[0-9]+$') AND word NOT IN ({STOP_SQL}) GROUP BY 1, 2)
SELECT dimension, word, n FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, word) AS k FROM c) q WHERE k <= 14""")
def top_words(d):
    return analytics.top_words(d.classified())


@query("junk_share", r"SELECT site_id, count(*) AS n, count(*) FILTER (regexp_matches(title, '\.gov\)|\(EIA\)|Administration|climate|公共服务网')) AS junk FROM items GROUP BY 1")
def junk_share(d):
    return analytics.junk_share(d.items(), r"\.gov\)|\(EIA\)|Administration|climate|公共服务网")


@query("hit_rate", "SELECT site_id, count(*) AS n, count(*) FILTER (relevant) AS hits, round(count(*) FILTER (relevant) / count(*), 9) AS rate FROM classified GROUP BY 1")
def hit_rate(d):
    from ..plans import rules
    out = analytics.hit_rate(rules.lowered(d.with_sites()), "site_id", rules.is_relevant())
    return out.withColumn("rate", F.round("rate", 9))


# ---------------------------------------------------------------- health
@query("health_series", "SELECT snap, count(*) FILTER (ok) AS ok_sites, count(*) FILTER (NOT ok) AS failed_sites, CAST(sum(n) AS BIGINT) AS raw FROM health GROUP BY snap")
def health_series(d):
    return health.snapshot_totals(d.base("health"))


@query("health_retain", "SELECT snap, site_id, n FROM health WHERE snap IN (SELECT DISTINCT snap FROM health ORDER BY snap DESC LIMIT 192)")
def health_retain(d):
    return health.retain(cut_lineage(d.base("health"))).select("snap", "site_id", "n")


@query("health_append", """WITH top AS (SELECT max(snap) AS m FROM health), a AS (SELECT snap, site_id, n FROM health WHERE snap <> (SELECT m FROM top) UNION ALL SELECT snap, site_id, n + 1000 FROM health WHERE snap = (SELECT m FROM top))
SELECT snap, site_id, n FROM a WHERE snap IN (SELECT DISTINCT snap FROM a ORDER BY snap DESC LIMIT 192)""")
def health_append(d):
    series = cut_lineage(d.base("health"))  # read more than once
    last = health.snapshots(series, 1).select("snap")
    entry = series.join(F.broadcast(last), "snap").withColumn("n", F.col("n") + 1000)  # one snapshot time
    return health.append_snapshot(series, entry).select("snap", "site_id", "n")


STREAK_CTE = """WITH s AS (SELECT snap, row_number() OVER (ORDER BY snap DESC) AS age FROM (SELECT DISTINCT snap FROM health) q ORDER BY snap DESC LIMIT 96),
sites AS (SELECT DISTINCT site_id FROM health JOIN s USING (snap)), g AS (SELECT sites.site_id, s.snap, s.age, h.ok FROM sites CROSS JOIN s LEFT JOIN health h ON h.site_id = sites.site_id AND h.snap = s.snap),
stop AS (SELECT site_id, coalesce(min(age) FILTER (ok IS NULL OR ok), 97) AS sat FROM g GROUP BY 1),
k AS (SELECT stop.site_id, sat - 1 AS streak, (SELECT g.snap FROM g WHERE g.site_id = stop.site_id AND g.age = sat AND g.ok) AS last_ok FROM stop)"""


@query("health_streaks", STREAK_CTE + " SELECT site_id, streak, last_ok FROM k")
def health_streaks(d):
    return health.failure_streaks(cut_lineage(d.base("health")))


@query("health_streaks_strict", """WITH health2 AS (SELECT snap, site_id, ok AND n % 3 = 0 AS ok FROM health WHERE n % 7 <> 0),
s AS (SELECT snap, row_number() OVER (ORDER BY snap DESC) AS age FROM (SELECT DISTINCT snap FROM health2) q ORDER BY snap DESC LIMIT 96),
sites AS (SELECT DISTINCT site_id FROM health2 JOIN s USING (snap)), g AS (SELECT sites.site_id, s.snap, s.age, h.ok FROM sites CROSS JOIN s LEFT JOIN health2 h ON h.site_id = sites.site_id AND h.snap = s.snap),
stop AS (SELECT site_id, coalesce(min(age) FILTER (ok IS NULL OR ok), 97) AS sat FROM g GROUP BY 1)
SELECT stop.site_id, sat - 1 AS streak, (SELECT g.snap FROM g WHERE g.site_id = stop.site_id AND g.age = sat AND g.ok) AS last_ok FROM stop""")
def health_streaks_strict(d):
    """The same with more failures and gaps."""
    series = cut_lineage(d.base("health").where("n % 7 <> 0").withColumn("ok", F.col("ok") & (F.col("n") % 3 == 0)))
    return health.failure_streaks(series)


@query("health_board", """SELECT snap, failed, CAST(least(100, greatest(0, CASE WHEN failed = 0 THEN 80 ELSE greatest(0, 50 - 5 * failed) END + CASE WHEN fresh THEN 20 ELSE 0 END + CASE WHEN fresh AND failed = 0 THEN 20 ELSE 0 END)) AS BIGINT) AS score,
  CASE WHEN age < 2 THEN 'ok' WHEN age < 6 THEN 'warn' ELSE 'bad' END AS band,
  CASE WHEN failed = 0 THEN 'green' WHEN fresh AND 50 - 5 * failed + 20 >= 50 OR 50 - 5 * failed >= 50 THEN 'amber' ELSE 'red' END AS colour
FROM (SELECT *, age < 2 AS fresh FROM (SELECT snap, count(*) FILTER (NOT ok) AS failed, date_diff('second', snap, TIMESTAMP '2024-01-31 00:00:00') / 3600.0 AS age FROM health GROUP BY snap) q) z""")
def health_board(d):
    totals = health.snapshot_totals(d.base("health"))
    score = health.health_score(F.col("failed_sites"), F.col("snap"), d.as_of)
    return totals.select("snap", F.col("failed_sites").alias("failed"), score.alias("score"),
                         health.freshness_band(F.col("snap"), d.as_of).alias("band"), health.health_colour(score).alias("colour"))


@query("status_table", """WITH c AS (SELECT site_id, max(snap) AS snap FROM health GROUP BY 1) SELECT h.site_id, h.ok, h.n AS item_count, 'other' AS category FROM health h JOIN c USING (site_id, snap)""")
def status_table(d):
    series = cut_lineage(d.base("health"))  # read more than once
    status = health.latest_entry_per_site(series).select("site_id", "ok", F.col("n").alias("item_count"))
    out = health.status_table(status, health.failure_streaks(series).select("site_id", "streak"), d.sites)
    return out.select("site_id", "ok", "item_count", "category")


@query("half_hour_buckets", """SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS snap, event_type AS site_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def half_hour_buckets(d):
    from ..streaming.ingest import snapshot_counts
    out = snapshot_counts(d.table("events"), site="event_type")
    return out.select("snap", F.col("event_type").alias("site_id"), "n", F.round("total", 6).alias("total"))
