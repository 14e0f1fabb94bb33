"""Queries over the rule-driven classifiers and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import backfill, fixed_values as V, health, rank, rules, score as scoring
from .base import AS_OF_SQL, has_any, ladder, query, quoted


@query("relevance", "SELECT id, site_class, relevant FROM classified")
def relevance(d):
    return rules.lowered(d.with_sites()).select("id", "site_class", rules.is_relevant().alias("relevant"))


@query("relevant_counts", "SELECT site_id, count(*) AS n FROM classified WHERE relevant GROUP BY site_id")
def relevant_counts(d):
    return scoring.relevant(d.with_sites()).groupBy("site_id").agg(F.count("*").alias("n"))


@query("source_scores", "SELECT id, authority FROM sited")
def source_scores(d):
    return d.with_sites().select("id", "authority")


@query("content_strength", "SELECT id, dimension, strength FROM parts")
def content_strength(d):
    return rules.lowered(d.classified()).select("id", "dimension", rules.strength_score().alias("strength"))


@query("topic_scores", "SELECT id, topic FROM parts")
def topic_scores(d):
    return rules.lowered(d.items()).select("id", rules.topic_score().alias("topic"))


@query("dimensions", "SELECT id, dimension FROM classified")
def dimensions(d):
    return d.classified().select("id", "dimension")


@query("strict_dimensions", f"""SELECT id, CASE WHEN site_class = 'ai' THEN 'AI' WHEN site_class = 'tech' THEN 'X' ELSE 'Y' END AS kind,
  {has_any("xl", [w for w in V.FINANCE_WORDS if not (w.isascii() and w.isalpha() and len(w) <= 4)])}
  OR regexp_matches(xl, '(^|[^a-z])(cbam|ccer|esg|ipo|ets|fund)([^a-z]|$)') AS finance FROM sited""")
def strict_dimensions(d):
    """Whole-word mode of the word lists."""
    kind = F.when(F.col("site_class") == "ai", "AI").when(F.col("site_class") == "tech", "X").otherwise("Y")
    return rules.lowered(d.with_sites()).select("id", kind.alias("kind"), rules.has_word(rules.TEXT_L, V.FINANCE_WORDS, 4).alias("finance"))


@query("region_split", "SELECT region, count(*) AS n FROM classified GROUP BY region")
def region_split(d):
    return d.classified().groupBy("region").agg(F.count("*").alias("n"))


@query("regions", "SELECT id, region FROM classified")
def regions(d):
    return rules.lowered(d.with_sites()).select("id", rules.region().alias("region"))


@query("topic_tags", "SELECT id, array_to_string(topics, ',') AS topics FROM classified")
def topic_tags(d):
    return rules.lowered(d.items()).select("id", F.array_join(rules.topics(), ",").alias("topics"))


TYPE_SQL = ladder([(has_any("tl", ws), quoted(n)) for n, ws in V.DOCUMENT_TYPES], "'行业动态'")


@query("document_types", f"SELECT id, {TYPE_SQL} AS document_type FROM sited")
def document_types(d):
    return rules.lowered(d.items()).select("id", rules.document_type().alias("document_type"))


@query("auto_tags", f"""WITH t AS (SELECT id, region AS r, topics, {TYPE_SQL} AS k FROM classified),
l AS (SELECT id, list_concat([r], topics, [k], CASE WHEN len(list_filter(topics, lambda v: v <> r AND v <> k)) = 0 THEN ['行业动态'] ELSE [] END) AS tags FROM t)
SELECT id, array_to_string(list_filter(tags, lambda v, i: list_position(tags, v) = i), ',') AS tags FROM l""")
def auto_tags(d):
    c = rules.lowered(d.classified()).withColumn("document_type", rules.document_type())
    return c.select("id", F.array_join(rules.tags("region", "topics", "document_type"), ",").alias("tags"))


@query("people", "SELECT id, array_to_string(people, ',') AS people FROM classified")
def people(d):
    return d.classified().select("id", F.array_join("people", ",").alias("people"))


@query("people_scores", f"""SELECT id, people_score,
  {ladder([("list_contains(people, '郑栅洁') OR list_contains(people, '黄润秋')", 10), ("list_contains(people, '周海兵')", 7),
           ("list_contains(people, '林伯强')", 5), ("list_contains(people, '张玉昕')", 3), ("list_contains(people, '傅强')", 3)], 0)} AS exact_score FROM parts""")
def people_scores(d):
    c = d.classified()
    return c.select("id", rules.people_score("people").alias("people_score"),
                    rules.people_score("people", exact_deputies=True).alias("exact_score"))


@query("person_roles", f"""SELECT p AS name, {ladder([(f"p = {quoted(n)}", quoted(r)) for n, r in V.PEOPLE], "''")} AS role, count(*) AS n
FROM (SELECT unnest(people) AS p FROM classified) q GROUP BY p""")
def person_roles(d):
    each = d.classified().select(F.explode("people").alias("name"))
    return each.groupBy("name").agg(F.count("*").alias("n")).withColumn("role", rules.person_role("name"))


@query("freshness", "SELECT id, freshness FROM parts")
def freshness(d):
    return d.items().select("id", rules.freshness_score("published_at", d.as_of).alias("freshness"))


@query("item_scores", """SELECT id, site_id, dimension, src_score, strength, topic, people_score, freshness, score, score_level FROM scored""")
def item_scores(d):
    return d.scored().select("id", "site_id", "dimension", "src_score", "strength", "topic", "people_score",
                             "freshness", "score", "score_level")


@query("score_levels", "SELECT score_level, count(*) AS n FROM scored GROUP BY score_level")
def score_levels(d):
    return d.scored().groupBy("score_level").agg(F.count("*").alias("n"))


@query("freshness_drift", f"""SELECT id, freshness, CASE WHEN h IS NULL THEN 0 WHEN h < 24 THEN 10 WHEN h < 48 THEN 8 WHEN h < 72 THEN 6 WHEN h < 96 THEN 4 ELSE 2 END AS freshness_live,
 freshness - CASE WHEN h IS NULL THEN 0 WHEN h < 24 THEN 10 WHEN h < 48 THEN 8 WHEN h < 72 THEN 6 WHEN h < 96 THEN 4 ELSE 2 END AS freshness_drift
FROM (SELECT *, (epoch_us(TIMESTAMP '2024-02-02 00:00:00') - epoch_us(published_at)) / 3.6e9 AS h FROM parts) q""")
def freshness_drift(d):
    rows = d.items().withColumn("freshness", rules.freshness_score("published_at", d.as_of))
    return scoring.freshness_drift(rows, F.lit("2024-02-02").cast("timestamp")).select(
        "id", "freshness", "freshness_live", "freshness_drift")


@query("site_categories", "SELECT category, count(*) AS n FROM sited GROUP BY category")
def site_categories(d):
    return d.with_sites().groupBy("category").agg(F.count("*").alias("n"))


@query("library_groups", "SELECT library, grp, count(*) AS n FROM sited GROUP BY library, grp")
def library_groups(d):
    return d.with_sites().groupBy("library", "grp").agg(F.count("*").alias("n"))


@query("registry", "SELECT site_id, site_name, library, grp, authority, home_region, site_class, category, window_hours, count(id) AS items FROM registry LEFT JOIN items USING (site_id) GROUP BY ALL")
def registry(d):
    counts = d.items().groupBy("site_id").agg(F.count("*").alias("items"))
    return d.sites.drop("site_rank").join(counts, "site_id", "left").withColumn("items", F.coalesce("items", F.lit(0)))


@query("site_facts", "SELECT id, site_id, library, grp, authority, home_region, site_class, window_hours FROM sited")
def site_facts(d):
    return d.with_sites().select("id", "site_id", "library", "grp", "authority", "home_region", "site_class", "window_hours")


@query("window_by_class", f"SELECT id, window_hours FROM sited WHERE published_at IS NULL OR published_at >= {AS_OF_SQL} - INTERVAL 1 HOUR * window_hours")
def window_by_class(d):
    return scoring.in_window(d.with_sites(), d.as_of).select("id", "window_hours")


@query("off_topic", "SELECT id, site_id FROM classified WHERE site_id NOT IN ('radarai', 'huxiu', 'caixin') OR relevant")
def off_topic(d):
    return scoring.drop_off_topic(d.with_sites(), ["radarai", "huxiu", "caixin"]).select("id", "site_id")


@query("dimension_filter", "SELECT id FROM classified WHERE dimension = '政策'")
def dimension_filter(d):
    return rank.filter_items(d.classified(), d.as_of, dimension=V.DIM_POLICY).select("id")


@query("place_filter", "SELECT id, region FROM classified WHERE region <> '中国'")
def place_filter(d):
    return rank.filter_items(d.classified(), d.as_of, place="abroad").select("id", "region")


@query("home_filter", "SELECT id FROM classified WHERE region = '中国'")
def home_filter(d):
    return rank.filter_items(d.classified(), d.as_of, place="home").select("id")


@query("period_filter", f"SELECT id FROM items WHERE coalesce(published_at, first_seen_at) >= {AS_OF_SQL} - INTERVAL 168 HOUR")
def period_filter(d):
    return rank.filter_items(d.items(), d.as_of, period="week").select("id")


@query("source_status", """SELECT r.site_id, r.site_name, count(i.id) AS item_count,
  CASE WHEN r.site_id IN ('ndrc', 'iea') THEN 'timeout' END AS error, r.site_id NOT IN ('ndrc', 'iea') AS ok
FROM registry r LEFT JOIN items i USING (site_id) GROUP BY r.site_id, r.site_name""")
def source_status(d):
    return _status(d).select("site_id", "site_name", "item_count", "error", "ok")


def _status(d):
    errors = d.sites.where(F.col("site_id").isin("ndrc", "iea")).select("site_id", F.lit("timeout").alias("error"))
    return health.source_status(d.items(), d.sites, errors)


STATUS_CTE = """WITH s AS (SELECT r.site_id, r.category, r.site_id NOT IN ('ndrc', 'iea') AS ok, count(i.id) AS item_count
  FROM registry r LEFT JOIN items i USING (site_id) GROUP BY ALL)"""


@query("status_roll_up", STATUS_CTE + """ SELECT count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed,
  CAST(sum(item_count) AS BIGINT) AS raw_items, CAST(7 AS BIGINT) AS kept_items FROM s""")
def status_roll_up(d):
    return health.roll_up(_status(d), 7)


@query("category_roll_up", STATUS_CTE + " SELECT category, count(*) FILTER (ok) AS ok_n, count(*) AS n FROM s GROUP BY category")
def category_roll_up(d):
    return health.by_category(_status(d), d.sites)


@query("source_fallback", """SELECT id, site_id, lang FROM items WHERE lang = 'en' OR site_id NOT IN (SELECT site_id FROM items WHERE lang = 'en')""")
def source_fallback(d):
    items = d.items().select("id", "site_id", "lang")
    return backfill.with_fallback(items.where("lang = 'en'"), items.where("lang <> 'en'"))
