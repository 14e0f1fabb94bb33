"""The item plan: site facts, classification and the 0-100 score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.joins import lookup_join
from . import fixed_values as V, rules
from .rules import RulePack

SITE_COLUMNS = ["library", "grp", "authority", "home_region", "site_class", "category", "window_hours", "site_rank"]


def with_site_facts(items: DataFrame, sites: DataFrame, columns=None, known_rows: int | None = None) -> DataFrame:
    """Left join on the registry; a site nobody registered gets the defaults."""
    defaults = {"library": V.DEFAULT_LAYOUT[0], "grp": V.DEFAULT_LAYOUT[1], "authority": V.DEFAULT_AUTHORITY,
                "home_region": "", "site_class": "keyword", "category": V.DEFAULT_CATEGORY,
                "window_hours": V.WINDOW_HOURS["default"], "site_rank": 1 << 30}
    columns = [c for c in (columns or SITE_COLUMNS) if c in sites.columns]
    joined = lookup_join(items.drop(*columns), sites.select("site_id", *columns), ["site_id"], known_rows=known_rows)
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(defaults[c])) for c in columns if c in defaults})


def classify(items: DataFrame, pack: RulePack = RulePack()) -> DataFrame:
    """Add ``dimension, region, topics, people`` (needs the site facts)."""
    return rules.lowered(items).withColumns({
        "dimension": rules.dimension(pack=pack), "region": rules.region(pack=pack), "topics": rules.topics(pack=pack),
        "people": rules.people("title", "summary", pack=pack),
    }).drop(rules.TITLE_L, rules.TEXT_L)


def score(items: DataFrame, as_of: Column, pack: RulePack = RulePack(), exact_deputies: bool = False) -> DataFrame:
    """Add the five parts, ``score`` and ``score_level`` (needs ``classify``)."""
    parts = rules.lowered(items).withColumns({
        "src_score": F.col("authority").cast("int"),
        "strength": rules.strength_score(pack=pack),
        "topic": rules.topic_score(pack=pack),
        "people_score": rules.people_score("people", pack, exact_deputies),
        "freshness": rules.freshness_score("published_at", as_of),
    }).drop(rules.TITLE_L, rules.TEXT_L)
    total = F.least(F.lit(100), F.col("src_score") + F.col("strength") + F.col("topic")
                    + F.col("people_score") + F.col("freshness"))
    return parts.withColumn("score", total).withColumn("score_level", rules.level("score"))


def breakdown() -> Column:
    return F.struct(F.col("src_score").alias("source"), "strength", "topic",
                    F.col("people_score").alias("people"), "freshness").alias("score_breakdown")


def enrich(items: DataFrame, sites: DataFrame, as_of: Column, pack: RulePack = RulePack()) -> DataFrame:
    return score(classify(with_site_facts(items, sites), pack), as_of, pack)


def relevant(items: DataFrame, pack: RulePack = RulePack()) -> DataFrame:
    return rules.lowered(items).where(rules.is_relevant(pack=pack)).drop(rules.TITLE_L, rules.TEXT_L)


def drop_off_topic(items: DataFrame, site_ids, pack: RulePack = RulePack()) -> DataFrame:
    """Remove rows of the given sites that fail the relevance test; other sites stay."""
    kept = rules.lowered(items).where(~F.col("site_id").isin(list(site_ids)) | rules.is_relevant(pack=pack))
    return kept.drop(rules.TITLE_L, rules.TEXT_L)


def in_window(items: DataFrame, as_of: Column, hours: Column | None = None) -> DataFrame:
    """Rows no older than their site's window; rows without a time stay."""
    width = hours if hours is not None else F.col("window_hours")
    return items.where(F.col("published_at").isNull()
                       | (F.col("published_at") >= as_of - F.make_interval(hours=width)))


def outside_window(items: DataFrame, as_of: Column) -> DataFrame:
    """Rows that ``in_window`` leaves out."""
    return items.where(F.col("published_at") < as_of - F.make_interval(hours=F.col("window_hours")))


def freshness_drift(items: DataFrame, as_of: Column) -> DataFrame:
    """Stored freshness against freshness now."""
    return items.withColumn("freshness_live", rules.freshness_score("published_at", as_of)) \
                .withColumn("freshness_drift", F.col("freshness") - F.col("freshness_live"))
