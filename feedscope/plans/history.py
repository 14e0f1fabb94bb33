"""Accumulating history: first version wins, rows age out, derived fields are recomputed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.base import text_or_empty
from ..functions.titles import strip_title_suffix, title_key
from ..operators.dedup import first_per_key
from ..operators.joins import lookup_join
from . import fixed_values as V, rules


def merge_key(title="title", url="url") -> Column:
    """Title key, or the URL for blank titles; NULL when both are missing (such rows are dropped)."""
    return F.coalesce(F.nullif(title_key(title), F.lit("")), F.nullif(text_or_empty(url), F.lit("")))


def retained(items: DataFrame, as_of: Column, days: int = V.RETENTION_DAYS) -> DataFrame:
    t = F.coalesce("published_at", "first_seen_at") if "first_seen_at" in items.columns else F.col("published_at")
    return items.where(t.isNull() | (t >= as_of - F.make_interval(days=F.lit(days))))


def merge(existing: DataFrame, new: DataFrame, as_of: Column, order_col: str = "id",
          days: int = V.RETENTION_DAYS) -> DataFrame:
    """Union of both under the key rule.

    Stored rows beat new ones.  Among stored rows of a title key the first wins, among
    stored rows known only by URL the last; among new rows always the first.
    """
    blank = F.coalesce(title_key("title"), F.lit("")) == ""
    stored = existing.withColumn("_prio", F.lit(0)) \
                     .withColumn("_seq", F.when(blank, -F.col(order_col)).otherwise(F.col(order_col)))
    fresh = new.withColumn("_prio", F.lit(1)).withColumn("_seq", F.col(order_col))
    both = stored.unionByName(fresh).withColumn("_key", merge_key()).where(F.col("_key").isNotNull())
    merged = first_per_key(both, ["_key"], [F.col("_prio"), F.col("_seq")])
    return retained(merged.drop("_prio", "_seq", "_key"), as_of, days)


def refresh(items: DataFrame, pack: rules.RulePack = rules.RulePack()) -> DataFrame:
    """Re-clean titles, recompute regions, fill missing topics; the score stays as captured."""
    t = rules.lowered(items.withColumn("title", strip_title_suffix("title")))
    return t.withColumn("region", rules.region(pack=pack)).withColumn(
        "topics", F.when(F.coalesce(F.size("topics"), F.lit(0)) > 0, F.col("topics")).otherwise(rules.topics(pack=pack))) \
        .drop(rules.TITLE_L, rules.TEXT_L)


def unseen(new: DataFrame, known: DataFrame, title: str = "title") -> DataFrame:
    """New rows whose trimmed title is not known yet."""
    return lookup_join(new.withColumn("_t", F.trim(title)), known.select(F.trim(title).alias("_t")).distinct(),
                       ["_t"], "left_anti").drop("_t")


def prepend_latest(history: DataFrame, latest: DataFrame) -> DataFrame:
    return unseen(latest, history).unionByName(history, allowMissingColumns=True)
