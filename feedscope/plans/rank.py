"""The interactive list: filters, sort, page, display columns and topic graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.base import let
from ..functions.titles import display_title
from ..operators import ranking
from . import fixed_values as V

PERIOD_HOURS = {"day": 24, "week": 7 * 24, "month": 30 * 24}


def filter_items(items: DataFrame, as_of: Column, dimension: str | None = None, place: str | None = None,
                 period: str | None = None) -> DataFrame:
    """``place`` is 'home' or 'abroad' (everything not home, unknown included)."""
    out = items
    if dimension:
        out = out.where(F.coalesce(F.nullif("dimension", F.lit("")), F.lit(V.DIM_POLICY)) == dimension)
    if place:
        home = F.col("region").eqNullSafe(F.lit(V.HOME_REGION))
        out = out.where(home if place == "home" else ~home)
    if period:
        t = item_time(items)
        out = out.where(t.isNull() | (t >= as_of - F.make_interval(hours=F.lit(PERIOD_HOURS[period]))))
    return out


def item_time(items: DataFrame) -> Column:
    if "first_seen_at" in items.columns:
        return F.coalesce("published_at", "first_seen_at")
    return F.col("published_at")


def list_page(items: DataFrame, as_of: Column, dimension=None, place=None, period=None, by: str = "importance",
              number: int = 1, size: int = 20, id_col: str = "id") -> DataFrame:
    rows = filter_items(items, as_of, dimension, place, period).withColumn("_t", item_time(items))
    order = (ranking.importance_order(id_col, ts="_t") if by == "importance" else ranking.newest_order(id_col, "_t"))
    out = ranking.page(rows, order, number, size).drop("_t")
    return out.withColumn("display_title", display_title("title", "title_zh")) if "title_zh" in out.columns else out


def topic_nodes(items: DataFrame, topics: str = "topics") -> DataFrame:
    """Items per topic and the drawing size, the largest topic being 60."""
    # an outer explode keeps the optimizer from testing (and so computing) the tags twice
    counts = items.select(F.explode_outer(F.array_distinct(topics)).alias("topic")).where("topic IS NOT NULL") \
                  .groupBy("topic").agg(F.count("*").alias("n"))
    # one row per topic tag: the tag list is the bound of this window
    top = F.max("n").over(Window.partitionBy())
    return counts.withColumn("size", (22 + F.floor(F.col("n") / top * 38 + 0.5)).cast("long"))


def topic_edges(items: DataFrame, topics: str = "topics") -> DataFrame:
    """Unordered topic pairs inside one item, counted over all items.

    Pairs come from one row's own short tag list (13 tags at most), never from a group of rows.
    """
    pairs = let(F.array_sort(F.array_distinct(topics)), lambda ts: F.flatten(F.transform(ts, lambda a: F.transform(
        F.filter(ts, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    return items.select(F.explode_outer(pairs).alias("p")).where("p IS NOT NULL") \
                .groupBy(F.col("p.a").alias("topic_a"), F.col("p.b").alias("topic_b")).agg(F.count("*").alias("n"))


def topic_summary(items: DataFrame, topics: str = "topics") -> DataFrame:
    """One row: distinct topics and items that carry at least one."""
    each = items.select(F.posexplode_outer(topics).alias("pos", "topic"))
    return each.agg(F.count_if(F.col("pos") == 0).alias("tagged_items"), F.countDistinct("topic").alias("topics"))
