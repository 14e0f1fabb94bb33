"""Filling items from side tables keyed by URL or title."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.base import chars, text_or_empty
from ..functions.text import needs_translation
from ..functions.times import local_to_utc
from ..functions.titles import is_contained, is_nav_title, strip_title_suffix, title_similarity
from ..operators.joins import lookup_join

SIMILAR_ENOUGH = 0.45


def one_per_key(index: DataFrame, key: str, column: str) -> DataFrame:
    """The greatest value of each key, so that a repeated key never multiplies items."""
    return index.groupBy(key).agg(F.max(column).alias(column))


def fill_published(items: DataFrame, index: DataFrame, first_seen: str = "first_seen_at") -> DataFrame:
    """``index(url, published)`` holds local text.  Without any time the capture time is used and marked."""
    j = lookup_join(items, one_per_key(index, "url", "published").withColumnRenamed("published", "_pub"), ["url"])
    archived = local_to_utc("_pub")
    return j.withColumn("time_source", F.when(F.col("published_at").isNotNull() | archived.isNotNull(), "published")
                        .when(F.col(first_seen).isNotNull(), "scraped")) \
            .withColumn("published_at", F.coalesce("published_at", archived, first_seen)).drop("_pub")


def fill_summary(items: DataFrame, index: DataFrame) -> DataFrame:
    j = lookup_join(items, one_per_key(index, "url", "summary").withColumnRenamed("summary", "_sum"), ["url"])
    return j.withColumn("summary", F.coalesce(F.nullif("summary", F.lit("")), F.nullif("_sum", F.lit("")),
                                              F.lit(""))).drop("_sum")


def fill_report(before: DataFrame, after: DataFrame, column: str = "summary", key: str = "id") -> DataFrame:
    """How many empty values were filled and how many are still empty."""
    empty = F.coalesce(F.col(column), F.lit("")) == ""
    return before.select(key, empty.alias("_was")).join(after.select(key, empty.alias("_is")), key).agg(
        F.count_if(F.col("_was") & ~F.col("_is")).alias("filled"), F.count_if("_is").alias("still_empty"))


def fill_title(items: DataFrame, index: DataFrame, least: float = SIMILAR_ENOUGH,
               containment_only: bool = False, as_indexed: bool = False) -> DataFrame:
    """Take the indexed title when it is longer, no navigation text and of the same article.

    The similarity runs on joined pairs only; ``containment_only`` keeps it on the JVM side.  ``as_indexed``: the index holds
    finished titles, which are taken as they are but for blanks around them; no tail is cut off and none is navigation.
    """
    title = F.regexp_replace("title", r"^\p{Zs}+|\p{Zs}+$", "") if as_indexed else strip_title_suffix("title")
    full = one_per_key(index, "url", "title").select("url", title.alias("_full"))
    j = lookup_join(items, full, ["url"])
    better = F.col("_full").isNotNull() & (chars("_full") > chars(text_or_empty("title")))
    if not as_indexed:
        better &= ~is_nav_title("_full")
    if containment_only:
        good = better & is_contained("_full", "title")
    else:
        j = j.withColumn("_sim", title_similarity(F.when(better, F.col("_full")), "title"))
        good = better & (F.col("_sim") >= least)
    return j.withColumn("title", F.when(good, F.col("_full")).otherwise(F.col("title"))).drop("_full", "_sim")


def translate_from_cache(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Add ``title_zh`` and ``to_translate`` (needs one, cache has none).  ``cache(title, title_zh)``."""
    j = lookup_join(items.drop("title_zh"), one_per_key(cache, "title", "title_zh").withColumnRenamed("title_zh", "_zh"), ["title"])
    need = needs_translation("title")
    return j.withColumn("title_zh", F.when(need, F.coalesce("_zh", F.lit(""))).otherwise(F.lit(""))) \
            .withColumn("to_translate", need & (F.coalesce("_zh", F.lit("")) == "")).drop("_zh")


def replace_by_url(items: DataFrame, fixes: DataFrame, column: str, how: str = "left") -> DataFrame:
    """Override a column from ``fixes(url, column)``."""
    j = lookup_join(items, one_per_key(fixes, "url", column).withColumnRenamed(column, "_fix"), ["url"], how)
    return j.withColumn(column, F.coalesce("_fix", column)).drop("_fix")


def real_urls(items: DataFrame, resolved: DataFrame, host: str) -> DataFrame:
    """Replace aggregator links by ``resolved(url, real_url)``; other links stay."""
    j = lookup_join(items, one_per_key(resolved, "url", "real_url"), ["url"])
    return j.withColumn("url", F.when(F.col("url").contains(host), F.coalesce(F.nullif("real_url", F.lit("")), "url"))
                        .otherwise(F.col("url"))).drop("real_url")


def restore_missing(current: DataFrame, backup: DataFrame, key: str = "url") -> DataFrame:
    """Rows of the backup whose key is gone come back."""
    gone = lookup_join(backup, current.select(key).distinct(), [key], "left_anti")
    return current.unionByName(gone)


def with_fallback(primary: DataFrame, secondary: DataFrame, site: str = "site_id") -> DataFrame:
    """Secondary rows only for sites whose primary gave none."""
    missing = lookup_join(secondary, primary.select(site).distinct(), [site], "left_anti")
    return primary.unionByName(missing)
