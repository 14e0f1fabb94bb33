"""Sorting, ranks, pages and quotas without a single-task global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .dedup import first_per_key

DIRECT_RANK_ROWS = 20_000


def importance_order(id_col: str = "id", score: str = "score", ts: str = "published_at") -> list[Column]:
    """Score, then time (none = oldest), then id to make the order total."""
    return [F.coalesce(F.col(score), F.lit(0)).desc(), F.col(ts).desc_nulls_last(), F.col(id_col).asc()]


def newest_order(id_col: str = "id", ts: str = "published_at") -> list[Column]:
    return [F.col(ts).desc_nulls_last(), F.col(id_col).asc()]


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position in a total order, computed in parallel.

    Range-partition and sort, number rows inside each partition, and add the row
    count of all earlier partitions (one row per partition, so that side is
    bounded by the shuffle width).  Rows are written before the range sort, because
    its sampling reads them an extra time, and after it, because partition numbers
    must not change between counting and numbering.
    """
    ranged = cut_lineage(df).repartitionByRange(*order).sortWithinPartitions(*order) \
               .withColumn("_mid", F.monotonically_increasing_id())
    fixed = cut_lineage(ranged)
    part = F.shiftright("_mid", 33)
    sizes = fixed.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return fixed.withColumn("_part", part).join(F.broadcast(offsets), "_part") \
        .withColumn(name, (F.col("_offset") + within + 1).cast("long")).drop("_mid", "_part", "_offset")


def top_n(df: DataFrame, order: list[Column], n: int, name: str | None = "rank") -> DataFrame:
    """First ``n`` rows, numbered.  Runs as a per-task top-n and one small merge."""
    head = df.orderBy(*order).limit(n)
    return head.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long")) if name else head


def page(df: DataFrame, order: list[Column], number: int, size: int, name: str = "rank") -> DataFrame:
    """Rows of one page with running ranks; a page past the end becomes the last page.

    Early pages use the bounded top-n; deep ones the parallel rank.
    """
    total = df.count()
    last = max(1, -(-total // size))
    number = min(max(1, number), last)
    end = number * size
    ranked = top_n(df, order, end, name) if end <= DIRECT_RANK_ROWS else global_rank(df, order, name)
    return ranked.where(F.col(name) > end - size).where(F.col(name) <= end) \
                 .withColumn("page", F.lit(number)).withColumn("total_pages", F.lit(last))


def per_group_head(df: DataFrame, keys: list, order: list[Column], k: int) -> DataFrame:
    return first_per_key(df, keys, order, k)


def quota_then_top(df: DataFrame, group: str, order: list[Column], quota: int, n: int) -> DataFrame:
    """At most ``quota`` rows per group, then the best ``n``; zero switches a bound off."""
    kept = first_per_key(df, [group], order, quota) if quota else df
    return top_n(kept, order, n, None) if n else kept
