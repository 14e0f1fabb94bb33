"""Writers.  Results are tables; text outputs are partitioned text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .note_files import write_notes  # noqa: F401


def feed_summary(kept: DataFrame, raw: DataFrame, as_of: Column, window_hours: int = 96) -> DataFrame:
    """The one-row head of a windowed feed."""
    # counts per site and side first, so the final aggregate sees one small row per site
    k = kept.groupBy("site_id").agg(F.count("*").alias("kept"), F.lit(0).cast("long").alias("raw"))
    r = raw.groupBy("site_id").agg(F.lit(0).cast("long").alias("kept"), F.count("*").alias("raw"))
    return k.unionByName(r).agg(
        F.coalesce(F.sum("kept"), F.lit(0)).alias("total_items"), F.count_if(F.col("kept") > 0).alias("site_count"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("total_raw")) \
        .withColumn("window_hours", F.lit(window_hours)).withColumn("generated_at", as_of)


def write_feed(kept: DataFrame, raw: DataFrame, as_of: Column, path: str, window_hours: int = 96) -> None:
    """Items, per-site counts and the summary row under ``path``."""
    from ..plans.analytics import site_counts
    kept.write.mode("overwrite").parquet(f"{path}/items")
    site_counts(kept).write.mode("overwrite").json(f"{path}/site_stats")
    feed_summary(kept, raw, as_of, window_hours).write.mode("overwrite").json(f"{path}/summary")


def write_history(items: DataFrame, path: str) -> None:
    """History partitioned by publish day, so retention reads only live partitions."""
    items.withColumn("day", F.to_date("published_at")).write.mode("overwrite").partitionBy("day").parquet(path)


def write_index(index: DataFrame, path: str) -> bool:
    """A lookup index is replaced only by a non-empty one."""
    rows = cut_lineage(index)  # computed once, and ``index`` may be read from ``path``
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def write_text(lines: DataFrame, path: str, column: str) -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_health(series: DataFrame, path: str) -> None:
    series.write.mode("overwrite").parquet(path)
