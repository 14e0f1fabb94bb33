"""Source status, snapshot series, streaks and health score.

A status table has one row per (snap, site_id) with ``ok`` (boolean) and ``n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.dedup import first_per_key
from ..operators.joins import lookup_join
from . import fixed_values as V


def source_status(items: DataFrame, sites: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row per registered site, sites without rows included; an error makes a site not ok."""
    counts = items.groupBy("site_id").agg(F.count("*").alias("item_count"))
    out = sites.select("site_id", "site_name").join(counts, "site_id", "left") \
               .withColumn("item_count", F.coalesce("item_count", F.lit(0)))
    if errors is None:
        return out.withColumn("error", F.lit(None).cast("string")).withColumn("ok", F.lit(True))
    failed = errors.groupBy("site_id").agg(F.min("error").alias("error"))
    return out.join(failed, "site_id", "left").withColumn("ok", F.col("error").isNull())


def roll_up(status: DataFrame, kept: int | Column = 0) -> DataFrame:
    kept = F.lit(kept) if isinstance(kept, int) else kept
    return status.agg(F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"),
                      F.coalesce(F.sum("item_count"), F.lit(0)).alias("raw_items")) \
                 .withColumn("kept_items", kept.cast("long"))


def by_category(status: DataFrame, sites: DataFrame) -> DataFrame:
    joined = lookup_join(status, sites.select("site_id", "category"), ["site_id"])
    return joined.groupBy(F.coalesce("category", F.lit(V.DEFAULT_CATEGORY)).alias("category")) \
                 .agg(F.count_if("ok").alias("ok_n"), F.count("*").alias("n"))


def snapshots(series: DataFrame, keep: int = V.HEALTH_SNAPSHOTS) -> DataFrame:
    """Newest ``keep`` snapshot times, numbered from the newest.  At most ``keep`` rows."""
    times = series.select("snap").distinct().orderBy(F.col("snap").desc()).limit(keep)
    return times.withColumn("age", F.row_number().over(Window.orderBy(F.col("snap").desc())))


def retain(series: DataFrame, keep: int = V.HEALTH_SNAPSHOTS) -> DataFrame:
    """Rows of the newest ``keep`` snapshots."""
    return series.join(F.broadcast(snapshots(series, keep)), "snap").drop("age")


def append_snapshot(series: DataFrame, entry: DataFrame, keep: int = V.HEALTH_SNAPSHOTS) -> DataFrame:
    """Add a snapshot; one with the same time replaces the stored one."""
    times = F.broadcast(entry.select("snap").distinct().limit(keep))
    return retain(series.join(times, "snap", "left_anti").unionByName(entry), keep)


def snapshot_totals(series: DataFrame) -> DataFrame:
    return series.groupBy("snap").agg(F.count_if("ok").alias("ok_sites"), F.count_if(~F.col("ok")).alias("failed_sites"),
                                      F.sum("n").alias("raw"))


def failure_streaks(series: DataFrame, last: int = V.STREAK_SNAPSHOTS) -> DataFrame:
    """Failures in a row per site, from the newest snapshot back; an ok or a missing one stops it.

    ``last_ok`` is the time of the ok that stopped it.  Windows hold at most ``last``
    rows per site, one per snapshot.
    """
    aged = series.join(F.broadcast(snapshots(series, last)), "snap")
    w = Window.partitionBy("site_id").orderBy("age")
    seq = aged.withColumn("_rn", F.row_number().over(w)) \
              .withColumn("_oks", F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    unbroken = F.col("_rn") == F.col("age")
    return seq.groupBy("site_id").agg(
        F.count_if(unbroken & (F.col("_oks") == 0)).alias("streak"),
        F.max(F.when(unbroken & F.col("ok") & (F.col("_oks") == 1), F.col("snap"))).alias("last_ok"))


def status_table(status: DataFrame, streaks: DataFrame, sites: DataFrame) -> DataFrame:
    """Display order: category, failing first, longest streak, registry order."""
    order = F.array_position(F.array(*[F.lit(c) for c in V.CATEGORY_ORDER]), F.col("category"))
    joined = lookup_join(lookup_join(status, streaks, ["site_id"]),
                         sites.select("site_id", "category", "site_rank"), ["site_id"])
    return joined.withColumn("streak", F.coalesce("streak", F.lit(0))) \
                 .withColumn("category", F.coalesce("category", F.lit(V.DEFAULT_CATEGORY))) \
                 .orderBy(order, F.col("ok").cast("int"), F.col("streak").desc(), "site_rank", "site_id")


def freshness_band(generated_at: Column, as_of: Column) -> Column:
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp(generated_at)) / 3600
    return F.when(hours < 2, "ok").when(hours < 6, "warn").otherwise("bad")


def health_score(failed: Column, generated_at: Column, as_of: Column) -> Column:
    fresh = F.coalesce((F.unix_timestamp(as_of) - F.unix_timestamp(generated_at)) < 7200, F.lit(False))
    base = F.when(failed == 0, F.lit(80)).otherwise(F.greatest(F.lit(0), F.lit(50) - failed * 5))
    bonus = F.when(fresh, F.lit(20)).otherwise(F.lit(0)) + F.when(fresh & (failed == 0), F.lit(20)).otherwise(F.lit(0))
    return F.least(F.lit(100), F.greatest(F.lit(0), base + bonus)).cast("long")


def health_colour(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 50, "amber").otherwise("red")


def bucketed(events: DataFrame, ts: str = "ts", width: str = "30 minutes") -> Column:
    return F.window(F.col(ts).cast("timestamp"), width)["start"]


def latest_entry_per_site(series: DataFrame) -> DataFrame:
    return first_per_key(series, ["site_id"], [F.col("snap").desc()])
