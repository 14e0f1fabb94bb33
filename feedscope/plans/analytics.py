"""Aggregates over scored items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.base import text_or_empty
from ..functions.times import local_day
from ..operators.dedup import first_per_key
from ..operators.ranking import top_n
from . import fixed_values as V

PARTS = {"src_score": "source", "strength": "strength", "topic": "topic", "people_score": "people",
         "freshness": "freshness"}


def counts_by(items: DataFrame, column: str, blank: str | None = None) -> DataFrame:
    key = F.col(column) if blank is None else F.coalesce(F.nullif(column, F.lit("")), F.lit(blank))
    return items.groupBy(key.alias(column)).agg(F.count("*").alias("n"))


def site_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("site_id").agg(F.min("site_name").alias("site_name"), F.count("*").alias("n"))


def score_histogram(items: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width bins of 0..100 by level."""
    width = 100 / bins
    bucket = F.least(F.floor(F.col("score") / width), F.lit(bins - 1)).cast("long")
    return items.groupBy(bucket.alias("bin"), "score_level").agg(F.count("*").alias("n"))


def daily_counts(items: DataFrame, ts: str = "published_at") -> DataFrame:
    return items.where(F.col(ts).isNotNull()).groupBy(local_day(ts).alias("day"), "dimension") \
                .agg(F.count("*").alias("n"))


def weekday_counts(items: DataFrame, ts: str = "published_at") -> DataFrame:
    """0 = Monday, local time."""
    return items.where(F.col(ts).isNotNull()).groupBy(F.weekday(local_day(ts)).alias("weekday"), "dimension") \
                .agg(F.count("*").alias("n"))


def top_sources(items: DataFrame, n: int = 15, source: str = "site_id") -> DataFrame:
    counts = items.groupBy(source).agg(F.count("*").alias("n"))
    return top_n(counts, [F.col("n").desc(), F.col(source)], n)


def top_sources_per_dimension(items: DataFrame, k: int = 3, source: str = "site_id") -> DataFrame:
    counts = items.groupBy("dimension", source).agg(F.count("*").alias("n"))
    return first_per_key(counts, ["dimension"], [F.col("n").desc(), F.col(source)], k)


def attainment(items: DataFrame) -> DataFrame:
    """Mean share of the maximum reached by each score part."""
    means = items.agg(*[F.avg(F.col(c) / V.SCORE_MAXIMA[p]).alias(p) for c, p in PARTS.items()])
    return means.unpivot([], list(PARTS.values()), "part", "rate")


def strength_spread(items: DataFrame, value: str = "strength") -> DataFrame:
    """Exact quartiles per dimension from pre-aggregated value counts."""
    counts = items.groupBy("dimension", value).agg(F.count("*").alias("n"))
    q = [F.expr(f"percentile({value}, {p}, n)").alias(a) for p, a in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))]
    return counts.groupBy("dimension").agg(F.min(value).alias("low"), *q, F.max(value).alias("high"),
                                           F.sum("n").alias("n"))


def authority_relation(items: DataFrame) -> DataFrame:
    """Points of the authority/score scatter, counted, per dimension."""
    return items.groupBy("dimension", "src_score", "score").agg(F.count("*").alias("n"))


def authority_correlation(items: DataFrame) -> DataFrame:
    return items.groupBy("dimension").agg(F.corr("src_score", "score").alias("corr"), F.count("*").alias("n"))


def facts(items: DataFrame, ts: str = "published_at") -> DataFrame:
    """One row of headline numbers.  The exact median keeps one count per score, 101 at most."""
    base = items.withColumn("_day", local_day(ts))
    main = base.agg(F.count("*").alias("items"),
                    F.avg(F.col("score_level").isin("S", "A").cast("int")).alias("top_share"),
                    F.avg("score").alias("mean_score"), F.countDistinct("_day").alias("days"),
                    F.percentile("score", F.lit(0.5)).alias("median_score"))
    return main.withColumn("per_day", F.col("items") / F.col("days"))


def top_words(items: DataFrame, columns=("title", "summary"), k: int = 14, head: int = 200,
              stop_words=tuple(V.STOP_WORDS)) -> DataFrame:
    """Most frequent words per dimension: letters only, 2+ characters, no stop word.

    The counting unit is the head of each text, which is what the measure is defined on.
    """
    tokens = F.concat(*[F.regexp_extract_all(F.lower(F.substring(text_or_empty(c), 1, head)),
                                             F.lit(r"[\p{L}\p{N}]+"), F.lit(0)) for c in columns])
    words = items.select("dimension", F.explode(tokens).alias("word")) \
                 .where((F.char_length("word") >= 2) & ~F.col("word").rlike("^[0-9]+$")
                        & ~F.col("word").isin(list(stop_words)))
    counts = words.groupBy("dimension", "word").agg(F.count("*").alias("n"))
    return first_per_key(counts, ["dimension"], [F.col("n").desc(), F.col("word")], k)


def tag_count_histogram(items: DataFrame, topics: str = "topics") -> DataFrame:
    return items.groupBy(F.size(topics).cast("long").alias("tags")).agg(F.count("*").alias("n"))


def junk_share(items: DataFrame, pattern: str = V.SCOPE_JUNK_TITLES) -> DataFrame:
    return items.groupBy("site_id").agg(F.count("*").alias("n"),
                                        F.count_if(F.col("title").rlike(pattern)).alias("junk"))


def hit_rate(items: DataFrame, group: str, hit: Column) -> DataFrame:
    return items.groupBy(group).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")) \
                .withColumn("rate", F.col("hits") / F.col("n"))


def count_change(before: DataFrame, after: DataFrame, key: str = "site_id") -> DataFrame:
    """Rows per key in two runs, keys of either side."""
    b = before.groupBy(key).agg(F.count("*").alias("before_n"))
    a = after.groupBy(key).agg(F.count("*").alias("after_n"))
    return b.join(a, key, "full_outer").select(
        key, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("before_n", "after_n")],
        (F.coalesce("after_n", F.lit(0)) - F.coalesce("before_n", F.lit(0))).alias("change"))


def new_keys(before: DataFrame, after: DataFrame, key: str = "site_id") -> DataFrame:
    return after.select(key).distinct().join(before.select(key).distinct(), key, "left_anti")
