"""Joins that stay whole and balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as D

MAX_BROADCAST_ROWS = 10_000
SALTS = 64
MAX_HOT_KEYS = 1_000


def hot_keys(rows: DataFrame, keys: list[str], fraction: float = 0.01, least: int = 1_000) -> list[tuple]:
    """At most ``MAX_HOT_KEYS`` frequent keys, from a sample.

    The list only decides where rows travel, never which rows join, so a sample is enough.
    """
    counts = rows.select(*keys).dropna().sample(fraction=fraction, seed=7).groupBy(*keys).count()
    top = counts.where(F.col("count") >= least).orderBy(F.col("count").desc()).limit(MAX_HOT_KEYS).collect()
    return [tuple(r[k] for k in keys) for r in top]


def _is_hot(keys: list[str], hot: list[tuple]) -> Column:
    if not hot:
        return F.lit(False)
    if len(keys) == 1:
        return F.coalesce(F.col(keys[0]).isin([h[0] for h in hot]), F.lit(False))
    marks = [F.struct(*[F.lit(v).alias(k) for k, v in zip(keys, h)]) for h in hot]
    return F.coalesce(F.array_contains(F.array(*marks), F.struct(*keys)), F.lit(False))


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "left",
                hot: list[tuple] = (), salts: int = SALTS) -> DataFrame:
    """Shuffle join in one pass: rows of the given hot keys and of NULL keys spread over ``salts`` tasks.

    For callers who know their hot keys (``hot_keys`` samples them); else ``lookup_join`` leaves skew to AQE.

    Only the facts of hot keys are repeated, so the few side grows by at most
    ``MAX_HOT_KEYS`` * ``salts`` rows.
    """
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    content = [f.name for f in rows.schema if isinstance(f.dataType, D.AtomicType)]
    spread = F.pmod(F.xxhash64(*content, F.spark_partition_id()), F.lit(salts)).cast("int")
    salted = rows.withColumn("_salt", F.when(no_key | _is_hot(keys, hot), spread).otherwise(F.lit(0)))
    copies = F.when(_is_hot(keys, hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = facts.withColumn("_salt", F.explode(copies)) if hot else facts.withColumn("_salt", F.lit(0))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def lookup_join(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "left",
                known_rows: int | None = None) -> DataFrame:
    """Join to a side table with one row per key.

    Spark picks the strategy from bytes, AQE again at run time, and AQE splits skewed keys.  A hint to broadcast is given
    only where the caller has made the table itself and states its rows (at most ``MAX_BROADCAST_ROWS``).
    """
    small = known_rows is not None and known_rows <= MAX_BROADCAST_ROWS
    return rows.join(F.broadcast(facts) if small else facts, keys, how)


def spread_if_narrow(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores before costly per-row work; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
