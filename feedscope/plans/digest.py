"""Digest selection and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import digest_summary, screen_summary
from ..functions.times import month_day
from ..functions.titles import clean_digest_title, display_title
from ..operators.dedup import by_url
from ..operators.ranking import quota_then_top, top_n
from . import fixed_values as V


def candidates(items: DataFrame, as_of: Column, min_score: int = 70, max_age_days: int = 7) -> DataFrame:
    """Score high enough, not older than the limit (0 = none); no time counts as fresh."""
    out = items.where(F.coalesce("score", F.lit(0)) >= min_score)
    if max_age_days:
        out = out.where(F.col("published_at").isNull()
                        | (F.col("published_at") >= as_of - F.make_interval(days=F.lit(max_age_days))))
    return out


def pick(items: DataFrame, as_of: Column, top: int = 20, min_score: int = 70, per_site: int = 2,
         max_age_days: int = 7, id_col: str = "id") -> DataFrame:
    """Candidates, one per URL, a quota per site, then the best ``top``."""
    order = [F.col("score").desc(), F.col(id_col).asc()]
    once = by_url(candidates(items, as_of, min_score, max_age_days), order)
    return quota_then_top(once, "site_id", order, per_site, top)


def _paragraph(parts: list[Column]) -> Column:
    return F.concat_ws("\n", *parts)


def text(picked: DataFrame, generated_day: str, site_count: int = V.DIGEST_SITES, id_col: str = "id",
         heading: str = "当日高分浓缩", footer: str = "") -> DataFrame:
    """The digest as one row ``digest``.  ``picked`` is the bounded result of ``pick``.

    ``heading`` and ``footer`` are the publisher's own first and last line.
    """
    order = Window.partitionBy("dimension").orderBy(F.col("score").desc(), F.col(id_col))
    dim = F.coalesce(F.nullif("dimension", F.lit("")), F.lit("其他"))
    title = clean_digest_title("title")
    rows = picked.withColumn("dimension", dim).withColumn("_title", title)
    rows = rows.withColumn("_sum", digest_summary("_title", "summary"))
    rows = rows.withColumn("_no", F.row_number().over(order))
    meta = F.concat_ws(" · ", F.coalesce("site_name", F.lit("")), month_day("published_at"))
    entry = _paragraph([
        F.concat(F.col("_no").cast("string"), F.lit(". "), F.col("_title"), F.lit("（"), meta, F.lit("）⭐"),
                 F.col("score").cast("string")),
        F.concat(F.lit("　　"), F.nullif("_sum", F.lit(""))),
        F.concat(F.lit("🔗 "), F.nullif(F.trim("url"), F.lit(""))),
        F.lit("")])
    ranks = F.array_position(F.array(*[F.lit(d) for d in V.DIMENSIONS]), F.col("dimension")).cast("int")
    icon = F.element_at(F.create_map(*[F.lit(x) for d in V.DIMENSIONS for x in (d, V.DIMENSION_ICONS[d])]),
                        F.col("dimension"))
    groups = rows.withColumn("_entry", entry).withColumn("_rank", ranks).groupBy("dimension", "_rank").agg(
        F.count("*").alias("_n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_entry"))), lambda x: x["_entry"]), "\n")
        .alias("_body"))
    shown = F.when(F.col("_rank") > 0, F.struct(
        "_rank",
        F.concat(F.lit("【"), icon, F.lit(" "), F.col("dimension"), F.lit(" · "), F.col("_n").cast("string"),
                 F.lit(" 条】\n"), F.col("_body"), F.lit("\n")).alias("block"),
        F.concat(icon, F.lit(" "), F.col("dimension"), F.lit(" "), F.col("_n").cast("string")).alias("share")))
    whole = groups.withColumn("_shown", shown).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.array_sort(F.collect_list("_shown")).alias("s"))
    return whole.select(F.concat(
        F.lit(f"{heading}\n📅 {generated_day} ｜ {site_count} 个信源 ｜ A级以上精选 "), F.col("n").cast("string"),
        F.lit(" 条\n\n"), F.array_join(F.transform("s", lambda x: F.concat(x["block"], F.lit("\n"))), ""),
        F.lit("📊 分布："), F.array_join(F.transform("s", lambda x: x["share"]), " / "),
        F.lit(f"\n\n{footer}\n" if footer else "\n")).alias("digest"))


def distribution(picked: DataFrame) -> DataFrame:
    return picked.groupBy(F.coalesce(F.nullif("dimension", F.lit("")), F.lit("其他")).alias("dimension")) \
                 .agg(F.count("*").alias("n"))


def clipboard(items: DataFrame, order: list[Column], n: int = 20) -> DataFrame:
    """Numbered paragraphs of the best ``n`` items, one row each."""
    best = top_n(items, order, n)
    summary = screen_summary("summary")
    zh = display_title("title", "title_zh") if "title_zh" in items.columns else F.col("title")
    entry = _paragraph([
        F.concat(F.col("rank").cast("string"), F.lit(". 【"), F.coalesce("score", F.lit(0)).cast("string"),
                 F.lit("分】"), zh),
        F.concat(F.lit("　　"), F.coalesce("site_name", F.lit("")), F.lit(" · "),
                 F.coalesce("dimension", F.lit(""))),
        F.concat(F.lit("　　"), F.nullif(summary, F.lit("")))])
    return best.select("rank", entry.alias("entry"))
