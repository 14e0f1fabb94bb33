"""The whole run as one plan: clean, keep once, judge, keep the window, fill, classify, score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.base import text_or_empty
from ..functions.text import needs_translation
from ..functions.titles import strip_title_suffix, title_key
from ..operators.dedup import first_per_key
from ..operators.joins import lookup_join
from ..session import cut_lineage
from . import backfill, history, score as scoring
from .rules import RulePack


@dataclass
class SideTables:
    """What earlier runs have learned: titles(url, title), summaries(url, summary), published(url, published as local text)
    and translations(title, title_zh).  None: nothing yet."""
    titles: DataFrame | None = None
    summaries: DataFrame | None = None
    published: DataFrame | None = None
    translations: DataFrame | None = None


def once(raw: DataFrame, order: list[Column]) -> DataFrame:
    """Each title key once, by the raw title; blank titles count as one key.  Equal ids have equal titles."""
    return first_per_key(raw, [title_key("title")], order)


def fill_full_title(items: DataFrame, side: SideTables, containment_only: bool = False) -> DataFrame:
    """The indexed title where it is better; a title that changed takes its own translation, if there is one."""
    if side.titles is None:
        return items
    filled = backfill.fill_title(items.withColumn("_before", F.col("title")), side.titles, containment_only=containment_only)
    changed = ~F.col("_before").eqNullSafe(F.col("title")) & needs_translation("title")
    if side.translations is None:
        return filled.drop("_before")
    cache = backfill.one_per_key(side.translations, "title", "title_zh").withColumnRenamed("title_zh", "_zh")
    zh = F.when(changed, F.nullif("_zh", F.lit("")))
    return lookup_join(filled, cache, ["title"]).withColumn("title_zh", F.coalesce(zh, F.col("title_zh"))).drop("_before", "_zh")


def feed(fresh: DataFrame, sites: DataFrame, side: SideTables, as_of: Column, pack: RulePack = RulePack(),
         containment_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, late) of items that are here once (``once``).

    Titles lose their tails and take a translation; relevance is judged on that title and the item's own summary.  Relevant
    items older than the window of their site's class are ``late``; those without a time never are.  Kept items then take
    title, summary and time from the side tables, and are classified and scored.
    """
    clean = fresh.withColumn("title", strip_title_suffix("title"))
    if "first_seen_at" not in clean.columns:
        clean = clean.withColumn("first_seen_at", as_of)
    clean = clean.withColumn("title_zh", F.lit("")) if side.translations is None else \
        backfill.translate_from_cache(clean, side.translations).drop("to_translate")
    relevant = cut_lineage(scoring.relevant(scoring.with_site_facts(clean, sites), pack))  # read for both results
    kept = fill_full_title(scoring.in_window(relevant, as_of), side, containment_only)
    kept = kept.withColumn("summary", text_or_empty("summary")) if side.summaries is None else backfill.fill_summary(kept, side.summaries)
    none = kept.select("url", F.lit(None).cast("string").alias("published")).limit(0)
    kept = backfill.fill_published(kept, none if side.published is None else side.published)
    late = scoring.outside_window(relevant, as_of)
    return scoring.score(scoring.classify(kept, pack), as_of, pack), late


def full_run(raw: DataFrame, sites: DataFrame, side: SideTables, as_of: Column, order: list[Column], order_col: str,
             stored: DataFrame | None = None, pack: RulePack = RulePack(), containment_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(history, late): the feed of ``raw`` merged into the ``stored`` history.

    ``order`` says which of several items of one title comes first; ``order_col`` is the number that history uses for it.
    """
    kept, late = feed(once(raw, order), sites, side, as_of, pack, containment_only)
    base = kept.limit(0) if stored is None else stored
    return history.merge(base, kept, as_of, order_col), late
