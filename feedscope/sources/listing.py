"""Listing pages -> links, driven by one rule row per page kind."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.pages import anchors
from ..functions.times import parse_day
from ..functions.urls import is_junk_link, resolve_href
from ..operators.dedup import first_per_key

@dataclass(frozen=True)
class ListRule:
    """What one kind of listing page offers as content."""
    list_id: str
    min_chars: int = 8
    path: str = ""          # pattern the address must match
    deny: str = ""          # pattern it must not match
    check_junk: bool = False
    head: int = 40


def listing_links(pages: DataFrame, rules: list[ListRule]) -> DataFrame:
    """Links of landed pages that their rule accepts.

    ``pages(page_id, list_id, url, html)``.  A link needs enough text, a matching path,
    no denied part and, if asked, no junk mark; it counts once per list by (label, href),
    and each list gives its first ``head``.  Rules become literal conditions, so every
    pattern is compiled once and no join is needed.
    """
    full = anchors(pages, keep=["page_id", "list_id", "url"]).withColumn("href", resolve_href("href", "url"))
    ok, limit = F, F
    for r in rules:
        fits = (F.char_length("label") >= r.min_chars) & (F.col("href") != "")
        if r.path:
            fits = fits & F.col("href").rlike(r.path)
        if r.deny:
            fits = fits & ~F.col("href").rlike(r.deny)
        if r.check_junk:
            fits = fits & ~is_junk_link("label", "href")
        ok, limit = ok.when(F.col("list_id") == r.list_id, fits), limit.when(F.col("list_id") == r.list_id, F.lit(r.head))
    order = [F.col("page_id"), F.col("link_no")]
    once = first_per_key(full.where(ok), ["list_id", "label", "href"], order)
    head = first_per_key(once, ["list_id"], order, max(r.head for r in rules))
    # the longest head bounds this window; shorter ones are cut on it
    numbered = head.withColumn("no", F.row_number().over(Window.partitionBy("list_id").orderBy(*order)))
    return numbered.where(F.col("no") <= limit) \
        .select("list_id", "page_id", "no", F.col("label").alias("title"), F.col("href").alias("url"),
                parse_day("day").alias("published_at"))
