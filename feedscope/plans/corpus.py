"""Maintenance of the note corpus.  A corpus is a DataFrame with one row per note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import notes as N, text as X, titles as T
from ..functions.base import chars, text_or_empty
from ..functions.times import local_to_utc, shift_back_if_future
from ..operators.dedup import first_per_key
from ..operators.joins import lookup_join
from ..operators.ranking import global_rank, top_n
from ..session import cut_lineage
from . import fixed_values as V, rules, score as scoring
from .note_names import claim_paths  # noqa: F401
from .links import referenced, repair_links, resolve_links, wiki_links  # noqa: F401


# ---------------------------------------------------------------- reading and rendering
def render(items: DataFrame, as_of: Column) -> DataFrame:
    """Add ``note_path`` and ``note``.  Needs site facts, published text, tags, keywords, people, author, body."""
    day = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.substring("published", 1, 10))
    return items.withColumns({
        "note_path": N.note_path(F.col("library"), F.col("grp"), F.col("site_name"), F.col("title"),
                                 F.date_format("published_at", "yyyy-MM-dd")),
        "note": N.note_text(F.col("site_name"), F.col("title"), F.col("url"), day, F.col("tags"), F.col("keywords"),
                            F.col("published"), F.col("author"), F.col("summary"), F.col("people"),
                            F.date_format(as_of, "yyyy-MM-dd HH:mm"), F.col("body")),
    })


def parse(notes: DataFrame, note: str = "note") -> DataFrame:
    """Front matter, heading and body as columns."""
    fm = notes.withColumn("_fm", N.frontmatter_block(note))
    fields = {k: N.front_field("_fm", k) for k in ("source", "url", "date", "published", "author", "summary")}
    lists = {k: N.list_field(N.front_field("_fm", k)) for k in ("tags", "keywords", "people")}
    return fm.withColumns({**fields, **lists, "title": N.note_heading(note), "body": N.note_body(note)}).drop("_fm")


def lookup_indexes(parsed: DataFrame, order: list[Column]) -> dict[str, DataFrame]:
    """url -> published / title / summary, non-empty only; a later note replaces an earlier one."""
    have_url = parsed.where(F.col("url").isNotNull())
    return {c: first_per_key(have_url.where(F.coalesce(F.col(c), F.lit("")) != ""), ["url"], order)
            .select("url", c) for c in ("published", "title", "summary")}


def title_index(parsed: DataFrame, order: list[Column]) -> DataFrame:
    """url -> heading without the known bad headings."""
    good = parsed.where(F.col("title").isNotNull() & F.col("url").isNotNull()
                        & ~F.col("title").rlike(V.INDEX_BAD_TITLES))
    return first_per_key(good, ["url"], order).select("url", "title")


# ---------------------------------------------------------------- planning new notes
def replaced_notes(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Old paths of stale notes that were planned again under another path."""
    stale = existing.where(~F.col("has_summary")).select("url", F.col("note_path").alias("old_path"))
    fresh = planned.select("url", "note_path").distinct()
    return stale.join(fresh, "url").where(F.col("old_path") != F.col("note_path")).select("old_path").distinct()


# ---------------------------------------------------------------- selections
def thin_notes(notes: DataFrame, least: int = 50, body: str = "body") -> DataFrame:
    return notes.where(chars(text_or_empty(body)) < least)


def without_listed(notes: DataFrame, junk: DataFrame, key: str = "note_path") -> DataFrame:
    return lookup_join(notes, junk.select(key).distinct(), [key], "left_anti")


def fix_titles_and_drop_navigation(items: DataFrame) -> DataFrame:
    """Strip agency tails; navigation pages go; static pages go when a tail had to be stripped."""
    stripped = items.withColumn("_t", T.strip_agency_tails("title"))
    changed = F.col("_t") != F.col("title")
    doomed = T.is_corpus_nav("_t") | (changed & T.is_static_page("_t"))
    return stripped.where(~doomed).withColumn("title", F.col("_t")).drop("_t")


def title_audit(notes: DataFrame, name: str = "file_name", heading: str = "title") -> DataFrame:
    """Class of each heading against its file name: OK, SUFFIX, ENHANCED or POLLUTED."""
    sim = T.title_similarity(name, heading, contained_is_one=False)
    n, h = F.col(name), F.col(heading)
    scored = notes.withColumn("_sim", sim)
    return scored.withColumn(
        "title_class",
        F.when(h.rlike(V.AUDIT_BAD_TITLES), "POLLUTED")
        .when((F.col("_sim") >= 0.9) & h.startswith(n) & (chars(h) > chars(n)), "SUFFIX")
        .when(F.col("_sim") >= 0.9, "OK").when(F.col("_sim") >= 0.5, "ENHANCED").otherwise("POLLUTED")).drop("_sim")


# ---------------------------------------------------------------- links between notes
def move_library_paths(text: Column | str, moves=tuple(V.LIBRARY_MOVES)) -> Column:
    """Rewrite relative links of sites that moved to another library folder."""
    out = F.col(text) if isinstance(text, str) else text
    for site, new in moves:
        out = F.replace(out, F.lit(f"../../政策库/{site}/"), F.lit(f"../../{new}/{site}/"))
    return out


# ---------------------------------------------------------------- repairs
def inject(notes: DataFrame, extra: DataFrame) -> DataFrame:
    """Put ``summary, published, body`` of ``extra(url, ...)`` into notes that lack them."""
    j = lookup_join(notes, extra.select("url", *[F.col(c).alias("_" + c) for c in ("summary", "published", "body")]),
                    ["url"])
    note = F.col("note")
    with_sum = F.when(F.coalesce(F.regexp_extract(note, r'(?m)^summary:\s*"([^"]+)', 1), F.lit("")) == "",
                      N.set_line(note, "summary", F.col("_summary"), "keywords")).otherwise(note)
    step1 = j.withColumn("note", with_sum)
    step2 = step1.withColumn("note", N.set_published(F.col("note"), F.col("_published"))) \
                 .withColumn("note", N.show_published(F.col("note"), F.col("_published")))
    return step2.withColumn("note", N.add_body(F.col("note"), F.col("_body"))).drop("_summary", "_published", "_body")


def rescore(items: DataFrame, sites: DataFrame, as_of: Column, filtered_sites=("radarai",)) -> DataFrame:
    """Drop off-topic rows of the given sites, then recompute dimension, people and score; marks changes."""
    old = scoring.with_site_facts(items.withColumn("_old", F.col("dimension")), sites)
    kept = scoring.drop_off_topic(old, filtered_sites)
    people = F.when(F.coalesce(F.size("_people"), F.lit(0)) > 0, F.col("_people")).otherwise(F.col("people"))
    redone = scoring.classify(kept.withColumn("_people", F.col("people"))).withColumn("people", people)
    return scoring.score(redone, as_of) \
        .withColumn("changed", ~F.col("_old").eqNullSafe(F.col("dimension"))).drop("_old", "_people")


def fill_topics(items: DataFrame) -> DataFrame:
    return rules.lowered(items).withColumn("topics", F.when(F.coalesce(F.size("topics"), F.lit(0)) > 0, F.col("topics"))
                                           .otherwise(rules.topics())).drop(rules.TITLE_L, rules.TEXT_L)


def fill_people(notes: DataFrame, force: bool = False, body_chars: int | None = None) -> DataFrame:
    """Find people in title, summary and body (or its head); write them where none are stored."""
    found = rules.people("title", "summary", "body", body_chars=body_chars)
    none = F.coalesce(F.size("people"), F.lit(0)) == 0
    write = (F.size("_found") > 0) & (F.lit(force) | none)
    return notes.withColumn("_found", found) \
        .withColumn("_write", write) \
        .withColumn("note", F.when(F.col("_write"), N.set_people(F.col("note"), F.col("_found"))).otherwise(F.col("note"))) \
        .withColumn("note", F.when(F.col("_write"), N.show_people(F.col("note"), F.col("_found"))).otherwise(F.col("note"))) \
        .withColumn("people", F.when(F.col("_write"), F.col("_found")).otherwise(F.col("people"))).drop("_found", "_write")


def suspect_times(index: DataFrame, items: DataFrame) -> DataFrame:
    """Index rows whose day equals the capture day of their item."""
    seen = items.where(F.col("first_seen_at").isNotNull()).groupBy("url").agg(F.max("first_seen_at").alias("_seen"))
    return index.join(seen, "url").where(F.substring("published", 1, 10) == F.date_format("_seen", "yyyy-MM-dd")) \
                .drop("_seen")


def repair_times(index: DataFrame, items: DataFrame, extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new index, new items): suspects take the re-extracted time, else count as captured only.

    ``extracted(url, published)`` comes from re-reading the pages.
    """
    suspects = suspect_times(index, items).select("url")
    verdict = lookup_join(suspects, extracted.select("url", F.col("published").alias("_new")), ["url"]) \
        .withColumn("_suspect", F.lit(True))
    verdict = cut_lineage(verdict)  # both results read it
    idx = lookup_join(index, verdict, ["url"])
    new_index = idx.where(F.col("_suspect").isNull() | F.col("_new").isNotNull()) \
                   .withColumn("published", F.coalesce("_new", "published")).drop("_new", "_suspect")
    it = lookup_join(items, verdict, ["url"])
    to_capture = F.col("_suspect") & F.col("_new").isNull() & (F.col("time_source") == "published")
    fixed = F.col("_new").isNotNull()
    new_items = it.withColumn("_pub", F.when(fixed, local_to_utc("_new")).when(to_capture, F.col("first_seen_at"))
                              .otherwise(F.col("published_at"))) \
                  .withColumn("time_source", F.when(fixed, "published").when(to_capture, "scraped")
                              .otherwise(F.col("time_source"))) \
                  .withColumn("published_at", F.col("_pub")).drop("_pub", "_new", "_suspect")
    return new_index, new_items


def shift_future(notes: DataFrame) -> DataFrame:
    """Published times later than their capture move back by 8 h steps."""
    t = F.try_to_timestamp("published")
    fixed = F.date_format(shift_back_if_future(t, "first_seen_at"), "yyyy-MM-dd HH:mm")
    late = local_to_utc("published") > F.col("first_seen_at")
    return notes.withColumn("published", F.when(late, fixed).otherwise(F.col("published")))


def finish(notes: DataFrame) -> DataFrame:
    """Missing publish time falls back to the date, then to the capture day; notes without body are link cards."""
    first = F.date_format("first_seen_at", "yyyy-MM-dd")
    return notes.withColumn("published", F.coalesce("published", "date", first)) \
                .withColumn("link_only", F.coalesce("body", F.lit("")) == "")


def upgrade_titles(notes: DataFrame, pages: DataFrame, limit: int = 30) -> DataFrame:
    """Short or site-tailed titles take the page title when it is longer or part of the old one.

    Adds ``new_name``; two notes never end on one path: a taken or doubly claimed name keeps the old file name.
    """
    j = lookup_join(notes, pages.select("url", F.col("page_title").alias("_page")), ["url"])
    take = (T.is_short_title("title", limit) & (text_or_empty("_page") != "")
            & ((chars("_page") > chars("title")) | F.col("title").contains(F.col("_page"))))
    prefix = F.regexp_extract("file_name", r"^(\d{4}-\d{2}-\d{2} )", 1)
    named = j.withColumn("_take", take).withColumns({
        "title": F.when(F.col("_take"), F.col("_page")).otherwise(F.col("title")),
        "_want": F.when(F.col("_take"), F.concat(prefix, N.safe_name("_page", 80))).otherwise(F.col("file_name")),
    }).drop("_page", "_take")
    moving = F.col("_want") != F.col("file_name")
    claims = named.where(moving).groupBy("folder", "_want").agg(F.min("id").alias("_winner"))
    taken = notes.select("folder", F.col("file_name").alias("_want"), F.lit(True).alias("_taken")).distinct()
    checked = lookup_join(lookup_join(named, claims, ["folder", "_want"]), taken, ["folder", "_want"])
    free = F.col("_taken").isNull() & (F.col("_winner") == F.col("id"))
    return checked.withColumn("new_name", F.when(moving & free, F.col("_want")).otherwise(F.col("file_name"))) \
                  .drop("_want", "_winner", "_taken")


def repair_summaries(items: DataFrame) -> DataFrame:
    hit = text_or_empty("summary").rlike(V.POLLUTED_SUMMARY)
    return items.withColumn("summary_fixed", hit) \
                .withColumn("summary", F.when(hit, X.clean_summary("summary")).otherwise(F.col("summary")))


def refresh_bodies(notes: DataFrame, pages: DataFrame, least: int = 50) -> DataFrame:
    """Thin notes take the page's body when that is longer.  ``pages(url, page_body)``; of several pages of one URL the
    longest body counts."""
    thin = thin_notes(notes, least)
    rest = notes.where(chars(text_or_empty("body")) >= least)
    j = lookup_join(thin, pages.groupBy("url").agg(F.max_by("page_body", F.struct(chars(text_or_empty("page_body")), "page_body")).alias("_body")), ["url"])
    longer = chars(text_or_empty("_body")) > chars(text_or_empty("body"))
    return j.withColumn("body", F.when(longer, F.col("_body")).otherwise(F.col("body"))).drop("_body") \
            .unionByName(rest)


def clear_dead_authors(notes: DataFrame, status: DataFrame, suspects: list[str]) -> DataFrame:
    """A suspect author goes when the page is gone.  ``status(url, gone)``."""
    j = lookup_join(notes, status.select("url", "gone"), ["url"])
    drop = F.col("author").isin(suspects) & F.coalesce("gone", F.lit(False))
    return j.withColumn("author", F.when(drop, F.lit(None).cast("string")).otherwise(F.col("author"))).drop("gone")


# ---------------------------------------------------------------- catalogues
def coverage(notes: DataFrame) -> DataFrame:
    """Notes, notes with body and link cards per group and site."""
    return notes.groupBy("grp", "site_name").agg(
        F.count("*").alias("n"), F.count_if(chars(text_or_empty("body")) > 0).alias("with_body"),
        F.count_if(chars(text_or_empty("body")) == 0).alias("link_cards"))


def latest(notes: DataFrame, n: int = 50, tag: str | None = None, id_col: str = "id") -> DataFrame:
    rows = notes.where(F.array_contains("tags", tag)) if tag else notes
    return top_n(rows, [F.col("date").desc_nulls_last(), F.col(id_col)], n)


def catalogue_entries(notes: DataFrame, id_col: str = "id", summary_chars: int | None = None) -> DataFrame:
    """Every note's catalogue paragraph, with its summary or the head of it, and its newest-first position."""
    def line(label, value, empty):
        return F.concat(F.lit(f"- {label}: "), F.coalesce(F.nullif(value, F.lit("")), F.lit(empty)))

    def optional(label, value):
        return F.concat(F.lit(f"- {label}: "), F.nullif(value, F.lit("")))
    def bracketed(name):
        return F.concat(F.lit("["), F.array_join(name, ", "), F.lit("]"))
    order = [F.col("date").desc_nulls_last(), F.col(id_col).asc()]
    # only the sort columns are ranked; texts meet their position by the unique id
    ranked = notes.join(global_rank(notes.select(id_col, "date"), order, "position").select(id_col, "position"), id_col)
    entry = F.concat_ws(
        "\n", F.concat(F.lit("### "), text_or_empty("date"), F.lit(" | "), text_or_empty("source"), F.lit(" | "),
                       F.col("note_path")),
        line("Title", F.col("title"), ""), line("Published", F.col("published"), "(unknown)"),
        optional("Author", F.col("author")), optional("People", F.when(F.size("people") > 0, bracketed("people"))),
        line("Tags", bracketed("tags"), ""), line("Keywords", bracketed("keywords"), ""),
        line("Summary", F.substring("summary", 1, summary_chars) if summary_chars else F.col("summary"), "(none)"), line("URL", F.col("url"), ""))
    return ranked.select(id_col, "position", entry.alias("entry"))


def catalogue_topics(notes: DataFrame, k: int = 30, id_col: str = "id") -> DataFrame:
    """Newest ``k`` notes per tag; ``n`` counts all of them."""
    each = notes.select(id_col, "date", "note_path", F.explode_outer("tags").alias("tag")) \
                .where(F.col("tag").isNotNull() & (F.col("tag") != "") & ~F.col("tag").isin(V.CATALOG_SKIPPED_TAGS))
    each = cut_lineage(each)  # read twice below
    total = each.groupBy("tag").agg(F.count("*").alias("n"))
    heads = first_per_key(each, ["tag"], [F.col("date").desc_nulls_last(), F.col(id_col)], k)
    w = Window.partitionBy("tag").orderBy(F.col("date").desc_nulls_last(), F.col(id_col))
    return lookup_join(heads.withColumn("place", F.row_number().over(w)), total, ["tag"])
