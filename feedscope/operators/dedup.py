"""Keep-one-per-key rules.

Each rule is a ``row_number() <= k`` filter: Spark puts a group limit in front of
the shuffle, so every task sends at most k rows per key and a hot key never
gathers in one task.  Orders are total (they end in a unique column), so the
result does not depend on arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.base import text_or_empty
from ..functions.titles import title_key
from .joins import lookup_join


def first_per_key(df: DataFrame, keys: list, order: list, k: int = 1) -> DataFrame:
    """The first ``k`` rows of every key under a total order.

    The early group limit applies up to ``spark.sql.optimizer.windowGroupLimitThreshold`` (1000) rows.
    """
    names = []
    for i, key in enumerate(keys):
        names.append(f"_k{i}")
        df = df.withColumn(f"_k{i}", F.col(key) if isinstance(key, str) else key)
    w = Window.partitionBy(*names).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn", *names)


def by_title(items: DataFrame, order: list, title: str = "title", id_col: str | None = "item_id") -> DataFrame:
    """Ingest rule: same id once, then same title key once; all blank titles count as one key."""
    once = first_per_key(items, [id_col], order) if id_col else items
    return first_per_key(once, [title_key(title)], order)


def by_title_keep_blank(items: DataFrame, order: list, title: str = "title") -> DataFrame:
    """File rule: same title key once, rows with a blank key all stay."""
    keyed = items.withColumn("_key", title_key(title))
    blank = keyed.where("_key = ''").drop("_key")
    return first_per_key(keyed.where("_key <> ''"), ["_key"], order).drop("_key").unionByName(blank)


def by_url(items: DataFrame, order: list, url: str = "url") -> DataFrame:
    """Same URL once, end slashes aside; rows without a URL count as one."""
    return first_per_key(items, [F.regexp_replace(text_or_empty(url), "/+$", "")], order)


def longest_by_url(notes: DataFrame, url: str = "url", title: str = "title", modified: str = "modified",
                   id_col: str = "id") -> DataFrame:
    """Same URL once: longest title, then newest, then lowest id; rows without a URL stay."""
    order = [F.char_length(text_or_empty(title)).desc(), F.col(modified).desc_nulls_last(), F.col(id_col)]
    return first_per_key(notes.where(F.col(url).isNotNull()), [url], order) \
        .unionByName(notes.where(F.col(url).isNull()))


def drop_undated_copies(notes: DataFrame, name: str = "file_name", url: str = "url", same_url: bool = True,
                        keep_both: Column | None = None, id_col: str = "id") -> DataFrame:
    """Where a name exists with and without a date prefix, the undated copies go.

    ``same_url`` picks the groups with one URL (True) or several (False).
    ``keep_both`` marks undated rows that save a pair of exactly one dated and one
    undated note.  Group facts are pre-aggregated; the join back splits hot names.
    """
    dated = F.col(name).rlike(r"^\d{4}-\d{2}-\d{2} ")
    marked = notes.withColumn("_dated", dated) \
                  .withColumn("_name", F.regexp_replace(name, r"^\d{4}-\d{2}-\d{2} ", "")) \
                  .withColumn("_keep", (keep_both if keep_both is not None else F.lit(False)) & ~dated)
    u = F.coalesce(F.col(url), F.lit("?"))
    facts = marked.groupBy("_name").agg(
        F.count_if("_dated").alias("_with"), F.count_if(~F.col("_dated")).alias("_without"),
        F.min(u).alias("_u0"), F.max(u).alias("_u1"), F.max("_keep").alias("_saved"))
    one_url = F.col("_u0") == F.col("_u1")
    doomed = facts.where((F.col("_with") > 0) & (F.col("_without") > 0) & (one_url if same_url else ~one_url)
                         & ~(F.col("_saved") & (F.col("_with") == 1) & (F.col("_without") == 1))) \
                  .select("_name", F.lit(True).alias("_doomed"))
    return lookup_join(marked, doomed, ["_name"]) \
        .where(~(F.coalesce(F.col("_doomed"), F.lit(False)) & ~F.col("_dated"))) \
        .drop("_dated", "_name", "_keep", "_doomed")


def best_section(rows: DataFrame, title: str, priority: Column, position: Column) -> DataFrame:
    """Same title in several sections: lowest priority number, then first position."""
    return first_per_key(rows.withColumn("_prio", priority), [title], [F.col("_prio"), position]).drop("_prio")


def first_of_repeated_keys(lines: DataFrame, note_id: str, line_no: str, line: str, key: str) -> DataFrame:
    """Inside each note only the first line ``key:`` stays."""
    hit = F.col(line).startswith(f"{key}:")
    return lines.where(~hit).unionByName(first_per_key(lines.where(hit), [note_id], [F.col(line_no)]))
