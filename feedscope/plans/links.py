"""Links between notes: finding, resolving and rewriting ``[[path|alias]]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.base import chars, text_or_empty
from ..operators.joins import lookup_join
from ..session import cut_lineage
from . import fixed_values as V

LINK = r"\[\[([^\[\]]+?)\]\]"
_DATED = r"^\d{4}-\d{2}-\d{2} "


def link_parts(note: Column | str) -> Column:
    """Array of (path, alias) of the links of a note; the alias keeps its bar."""
    inner = F.regexp_extract_all(text_or_empty(note), F.lit(LINK), F.lit(1))

    def parts(x):
        path = F.regexp_extract(x, r"(?s)^(.*?)(?:\\?\|.*)?\z", 1)
        return F.struct(path.alias("path"), F.substring(x, chars(path) + 1, chars(x)).alias("alias"))
    return F.transform(inner, parts)


def wiki_links(notes: DataFrame, note: str = "note") -> DataFrame:
    """One row per ``[[target|alias]]``."""
    return notes.select(*[c for c in notes.columns if c != note], F.explode(link_parts(note)).alias("_l")) \
                .withColumn("target", F.trim("_l.path")).drop("_l")


def referenced(names: DataFrame, links: DataFrame, name: str = "file_name") -> DataFrame:
    """Names that some link points at, with the number of links."""
    hits = links.groupBy(F.col("target").alias(name)).agg(F.count("*").alias("links"))
    return names.select(name).distinct().join(hits, name)


# ------------------------------------------------------------------ resolving names
def _levels(x: Column) -> Column:
    """The powers of two up to the length of ``x``, which is not empty."""
    return F.transform(F.sequence(F.lit(0), F.length(F.bin(chars(x))) - 1), lambda j: F.pow(F.lit(2.0), j).cast("int"))


def _cuts(long: DataFrame, short: DataFrame) -> DataFrame:
    """long(_x, ...), short(_s): long with ``_cut``, the first letters of ``_x`` at every length where they may be some shorter ``_s``.

    A trie whose levels are powers of two: a short text is listed with its length under its first 1, 2, 4, 8 ... letters, as
    many as it has, so texts meet there only if they share at least half of the shorter one.  A text asks once a level, and
    only hashes and lengths travel to find its lengths.  Equal hashes of other texts add a cut, which then meets no ``_s``.
    """
    n, size = F.char_length("_s"), F.element_at(_levels(F.col("_s")), -1)
    listed = short.where("_s <> ''").select(F.xxhash64(F.substring(F.col("_s"), F.lit(1), size), size).alias("_head"), n.alias("_n")) \
        .groupBy("_head").agg(F.collect_set("_n").alias("_sizes"))
    heads = F.transform(_levels(F.col("_x")), lambda k: F.xxhash64(F.substring(F.col("_x"), F.lit(1), k), k))
    asked = long.where("_x <> ''").select(F.xxhash64("_x").alias("_key"), F.char_length("_x").alias("_all"), F.explode(heads).alias("_head"))
    sizes = asked.join(listed, "_head").select("_key", F.explode(F.filter("_sizes", lambda k: k < F.col("_all"))).alias("_k")) \
        .groupBy("_key").agg(F.collect_set("_k").alias("_sizes"))
    return long.where("_x <> ''").withColumn("_key", F.xxhash64("_x")).join(sizes, "_key") \
        .select(*long.columns, F.explode("_sizes").alias("_k")).where(F.col("_k") < F.char_length("_x")) \
        .select(*long.columns, F.substring(F.col("_x"), F.lit(1), F.col("_k")).alias("_cut"))


def _proper_prefixes(long: DataFrame, short: DataFrame, full: Column | str = "_all") -> DataFrame:
    """The first letters of ``_x`` that may be some ``_s``, with the least and greatest ``full``.

    Cuts are reduced to two values before they are shuffled, so a beginning that very many texts share is one row per task.
    """
    return _cuts(long, short).groupBy("_cut").agg(F.min(full).alias("_lo"), F.max(full).alias("_hi"))


def resolve_links(links: DataFrame, files: DataFrame, target: str = "target", name: str = "file_name",
                  path: str = "note_path") -> DataFrame:
    """Path each link name means, NULL when none or several fit.

    Exact name first (must have one path).  Otherwise the names that start with the link, that the link starts with, or
    that are the link after a date prefix must be one single name.  Every test is an equi-join on a cut of a name or link
    at a length that exists on the other side; no pairs are listed.  Only names that no file has go through the cuts.
    """
    by_name = cut_lineage(files.where(text_or_empty(name) != "").groupBy(name).agg(
        F.min(path).alias("_path"), F.max(path).alias("_path2")))
    wanted = links.select(F.col(target).alias("_link")).where("_link <> ''").distinct()
    exact = cut_lineage(wanted.join(by_name.select(F.col(name).alias("_link"), F.lit(True).alias("_known"), F.when(
        F.col("_path") == F.col("_path2"), F.col("_path")).alias("_exact")), "_link", "left"))  # read several times below
    open_links = exact.where(F.col("_known").isNull()).select("_link")
    names = by_name.select(F.col(name).alias("_n"))
    # names that go on where the link ends
    starts = _proper_prefixes(names.select(F.col("_n").alias("_x")), open_links.select(F.col("_link").alias("_s")), "_x")
    longer = open_links.join(starts.withColumnRenamed("_cut", "_link"), "_link")
    # dated names that end with the link: the same on turned texts
    dated = names.where(F.col("_n").rlike(_DATED)).select(F.reverse("_n").alias("_x"))
    ends = _proper_prefixes(dated, open_links.select(F.reverse("_link").alias("_s")), F.reverse("_x"))
    ending = open_links.join(ends.select(F.reverse("_cut").alias("_link"), "_lo", "_hi"), "_link")
    # names that the link goes on from: links are cut, each cut is one name
    cuts = _cuts(open_links.select(F.col("_link").alias("_x")), names.select(F.col("_n").alias("_s"))) \
        .select(F.col("_x").alias("_link"), F.col("_cut").alias("_n"))
    shorter = cuts.join(names, "_n").groupBy("_link").agg(F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    fuzzy = longer.unionByName(ending).unionByName(shorter).groupBy("_link") \
        .agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).where("_lo = _hi") \
        .join(by_name.select(F.col(name).alias("_lo"), F.col("_path").alias("_fuzzy")), "_lo").select("_link", "_fuzzy")
    answer = exact.join(fuzzy, "_link", "left").select(
        F.col("_link").alias(target), F.coalesce("_exact", "_fuzzy").alias("resolved_path"))
    return lookup_join(links, answer, [target])


# ------------------------------------------------------------------ rewriting notes
def normal_path(folder: Column, relative: Column) -> Column:
    """``folder/relative`` without ``.`` and ``..``; NULL when it leaves the root."""
    steps = F.concat(F.split(folder, "/"), F.split(relative, "/"))
    none = F.lit(None).cast("array<string>")

    def step(done, s):
        return (F.when((s == "") | (s == "."), done)
                .when((s == "..") & (F.size(done) > 0), F.slice(done, F.lit(1), F.size(done) - 1))
                .when(s == "..", none).otherwise(F.concat(done, F.array(s))))
    start = F.array().cast("array<string>")
    return F.array_join(F.aggregate(steps, start, lambda done, s: F.when(done.isNotNull(), step(done, s))), "/")


def _library_rest(path: Column) -> Column:
    """What follows the library folder of a link, NULL for other links."""
    found = F.regexp_extract(path, rf"(?s)^(?:\.\./\.\./)?(?:{'|'.join(V.NOTE_LIBRARY_DIR.values())})/(.*)\z", 1)
    return F.when(path.rlike(rf"^(?:\.\./\.\./)?(?:{'|'.join(V.NOTE_LIBRARY_DIR.values())})/"), found)


def repair_links(notes: DataFrame, files: DataFrame, key: str = "note_path", note: str = "note") -> DataFrame:
    """``notes`` with links into the libraries repaired, and ``links_fixed``, the number of rewritten links.

    Paths count from the folder of all notes; a note's own folder is that of its ``note_path``.  The doubled prefix of
    ``V.LINK_PREFIX_FIX`` goes first.  A link whose file exists stays; so does one whose name fits no file or several.
    Other library links get the path of the file their last part names, with their alias.  ``files(file_name, note_path)``.

    Only links travel: a note is split at its links in place, the new links come back as one ordered array and are put
    between the pieces.  Notes without a rewritten link are not changed.
    """
    tidy = notes.withColumn(note, F.replace(F.col(note), *[F.lit(x) for x in V.LINK_PREFIX_FIX])) \
                .withColumn("_row", F.xxhash64(note, key))
    folder = F.regexp_extract(key, r"(?s)^(.*)/[^/]*\z", 1)
    links = tidy.select(key, "_row", F.posexplode(link_parts(note)).alias("_no", "_l")) \
        .select(key, "_row", "_no", "_l.*", normal_path(folder, F.col("_l.path")).alias("_at"), _library_rest(F.col("_l.path")).alias("_rest"))
    # copies of a note have the same links
    links = cut_lineage(links.where("_rest is not null").dropDuplicates([key, "_row", "_no"]))
    places = files.select(F.explode(F.array(F.col("note_path"), F.regexp_replace("note_path", r"\.md$", ""))).alias("_at"),
                          F.lit(True).alias("_there")).distinct()
    lost = lookup_join(links, places, ["_at"]).where("_there is null") \
        .withColumn("target", F.regexp_extract("_rest", r"(?s)([^/]*)\z", 1))
    found = resolve_links(lost, files).where("resolved_path is not null")
    new = F.concat(F.lit("[[../../"), F.regexp_replace("resolved_path", r"\.md$", ""), F.col("alias"), F.lit("]]"))
    per_note = found.groupBy(key, "_row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_no", new)))).alias("_new"))
    joined = lookup_join(tidy, per_note, [key, "_row"])
    whole, pieces = F.regexp_extract_all(note, F.lit(LINK), F.lit(0)), F.split(note, LINK, -1)
    rebuilt = F.array_join(F.zip_with(pieces, F.transform(whole, lambda x, i: F.coalesce(F.element_at("_new", i), x)),
                                      lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return joined.withColumns({note: F.when(F.col("_new").isNotNull(), rebuilt).otherwise(F.col(note)),
                               "links_fixed": F.when(F.col("_new").isNotNull(), F.size("_new")).otherwise(0)}).drop("_row", "_new")
