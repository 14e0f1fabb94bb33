"""Repair of links between notes."""
from pyspark.sql import functions as F

from feedscope.plans import links as L

FILES = [("2024-01-05 Carbon market opens", "政策库/中国/2024-01-05 Carbon market opens.md"), ("Solar", "媒体库/a/Solar.md"),
         ("Twice", "媒体库/a/Twice.md"), ("Twice", "媒体库/b/Twice.md"), ("Wind farm one", "媒体库/a/Wind farm one.md"),
         ("Wind farm two", "媒体库/a/Wind farm two.md"), ("a$1\\b", "政策库/a$1\\b.md")]


def repaired(spark, notes, files=FILES):
    rows = spark.createDataFrame(notes, "note_path string, note string")
    got = L.repair_links(rows, spark.createDataFrame(files, "file_name string, note_path string"))
    return {(r.note_path, r.note, r.links_fixed) for r in got.collect()}


def test_links_are_rewritten_in_place(spark):
    cases = {
        "[[../../政策库/x/Carbon market opens|the \\ $1 alias]]": "[[../../政策库/中国/2024-01-05 Carbon market opens|the \\ $1 alias]]",
        "[[../../政策库/x/2024-01-05 Carbon\\|cut]]": "[[../../政策库/中国/2024-01-05 Carbon market opens\\|cut]]",
        "[[媒体库/Solar panels more]]": "[[../../媒体库/a/Solar]]",
        "[[../../媒体库/Twice]]": "[[../../媒体库/Twice]]",              # two files
        "[[../../媒体库/Wind farm]]": "[[../../媒体库/Wind farm]]",      # two names
        "[[../../媒体库/a/Solar|fine]]": "[[../../媒体库/a/Solar|fine]]",  # exists
        "[[../../policy/../../政策库/x/Solar]]": "[[../../媒体库/a/Solar]]",
        "[[../../policy/../../政策库/nothing]]": "[[../../政策库/nothing]]",
        "[[../../政策库/zz/a$1\\b|z]]": "[[../../政策库/a$1\\b|z]]",
        "[[Solar]] [[人物/Solar]] [[]] [ [x] ]": "[[Solar]] [[人物/Solar]] [[]] [ [x] ]",
        "[[../../../../政策库/Solar]]": "[[../../../../政策库/Solar]]",
    }
    text = lambda parts: "a\n" + "\n--\n".join(parts) + "\nend\n"
    note = ("政策wiki/k/n.md", text(cases))
    assert repaired(spark, [note, note]) == {("政策wiki/k/n.md", text(cases.values()), 5)}


def test_odd_notes_and_no_files(spark):
    notes = [("w/a.md", None), (None, "[[../../政策库/Solar]]"), ("top.md", "no links"), ("w/k/b.md", "")]
    assert {n[:2] for n in repaired(spark, notes)} >= {("w/a.md", None), ("top.md", "no links"), ("w/k/b.md", "")}
    assert repaired(spark, [("w/k/b.md", "[[政策库/Solar]]")], files=[]) == {("w/k/b.md", "[[政策库/Solar]]", 0)}


def test_cuts_only_at_lengths_of_links(spark):
    """A name of 100,000 letters is cut once per length that a link under its head has, not once per letter."""
    files = spark.createDataFrame([("z" * 100_000, "p"), ("y" * 50_000, "q")], "file_name string, note_path string")
    long = files.select(F.col("file_name").alias("_x"), F.col("file_name").alias("_all"))
    short = spark.createDataFrame([("z" * 20,), ("z" * 90,), ("zz",), ("x" * 30,)], "_s string")
    assert {len(r._cut) for r in L._proper_prefixes(long, short).collect()} == {2, 20, 90}
    links = spark.createDataFrame([("z" * 90,), ("y" * 60_000,)], "target string")
    assert {r.resolved_path for r in L.resolve_links(links, files).collect()} == {"p", "q"}


def test_cuts_do_not_grow_with_the_lengths_of_other_texts(spark):
    """Texts that share only their first letters are not cut at each other's lengths; a text is met wherever it ends."""
    names = [f"Common beginning {i:03d} " + "x" * i for i in range(300)]
    long = spark.createDataFrame([(n, n) for n in names], "_x string, _all string")
    short = spark.createDataFrame([(n[:-3],) for n in names], "_s string")
    cuts = L._proper_prefixes(long, short)
    assert {n[:-3] for n in names} <= {r._cut for r in cuts.collect()}
    assert cuts.count() < 35 * len(names)
    text = "".join(chr(97 + i % 26) for i in range(70))
    got = L.resolve_links(spark.createDataFrame([(text,)], "target string").unionByName(
        spark.createDataFrame([(text[:k] + "?",) for k in (1, 2, 3, 4, 7, 8, 9, 31, 32, 33, 64, 69)], "target string")),
        spark.createDataFrame([(text[:k], str(k)) for k in (3, 32)], "file_name string, note_path string"))
    assert {(len(r.target), r.resolved_path) for r in got.collect()} == {
        (70, None), (2, None), (3, None), (4, "3"), (5, "3"), (8, "3"), (9, "3"), (10, "3"), (32, "3"), (33, None), (34, None), (65, None), (70, None)}
