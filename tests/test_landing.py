"""Files in, files out, streams and repeated maintenance runs."""
import json

from pyspark.sql import functions as F

from feedscope.functions import notes as N, pages as P, text as X, times as TM, urls as U
from feedscope.operators import dedup
from feedscope.plans import corpus as C, history as H
from feedscope.sources import payloads, sinks
from feedscope.streaming import ingest

AS_OF = "2024-01-31"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def test_item_files_wrapped_and_bare(spark, tmp_path):
    item = {"id": "1", "title": "a", "url": "u", "published_at": "2024-01-01T08:00:00+08:00", "topics": ["x"], "score": 7}
    (tmp_path / "wrapped.json").write_text(json.dumps({"generated_at": "x", "items": [item, {**item, "id": "2", "published_at": "junk"}]}))
    (tmp_path / "bare.json").write_text(json.dumps([{**item, "id": "3"}]))
    rows = {r["id"]: r for r in payloads.read_items(spark, str(tmp_path)).collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["1"]["published_at"].isoformat() == "2024-01-01T00:00:00" and rows["2"]["published_at"] is None
    assert rows["3"]["topics"] == ["x"] and rows["3"]["score"] == 7


def test_feed_files(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A &amp; B</title><link>http://x/1</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>"
                                    "<item><title> </title><link>http://x/2</link></item><item><title>A &amp; B</title><link>http://x/1</link></item></channel></rss>")
    e = payloads.read_feed_files(spark, str(tmp_path / "f.xml")).withColumn("site_id", F.lit("s")).withColumn("site_name", F.lit("S"))
    rows = payloads.feed_items(e).collect()
    assert [(r["title"], r["source"], r["published_at"].isoformat()) for r in rows] == [("A & B", "S", "2024-01-02T10:00:00")]


def test_atom_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<feed><entry><title>T</title><link rel="self" href="http://x/self"/><link href="http://x/1"/><updated>2024-01-02T10:00:00Z</updated>'
                                    '<author><name>N</name></author></entry><entry><title>U</title><link rel="alternate" href="http://x/2"/></entry></feed>')
    e = payloads.read_feed_files(spark, str(tmp_path / "a.xml"), "entry").withColumn("site_id", F.lit("s")).withColumn("site_name", F.lit("S"))
    rows = sorted((r["title"], r["url"], r["source"], r["published_at"] and r["published_at"].isoformat()) for r in payloads.feed_items(e).collect())
    assert rows == [("T", "http://x/1", "N", "2024-01-02T10:00:00"), ("U", "http://x/2", "S", None)]


def test_aged_out_titles_come_back(spark, tmp_path):
    table = ingest.HistoryTable(spark, str(tmp_path / "t"))
    row = spark.createDataFrame([(1, "A title", "u")], "id int, title string, url string")
    table.append(row.withColumn("published_at", F.lit("2023-10-01").cast("timestamp")), 0, [F.col("id")])
    table.append(row.withColumn("published_at", as_of()), 1, [F.col("id")], as_of())
    table.append(row.withColumn("published_at", as_of()), 2, [F.col("id")], as_of())
    assert [r["published_at"].isoformat() for r in table.read(as_of(), 62).collect()] == ["2024-01-31T00:00:00"]


def test_note_files_round_trip(spark, tmp_path):
    rows = [("政策库/中国/部/2024-01-01 标题 a.md", "---\nsource: \"部\"\nurl: http://x/1\ndate: 2024-01-01\ntags: [t1, t2]\nurl: http://x/2\n---\n\n# 标题 a\n\n## 正文\n\nline: 1\nline 2"),
            ("媒体库/b+c/plain.md", "no front matter"), ("政策库/政策库.md", "index")]
    for path, text in rows:
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    notes = payloads.read_notes(spark, str(tmp_path))
    got = {r["file_name"]: r for r in C.parse(notes).collect()}
    assert set(got) == {"2024-01-01 标题 a", "plain"}
    one = got["2024-01-01 标题 a"]
    assert (one["url"], one["tags"], one["title"], one["body"]) == ("http://x/2", ["t1", "t2"], "标题 a", "line: 1\nline 2")
    assert got["plain"]["url"] is None and got["plain"]["tags"] == []


def test_outlines(spark):
    text = '<opml><body><outline text="g"><outline text="A &amp; b" xmlUrl="https://a/rss"/><outline xml_url="http://b/feed.xml"/><outline xmlUrl="ftp://c"/></outline></body></opml>'
    got = sorted(map(tuple, payloads.outlines(spark.createDataFrame([(text,)], "value string")).collect()))
    assert got == [("http://b/feed.xml", "feed.xml"), ("https://a/rss", "A & b")]


def test_sinks(spark, tmp_path):
    items = spark.createDataFrame([("1", "s", "S"), ("2", "s", "S")], "id string, site_id string, site_name string").withColumn("published_at", as_of())
    sinks.write_feed(items, items, as_of(), str(tmp_path / "feed"))
    assert spark.read.json(str(tmp_path / "feed/summary")).first()["total_items"] == 2
    sinks.write_history(items, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == 2
    assert sinks.write_index(items.limit(0), str(tmp_path / "i")) is False
    assert sinks.write_index(items, str(tmp_path / "i")) is True


def test_note_edits_do_not_repeat(spark):
    note = "---\nurl: u\ndate: 2024-01-01\nkeywords: [k]\n---\n\n# T\n\n> 来源: s\n> 首次抓取: x\nbody $1 \\ end"
    v, p = F.lit('cost $5 \\ "q"'), F.array(F.lit("n1"), F.lit("n2"))

    def edit(c):
        c = N.set_line(c, "summary", v, "keywords")
        c = N.show_published(N.set_published(c, F.lit("2024-01-02")), F.lit("2024-01-02"))
        return N.add_body(N.show_people(N.set_people(c, p), p), F.lit("B"))
    df = spark.createDataFrame([(note,)], "note string")
    once = df.withColumn("note", edit(F.col("note")))
    text = once.first()[0]
    assert text == ("---\nurl: u\ndate: 2024-01-01\npublished: \"2024-01-02\"\nkeywords: [k]\nsummary: \"cost $5 \\ 'q'\"\npeople: [n1, n2]\n---\n\n# T\n\n> 来源: s\n"
                    "> 发布时间: 2024-01-02\n> 首次抓取: x\n> 人物: [[人物/n1|n1]]、[[人物/n2|n2]]\nbody $1 \\ end\n\n## 正文\n\nB\n")
    assert once.withColumn("note", edit(F.col("note"))).first()[0] == text


def test_merge_is_idempotent_and_order_free(spark):
    rows = spark.range(300).select("id", F.concat(F.lit("Title "), (F.col("id") % 120).cast("string")).alias("title"),
                                   F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit(None).cast("timestamp").alias("published_at"))
    a, b = rows.where("id < 200"), rows.where("id >= 150")
    once = H.merge(a, b, as_of())
    twice = H.merge(once, b, as_of())
    shuffled = H.merge(a.repartition(7, F.rand(3)), b.repartition(3, F.rand(4)), as_of())
    ids = sorted(r["id"] for r in once.collect())
    assert ids == sorted(r["id"] for r in twice.collect()) == sorted(r["id"] for r in shuffled.collect()) and len(ids) == 120


def test_keyless_rows(spark):
    rows = spark.createDataFrame([(1, "", "u"), (2, "-", "u"), (3, "", None), (4, "x", None)], "id int, title string, url string") \
                .withColumn("published_at", F.lit(None).cast("timestamp"))
    assert sorted(r["id"] for r in H.merge(rows, rows.limit(0), as_of()).collect()) == [2, 4]  # stored: last wins
    assert sorted(r["id"] for r in H.merge(rows.limit(0), rows, as_of()).collect()) == [1, 4]  # new: first wins
    assert sorted(r["id"] for r in dedup.by_title_keep_blank(rows, [F.col("id")]).collect()) == [1, 2, 3, 4]


def test_stream_equals_batch_and_survives_a_rerun(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.range(200).select("id", F.concat(F.lit("T"), (F.col("id") % 90).cast("string")).alias("title"),
                                   F.lit("u").alias("url"), F.lit(None).cast("timestamp").alias("published_at"))
    for part in range(4):
        rows.where(f"id div 50 = {part}").coalesce(1).write.mode("append").parquet(str(src))
    table = ingest.HistoryTable(spark, str(tmp_path / "table"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    ingest.accumulate(stream, table, str(tmp_path / "cp"), [F.col("id")]).awaitTermination()
    keys = sorted(r["title"] for r in table.read(as_of(), 62).collect())
    assert keys == sorted({f"T{i % 90}" for i in range(200)})
    entries = table.entries()
    assert sorted(e["batch"] for e in entries) == [0, 1, 2, 3]
    name = entries[0]["stream"]
    table.append(rows.where("id >= 50 AND id < 100"), 1, [F.col("id")], stream=name)
    assert sorted(r["title"] for r in table.read(as_of(), 62).collect()) == keys


def test_a_new_checkpoint_keeps_what_is_stored(spark, tmp_path):
    table = ingest.HistoryTable(spark, str(tmp_path / "table"))
    for name, ids in (("a", (1, 2)), ("b", (2, 3))):
        rows = spark.createDataFrame([(i, f"T{i}", "u") for i in ids], "id int, title string, url string") \
                    .withColumn("published_at", F.lit(None).cast("timestamp"))
        rows.coalesce(1).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / name))
        ingest.accumulate(stream, table, str(tmp_path / f"cp-{name}"), [F.col("id")]).awaitTermination()
    assert sorted(r["id"] for r in table.read(as_of(), 62).collect()) == [1, 2, 3]


def test_history_may_start_with_a_later_batch(spark, tmp_path):
    row = spark.createDataFrame([(1, "A title", "u")], "id int, title string, url string").withColumn("published_at", as_of())
    table = ingest.HistoryTable(spark, str(tmp_path / "t"))
    table.append(row, 3, [F.col("id")])
    assert [r["id"] for r in table.read(as_of(), 62).collect()] == [1]


def test_link_numbers_of_large_pages(spark):
    html = "".join(f"<a href='/{i}'>l</a>" for i in range(2300))
    rows = P.anchors(spark.createDataFrame([(html,)], "html string")).agg(F.max("link_no"), F.count("*")).first()
    assert tuple(rows) == (2299 * 1000000, 2300)


def test_time_parsing(spark):
    cases = {"2024-01-02T03:04:05+08:00": "2024-01-01T19:04:05", "2024-01-02 03:04": "2024-01-02T03:04:00", "Tue, 2 Jan 2024 03:04:05 +0000": "2024-01-02T03:04:05",
             "2024-13-01": None, "soon": None, "": None, "2024/1/2": "2024-01-02T00:00:00"}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", TM.parse_time("s").alias("t"))
    assert {r["s"]: r["t"] and r["t"].isoformat() for r in df.collect()} == cases


def test_publish_ladder(spark):
    cases = {"2024-01-02T03:04:05Z": "2024-01-02 11:04", "编辑 2024-13-01 发布时间：2024年1月5日 8:30": "2024-01-05 08:30", "日期：2024-02-30": "2024-02-30", "日期：2024-14-01 2024-01-01": None,
             "2024.3.4 9：05": "2024-03-04 09:05", "no": None, "2024-01-02 10:00": "2024-01-02 10:00", "2024-01-02T03:04:05-0500": "2024-01-02 16:04"}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", TM.publish_text("s").alias("t"))
    assert {r["s"]: r["t"] for r in df.collect()} == cases


def test_urls(spark):
    cases = {"http://a.com?x=1": "http://a.com?x=1", "HTTP://A.com/x/../y/./z;p=1?q#f": "http://A.com/y/z", "mailto:a@b?s=1": "a@b", "foo?x": "foo?x",
             " https://a.com/ ": "https://a.com", "http://a.com/a;b/c;d": "http://a.com/a;b/c"}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", U.normalize_url("s").alias("t"))
    assert {r["s"]: r["t"] for r in df.collect()} == cases


def test_readable_text(spark):
    long = "word " * 60
    pages = {
        f"<html><body><nav>{long}</nav><article><h1>A long heading here</h1><p>{long}</p><p>{long}</p><p>short</p><div class='ad'>{long}</div></article></body></html>": long.strip(),
        f"<body><div class='TRS_Editor'><div>{long}a</div><div>{long}b</div></div></body>": f"{long}a\n\n{long}b",
        "<p>tiny</p>": "", f"<div id='zoom'>{long}<br>{long}</div>": f"{long.strip()}\n\n{long.strip()}", f"<p>A long heading here {long}": long.strip()}
    df = spark.createDataFrame([(k,) for k in pages], "html string").select("html", P.readable_text("html", F.lit("A long heading here")).alias("t"))
    assert {r["html"]: r["t"] for r in df.collect()} == pages


def test_digest_summary_drops_repeated_titles(spark):
    title = "关于开展碳排放权交易的通知安排"
    df = spark.createDataFrame([(title, f"{title} {title} 正文从这里开始。"), (title, "别的内容"), ("t", "x" * 120)], "t string, s string")
    got = [r[0] for r in df.select(X.digest_summary("t", "s")).collect()]
    assert got == ["正文从这里开始", "别的内容", "x" * 90 + "…"]


def test_reflow_and_lines(spark):
    body = "第一段结束。\n第二段开始\n- 列表\n短\n这是一个很长很长很长很长的句子没有标点\n这也是一个很长很长很长很长的句子继续"
    df = spark.createDataFrame([(body,)], "b string")
    out = df.select(X.reflow("b")).first()[0]
    assert out == body.replace("结束。\n", "结束。\n\n").replace("标点\n", "标点\n\n")
    again = df.withColumn("b", X.reflow("b")).select(X.reflow("b")).first()[0]
    assert again == out


# ---------------------------------------------------------------- stored keys
def _history_rows(spark, ids, title="T{}"):
    return spark.createDataFrame([(i, title.format(i), "u") for i in ids], "id int, title string, url string").withColumn("published_at", as_of())


def _files(df):
    return sorted({f.split("/keys/")[1].split("/")[1] for f in df.inputFiles()})


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    table = ingest.HistoryTable(spark, str(tmp_path / "t"), buckets=16)
    table.append(_history_rows(spark, range(300)), 0, [F.col("id")], stream="s")
    assert table.entries()[0]["buckets"] == list(range(16))
    one = _history_rows(spark, [7]).withColumn("b", F.pmod(F.xxhash64(table.key), F.lit(16)))
    bucket = one.first()["b"]
    seen = []
    table.known_keys, whole = (lambda buckets, entries: seen.append((buckets, read := whole(buckets, entries))) or read), table.known_keys
    assert table.append(one.drop("b"), 1, [F.col("id")], stream="s").count() == 0
    ((buckets, known),) = seen
    assert buckets == [bucket] and _files(known) == [f"bucket={bucket}"] and known.count() < 60


def test_compaction_keeps_rows_keys_and_restarts(spark, tmp_path):
    table = ingest.HistoryTable(spark, str(tmp_path / "t"), buckets=4)
    for stream in ("a", "b"):  # two checkpoints
        for n in range(3):
            table.append(_history_rows(spark, range(n * 20, n * 20 + 30)), n, [F.col("id")], stream=stream)
    before = sorted(r["id"] for r in table.read(as_of(), 62).collect())
    assert before == list(range(70))
    table.compact()
    assert sorted((e["stream"], e["batch"]) for e in table.entries()) == [("", -1), ("a", 2), ("b", 2)]
    assert sorted(r["id"] for r in table.read(as_of(), 62).collect()) == before
    # the newest batch runs again, then a known and a new row come
    table.append(_history_rows(spark, range(40, 70)), 2, [F.col("id")], stream="a")
    assert [r["id"] for r in table.append(_history_rows(spark, [5, 70]), 3, [F.col("id")], stream="a").collect()] == [70]
    table.compact()
    assert sorted(r["id"] for r in table.read(as_of(), 62).collect()) == list(range(71))
    live = {e["folder"] for e in table.manifest.read()[1]}
    assert {p.name for p in (tmp_path / "t" / "rows").iterdir()} == live  # what the first compaction replaced is gone
    small = ingest.HistoryTable(spark, str(tmp_path / "small"), compact_after=2)
    for n in range(5):
        small.append(_history_rows(spark, [n]), n, [F.col("id")])
    assert len(small.entries()) <= 3 and small.read(as_of(), 62).count() == 5


def test_a_run_with_repeated_side_rows_multiplies_nothing(spark):
    from feedscope.plans import rules, run as R
    raw = spark.createDataFrame([(1, "unlisted", "Carbon market report", "", "u1", None), (2, "unlisted", "carbon market report!", "", "u2", None),
                                 (3, "unlisted", "Solar power grid", "s", None, None)],
                                "id long, site_id string, title string, summary string, url string, published_at timestamp")
    twice = spark.createDataFrame([("u1", "Carbon market report in full", "S", "2024-01-20 08:00")] * 3, "url string, title string, summary string, published string")
    zh = spark.createDataFrame([("Carbon market report", "old"), ("Carbon market report in full", "new"), ("Carbon market report", "old")], "title string, title_zh string")
    side = R.SideTables(twice, twice, twice, zh)
    kept, late = R.full_run(raw, rules.registry(spark), side, as_of(), [F.col("id")], "id", containment_only=True)
    got = {r["id"]: (r["title"], r["title_zh"], r["summary"], r["time_source"]) for r in kept.collect()}
    assert got[1] == ("Carbon market report in full", "new", "S", "published") and len(got) == kept.count() and late.count() == 0
    bare, _ = R.full_run(raw, rules.registry(spark), R.SideTables(), as_of(), [F.col("id")], "id")
    assert {r["title_zh"] for r in bare.collect()} == {""} and R.full_run(raw.limit(0), rules.registry(spark), R.SideTables(), as_of(), [F.col("id")], "id")[0].count() == 0


def test_streams_read_tables_that_are_folders_of_part_files(spark, tmp_path):
    from feedscope.queries import all_queries
    single = "/root/testdata/sf0.001"
    for name in ("documents", "events"):
        spark.read.parquet(f"{single}/{name}.parquet").repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("stream_history", "stream_repeats"):
        rows = [sorted(map(tuple, all_queries()[name](spark, folder).collect())) for folder in (single, str(tmp_path))]
        assert rows[0] and rows[0] == rows[1]


def test_a_landing_is_not_gathered_in_one_file(spark, tmp_path, monkeypatch):
    from feedscope.queries import all_queries, runs
    monkeypatch.setattr(runs, "run_folder", lambda d, name: str(tmp_path / name))
    all_queries()["stream_full_run"](spark, "/root/testdata/sf0.001")
    for part in "012":
        assert len(list((tmp_path / "feed" / "landed" / part).glob("*.parquet"))) > 1
    archive = ingest.HistoryTable(spark, str(tmp_path / "feed" / "run" / "archive"))
    assert [e["batch"] for e in archive.entries()] == [0, 1, 2]  # still a micro-batch a landing
