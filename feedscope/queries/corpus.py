"""Queries over the note corpus; notes are rendered from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as P, text as X
from ..functions.times import local_minute_text
from ..plans import corpus as C, fixed_values as V, rules, score as scoring
from ..plans.note_names import item_path
from ..sources import payloads, sinks
from .base import SITE_COUNT, SITE_IDS, query, run_folder
from .cleaning import NAV_MIX
from .classification import TYPE_SQL


def _note_rows(d, body=True):
    """Items with everything a note needs."""
    c = d.classified().join(F.broadcast(d.sites.select("site_id", F.col("site_name"))), "site_id", "left")  # 70 fixed rows
    c = c.withColumn("site_name", F.coalesce("site_name", "site_id"))
    tags = rules.tags("region", "topics", "document_type")
    c = rules.lowered(c).withColumn("document_type", rules.document_type()).withColumn("tags", tags).drop(rules.TITLE_L, rules.TEXT_L)
    return c.withColumn("keywords", X.keyword_list("tags", "title")).withColumn(
        "published", F.when(F.col("id") % 5 != 0, local_minute_text("published_at"))).withColumn(
        "author", F.when(F.col("id") % 7 == 0, F.concat(F.lit('desk "'), "lang", F.lit('"')))).withColumn(
        "body", F.when(F.col("id") % 4 != 0, F.col("body")) if body else F.lit(None).cast("string"))


def _notes(d):
    return C.render(_note_rows(d), d.as_of)


NOTE_CTE = rf"""WITH t0 AS (SELECT *, coalesce(site_name, site_id) AS sname, {TYPE_SQL} AS k FROM classified),
t1 AS (SELECT *, list_concat([region], topics, [k], CASE WHEN len(list_filter(topics, lambda v: v <> region AND v <> k)) = 0 THEN ['行业动态'] ELSE [] END) AS tg0 FROM t0),
t2 AS (SELECT *, list_filter(tg0, lambda v, i: list_position(tg0, v) = i) AS tags,
  list_filter(list_transform(regexp_split_to_array(regexp_replace(title, '[：，、]', ' ', 'g'), '[\s\x{{a0}}\x{{3000}}]+'),
    lambda w: regexp_replace(w, '[,，.。、:：;；!！?？''"‘’“”()（）\[\]【】]', '', 'g')), lambda w: length(w) BETWEEN 2 AND 12 AND NOT starts_with(w,'http') AND NOT starts_with(w,'www')) AS toks FROM t1),
n AS (SELECT *, list_slice(list_sort(list_distinct(list_concat(tags, toks))), 1, 15) AS keywords,
  CASE WHEN id % 5 <> 0 THEN strftime(published_at + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') END AS published,
  CASE WHEN id % 7 = 0 THEN concat('desk "', lang, '"') END AS author, CASE WHEN id % 4 <> 0 THEN nullif(body, '') END AS nbody,
  strftime(published_at, '%Y-%m-%d') AS day,
  concat(CASE WHEN library = 'media' THEN '媒体库/' ELSE concat('政策库/', coalesce(nullif(grp,''),'其他'), '/') END, trim(regexp_replace(sname, '[<>:"/\\|?*]', '_', 'g')), '/',
    CASE WHEN published_at IS NULL THEN '' ELSE concat(strftime(published_at, '%Y-%m-%d'), ' ') END,
    trim(substring(regexp_replace(title, '[<>:"/\\|?*]', '_', 'g'), 1, 80)), '.md') AS note_path FROM t2)"""


@query("note_paths", NOTE_CTE + " SELECT id, note_path FROM n")
def note_paths(d):
    return _notes(d).select("id", "note_path")


NOTE_TEXT = r"""concat('---', chr(10), 'source: "', sname, '"', chr(10), 'url: ', url, chr(10), 'date: ', coalesce(day, published[1:10], ''), chr(10),
 'tags: [', array_to_string(tags, ', '), ']', chr(10), 'keywords: [', array_to_string(keywords, ', '), ']', chr(10),
 CASE WHEN published IS NULL THEN '' ELSE concat('published: "', published, '"', chr(10)) END,
 CASE WHEN author IS NULL THEN '' ELSE concat('author: "', replace(author, '"', ''''), '"', chr(10)) END,
 CASE WHEN summary = '' THEN '' ELSE concat('summary: "', replace(replace(summary, '"', ''''), chr(10), ' '), '"', chr(10)) END,
 CASE WHEN len(people) = 0 THEN '' ELSE concat('people: [', array_to_string(people, ', '), ']', chr(10)) END,
 '---', chr(10), chr(10), '# ', title, chr(10), chr(10), '[原文链接](', url, ')', chr(10), chr(10), '> 来源: ', sname, chr(10), '> 首次抓取: 2024-01-31 00:00 UTC',
 CASE WHEN published IS NULL THEN '' ELSE concat(chr(10), '> 发布时间: ', published) END, CASE WHEN author IS NULL THEN '' ELSE concat(chr(10), '> 作者: ', author) END,
 CASE WHEN len(people) = 0 THEN '' ELSE concat(chr(10), '> 人物: ', array_to_string(list_transform(people, lambda p: concat('[[人物/', p, '|', p, ']]')), '、')) END,
 CASE WHEN nbody IS NULL THEN '' ELSE concat(chr(10), chr(10), '## 正文', chr(10), chr(10), nbody) END)"""


@query("note_text", NOTE_CTE + f" SELECT id, {NOTE_TEXT} AS note FROM n")
def note_text(d):
    return _notes(d).select("id", "note")


@query("note_round_trip", NOTE_CTE + """ SELECT id, sname AS source, url, coalesce(day, published[1:10]) AS date, published, replace(author, '"', '''') AS author,
  nullif(trim(replace(replace(summary, '"', ''''), chr(10), ' '), ' '''), '') AS summary, array_to_string(people, ',') AS people, trim(title) AS title, nbody AS body FROM n""")
def note_round_trip(d):
    p = C.parse(_notes(d).select("id", "note"))
    return p.select("id", "source", "url", "date", "published", "author", F.nullif(F.regexp_replace("summary", "^[ ']+|[ ']+$", ""), F.lit("")).alias("summary"),
                    F.array_join("people", ",").alias("people"), "title", "body")


@query("note_files_round_trip", NOTE_CTE + """ SELECT sname AS source, url, coalesce(day, published[1:10]) AS date, published, replace(author, '"', '''') AS author,
  array_to_string(tags, ',') AS tags, array_to_string(people, ',') AS people, trim(title) AS title, nbody AS body FROM n WHERE id IN (SELECT min(id) FROM n GROUP BY url)""")
def note_files_round_trip(d):
    """Plan, write one file a note, read the files back, parse."""
    rows = _note_rows(d)
    none = d.spark.createDataFrame([], "url string, note_path string, has_summary boolean")
    slim = rows.select("id", "url", "library", "grp", "site_name", "title", "published_at")
    paths = C.claim_paths(slim, none, [F.col("id")]).select("id", "note_path")
    root = run_folder(d, "notes")
    sinks.write_notes(C.render(rows, d.as_of).drop("note_path").join(paths, "id"), root)
    p = C.parse(payloads.read_notes(d.spark, root, relative=True))
    return p.select("source", "url", "date", "published", "author", F.array_join("tags", ",").alias("tags"),
                    F.array_join("people", ",").alias("people"), "title", "body")


@query("lookup_indexes", NOTE_CTE + """, i AS (SELECT url, 'published' AS kind, published AS value, id FROM n WHERE published IS NOT NULL UNION ALL
  SELECT url, 'title', trim(title), id FROM n)
SELECT url, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY url, kind ORDER BY id DESC) AS k FROM i) q WHERE k = 1""")
def lookup_indexes(d):
    idx = C.lookup_indexes(C.parse(_notes(d).select("id", "note")), [F.col("id").desc()])
    return idx["published"].select("url", F.lit("published").alias("kind"), F.col("published").alias("value")).unionByName(
        idx["title"].select("url", F.lit("title").alias("kind"), F.col("title").alias("value")))


@query("title_index", r"""SELECT url, title FROM (SELECT url, title, row_number() OVER (PARTITION BY url ORDER BY id DESC) AS k FROM (SELECT id, url, CASE WHEN id % 5 = 0 THEN concat(title, ' (EPA)') ELSE title END AS title FROM items) q
  WHERE NOT contains(title, '(EPA)')) z WHERE k = 1""")
def title_index(d):
    rows = d.items().withColumn("title", F.when(F.col("id") % 5 == 0, F.concat("title", F.lit(" (EPA)"))).otherwise(F.col("title")))
    return C.title_index(rows, [F.col("id").desc()])


# three days or none, four sites, equal titles, titles equal up to the cut, two items of one URL
CLASHES = """SELECT id, site_id, CASE id % 5 WHEN 0 THEN 'Weekly report' WHEN 1 THEN concat(repeat('long title ', 9), CAST(id AS VARCHAR(20)), '?') ELSE title END AS title,
  CASE WHEN id % 6 < 2 THEN concat('p/', CAST(CAST(floor(id / 2) AS BIGINT) AS VARCHAR(20))) ELSE concat('u/', CAST(id AS VARCHAR(20))) END AS url,
  CASE WHEN id % 3 <> 0 THEN TIMESTAMP '2024-01-05 10:00:00' + INTERVAL '1' DAY * CAST(id % 2 AS INT) END AS published_at FROM {articles}"""


def _plan_case(d):
    names = F.array(*[F.lit(s) for s in SITE_IDS[:4]])
    i = scoring.with_site_facts(d.sql(CLASHES).withColumn("site_id", F.element_at(names, (F.col("id") % 4 + 1).cast("int"))), d.sites, known_rows=SITE_COUNT)
    i = i.join(F.broadcast(d.sites.select("site_id", "site_name")), "site_id", "left") if "site_name" not in i.columns else i  # 70 fixed rows
    k = F.col("id") % 10
    existing = i.where("id % 10 < 4").select(
        F.when(k == 3, F.concat(F.lit("none/"), F.col("id").cast("string"))).otherwise(F.col("url")).alias("url"),
        F.when(k == 2, F.concat(F.lit("old/"), F.col("id").cast("string"))).otherwise(item_path()).alias("note_path"),
        (k == 0).alias("has_summary"))
    return i, existing


PLAN_CTE = r"""WITH a AS (SELECT c.*, r.library, r.grp, r.site_name FROM (SELECT * REPLACE (list_extract([{sites}], CAST(id % 4 + 1 AS INT)) AS site_id) FROM ({clashes}) z) c LEFT JOIN registry r USING (site_id)),
b AS (SELECT *, regexp_replace(title, '[<>:"/\\|?*]', '_', 'g') AS safe, substr(sha256(concat(url, chr(10), title)), 1, 8) AS mark,
  concat(CASE WHEN library = 'media' THEN '媒体库/' ELSE concat('政策库/', coalesce(nullif(grp,''),'其他'), '/') END, trim(regexp_replace(site_name, '[<>:"/\\|?*]', '_', 'g')), '/',
    CASE WHEN published_at IS NULL THEN '' ELSE concat(strftime(published_at, '%Y-%m-%d'), ' ') END) AS head FROM a),
i AS (SELECT id, url, length(safe) > 80 AS cut, concat(head, trim(substring(safe, 1, 80)), '.md') AS p0, concat(head, trim(substring(safe, 1, 70)), ' ~', mark, '.md') AS p1 FROM b),
e AS (SELECT CASE WHEN id % 10 = 3 THEN concat('none/', id) ELSE url END AS url, CASE WHEN id % 10 = 2 THEN concat('old/', id) ELSE p0 END AS note_path, id % 10 = 0 AS has_summary FROM i WHERE id % 10 < 4),
t AS (SELECT note_path, min(url) AS u1, max(url) AS u2 FROM e GROUP BY 1),
f AS (SELECT *, url IN (SELECT url FROM e) AS stale FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS n FROM i WHERE url NOT IN (SELECT url FROM e WHERE has_summary)) q WHERE n = 1),
c AS (SELECT f.*, t.note_path IS NOT NULL AND NOT (u1 = f.url AND u2 = f.url) AS away FROM f LEFT JOIN t ON t.note_path = p0),
d AS (SELECT *, row_number() OVER (PARTITION BY p0, away ORDER BY id) AS k FROM c WHERE NOT away OR stale OR cut),
w AS (SELECT id, url, p0 AS note_path FROM d WHERE NOT away AND k = 1),
p AS (SELECT * FROM w UNION ALL SELECT id, url, p1 FROM d WHERE NOT (NOT away AND k = 1) AND p1 NOT IN (SELECT note_path FROM w) AND p1 NOT IN (SELECT note_path FROM e))"""
PLAN_CTE = PLAN_CTE.replace("{sites}", ", ".join(f"'{s}'" for s in SITE_IDS[:4])).replace("{clashes}", CLASHES.replace("{articles}", "articles"))


@query("note_plan", PLAN_CTE + " SELECT id, note_path FROM p")
def note_plan(d):
    """Clashing items: each planned note has a path of its own."""
    return C.claim_paths(*_plan_case(d), [F.col("id")]).select("id", "note_path")


@query("replaced_notes", PLAN_CTE + " SELECT DISTINCT e.note_path AS old_path FROM e JOIN p USING (url) WHERE NOT e.has_summary AND e.note_path <> p.note_path")
def replaced_notes(d):
    items, existing = _plan_case(d)
    return C.replaced_notes(C.claim_paths(items, existing, [F.col("id")]), existing)


@query("thin_notes", "SELECT doc_id FROM documents WHERE length(text) < 50")
def thin_notes(d):
    return C.thin_notes(d.table("documents"), 50, "text").select("doc_id")


@query("listed_junk", "SELECT id FROM items WHERE url NOT IN (SELECT url FROM items WHERE id % 97 = 0)")
def listed_junk(d):
    i = d.items()
    return C.without_listed(i, i.where("id % 97 = 0"), "url").select("id")


@query("navigation_drop", r"""WITH q AS (""" + NAV_MIX + r""" items), s AS (SELECT id, t, CASE WHEN suffix(t, ' - EPA') THEN trim(left(t, length(t) - 6)) ELSE trim(t) END AS c FROM q)
SELECT id, c AS title FROM s WHERE NOT (length(c) < 4 OR lower(c) IN ('about us', 'eia') OR regexp_matches(lower(c), '^station [\w\s\-,#''()]+$') OR regexp_matches(lower(c), '^enso')
  OR regexp_matches(lower(c), '^u\.s\. energy information administration') OR (t <> c AND lower(c) = 'clean trucks plan'))""")
def navigation_drop(d):
    rows = d.sql(NAV_MIX + "{items}").select("id", F.col("t").alias("title"))
    return C.fix_titles_and_drop_navigation(rows).select("id", "title")


@query("short_titles", "SELECT id FROM articles WHERE length(title) < 30 OR (regexp_matches(title, '(网|官网|委员会|政府|部|中心|门户)$') AND length(title) < 60)")
def short_titles(d):
    from ..functions.titles import is_short_title
    return d.articles().where(is_short_title("title")).select("id")


@query("suspicious_titles", "SELECT id FROM (SELECT id, CASE id % 6 WHEN 0 THEN concat(site_id, ' ', title) WHEN 1 THEN concat(title, '门户网站') ELSE title END AS title, site_id FROM items) q WHERE starts_with(title, site_id) OR contains(title, '门户网站')")
def suspicious_titles(d):
    from ..functions.titles import is_suspicious_title
    t = F.when(F.col("id") % 6 == 0, F.concat("site_id", F.lit(" "), "title")).when(F.col("id") % 6 == 1, F.concat("title", F.lit("门户网站"))).otherwise(F.col("title"))
    return d.items().where(is_suspicious_title(t, "site_id")).select("id")


@query("title_audit")
def title_audit(d):
    name = F.when(F.col("id") % 3 == 0, F.substring("title", 1, 40)).otherwise(F.col("title"))
    return C.title_audit(d.articles().withColumn("file_name", name)).groupBy("title_class").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- links
# whole titles as names; links name them rightly, cut, with more behind, without their date, or not at all
FILES = """SELECT id, file_name, concat(CASE WHEN id % 2 = 0 THEN '政策库/g/' ELSE '媒体库/s/' END, file_name, '.md') AS note_path FROM (
SELECT id, concat(CASE WHEN id % 3 = 0 THEN '2024-01-05 ' ELSE '' END, t) AS file_name FROM (SELECT id, {safe} AS t FROM {{articles}}) q) q"""
LINKS = """SELECT id, CASE id % 7 WHEN 0 THEN concat('../../', CASE WHEN id % 2 = 0 THEN '政策库/g/' ELSE '媒体库/s/' END, n) WHEN 1 THEN concat('../../政策库/old/', n)
  WHEN 2 THEN concat('政策库/x/', substring(n, 1, length(n) - 3)) WHEN 3 THEN concat('../../媒体库/', n, ' more') WHEN 4 THEN concat('../../政策库/alt/', t)
  WHEN 5 THEN concat('../../政策库/none ', CAST(id AS VARCHAR(20))) ELSE concat('人物/', n) END AS path,
  CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '|alias' ELSE '{bar}| a b' END AS alias, concat('../../媒体库/zzz/', n) AS path2, n
FROM (SELECT id, t, concat(CASE WHEN id % 3 = 0 THEN '2024-01-05 ' ELSE '' END, t) AS n FROM (SELECT id, {safe} AS t FROM {{articles}}) q) q"""
SAFE = r"""regexp_replace(title, '[\[\]<>:"/\\|?*]', '_'{g})"""


def _both(text, spark):
    """The same select for both engines: DuckDB replaces all with a flag, Spark doubles the backslashes of literals."""
    safe = SAFE.format(g="" if spark else ", 'g'")
    out = text.format(safe=safe.replace("\\", "\\\\") if spark else safe, bar="\\\\" if spark else "\\")
    return out if spark else out.replace("{articles}", "articles")


def _linked_notes(d):
    """Notes of two library links and one other between texts; every fourth has the doubled prefix."""
    first = F.when(F.col("id") % 4 == 1, F.replace("path", F.lit("../../政策库/"), F.lit("../../policy/../../政策库/"))).otherwise(F.col("path"))
    note = F.concat(F.lit("See [["), first, "alias", F.lit("]] and [[人物/x|x]], then [["), "path2", F.lit("|b]].\n"), "n")
    return d.sql(_both(LINKS, True)).select("id", F.concat(F.lit("政策wiki/概念/n"), F.col("id").cast("string"), F.lit(".md")).alias("note_path"), note.alias("note"))


@query("wiki_links", f"""WITH f AS ({_both(FILES, False)}), l AS ({_both(LINKS, False)}),
e AS (SELECT file_name, min(note_path) AS a, max(note_path) AS b FROM f WHERE file_name <> '' GROUP BY 1),
s AS (SELECT id, 1 AS no, path AS p FROM l UNION ALL SELECT id, 2, path2 FROM l),
g AS (SELECT id, no, regexp_extract(p, '[^/]*$') AS target FROM s WHERE NOT starts_with(p, '人物/')
  AND NOT (starts_with(p, '../../') AND (concat(substring(p, 7), '.md') IN (SELECT note_path FROM f) OR substring(p, 7) IN (SELECT note_path FROM f)))),
t AS (SELECT DISTINCT target FROM g WHERE target <> ''),
x AS (SELECT t.target, e.file_name IS NOT NULL AS known, CASE WHEN a = b THEN a END AS p FROM t LEFT JOIN e ON e.file_name = t.target),
z AS (SELECT x.target, count(*) AS c, min(e.a) AS p FROM x JOIN e ON (starts_with(e.file_name, x.target) AND length(e.file_name) > length(x.target)) OR starts_with(x.target, e.file_name)
  OR (regexp_matches(e.file_name, '^\\d{{4}}-\\d{{2}}-\\d{{2}} ') AND suffix(e.file_name, x.target)) WHERE NOT x.known GROUP BY 1),
r AS (SELECT g.id, g.no, concat('../../', left(q.p, length(q.p) - 3)) AS p FROM g JOIN (SELECT x.target, coalesce(x.p, CASE WHEN z.c = 1 THEN z.p END) AS p FROM x LEFT JOIN z USING (target)) q USING (target) WHERE q.p IS NOT NULL)
SELECT l.id, concat('See [[', coalesce(r1.p, l.path), alias, ']] and [[人物/x|x]], then [[', coalesce(r2.p, path2), '|b]].', chr(10), n) AS note,
  CAST(CASE WHEN r1.p IS NULL THEN 0 ELSE 1 END + CASE WHEN r2.p IS NULL THEN 0 ELSE 1 END AS INT) AS links_fixed
FROM l LEFT JOIN (SELECT * FROM r WHERE no = 1) r1 ON r1.id = l.id LEFT JOIN (SELECT * FROM r WHERE no = 2) r2 ON r2.id = l.id""".replace("\\\\d", "\\d"))
def wiki_links(d):
    return C.repair_links(_linked_notes(d), d.sql(_both(FILES, True))).select("id", "note", "links_fixed")


@query("referenced_notes", f"""WITH l AS ({_both(LINKS, False)}), f AS ({_both(FILES, False)}), t AS (SELECT trim(path) AS target FROM l UNION ALL SELECT trim(path2) FROM l UNION ALL SELECT '人物/x' FROM l)
SELECT file_name, count(*) AS links FROM t JOIN (SELECT DISTINCT concat('人物/', file_name) AS file_name FROM f UNION SELECT concat('../../媒体库/zzz/', file_name) FROM f UNION SELECT '人物/x') q ON trim(target) = file_name GROUP BY 1""")
def referenced_notes(d):
    files = d.sql(_both(FILES, True))
    names = [F.concat(F.lit(folder), "file_name") for folder in ("人物/", "../../媒体库/zzz/")]
    names = files.select(F.explode(F.array(*names, F.lit("人物/x"))).alias("file_name"))
    return C.referenced(names, C.wiki_links(_linked_notes(d).select("id", "note")))


@query("library_moves", """SELECT id, concat('[[../../', CASE id % 4 WHEN 0 THEN '政策库/中国/生态环境部/' WHEN 1 THEN '政策库/国际组织/IEA/' WHEN 2 THEN '媒体库/碳道/' ELSE '政策库/other/' END, title, ']]') AS line FROM articles""")
def library_moves(d):
    old = F.expr("CASE id % 4 WHEN 0 THEN '政策库/生态环境部/' WHEN 1 THEN '政策库/IEA/' WHEN 2 THEN '政策库/碳道/' ELSE '政策库/other/' END")
    line = F.concat(F.lit("[[../../"), old, "title", F.lit("]]"))
    return d.articles().select("id", C.move_library_paths(line).alias("line"))


# ---------------------------------------------------------------- repairs
@query("note_injection", """WITH x AS (SELECT url, min(id) AS m FROM items GROUP BY url)
SELECT id, '2024-01-07 08:00' AS published, CASE WHEN id % 2 = 1 AND summary <> '' THEN nullif(trim(replace(replace(summary, chr(34), chr(39)), chr(10), ' '), concat(' ', chr(39))), '')
  ELSE concat('New ', chr(39), 'sum', chr(39), ' ', m) END AS summary, concat('New body ', m, chr(10)) AS body FROM items JOIN x USING (url)""")
def note_injection(d):
    """Bare notes take summary, time and body from a side table."""
    bare = C.render(_note_rows(d, body=False).withColumn("published", F.lit(None).cast("string")).withColumn(
        "summary", F.when(F.col("id") % 2 == 0, F.lit("")).otherwise(F.col("summary"))), d.as_of)
    extra = d.items().groupBy("url").agg(F.concat(F.lit('New "sum" '), F.min("id").cast("string")).alias("summary"),
                                         F.lit("2024-01-07 08:00").alias("published"), F.concat(F.lit("New body "), F.min("id").cast("string")).alias("body"))
    done = C.parse(C.inject(bare.select("id", "url", "note"), extra).select("id", "note"))
    kept = F.when(F.col("summary").startswith("New 'sum'"), F.col("summary")).otherwise(
        F.nullif(F.regexp_replace("summary", "^[ ']+|[ ']+$", ""), F.lit("")))
    return done.select("id", "published", kept.alias("summary"), "body")


@query("people_fill", NOTE_CTE + """ SELECT id, array_to_string(people, ',') AS people FROM (SELECT n.id, list_filter([""" +
       ", ".join(f"CASE WHEN contains(concat_ws(' ', title, summary, coalesce(nbody,'')), '{n}') THEN '{n}' END" for n, _ in V.PEOPLE) +
       """], lambda v: v IS NOT NULL) AS people FROM n) q""")
def people_fill(d):
    rows = _note_rows(d).withColumn("people", F.array().cast("array<string>"))
    filled = C.fill_people(C.render(rows, d.as_of))
    return C.parse(filled.select("id", "note")).select("id", F.array_join("people", ",").alias("people"))


@query("note_finish", """SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN '2024-01-01 10:00' END, strftime(published_at, '%Y-%m-%d'), strftime(first_seen_at, '%Y-%m-%d')) AS published, id % 4 = 0 AS link_only FROM items""")
def note_finish(d):
    rows = d.items().select("id", F.when(F.col("id") % 2 == 0, "2024-01-01 10:00").alias("published"),
                            F.date_format("published_at", "yyyy-MM-dd").alias("date"), "first_seen_at",
                            F.when(F.col("id") % 4 != 0, F.lit("text")).alias("body"))
    return C.finish(rows).select("id", "published", "link_only")


@query("title_upgrade", r"""WITH nt AS (SELECT id, site_id AS folder, url, CASE WHEN id % 3 = 0 THEN concat('T ', id) ELSE title END AS title, concat(CASE WHEN id % 2 = 0 THEN '2024-01-05 ' ELSE '' END, 'note ', id % 300) AS file_name FROM items),
pg AS (SELECT url, max(title) AS page FROM items GROUP BY url),
j AS (SELECT nt.*, page, (length(nt.title) < 30 OR (regexp_matches(nt.title, '(网|官网|委员会|政府|部|中心|门户)$') AND length(nt.title) < 60)) AND (length(page) > length(nt.title) OR contains(nt.title, page)) AS take FROM nt LEFT JOIN pg USING (url)),
w AS (SELECT *, CASE WHEN take THEN concat(CASE WHEN id % 2 = 0 THEN '2024-01-05 ' ELSE '' END, trim(substring(regexp_replace(page, '[<>:"/\\|?*]', '_', 'g'), 1, 80))) ELSE file_name END AS want FROM j),
c AS (SELECT folder, want, min(id) AS winner FROM w WHERE want <> file_name GROUP BY 1, 2)
SELECT w.id, CASE WHEN take THEN page ELSE title END AS title, CASE WHEN want <> w.file_name AND winner = w.id AND t.file_name IS NULL THEN want ELSE w.file_name END AS new_name
FROM w LEFT JOIN c USING (folder, want) LEFT JOIN (SELECT DISTINCT folder, file_name FROM nt) t ON t.folder = w.folder AND t.file_name = w.want""")
def title_upgrade(d):
    name = F.concat(F.when(F.col("id") % 2 == 0, "2024-01-05 ").otherwise(""), F.lit("note "), (F.col("id") % 300).cast("string"))
    notes = d.items().select("id", F.col("site_id").alias("folder"), "url", F.expr("CASE WHEN id % 3 = 0 THEN concat('T ', id) ELSE title END").alias("title"), name.alias("file_name"))
    pages = d.items().groupBy("url").agg(F.max("title").alias("page_title"))
    return C.upgrade_titles(notes, pages).select("id", "title", "new_name")


@query("body_refresh", f"""WITH l AS (SELECT id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines,
  CASE id % 3 WHEN 0 THEN concat('thin ', id) WHEN 1 THEN '' ELSE text END AS nb FROM (SELECT id, body AS text FROM articles) q),
b AS (SELECT *, list_filter(lines, lambda x: length(x) >= {P.BLOCK_MIN}) AS blocks FROM l),
t AS (SELECT *, len(blocks) < 2 OR list_sum(list_transform(blocks, lambda x: length(x))) < {P.STRONG_MIN} AS thin, array_to_string(lines, chr(10) || chr(10)) AS whole FROM b),
p AS (SELECT id, nb, CASE WHEN thin AND length(whole) >= {P.BLOCK_MIN} THEN whole ELSE array_to_string(list_filter(blocks, lambda x, i: i = 1 OR x <> blocks[i - 1]), chr(10) || chr(10)) END AS page FROM t)
SELECT id, CASE WHEN length(nb) < 50 AND length(coalesce(page, '')) > length(nb) THEN page ELSE nb END AS body FROM p""")
def body_refresh(d):
    """Thin notes take the readable body of the page with their URL."""
    a = d.articles().withColumn("url", F.concat("url", F.lit("#"), F.col("id").cast("string")))
    notes = a.select("id", "url", F.expr("CASE id % 3 WHEN 0 THEN concat('thin ', id) WHEN 1 THEN '' ELSE body END").alias("body"))
    escaped = F.replace(F.replace(F.col("body"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><body><nav><li>A menu that is long enough</li></nav><article><p>"), F.replace(escaped, F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p></article></body></html>"))
    pages = a.select("url", html.alias("html")).select("url", P.readable_text("html", F.lit(None).cast("string")).alias("page_body"))
    return C.refresh_bodies(notes, pages).select("id", "body")


@query("dead_authors", """WITH g AS (SELECT DISTINCT url FROM items WHERE id % 5 = 0) SELECT id, CASE WHEN id % 3 = 0 AND url IN (SELECT url FROM g) THEN NULL WHEN id % 3 = 0 THEN '无' ELSE lang END AS author FROM items""")
def dead_authors(d):
    i = d.items().withColumn("author", F.when(F.col("id") % 3 == 0, "无").otherwise(F.col("lang")))
    gone = i.where("id % 5 = 0").select("url", F.lit(True).alias("gone")).distinct()
    return C.clear_dead_authors(i, gone, ["无"]).select("id", "author")


# ---------------------------------------------------------------- catalogues
@query("note_coverage", NOTE_CTE + " SELECT grp, sname AS site_name, count(*) AS n, count(nbody) AS with_body, count(*) - count(nbody) AS link_cards FROM n GROUP BY 1, 2")
def note_coverage(d):
    return C.coverage(_note_rows(d).select("grp", "site_name", "body"))


@query("latest_notes", "SELECT id, date FROM (SELECT id, strftime(published_at, '%Y-%m-%d') AS date FROM items) q ORDER BY date DESC NULLS LAST, id LIMIT 50")
def latest_notes(d):
    return C.latest(d.items().withColumn("date", F.date_format("published_at", "yyyy-MM-dd"))).select("id", "date")


@query("latest_with_tag", "SELECT id, date FROM (SELECT id, strftime(published_at, '%Y-%m-%d') AS date FROM classified WHERE list_contains(topics, '碳市场')) q ORDER BY date DESC NULLS LAST, id LIMIT 20")
def latest_with_tag(d):
    rows = d.classified().withColumn("date", F.date_format("published_at", "yyyy-MM-dd")).withColumn("tags", F.col("topics"))
    return C.latest(rows, 20, "碳市场").select("id", "date")


@query("catalogue_entries", NOTE_CTE + """, o AS (SELECT *, strftime(published_at, '%Y-%m-%d') AS dt FROM n)
SELECT id, row_number() OVER (ORDER BY dt DESC NULLS LAST, id) AS position, concat('### ', coalesce(dt,''), ' | ', sname, ' | ', note_path, chr(10), '- Title: ', title, chr(10), '- Published: ', coalesce(published, '(unknown)'), chr(10),
  CASE WHEN author IS NULL THEN '' ELSE concat('- Author: ', author, chr(10)) END, CASE WHEN len(people) = 0 THEN '' ELSE concat('- People: [', array_to_string(people, ', '), ']', chr(10)) END,
  '- Tags: [', array_to_string(tags, ', '), ']', chr(10), '- Keywords: [', array_to_string(keywords, ', '), ']', chr(10), '- Summary: ', CASE WHEN summary = '' THEN '(none)' ELSE substring(summary, 1, 150) END, chr(10), '- URL: ', url) AS entry FROM o""")
def catalogue_entries(d):
    rows = _notes(d).withColumn("date", F.date_format("published_at", "yyyy-MM-dd")).withColumn("source", F.col("site_name"))
    return C.catalogue_entries(rows, summary_chars=V.CATALOGUE_SUMMARY_CHARS)


@query("catalogue_topics", """WITH e AS (SELECT id, strftime(published_at, '%Y-%m-%d') AS date, unnest(topics) AS tag FROM classified), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY date DESC NULLS LAST, id) AS place, count(*) OVER (PARTITION BY tag) AS n FROM e)
SELECT tag, CAST(place AS INT) AS place, id, n FROM r WHERE place <= 30""")
def catalogue_topics(d):
    rows = d.classified().withColumn("date", F.date_format("published_at", "yyyy-MM-dd")).withColumn("tags", F.col("topics")) \
            .withColumn("note_path", F.col("url"))
    return C.catalogue_topics(rows).select("tag", "place", "id", "n")
