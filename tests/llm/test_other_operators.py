"""Quality rules, token shards, vectors, pages, BPE and the pipeline."""
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F, types as D

from odd import odd_rows
from feedscope.llm import bpe, common, quality, vectors, wavelet, webtext


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    return tok


TEXTS = ["", "Hello, World!!! it's 2024's they'll", "<|endoftext|>mid<|startoftext|>x<|END", "ÀÉÎ ﬁ Ⅷ İSTANBUL ΣΑΣ ǅ ŉ", "a\x1cb\x1d c\x85d\xa0e f",
         "é ́x ñ", "日本語テキスト 🎉🎉 emoji👩‍👩‍👧", "x" * 400, "aaaaab" * 30, "\t\n ", "1234 5,678.90 $$$%%% ### | x|y", "ß ẞ ſ K Å",
         "ab" * 3000 + " " + "the " * 100, "don't can't I've we're I'm he'd she'll '", "​zero​width ﻿bom"]


def test_encoders_equal_the_library(library):
    content = common.tokenizer_text()
    rng = random.Random(2)
    alphabet = "abetznshé 'ÄßİΣ1.,!|$\n\x1c\xa0<>日🎉"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(800)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    own, encoder = bpe.worker(content)
    assert [own.encode(t) for t in texts] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(texts)] == want
    assert [np.frombuffer(x, "<u4").tolist() for x in common.library_encoder(content)(texts)] == want
    assert [own.decode(np.array(x, np.int64)) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_merge_tree_equals_plain_merging():
    content = common.tokenizer_text()
    own, rng = bpe.Bpe(content), random.Random(4)

    def plain(symbols):
        while True:
            ranked = [(own.pairs[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in own.pairs]
            if not ranked:
                return symbols
            i = min(ranked)[1]
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
    for _ in range(500):
        word = [rng.choice("thenaiosr") for _ in range(rng.randrange(1, 30))]
        word[-1] += "</w>"
        assert own.merge(list(word)) == plain(list(word))


def test_bpe_and_shards_of_odd_rows(spark, docs_of, library, tmp_path):
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs = docs_of(rows)
    ids = [(i, t, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    want = sorted((str(i), len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, _, x in ids)
    assert sorted((str(r.doc_id), *r[1:]) for r in bpe.digests(docs).collect()) == want
    # shards: nulls first, then ids, equal ids by text
    ordered = sorted(ids, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    folder = wavelet.write_shards(docs, str(tmp_path / "shards"), shard_tokens=5000)
    got = sorted(wavelet.read_documents(spark, folder).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, _, x) in zip(got, ordered, strict=True):
        x = x + [1]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, at, len(x), x)
        at += len(x)
    stream = [t for _, _, x in ordered for t in [*x, 1]]
    tokens = [1, stream[3], 49407, 49000]
    places = sorted((r.token, r.place) for r in wavelet.occurrences(spark, folder, tokens).collect())
    assert places == sorted((t, k) for t in set(tokens) for k, s in enumerate(stream) if s == t)
    assert wavelet.digests(docs_of([])).collect() == [] and bpe.digests(docs_of([])).collect() == []
    with pytest.raises(Exception, match="more than 3 bits"):
        wavelet.write_shards(docs_of([(1, "some text")]), str(tmp_path / "narrow"), width=3)


def test_bpe_round_trip_is_bounded_in_memory(docs_of, library, monkeypatch):
    """One Python worker a task does both ways; words of any number and length are merged a bounded number of places at a time."""
    plan = bpe.digests(docs_of([(1, "some text")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    own, rng, seen, plain = bpe.worker(common.tokenizer_text())[0], random.Random(6), [], bpe.Bpe._merge_rows

    def watched(self, raw, size, width):
        seen.append((len(raw), width))
        return plain(self, raw, size, width)
    monkeypatch.setattr(bpe.Bpe, "_merge_rows", watched)
    monkeypatch.setattr(bpe, "MERGE_PLACES", 256)
    words = ["".join(rng.choice("thenaiosr") for _ in range(n)) for n in (*range(1, 60), *[40] * 50, 300, 500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_letters(words)] \
        == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert all(n == 1 or n * width <= 256 for n, width in seen) and max(width for _, width in seen) == 512


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (1, 7, 512, 513, 3000):
        ids = np.minimum(rng.zipf(1.3, n), 4000).astype(np.uint32)
        w = wavelet.Wavelet(n, wavelet._build(ids, 12))
        assert (w.ids() == ids).all()
        for i in rng.integers(0, n, 20):
            assert w.access(int(i)) == ids[i]
        for t in {*ids[:10].tolist(), 1, 4095, 5000}:
            at = np.flatnonzero(ids == t)
            assert w.count(t) == len(at) and w.rank(t, n // 2) == (at < n // 2).sum()
            assert [w.select(t, k) for k in range(min(len(at), 5))] == at[:5].tolist()


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scored(common.prepare(spark) and docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    assert all(r.predicted for r in got if r.quality == 1)


def test_labels_of_the_held_out_fold_are_not_learnt(spark, docs_of):
    rows = [(i, "Plain words in a line. " * (i % 7 + 2) if i % 2 else "a | b | c || $$$ " * (i % 5 + 2)) for i in range(400)]
    schema = "doc_id long, quality int, toxic int"
    good = [(i, i % 2, 0) for i, _ in rows]
    twisted = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, q, _ in good]
    a, b = (sorted(quality.scored(docs_of(rows), spark.createDataFrame(x, schema)).collect(), key=str) for x in (good, twisted))
    assert a == b and all(r.predicted == r.doc_id % 2 for r in a)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in a)


def test_quality_of_odd_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.scored(docs_of(odd_rows()), none).collect()
    assert len(got) == len(odd_rows()) and {r.score for r in got} == {0.5}
    odd = spark.createDataFrame([(1, None, 0), (None, 1, 0), (4, 1, 0), (4, 0, 0), (7, 1, 0)], none.schema)
    assert quality.scored(docs_of(odd_rows()), odd).count() == len(odd_rows())
    assert quality.scored(docs_of([]), none).collect() == []
    kept = quality.keep_good(docs_of(odd_rows()), none)
    assert kept.columns == docs_of([]).columns and kept.count() == len(odd_rows())
    stats = {r.doc_id: r for r in quality.statistics(docs_of([(1, "AB cd,\nEF |"), (2, None)])).collect()}
    assert stats[1].words_per_line == 2 and stats[1].alone_signs == 0.25 and stats[1].loud_words == 0.5
    assert set(stats[2][1:]) == {0.0}


def test_rows_go_by_their_own_score(spark, docs_of):
    def text(i, good):
        return "Plain words in a line. " * (i % 7 + 2) if good else "a | b | c || $$$ " * (i % 5 + 2)
    rows = [(i, text(i, i % 2)) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    odd = [(None, text(3, True)), (None, text(4, False)), (901, text(5, True)), (901, text(6, False))]
    kept = quality.keep_good(docs_of(rows + odd), labels)
    assert kept.columns == docs_of([]).columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == \
        sorted([r for r in rows if r[0] % 2] + [odd[0], odd[2]], key=str)


def test_tree_rules():
    text = "root\n  If (feature 0 <= 1.5)\n   If (feature 0 <= 0.5)\n    Predict: 0\n   Else (feature 0 > 0.5)\n    Predict: 1\n" \
           "  Else (feature 0 > 1.5)\n   Predict: 0\n"
    assert quality.tree_rules(text, ["x"]) == [(("x", False, 1.5),), (("x", False, 0.5),),
                                               (("x", False, 1.5), ("x", True, 0.5)), (("x", True, 1.5),)]


def links_of(x):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    return near


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 32))
    x[300:500] = x[7] + rng.normal(size=(200, 32)) * 0.06
    x[500:600] = x[8:108] * 3 + rng.normal(size=(100, 32)) * 0.05
    rows = [(int(i), [float(np.float32(v)) for v in r], 0) for i, r in enumerate(x)]
    bad = [(1000, None, 0), (1001, [0.0] * 32, 0), (1002, [None] + [1.0] * 31, 0), (1003, [float("nan")] * 32, 0),
           (1004, [float("inf")] + [1.0] * 31, 0), (1005, [1.0] * 5, 0), (1006, [], 0)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in vectors.near_vectors(frame, block=64).collect()}
    near = links_of(np.array([r[1] for r in rows]))
    least = np.arange(len(rows))
    while True:
        new = np.array([min([least[i], *least[near[i]]]) for i in range(len(rows))])
        if (new == least).all():
            break
        least = new
    assert near.sum() > 20_000
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert found.sum() >= 0.999 * near.sum() and (found <= near.sum(1)).all()
    assert [got[i].component_id for i in range(len(rows))] == least.tolist()
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    assert all((got[b[0]].n_links, got[b[0]].component_id) == (0, b[0]) for b in bad)


def test_vectors_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in vectors.near_vectors(spark.createDataFrame([(1, None, 0)], schema)).collect()] == [(1, 0, 1, True)]
    twice = spark.createDataFrame([(2, [1.0, 0.0], 0), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [0.0, 1e30], 1)], schema)
    got = sorted(map(tuple, vectors.near_vectors(twice).collect()), key=str)
    assert got == sorted([(2, 2, 2, True), (2, 2, 2, True), (None, 2, 2, False), (5, 0, 5, True)], key=str)


ARTICLE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head>
<body class="page menu-open"><header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<div class="ad">Buy</div><!-- <article>gone</article> --><main><article><header><h1>Head&amp;line</h1></header>
<p>One <b>bo</b>ld &eacute;&#233;&#xe9; a&nbsp;b<br>next   line</p><p>Two<p>Three <em>x</em><div class="newsletter">Sign up</div>
<form><input value="q">Ask</form><aside>Side</aside><ul><li>Item 1</li><li>Item 2</li></ul>
<section id="comments"><p>Reader says</p></section><p hidden>Hid</p><p>Last &am 5 < 6</article>
<div class="related-posts">More</div></main><footer>&copy; End</footer></body></html>"""


def test_article_text():
    text, marked = webtext.blocks(ARTICLE)
    assert marked and text == ["Head&line", "One bold ééé a b", "next line", "Two", "Three x", "Item 1",
                               "Item 2", "Last &am 5 < 6"]
    assert webtext.blocks("") == ([], False) and webtext.blocks("plain &lt;b&gt;") == (["plain <b>"], False)
    assert webtext.blocks("<p class='x>broken<article>yes")[0] == ["yes"]
    assert webtext.blocks("<article></article><p>out</p>") == (["out"], False)


def test_article_text_is_not_lost_by_markup():
    def text(page):
        return webtext.blocks(page)[0]
    assert text("<article><p class=ad>Buy<p>One<p hidden>Hid<p>Two</article>") == ["One", "Two"]
    assert text("<article><p class='ad'>Buy<div>One</div><p>Two</article>") == ["One", "Two"]
    assert text("<article><ul><li class='share'>Share<li>One<ul><li>a<li hidden>b</ul><li>Two</ul>Three</article>") == \
        ["One", "a", "Two", "Three"]
    assert text("<article><dl><dt hidden>x<dd>One<dt>Two</dl><table><tr hidden><td>y<tr><td class=ad>z<td>Three</table></article>") \
        == ["One", "Two", "Three"]
    for name in ("post has-sidebar", "social-policy", "notice-of-court", "comments", "post no-comments"):
        assert text(f"<div id='page' class='no-comments'><article class='{name}'><p>One</p></article></div>") == ["One"]
    assert text("<div class='page paywall'><main><p>One</p><div class=ad>Buy</div></main></div>") == ["One"]
    assert text("<article>One</article><div class=related><article>Other</article></div>") == ["One"]
    assert text("<article>One<article class=comment>Reader</article></article>") == ["One"]
    assert text("<nav><article>Menu</article></nav><p>One</p>") == ["One"]


def test_host_boilerplate(spark):
    bar = "one two three four five six seven eight nine ten"
    schema = "page_id long, url string, html string, host string, blocks string"
    page = "<html><body><div><p>{}</p><p>{}</p></div><footer>f</footer></body></html>"
    rows = [(i, f"http://a.org/{i}", page.format(bar + f" own{i}", f"text number {i} only here"), "h", "b") for i in range(4)]
    rows += [(10, "http://b.org/1", page.format(bar, "sole page of its host"), "h", "b"),
             (11, None, None, "h", "b"), (12, "odd", "", "h", "b"), (None, "http://c.org", "<main>x</main>", "h", "b"),
             (13, "http://d.org/1", page.format(bar, "same"), "h", "b"), (14, "http://d.org/2", page.format(bar, "same"), "h", "b"),
             (15, "http://a.org/z", f"<article><p>{bar}</p></article><p>{bar}</p>", "h", "b")]
    got = {r.page_id: r for r in webtext.main_text(spark.createDataFrame(rows, schema)).collect()}
    assert [got[i].text for i in range(4)] == [f"own{i} text number {i} only here" for i in range(4)]
    assert got[10].text == bar + " sole page of its host" and got[11].text == got[12].text == "" and got[None].text == "x"
    assert got[13].text == got[14].text == bar + " same" and got[15].text == bar
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert webtext.main_text(spark.createDataFrame([], schema)).collect() == []


def test_pipeline(spark):
    import corpus_pipeline
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs.count()
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.simpleString() == docs.schema.simpleString()
        docs = common.table(out)
        sizes.append(docs.count())
        assert docs.where(F.char_length("text") != F.col("n_chars")).count() == 0
    assert sizes[0] < kept and sizes[1] == sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    whole = corpus_pipeline.run(spark, folder)
    assert whole.select("doc_id").distinct().count() == sizes[3]
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []
    odd = spark.createDataFrame([(i, t, "en", "s", 0, "x") for i, t in odd_rows()],
                                D.StructType([*docs.schema.fields, D.StructField("id", D.StringType())]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        odd = common.table(stage(spark, odd, folder))
        assert odd.columns == [*docs.columns, "id"]
    assert odd.count() >= 8


def test_compound_names_inside_articles():
    gone = "comment-list comments-area reader-comments cookie-banner newsletter-signup sidebar-left ad-slot related-posts share-buttons ad_slot".split()
    kept = "social-policy notice-of-court has-sidebar no-comments advertising-law commentary".split()
    for name in gone + kept:
        page = f'<div class="{name}"><article class="{name}"><p>one</p><div id="x" class="a {name}"><p>two</p></div><p>three</p></article></div>'
        assert webtext.blocks(page)[0] == (["one", "three"] if name in gone else ["one", "two", "three"]), name
