"""Quality rules, fill-in-middle and token alignment against brute force."""
import hashlib
import random
import re
from collections import Counter
from math import comb

import duckdb
import pytest
from pyspark.sql import functions as F

from odd import odd_rows, plain_best_fit
from feedscope.llm import alignment, common, infill, queries, rules

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ quality rules
def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    marks = sum(c in "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~" for c in text)
    chars, dup = sum(map(len, words)), len(lines) - len(set(lines))
    symbols, n = sum(c in "#*$%&|<>" for c in text), max(1, len(words))
    length = min(100_000, chars * 100 // n)
    measures = [symbols * 1000 // n, length, 100_000 - length, dup * 1000 // max(1, len(lines)), len(covered) * 1000 // n,
                sum("A" <= c <= "Z" for c in text) * 1000 // max(1, chars), marks * 1000 // max(1, chars)]
    return len(words), chars, symbols, dup, len(covered), [min(m, 100_000) for m in measures]


def test_statistics_of_odd_rows(spark, docs_of):
    rows = odd_rows() + [(50, "a b a b a b c"), (51, "x y z\nx y z\n\n\nx y z "), (52, "A|B <C> & é%"), (53, "a b c d a b c")]
    got = rules.statistics(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), *r[2:]) for r in got) == sorted((str(i), *plain_statistics(t)) for i, t in rows)


def test_binomial_tail_is_exact():
    for n, p in ((1, 0.05), (20, 0.05), (161, 0.05), (300, 0.3)):
        for k in (0, 1, 5, n - 1, n):
            if k <= n:
                assert rules.tail(k, n, p) == pytest.approx(sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1)))
    assert rules.tail(49_000, 1_000_000, 0.05) < 1e-5


def plain_verdicts(stats, labels, proposes):
    """doc_id -> kept by plain loops over the same rule of choice."""
    best = {}
    for i, q in labels:
        if i is not None and q is not None:
            best[i] = max(best.get(i, q), q)
    failed = {i: s[0] < 50 or 100 * s[4] > 50 * s[0] for i, (_, s) in stats.items()}
    rows = [(g, s[5], best[i] == 1, proposes[i]) for i, (g, s) in stats.items() if i in best and not failed[i]]
    none, strata, cuts = 2 ** 31 - 1, sorted({r[0] for r in rows if r[3]}), {}
    for g in strata:
        own = [r for r in rows if r[0] == g and r[3]]
        good, bad = ([r[1] for r in own if r[2] == side] for side in (True, False))
        per = []
        for k in range(len(rules.RULES)):
            values, by_share = sorted({r[1][k] for r in own}), {}
            for _, q in rules.LEVELS:
                v = min(x for x in values if sum(m[k] > x for m in good) <= int(q * len(good)))
                over_g, over_b = sum(m[k] > v for m in good), sum(m[k] > v for m in bad)
                useful = over_b > 0 and over_b * (len(good) + 1) >= rules.LIFT * (over_g + 1) * len(bad)
                by_share[q] = ((v + min([x for x in values if x > v] or [v])) // 2 if useful else none, over_b if useful else 0)
            per.append(by_share)
        rank = sorted(range(len(per)), key=lambda k: (-per[k][0.0][1], k))
        cuts[g] = [[per[k][q][0] if rank.index(k) < most else none for k in range(len(per))] for most, q in rules.LEVELS]

    def level(g, m):
        return next((j for j, c in enumerate(cuts.get(g, []), 1) if any(x > y for x, y in zip(m, c))), 0)
    chosen = {}
    for g in strata:
        mine = [(level(g, m), ok, p) for h, m, ok, p in rows if h == g]
        n_good = sum(ok and not p for _, ok, p in mine)
        holds = 0
        for j in range(1, len(rules.LEVELS) + 1):
            lost = sum(0 < x <= j and ok and not p for x, ok, p in mine)
            tail = sum(comb(n_good, i) * rules.ALPHA ** i * (1 - rules.ALPHA) ** (n_good - i) for i in range(lost + 1))
            if not n_good or tail > rules.DELTA / len(strata):
                break
            holds = j

        def gain(j):
            share = [sum(0 < x <= j and ok == side and p for x, ok, p in mine) * sum(ok != side and p for _, ok, p in mine)
                     for side in (False, True)]
            return share[0] - share[1]
        best_j = max(range(1, holds + 1), key=lambda j: (gain(j), -j), default=0)
        chosen[g] = best_j if best_j and gain(best_j) > 0 else 0
    return {i: not failed[i] and not 0 < level(g, s[5]) <= chosen.get(g, 0) for i, (g, s) in stats.items()}, chosen


def test_verdicts_equal_plain_rules(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = common.documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    # every fourth language is a stratum without enough labels
    stats = {r.doc_id: (r.lang, plain_statistics(r.text)) for r in docs.collect()}
    half = {r.doc_id: r.p for r in docs.select("doc_id", (F.xxhash64("doc_id") % 2 == 0).alias("p")).collect()}
    want, chosen = plain_verdicts(stats, [(r.doc_id, r.quality) for r in labels.collect()], half)
    got = rules.judged(docs, labels).collect()
    assert {r.doc_id: r.kept for r in got} == want and any(chosen.values())
    quality = {r.doc_id: r.quality for r in labels.collect()}
    good = [r for r in got if quality.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(not r.kept for r in good) <= rules.ALPHA * len(good)


def test_rules_without_use(spark, docs_of):
    """No labels, empty tables, contradicting and null labels: only the base rules judge."""
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, lang string")
    odd = spark.createDataFrame([(None, 1), (5, 1), (5, 0), (7, None)], "doc_id long, quality int")
    for labels in (none, odd):
        got = rules.judged(docs_of(odd_rows()), labels).collect()
        assert len(got) == len(odd_rows()) and all(r.kept == (not r.base_failed) and r.level == 0 for r in got)
    assert rules.judged(docs_of([]), odd).count() == 0


# ------------------------------------------------------------------ fill in the middle
def plain_infill(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_plain(spark, docs_of):
    rng = random.Random(5)
    rows = odd_rows() + [(90, "a<P>b"), (91, "<S>"), (92, "x<M>"), (93, "<P"), (94, "<<S"), (95, "🎉é" * 5)]
    rows += [(1000 + i, "".join(rng.choice("<>PSM aé🎉") for _ in range(rng.randrange(12)))) for i in range(600)]
    got = infill.transformed(docs_of(rows)).collect()

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *plain_infill(i, t), sha(plain_infill(i, t)[-1]), sha(t or "")) for i, t in rows]
    assert sorted(map(repr, ((*r[:6], *r[7:]) for r in got))) == sorted(map(repr, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:  # the descriptors read text and sentinels only
        text = next((t or "").encode() for i, t in rows if i == r.doc_id and (i, *plain_infill(i, t))[5] == r.output)
        assert b"".join(infill.views([tuple(p) for p in r.pieces], (text, b"<P><M><S>"))) == r.output.encode()
    assert infill.transformed(docs_of([])).count() == 0


def test_piece_tables():
    table = [(0, 0, 5), (1, 3, 3), (0, 5, 2)]
    for at in range(12):
        left, right = infill.cut(table, at)
        buffers = (b"abcdefg", b"012345")
        assert b"".join(infill.views(left + right, buffers)) == b"abcde345fg"
        assert b"".join(infill.views(left, buffers)) == b"abcde345fg"[:at]
    assert infill.permuted(infill.permuted("xyz", (2, 0, 1)), infill.inverse((2, 0, 1))) == list("xyz")
    with pytest.raises(ValueError):
        infill.Arranger(1, ("<P>", "<P>", "<S>"), 90, 20)


def test_infill_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    got = queries.op12_fill_in_middle(spark, FOLDER)
    want = con.sql(queries.ORACLES["op12_fill_in_middle"])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


# ------------------------------------------------------------------ token alignment
@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain_alignment(rows, libraries):
    a, b = libraries
    signs = alignment.byte_alphabet()
    out, pairs = [], Counter()
    for doc_id, text in rows:
        held = None
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(signs[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
            raw = (" " + text).encode()
            if b"".join(bytes_a) == raw == b"".join(bytes_b):
                ends = [[sum(map(len, side[:k + 1])) for k in range(len(side))] if len(side) < 300 else None
                        for side in (bytes_a, bytes_b)]
                for k, side in enumerate((bytes_a, bytes_b)):
                    at, ends[k] = 0, []
                    for t in side:
                        at += len(t)
                        ends[k].append(at)
                both, groups, links, i, j = set(ends[0]) & set(ends[1]), [], [], 0, 0
                for e in sorted(both):
                    x, y = ends[0].index(e, i) + 1, ends[1].index(e, j) + 1
                    groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
                    links.append((ids_a[x - 1], ids_b[y - 1]))
                    i, j = x, y
                held = (len(ids_a), len(ids_b), groups, links)
                pairs.update(links)
        out.append((doc_id, held))
    top = {}
    for (_, y), n in pairs.items():
        top[y] = max(top.get(y, 0), n)
    return [(d, 0, 0, 0, 0, 0, 0, "") if h is None else
            (d, h[0], h[1], len(h[2]), len(h[3]), sum(pairs[p] == top[p[1]] for p in h[3]), sum(pairs[p] for p in h[3]),
             hashlib.sha256(";".join(h[2]).encode()).hexdigest()) for d, h in out]


def test_alignment_equals_plain(spark, docs_of, libraries):
    rng = random.Random(9)
    rows = odd_rows() + [(100 + i, "".join(rng.choice("abe é  🎉\n<s>|</s>1 ▁日the ") for _ in range(rng.randrange(60))))
                         for i in range(200)]
    rows += [(400, " leading"), (401, "trailing  "), (402, "<unk><s>"), (403, "\x00\x01"), (404, "▁"), (405, " "), (406, "x" * 3000)]
    got = alignment.scored(docs_of(rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_alignment(rows, libraries)))
    assert any(r.n_groups and r.n_a > r.n_groups for r in got)
    assert alignment.scored(docs_of([])).count() == 0
    assert all(r.n_a == 0 and r.groups_sha256 == "" for r in alignment.scored(docs_of([(1, None), (2, "")])).collect())


def test_alignment_of_the_documents(spark, libraries):
    docs = common.documents(spark, FOLDER)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = queries.op13_token_alignment(spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == sorted(plain_alignment(rows, libraries))


def test_small_window_tables_change_nothing(libraries):
    contents = alignment.vocabularies()
    texts = [f"The number {i} of {i % 7} things, isn't it? {'🎉' * (i % 3)}" for i in range(60)] * 2
    small, large = alignment.Aligner(*contents, most=5), alignment.Aligner(*contents)
    for part in (texts[:50], texts[50:], texts):
        assert [x[:4] for x in small.align(part)] == [x[:4] for x in large.align(part)]


def test_fast_byte_encoder_equals_the_library(libraries):
    side = alignment.ByteSide(alignment.vocabularies()[0])
    assert side._fast is not None
    for block in range(0, 0x110000, 0x400 * 5):
        text = "".join(f"x{chr(c)}y {chr(c)}1{chr(c)}\n" for c in range(block, block + 0x400) if not 0xD800 <= c < 0xE000)
        assert side.encode([text])[0].tolist() == libraries[0].encode(text, add_special_tokens=False).ids


# ------------------------------------------------------------------ twins and packing of earlier operators
@pytest.mark.parametrize("name", ["op1_substring_dedup", "op8_embedding_dedup"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = queries.QUERIES[name](spark, FOLDER)
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_packing_is_plain_online_best_fit(spark):
    """One task's pieces in hash order against a loop over all open bins."""
    from feedscope.llm import packing
    rng = random.Random(8)
    sizes = [rng.choice([2048, rng.randrange(1, 2049), rng.randrange(1, 300)]) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(sizes)), "n long, length long")
    arrival = [r.length for r in rows.withColumn("_m", F.xxhash64("n")).orderBy("_m", "n").collect()]
    packed = packing.pack(rows, ["n"])
    assert packed.select("sequence_id").distinct().count() == plain_best_fit(arrival, packing.CAPACITY, packing.OPEN_BINS)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("s")).where(f"s > {packing.CAPACITY}").count() == 0


def test_vectors_near_the_limit_are_found(spark):
    """Planted pairs at cosine 0.95 to 0.97 among 6,000 vectors in many lists: links and counts against brute force."""
    import numpy as np
    from feedscope.llm import vectors
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for k in range(0, 3000, 3):  # two neighbours of a third of them
        for step in (1, 2):
            side = rng.normal(size=64)
            side -= (side @ x[k]) * x[k]
            c = rng.uniform(0.95, 0.97)
            x[k + step] = c * x[k] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in vectors.near_vectors(frame, list_rows=20).collect()}
    cos = x @ x.T
    want = {i: int((cos[i] >= 0.95).sum()) - 1 for i in range(len(x))}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.99 * sum(want.values()) > 3500
