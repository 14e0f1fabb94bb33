"""Substring dedup, packing, fingerprints, near and line dedup against brute force, and their odd rows."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from odd import odd_rows, plain_best_fit
from feedscope.llm import fingerprints, lines, near, packing, substring

WORD = re.compile("[^\x20\x09-\x0d]+")


def prose(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Documents with shared passages of 40 to 120 words, copies, near copies and self-repeats."""
    rng = random.Random(5)
    passages = [prose(rng, n) for n in (49, 50, 51, 70, 120, 300)]
    rows = []
    for i in range(120):
        words = prose(rng, rng.randrange(0, 160))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, max(1, len(p) - 50))
            at = rng.randrange(len(words) + 1)
            words[at:at] = p[a:a + rng.randrange(45, 200)]
        rows.append((i, " ".join(words)))
    base = prose(rng, 400)
    for i in range(120, 150):
        copy = list(base)
        for _ in range(rng.randrange(0, 12)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        rows.append((i, ("\n" if i % 2 else " ").join(copy)))
    rows += [(150, rows[3][1]), (151, rows[3][1] + " "), (152, " ".join(["same"] * 130)), (153, " ".join(["same"] * 90))]
    return rows


def removed(rows, window=50):
    first, out = {}, {}
    words = {i: WORD.findall(t) for i, t in rows}
    for i in sorted(words):
        for s in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][s:s + window]), i)
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < i:
                gone.update(range(s, s + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_repeats_equal_brute_force(docs_of, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(docs_of(corpus)).collect()}
    want = removed(corpus)
    assert got == want and sum(n for _, n, _ in want.values()) > 2000


def test_repeats_of_odd_rows(docs_of):
    rows = odd_rows()
    got = substring.remove_repeats(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.text): r for r in got}
    long = rows[10][1]
    assert by[7, long].n_removed == 0 and by[8, long].n_removed == 30_000 and by[8, long].kept == ""
    assert by[1, None].n_words == 0 and by[9, rows[12][1]].kept == " ".join(WORD.findall(rows[12][1]))
    whole = substring.without_repeats(docs_of(rows))
    assert whole.columns == docs_of(rows).columns and whole.count() == len(rows)
    assert {r.text for r in whole.where("doc_id = 8").collect()} == {""}
    assert {r._row for r in whole.collect()} == {"r"}
    assert substring.remove_repeats(docs_of([])).collect() == []


def test_packing(docs_of, corpus):
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus + [(900, None), (901, ""), (902, " ".join(t for _, t in corpus))]
    got = packing.pack_documents(docs_of(rows)).collect()
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    bins = defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.start == 2048 * r.piece and len(part) == r.length == min(2048, len(ids[r.doc_id]) - r.start)
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    # exactly as many as plain online best-fit makes of the pieces in the same order
    order = ["doc_id", "piece", "ids_crc32"]
    arrival = packing.pieces(docs_of(rows)).withColumn("_m", F.xxhash64(*order)).orderBy("_m", *order).collect()
    assert len(bins) == plain_best_fit([r.length for r in arrival], 2048, packing.OPEN_BINS)
    assert packing.pack_documents(docs_of([])).collect() == []
    assert packing.pack_documents(docs_of(odd_rows())).where("piece = 0").count() == len(odd_rows())


def test_open_bins_are_bounded_and_best_fit():
    rng = random.Random(1)
    bins = packing.OpenBins(100, 8)
    fill = Counter()
    for _ in range(3000):
        size = rng.randrange(1, 101)
        free = {n: 100 - fill[n] for b in bins.by_free.values() for n in b}
        assert len(free) == bins.open <= 8
        number, offset = bins.put(size)
        assert offset == fill[number]
        fits = [f for f in free.values() if f >= size]
        if fits:
            assert 100 - offset == min(fits)
        else:
            assert offset == 0
        fill[number] += size
        assert fill[number] <= 100


def shingles(text):
    w = WORD.findall(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def test_fingerprints_of_edited_texts(docs_of, corpus):
    rows = corpus + [(200, None), (201, ""), (202, "x"), (203, "öß" * 5000)]
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs_of(rows), ranges=7).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    errors = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + n[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = set(shingles(t)), set(shingles(edited))
        errors.append(got[i].near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04
    assert got[150].fingerprint == got[3].fingerprint and got[200].fingerprint == got[201].fingerprint
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs_of(rows)).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}
    odd = fingerprints.edited_fingerprints(docs_of(odd_rows()), ranges=3)
    assert odd.count() == len(odd_rows())
    assert fingerprints.edited_fingerprints(docs_of([])).collect() == []
    assert len(fingerprints.edited_fingerprints(docs_of([(4, "alone here")])).collect()) == 1


def test_fingerprint_bits_round_trip():
    values = np.arange(64, dtype=np.uint8).reshape(2, 32) % 16
    assert [fingerprints.unpacked(p).tolist() for p in fingerprints.packed(values)] == values.tolist()


def test_empty_bins_are_filled_by_the_first_draw(monkeypatch):
    """As drawing attempt by attempt does, without hashing the draws for every sketch again."""
    from feedscope.llm import common as C
    bins, rng = 64, np.random.default_rng(3)
    sketch = np.full((80, bins), fingerprints.EMPTY, np.uint64)
    for r in range(len(sketch)):
        held = rng.choice(bins, [1, 1, 2, 3, 7, 20, 40, bins][r % 8], replace=False)
        sketch[r, held] = rng.integers(0, 1 << 62, len(held)).astype(np.uint64)
    want = sketch.copy()
    for r, row in enumerate(sketch):
        near = np.flatnonzero(row != fingerprints.EMPTY)
        for c in np.flatnonzero(row == fingerprints.EMPTY):
            draws = C.mix((c * fingerprints.ROUNDS + np.arange(fingerprints.ROUNDS) + 1).astype(np.uint64)) % np.uint64(bins)
            met = np.flatnonzero(np.isin(draws.astype(int), near))
            want[r, c] = row[draws[met[0]]] if len(met) else row[near[np.searchsorted(near, c) % len(near)]]
    fingerprints._densify(sketch.copy())
    hashed = []
    monkeypatch.setattr(C, "mix", lambda x: hashed.append(x))
    for few in (0, 5, bins):
        monkeypatch.setattr(fingerprints, "FEW", few, raising=False)
        got = sketch.copy()
        fingerprints._densify(got)
        assert (got == want).all()
    assert not hashed


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    n, k = 400, 256
    errors = []
    for common in (0, 40, 80):
        count_a, count_b = rng.integers(1, 40, n), rng.integers(1, 40, n)
        ids = np.sort(rng.choice(1 << 40, 2 * n, replace=False)).astype(np.uint64)
        a, b = np.sort(rng.choice(2 * n, n, replace=False)), np.sort(rng.choice(2 * n, n, replace=False))
        b[:common] = a[:common]
        b, first = np.unique(b, return_index=True)
        count_b = count_b[first]
        sig = near.signatures(np.r_[np.zeros(len(a), int), np.ones(len(b), int)], np.r_[ids[a], ids[b]],
                              np.r_[count_a, count_b], 2, k)
        x, y = dict(zip(a, count_a)), dict(zip(b, count_b))
        least = sum(min(x.get(i, 0), y.get(i, 0)) for i in x)
        errors.append((sig[0] == sig[1]).mean() - least / (sum(x.values()) + sum(y.values()) - least))
    assert max(map(abs, errors)) < 0.12
    whole = near.signatures(np.zeros(3, int), np.array([5, 6, 7], np.uint64), np.array([1, 1000, 3]), 1, 64)
    assert np.isfinite(whole).all()


def groups_of(ids, links):
    least = {i: i for i in ids}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        least[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_brute_force(docs_of, corpus):
    bag = {i: shingles(t) for i, t in corpus}

    def similar(x, y):
        least = sum((bag[x] & bag[y]).values())
        return least >= 0.8 * (sum(bag[x].values()) + sum(bag[y].values()) - least)
    want = groups_of(bag, [(x, y) for x in bag for y in bag if x < y and similar(x, y)])
    got = {r.doc_id: (r.class_id, r.kept) for r in near.near_duplicates(docs_of(corpus)).collect()}
    assert got == {i: (c, i == c) for i, c in want.items()}
    kept = near.keep_one(docs_of(corpus))
    assert kept.columns == docs_of(corpus).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("with_source", [True, False])
def test_copies_with_edits_of_their_own_make_few_pairs(docs_of, monkeypatch, with_source):
    """Copies of one text under the limit of each other are not compared pair by pair, and twins among them are found."""
    rng = random.Random(11)
    source = prose(rng, 150)

    def edited(words, edits):
        words = list(words)
        for at in rng.sample(range(len(words)), edits):
            words[at] = f"new{rng.randrange(10**9)}"
        return words
    texts = [source] * with_source + [edited(source, rng.randrange(4, 9)) for _ in range(200)]
    texts += [edited(w[:140], 1) for w in rng.sample(texts[1:], 20)]
    rows = list(enumerate(map(" ".join, texts)))
    rng.shuffle(rows)
    made, plain_verifier = [], near.verifier

    def watched(*args):
        verify = plain_verifier(*args)

        def counting(pairs):
            made.append(pairs.count())
            return verify(pairs)
        return counting
    monkeypatch.setattr(near, "verifier", watched)
    bag = {i: shingles(t) for i, t in rows}

    def similar(x, y):
        least = sum((bag[x] & bag[y]).values())
        return least >= 0.8 * (sum(bag[x].values()) + sum(bag[y].values()) - least)
    want = groups_of(bag, [(x, y) for x in bag for y in bag if x < y and similar(x, y)])
    assert {r.doc_id: r.class_id for r in near.near_duplicates(docs_of(rows)).collect()} == want
    assert 15 < len(rows) - len(set(want.values())) < 100
    assert sum(made[1:]) < 5 * len(rows)


def test_near_duplicates_of_odd_rows(docs_of):
    got = near.near_duplicates(docs_of(odd_rows())).collect()
    assert len(got) == len(odd_rows())
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.class_id, r.kept))
    assert by[1] == {(1, True)} and by[2] == by[3] == by[11] == {(1, False)}
    assert by[5] == {(4, False), (5, True)} and by[8] == {(7, False)}
    assert near.near_duplicates(docs_of([])).collect() == []


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def plain(line):
    return " ".join(re.sub(r"[^a-zäöüß]+", " ", line.lower()).split())


def test_lines_equal_brute_force(spark, docs_of):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice((3, 8, 20, 60, 200)))] for _ in range(30)]
    rows = []
    for i in range(40):
        text = []
        for _ in range(rng.randrange(1, 8)):
            line = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 2))):
                line[rng.randrange(len(line))] = rng.choice(words)
            text.append(" ".join(line).upper() + "!" if rng.random() < 0.3 else " ".join(line))
            if rng.random() < 0.2:
                text.append("--- 12 ---")
        rows.append((i, "\n".join(text)))
    distinct = sorted({plain(x) for _, t in rows for x in t.split("\n")} - {""})
    frame = spark.createDataFrame([(x,) for x in distinct], "line string")
    from pyspark.sql import functions as F
    sim = {r.line: r.sketch & (1 << 64) - 1 for r in lines.simhashes(frame, "line").collect()}
    hashes = {r.w: r.h & (1 << 64) - 1 for r in frame.select(F.explode(F.split("line", " ")).alias("w")).distinct()
              .select("w", F.xxhash64("w").alias("h")).collect()}
    for x in distinct:
        own = x.split(" ")
        bits = [sum(hashes[w] >> b & 1 for w in own) for b in range(64)]
        assert sim[x] == sum(1 << b for b in range(64) if 2 * bits[b] > len(own)), x
    close = [(x, y) for x in distinct for y in distinct if x < y and (sim[x] ^ sim[y]).bit_count() <= 2
             and edit_distance(x, y) <= round(0.1 * max(len(x), len(y)), 9)]
    assert close
    group = groups_of(distinct, close)
    seen, want = set(), {}
    for i, t in rows:
        kept = []
        for line in t.split("\n"):
            g = group.get(plain(line))
            if g is None or g not in seen:
                kept.append(line)
            seen.add(g)
        want[i] = "\n".join(kept)
    got = lines.drop_lines(docs_of(rows))
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert got.columns == [*docs_of(rows).columns, "n_lines", "n_dropped"]


def test_lines_linked_by_edit_similarity_alone(docs_of):
    rng = random.Random(21)
    letters = "abcdefghij"

    def changed(line, edits):
        line = list(line)
        for _ in range(edits):
            at = rng.randrange(1, len(line) - 1)
            line[at:at + rng.choice((0, 1, 1))] = rng.choice(letters)
        return "".join(line)
    groups = []
    for n in [9, 10, 12, 19, 20, 21, 24, 33, 45, 47, 60, 75, 90, 98, 109, 112, 143, 180, 199, 204, 240] * 3:
        line = " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))[:n - 1] + "k"
        groups.append([plain(line), plain(changed(line, 1)), plain(changed(line, n // 10))])
    han = "".join(chr(0x4e00 + rng.randrange(3000)) for _ in range(80))
    groups.append([han, han[:40] + "一" + han[41:]])
    rows, want, short = [], set(), set()
    for g in groups:
        g = list(dict.fromkeys(g))
        ids = range(len(rows), len(rows) + len(g))
        links = [(i, j) for i in ids for j in ids if i < j and
                 edit_distance(g[i - ids[0]], g[j - ids[0]]) * 10 <= max(len(g[i - ids[0]]), len(g[j - ids[0]]))]
        want |= set(groups_of(ids, links).values())
        short |= {i for i in ids if len(g[i - ids[0]]) <= 46}
        rows += [(i, x) for i, x in zip(ids, g)]
    got = lines.drop_lines(docs_of(rows), runs=True)
    kept = {r.doc_id for r in got.where("n_dropped = 0").collect()}
    assert want <= kept and kept & short == want & short
    assert len(rows) - len(want) > 80 and len(kept - want) <= 0.02 * (len(rows) - len(want))


def test_lines_linked_by_phrases(spark, docs_of):
    """Words changed in a tenth of a line's letters: all links are found, by a bounded number of keys a line."""
    from pyspark.sql import functions as F
    rng = random.Random(33)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    rows = []
    for n in [2, 4, 6, 9, 14, 30, 60, 150] * 6:
        line = [rng.choice(words) for _ in range(n)]
        other = list(line)
        for _ in range(max(1, n // 16)):
            other[rng.randrange(n)] = rng.choice(words)
        rows += [" ".join(line), " ".join(other)]
    han = "".join(chr(0x4e00 + rng.randrange(3000)) for _ in range(80))
    rows += [han, han[:40] + "一" + han[41:]]
    links = [(i + 1, i) for i in range(0, len(rows), 2)
             if 0 < edit_distance(rows[i], rows[i + 1]) * 10 <= max(len(rows[i]), len(rows[i + 1]))]
    links += [(i + 1, i) for i in range(0, len(rows), 2) if rows[i] == rows[i + 1]]
    got = lines.drop_lines(docs_of(list(enumerate(rows))), phrases=True)
    assert {r.doc_id for r in got.where("n_dropped > 0").collect()} == {i for i, _ in links} and len(links) > 25
    frame = spark.createDataFrame([(x,) for x in rows if len(x) >= lines.PHRASES_FROM], "line string").distinct()
    sims = lines.simhashes(frame, "line", seeds=lines.SEEDS)
    assert sims.columns == ["line", "sketch", *[f"m{k}" for k in range(lines.SEEDS)]] and lines.SEEDS <= 8
    plain_sims = {r.line: r.sketch for r in lines.simhashes(frame, "line").collect()}
    assert all(plain_sims[r.line] == r.sketch for r in sims.where(F.size(F.split("line", " ")) > 1).collect())


def test_unlike_lines_make_few_pairs(spark, docs_of, monkeypatch):
    """Short lines of a few syllables share many runs of letters; the pairs to verify stay near the links, and none is lost."""
    rng = random.Random(41)
    syllables = ["th", "en", "er", "ing", "on", "at", "ed", "ha", "re", "wh", "nd", "tion", "ou", "es", "an", "st"]

    def line():
        out = ""
        while len(out) < 30:
            out += "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) + " "
        return out.strip()[:44].strip()
    rows = [line() for _ in range(1200)]
    for x in rows[:60]:
        y = list(x)
        for _ in range(rng.randrange(1, len(x) // 10 + 1)):
            at = rng.randrange(len(y))
            y[at:at + rng.choice((0, 1, 1))] = rng.choice("abcdeghi")
        rows.append(plain("".join(y)))
    rows = list(dict.fromkeys(rows))
    made, block_groups = [], lines.block_groups

    def counted(members, near, verify, **more):
        def and_count(pairs, *known):
            made.append(pairs.count())
            return verify(pairs, *known)
        return block_groups(members, near, and_count, **more)
    monkeypatch.setattr(lines, "block_groups", counted)
    got = lines.drop_lines(docs_of(list(enumerate(rows))), phrases=True)
    links = [(x, y) for i, x in enumerate(rows) for y in rows[:i] if abs(len(x) - len(y)) * 10 <= max(len(x), len(y))
             and sum((Counter(x) - Counter(y)).values()) * 10 <= max(len(x), len(y))
             and edit_distance(x, y) * 10 <= max(len(x), len(y))]
    group = groups_of(rows, links)
    first = {}
    for x in rows:
        first.setdefault(group[x], x)
    assert {rows[r.doc_id] for r in got.where("n_dropped = 0").collect()} == set(first.values())
    assert len(links) > 40 and sum(made) < 4 * len(links)


def test_bags_of_lines_lose_no_link(spark):
    from pyspark.sql import functions as F
    rng = random.Random(42)
    pairs = [("e" * 20000, "e" * 22222), ("e" * 40000 + "t", "e" * 40000 + "a"), ("漢字" * 10, "漢字" * 9 + "字漢"), ("ab", "ba")]
    for _ in range(300):
        x = [rng.choice("etaoin xyz é") for _ in range(rng.randrange(10, 120))]
        y = list(x)
        for _ in range(rng.randrange(0, len(x) // 6 + 1)):
            at = rng.randrange(len(y) + 1)
            y[at:at + rng.choice((0, 1, 1))] = rng.choice(([], ["e"], ["q"]))
        pairs.append(("".join(x), "".join(y)))
    frame = spark.createDataFrame(pairs, "x string, y string")
    bags = frame.select("x", "y", lines._bag(F.col("x")).alias("p"), lines._bag(F.col("y")).alias("q"))
    got = bags.select("x", "y", lines._bags_near(F.col("p"), F.col("q"), 0.9).alias("near"),
                      lines._bags_near(F.col("q"), F.col("p"), 0.9).alias("back")).collect()
    for r in got:
        n = max(len(r.x), len(r.y))
        assert r.near == r.back
        if n <= 120:
            gone, new = (sum((Counter(a) - Counter(b)).values()) for a, b in ((r.x, r.y), (r.y, r.x)))
            assert r.near or edit_distance(r.x, r.y) * 10 > n
            assert not r.near or max(gone, new) * 10 <= n or set(r.x + r.y) & set("xyzqé 漢字")
    assert [r.near for r in got if len(r.x) > 9000] == [True, True] and {r.near for r in got} == {True, False}


def test_lines_meet_by_bands_of_length(spark, docs_of):
    """Lengths that allow a link are in the same or neighbouring bands, lengths that do not are soon apart."""
    from pyspark.sql import functions as F
    for similarity in (0.9, 0.95, 1.0):
        sizes = [*range(1, 400), *range(400, 200_000, 997), 9_000, 10_000, 90_000, 100_000, 180_000, 200_000]
        got = {r.n: r.b for r in spark.createDataFrame([(n,) for n in sizes], "n int")
               .select("n", lines._length_band(F.col("n"), similarity).alias("b")).collect()}
        for n in sizes:
            least = n - int(n * round(1 - similarity, 9))
            assert all(abs(got[n] - got[k]) <= 1 for k in sizes if least <= k <= n)
            assert similarity == 1 or all(abs(got[n] - got[k]) > 1 for k in sizes if k < n * similarity ** 2.1 or k > n / similarity ** 2.1)
    # one passage in lines of many lengths, and pairs at the limit of each length
    rng = random.Random(8)
    rows = []
    for n in range(60, 400, 20):
        own = "the passage that all of them share and " + " ".join("".join(rng.choice("abcdefghijklm") for _ in range(5)) for _ in range(n // 6))
        rows += [own, own + " " + "z" * ((len(own) + 1) // 9 - 2)]
    want = {2 * k for k in range(len(rows) // 2)}
    got = lines.drop_lines(docs_of(list(enumerate(rows))), phrases=True)
    assert {r.doc_id for r in got.where("n_dropped = 0").collect()} == want


def test_distance_without_common_ends(spark):
    from pyspark.sql import functions as F
    rng = random.Random(34)
    pairs = [("a", "b"), ("a b", "a"), ("a a", "a a a"), ("a b a", "a c a"), ("x a b", "a b"), ("ab", "ab c")]
    for _ in range(200):
        x = [rng.choice(["a", "bc", "d"]) for _ in range(rng.randrange(1, 9))]
        y = x[:rng.randrange(0, 4)] + [rng.choice(["a", "bc", "e"])] + x[rng.randrange(0, len(x)):]
        pairs.append((" ".join(x), " ".join(y)))
    frame = spark.createDataFrame([p for p in pairs if p[0] != p[1]], "x string, y string")
    got = frame.select("x", "y", F.levenshtein("x", "y").alias("d"), lines._unlike(F.col("x"), F.col("y"), F.levenshtein).alias("e"),
                       lines._unlike(F.col("x"), F.col("y"), lambda a, b: F.char_length(a) + F.char_length(b)).alias("n")).collect()
    assert all(r.d == r.e for r in got) and any(r.n < len(r.x) + len(r.y) for r in got)


def test_lines_of_odd_rows(docs_of):
    got = lines.drop_lines(docs_of(odd_rows())).collect()
    assert len(got) == len(odd_rows())
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.text, r.n_lines, r.n_dropped))
    assert by[1] == {(None, 0, 0)} and by[2] == {("", 1, 0)} and by[6] == {("!!! ### 123\n...\n", 3, 0)}
    assert by[4] == {("a", 1, 0)} and by[5] == {("", 1, 1), ("b c d", 1, 0)} and by[8] == {("", 1, 1)}
    assert by[10] == {("one two three four five six seven eight\n", 41, 39)} and by[11] == {("\n" * 1000, 1001, 0)}
    assert lines.drop_lines(docs_of([])).collect() == []


def test_lines_by_ends_of_words(spark, docs_of):
    """Pairs of lines: all links up to 46 letters, beyond that those whose SimHashes agree in two of five blocks."""
    rng = random.Random(5)
    letters, pairs = "abcdefghijklmnop", []
    for n in [1, 2, 4, 6, 12, 20, 30, 45, 80] * 5:
        line = list(" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(n)))
        other = list(line)
        for _ in range(rng.randrange(1, 4)):
            other[rng.choice([i for i, x in enumerate(other) if x != " "])] = rng.choice(letters)
        pairs.append(("".join(line), "".join(other)))
    han = "".join(chr(0x4e00 + rng.randrange(3000)) for _ in range(80))
    pairs = [p for p in pairs if p[0] != p[1]] + [(han, han[:40] + "一" + han[41:])]
    frame = spark.createDataFrame([(x,) for x in {x for p in pairs for x in p}], "line string")
    sim = {r.line: r.sketch & (1 << 64) - 1 for r in lines.simhashes(frame, "line", ends=True).collect()}
    cuts = [64 * i // 5 for i in range(6)]

    def candidates(x, y):
        apart = sim[x] ^ sim[y]
        same = sum(not apart >> a & (1 << b - a) - 1 for a, b in zip(cuts, cuts[1:]))
        assert same >= 2 or apart.bit_count() > 3
        return max(len(x), len(y)) <= 46 or same >= 2 and apart.bit_count() <= 12
    linked = [edit_distance(x, y) * 10 <= max(len(x), len(y)) for x, y in pairs]
    found = [near and candidates(*p) for near, p in zip(linked, pairs)]
    got = lines.drop_lines(docs_of([(i, x) for i, x in enumerate(x for p in pairs for x in p)]), ends=True)
    gone = {r.doc_id for r in got.where("n_dropped > 0").collect()}
    assert gone == {2 * i + 1 for i, f in enumerate(found) if f}


def test_the_chunk_table_is_not_emptied_by_many_words():
    import itertools
    from feedscope.llm import common
    encoder, learned = common.library_encoder(common.tokenizer_text()), []
    letters = encoder.encode_letters
    encoder.encode_letters = lambda words: learned.append(len(words)) or letters(words)
    try:
        words = ["".join(w) for w in itertools.islice(itertools.product("bcdfghjklm", repeat=6), 420_000)]
        texts = [" ".join(words[i:i + 1000]) for i in range(0, len(words), 1000)]
        first = [x for i in range(0, len(texts), 100) for x in encoder(texts[i:i + 100])]
        once = sum(learned)
        assert [x for i in range(0, len(texts), 100) for x in encoder(texts[i:i + 100])] == first and sum(learned) == once
    finally:
        common._encoders.clear()
