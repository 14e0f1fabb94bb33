"""Quality rules whose cutoffs are certified on labelled holdouts.

Each document has a few statistics and each rule rejects it when one of them is above a cutoff.  Cutoffs come from labels,
apart for every stratum (language):

1. Half of the labelled documents proposes.  A level lets so many rules take part, those that catch most bad documents
   first, each with the least value that at most a given share of the good documents exceed (and half the way to the next
   value seen) as its cutoff, and only where bad documents exceed it far more often.  A document's level is the first that rejects it, so the levels are nested.
2. The other half certifies.  A level holds if the exact binomial test rejects "more than ``ALPHA`` of the good documents
   are lost" and all levels before it hold.  Levels are tested in a fixed order, so one stratum needs no correction for
   them; the error ``DELTA`` is shared among the strata (Bonferroni).
3. Of the certified levels the one with the best difference of bad and good documents rejected, by the proposing half, is
   used.  Whichever it is, with probability 1 - DELTA no stratum loses more than ALPHA of its good documents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C

#: Most words in repeated windows (of 100) and fewest words of a document that is not rejected outright.
REPEATED, LEAST_WORDS = 50, 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"
ALPHA, DELTA = 0.05, 0.05
#: How many rules take part in a level, and the share of good documents that each may reject, in the order of testing.
LEVELS = ((1, 0.0), (2, 0.0), (3, 0.0), (7, 0.0), (7, 0.0025), (7, 0.005), (7, 0.01), (7, 0.02))
#: A rule takes part where bad documents are so many times as likely to be above its cutoff as good ones.
LIFT = 10
#: The rules' statistics, as whole numbers: thousandths, but word lengths in hundredths.
RULES = ("symbols_per_word", "long_words", "short_words", "dup_line_share", "repeat_share", "capital_share", "mark_share")
_MOST = 100_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 44), 45, *range(47, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    sums = np.r_[0, np.cumsum(flags)]
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(w: C.Words, window: int) -> np.ndarray:
    """Words of each text inside windows that occur in it twice or more."""
    hashes, doc = w.shingles(window)
    _, named, count = np.unique(C.mix(hashes + doc.astype(C.U64) * C.U64(0x9E3779B97F4A7C15)), return_inverse=True,
                                return_counts=True)
    begins = (w.first[:-1][doc] + np.arange(len(doc)) - np.searchsorted(doc, doc))[count[named] > 1]
    covered = np.zeros(len(w.starts) + window, np.int64)
    np.add.at(covered, begins, 1)
    np.add.at(covered, begins + window, -1)
    return _per_text(np.cumsum(covered)[:len(w.starts)] > 0, w.first)


def _lines(text: str) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines), len(lines) - len(set(lines))


def statistics(docs: DataFrame, stratum: Column | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and measures (one number a rule).

    Null texts have no words and all numbers zero.  Whole texts are read.  ``stratum`` is by default the column lang, if
    there is one; null counts as ''.
    """
    if stratum is None:
        stratum = F.col("lang") if "lang" in docs.columns else F.lit("")
    rows = docs.select("doc_id", F.coalesce(stratum.cast("string"), F.lit("")).alias("stratum"), "text")

    def share(x: np.ndarray, of: np.ndarray, unit: int = 1000) -> np.ndarray:
        return np.minimum(x * unit // np.maximum(of, 1), _MOST)

    def run(batch: pa.RecordBatch):
        for part in C.slices(batch):
            w = C.Words(part.column("text"))
            n_words = np.diff(w.first)
            inside = _LEAD[w.bytes] & ~C._SEPARATES[w.bytes]
            word_chars, symbols = _per_text(inside, w.offsets), _per_text(_SYMBOL[w.bytes], w.offsets)
            lines, dup = np.array([_lines(t) for t in C.texts(part.column("text"))], np.int64).T
            repeats = _repeats(w, window)
            length = share(word_chars, n_words, 100)
            measures = np.stack([share(symbols, n_words), length, _MOST - length, share(dup, lines), share(repeats, n_words),
                                 share(_per_text(_CAPITAL[w.bytes], w.offsets), word_chars),
                                 share(_per_text(_MARK[w.bytes], w.offsets), word_chars)], axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("stratum"),
                 *(pa.array(x.astype(np.int64)) for x in (n_words, word_chars, symbols, dup, repeats)),
                 pa.ListArray.from_arrays(np.arange(0, measures.size + 1, len(RULES), dtype=np.int32), measures.reshape(-1))],
                names=["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "measures"])
    return C.by_arrow(rows, run, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, "
                                 "n_dup_lines long, n_repeat_words long, measures array<int>")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))


# ------------------------------------------------------------------ certified cutoffs
def tail(k: int, n: int, p: float) -> float:
    """Exactly the chance of at most ``k`` of ``n``, each with probability ``p``."""
    if k >= n:
        return 1.0
    i = np.arange(k, dtype=np.float64)
    steps = np.log((n - i) / (i + 1)) + math.log(p / (1 - p))
    return float(min(1.0, np.exp(n * math.log1p(-p) + np.r_[0.0, np.cumsum(steps)]).sum()))


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, measures, good and proposes of the labelled documents that pass the base rules.

    Of contradicting labels of one id the better counts; null ids and null labels are none.  The half of a document is a
    hash of its id.
    """
    each = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        (F.max("quality") == 1).alias("good"))
    return stats.where(~base_failed()).join(each, "doc_id").select(
        "stratum", "measures", "good", (F.xxhash64("doc_id") % 2 == 0).alias("proposes"))


def proposed(rows: DataFrame, levels=LEVELS, lift: int = LIFT) -> DataFrame:
    """stratum and cuts: for each level each rule's cutoff (the greatest number where it takes no part).

    Counts per value are summed before they are ordered, so a window holds the different values of one rule in one
    stratum, at most a hundred thousand, however many documents there are.
    """
    values = rows.where("proposes").select("stratum", "good", F.posexplode("measures").alias("rule", "value")) \
        .groupBy("stratum", "rule", "value").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    whole, above = Window.partitionBy("stratum", "rule"), Window.partitionBy("stratum", "rule").orderBy(F.desc("value"))
    above = above.rowsBetween(Window.unboundedPreceding, -1)
    higher = F.lag("value").over(Window.partitionBy("stratum", "rule").orderBy(F.desc("value")))
    between = F.floor((F.col("value") + F.coalesce(higher, F.col("value"))) / 2).cast("int")
    counted = values.select("stratum", "rule", "value", between.alias("between"), F.sum("g").over(whole).alias("all_g"), F.sum("b").over(whole).alias("all_b"),
                            *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"over_{c}") for c in "gb"])
    # shares are compared as whole numbers: over_b / all_b >= lift * (over_g + 1) / (all_g + 1)
    useful = (F.col("over_b") > 0) & (F.col("over_b") * (F.col("all_g") + 1) >= lift * (F.col("over_g") + 1) * F.col("all_b"))
    most = F.lit(2 ** 31 - 1)
    shares = sorted({q for _, q in levels})
    least = [F.min_by(F.struct(F.when(useful, F.col("between")).otherwise(most).alias("cut"),
                               F.when(useful, F.col("over_b")).otherwise(0).alias("caught")),
                      F.when(F.col("over_g") <= F.floor(F.lit(q) * F.col("all_g")), F.col("value"))).alias(f"q{k}")
             for k, q in enumerate(shares)]
    per_rule = counted.groupBy("stratum", "rule").agg(*least)
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("q0.caught"), "rule"))
    by_level = [F.when(F.col("rank") <= k, F.col(f"q{shares.index(q)}.cut")).otherwise(most) for k, q in levels]
    per_rule = per_rule.withColumn("rank", rank).select("stratum", "rule", F.array(*by_level).alias("cuts"))
    by_rule = F.array_sort(F.collect_list(F.struct("rule", "cuts")))
    return per_rule.groupBy("stratum").agg(by_rule.alias("r")).select(
        "stratum", F.transform(F.sequence(F.lit(0), F.lit(len(levels) - 1)),
                               lambda j: F.transform("r", lambda x: F.get(x["cuts"], j))).alias("cuts"))


def level() -> Column:
    """The first level that rejects a row by its measures and cuts, from 1; 0 if none does."""
    rules = F.sequence(F.lit(0), F.lit(len(RULES) - 1))
    return F.array_position(F.transform("cuts", lambda c: F.exists(rules, lambda i: F.get("measures", i) > F.get(c, i))), True)


def certified(rows: DataFrame, cuts: DataFrame, alpha: float = ALPHA, delta: float = DELTA, levels: int = len(LEVELS)) -> DataFrame:
    """stratum, cuts, certified (levels that hold), chosen (the level used, 0: none), n_good and lost (good documents of
    the certifying half, and those that the chosen level rejects).

    Only the number of strata reaches the driver.  Strata without good documents in either half certify nothing.
    """
    counts = rows.join(cuts, "stratum").select("stratum", "proposes", "good", level().alias("level")) \
        .groupBy("stratum", "proposes", "good", "level").agg(F.count("*").alias("n"))
    per = counts.groupBy("stratum").agg(F.collect_list(F.struct("proposes", "good", "level", "n")).alias("counts"))
    strata = max(1, cuts.agg(F.count("*")).first()[0])

    def choose(batch: pa.RecordBatch):
        out = []
        for held in batch.column("counts").to_pylist():
            n = np.zeros((2, 2, levels + 1), np.int64)
            for c in held:
                n[int(c["proposes"]), int(c["good"]), int(c["level"])] += c["n"]
            lost = np.cumsum(n[:, :, 1:], axis=2)
            every = n.sum(axis=2)
            holds = 0
            while holds < levels and every[0, 1] and tail(int(lost[0, 1, holds]), int(every[0, 1]), alpha) <= delta / strata:
                holds += 1
            gain = lost[1, 0, :holds] * every[1, 1] - lost[1, 1, :holds] * every[1, 0]
            chosen = int(np.argmax(gain)) + 1 if holds and gain.max() > 0 else 0
            out.append((holds, chosen, int(every[0, 1]), int(lost[0, 1, chosen - 1]) if chosen else 0))
        a, b, c, d = zip(*out) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays([batch.column("stratum"), *(pa.array(x, pa.int64()) for x in (a, b, c, d))],
                                          names=["stratum", "certified", "chosen", "n_good", "lost"])
    found = C.by_arrow(per, choose, "stratum string, certified long, chosen long, n_good long, lost long")
    return cuts.join(found, "stratum")


def judged(docs: DataFrame, labels: DataFrame, stratum: Column | None = None, alpha: float = ALPHA, delta: float = DELTA,
           levels=LEVELS, lift: int = LIFT) -> DataFrame:
    """One row per document: the columns of ``statistics``, base_failed, level (the first that rejects it, 0: none) and kept.

    A document fails the base rules or is rejected by the chosen level of its stratum; strata without a certified level
    only know the base rules.  Every row is judged by itself, also repeated ones and those with a null id; an empty table
    gives no rows; other columns are not read.
    """
    stats = C.table(statistics(docs, stratum))
    rows = C.table(labelled(stats, labels))
    cuts = C.table(proposed(rows, levels, lift))
    chosen = C.table(certified(rows, cuts, alpha, delta, len(levels)).select("stratum", "cuts", "chosen"))
    met = stats.join(chosen, "stratum", "left").withColumn("level", F.coalesce(level(), F.lit(0)))
    failed = base_failed()
    rejected = (F.col("level") > 0) & (F.col("level") <= F.coalesce("chosen", F.lit(0)))
    return met.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "measures",
                      failed.alias("base_failed"), "level", (~failed & ~rejected).alias("kept"))
