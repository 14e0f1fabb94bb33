"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

Statistics of each whole text come from byte classes and words.  A forest is grown on labelled rows, every path from a root
to a node is a conjunctive rule, and a lasso logistic regression over the rules (and the statistics themselves, scaled) keeps
few of them.  The score is one column expression over the statistics.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

#: Most labelled rows used to fit; larger label tables are sampled by a hash of the id.
FIT_ROWS = 20_000
TREES, DEPTH, LASSO = 30, 3, 0.002
THRESHOLD = 0.3

#: Byte classes by name; every other ASCII sign counts as "other", bytes above 127 as "wide".
CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t\x0b\x0c",
           "line": b"\n\r", "stop": b".,;:?", "shout": b"!", "bar": b"|", "sign": b"#$%&*+=<>@^_~`\\/", "other": (),
           "wide": range(128, 256)}
NAMES = [*[f"{c}_share" for c in CLASSES], "words_log", "word_length", "short_words", "long_words", "fresh_words",
         "alone_signs", "words_per_line", "loud_words"]
_CLASS = np.full(256, list(CLASSES).index("other"), np.int64)
for _i, _codes in enumerate(CLASSES.values()):
    _CLASS[list(_codes)] = _i


def statistics(docs: DataFrame, row: bool = False) -> DataFrame:
    """doc_id and the columns NAMES (doubles) of every text.  A text without words (null, empty) has zeros only.

    ``row``: with _row, the text's hash, after doc_id.
    """
    named = ["doc_id", "_row"] if row else ["doc_id"]

    def run(batch: pa.RecordBatch):
        for part in C.slices(batch):
            w, n, k = C.Words(part.column("text"), lower=True), part.num_rows, len(CLASSES)
            size = np.diff(w.offsets)
            of = np.repeat(np.arange(n), size)
            kinds = _CLASS[w.bytes]
            share = np.bincount(of * k + kinds, minlength=n * k).reshape(n, k) / np.maximum(size, 1)[:, None]
            words, doc, length = np.diff(w.first), w.doc, w.ends - w.starts
            per = np.maximum(words, 1)

            def rate(mask):
                return np.bincount(doc[mask], minlength=n) / per
            key = np.sort(doc.astype(C.U64) << C.U64(48) | w.hashes >> C.U64(16))
            fresh = np.bincount((key[np.r_[True, key[1:] != key[:-1]]] >> C.U64(48)).astype(np.int64), minlength=n) / per \
                if len(key) else np.zeros(n)
            letters = np.concatenate([[0], np.cumsum((kinds < 2) | (kinds == k - 1))])
            upper = np.concatenate([[0], np.cumsum(kinds == 0)])
            has = letters[w.ends] - letters[w.starts]
            lines = np.bincount(of[w.bytes == 10], minlength=n) + 1
            columns = [*share.T, np.log1p(words), np.bincount(doc, length, n) / per, rate(length <= 3), rate(length >= 12),
                       fresh, rate(has == 0), words / lines, rate((has > 1) & (upper[w.ends] - upper[w.starts] == has))]
            columns = [np.where(words > 0, c, 0.0).astype(np.float64) for c in columns]
            yield pa.RecordBatch.from_arrays([*map(part.column, named), *map(pa.array, columns)], names=[*named, *NAMES])
    return C.by_arrow(docs.select(*C.doc_key()[:len(named)], "text"), run,
                      ", ".join([f"{c} long" for c in named] + [f"{c} double" for c in NAMES]))


@dataclass(frozen=True)
class Model:
    """Weighted rules: conjunctions of (statistic, is_greater, bound), scaled statistics and an intercept."""
    intercept: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]
    linear: tuple[tuple[float, str, float], ...]

    def score(self) -> Column:
        """Probability of label 1 as one expression over the statistics."""
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(_holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        for weight, name, scale in self.linear:
            total = total + F.least(F.col(name) / F.lit(scale), F.lit(3.0)) * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(rule) -> Column:
    out = F.lit(True)
    for name, greater, bound in rule:
        out = out & ((F.col(name) > bound) if greater else (F.col(name) <= bound))
    return out


_SPLIT = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_rules(text: str, names: list[str]) -> list[tuple]:
    """The conjunction of every path from the root of a printed tree, bounds of one statistic drawn together."""
    path, rules = [], []
    for line in text.splitlines():
        m = _SPLIT.match(line)
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, names[int(m[3])], m[4] == ">", float(m[5]))]
        bounds: dict[tuple, float] = {}
        for _, name, greater, bound in path:
            old = bounds.get((name, greater), bound)
            bounds[name, greater] = max(old, bound) if greater else min(old, bound)
        rules.append(tuple(sorted((n, g, b) for (n, g), b in bounds.items())))
    return rules


def fit(labelled: DataFrame, label: str = "quality", trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO,
        most: int = FIT_ROWS) -> Model:
    """Fit on rows with NAMES and a 0/1 label, at most ``most`` of them, the least by a hash of their ids.

    With one label only (or no row) the score is that label's smoothed share for every text.
    """
    rows = C.table(labelled.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
                   .select(F.col(label).cast("double").alias("label"), "doc_id", *NAMES)
                   .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return Model(float(np.log((ones + 1) / (n - ones + 1))), (), ())
    vectors = VectorAssembler(inputCols=NAMES, outputCol="x").transform(rows)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=7,
                                    minInstancesPerNode=5).fit(vectors)
    rules = list(dict.fromkeys(r for t in forest.trees for r in tree_rules(t.toDebugString, NAMES)))
    scales = rows.agg(*[F.greatest(F.stddev_pop(c), F.lit(1e-9)).alias(c) for c in NAMES]).first()
    linear = [F.least(F.col(c) / F.lit(scales[c]), F.lit(3.0)) for c in NAMES]
    wide = rows.select("label", F.array(*[_holds(r).cast("double") for r in rules], *linear).alias("_v"))
    from pyspark.ml.functions import array_to_vector
    wide = C.table(wide).select("label", array_to_vector("_v").alias("x"))
    lr = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso, maxIter=60,
                            standardization=False).fit(wide)
    w = lr.coefficients.toArray()
    return Model(float(lr.intercept), tuple((float(x), r) for x, r in zip(w, rules) if x),
                 tuple((float(x), c, float(scales[c])) for x, c in zip(w[len(rules):], NAMES) if x))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5 == 0,
                      F.lit(False))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Only ``labels`` rows outside the held-out fold are learnt from, one per doc_id.  Rows without a doc_id or label are
    scored like all others; a null text is empty.
    """
    stats = C.table(statistics(docs))
    known = labels.where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    model = fit(stats.join(known, "doc_id"))
    return stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score")) \
                .withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text is predicted good, with all their columns; each row goes by its own text."""
    stats = C.table(statistics(docs, row=True))
    known = labels.where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    model = fit(stats.drop("_row").join(known, "doc_id"))
    bad = stats.where(model.score() < threshold).select("doc_id", "_row").distinct().alias("b")
    same = F.col("r.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("r._row") == F.col("b._row"))
    return C.unfolded(C.whole_rows(docs).alias("r").join(bad, same, "left_anti"), docs)
