"""Embedding near-dedup: coarse inverted lists, product-quantised residuals, table-lookup distances, exact rerank.

Every vector is in the list of its nearest centre, with the codes of its residual.  As a query it probes each list whose
region comes within a slack of it, measured to the plane half-way to the nearest centre.  Of two vectors on both sides of
such a plane the nearer one has at most half their distance across it, so it is enough that one of the two probes the
other's list: the slack is half of what one side alone would need.  A pair that only one side finds counts for both.  Lists and their queries are cut
into blocks, and a task compares one block with one block: asymmetric distances from tables of the query's subspaces drop
what is surely too far (a code's own error is known), and the rest is decided by the exact cosine in double precision.
A block pair returns a count per query and the edges of its connected parts, never its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common as C
from .links import components

COSINE = 0.95
FIT_ROWS = 20_000
LIST_ROWS = 50
MOST_LISTS = 2_048
BLOCK = 512
SUBSPACE = 8
CODES = 256


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres ** 2).sum(1) / 2
    return np.concatenate([(x[i:i + 2048] @ centres.T - half).argmax(1) for i in range(0, len(x), 2048)]
                          or [np.zeros(0, np.int64)])


def _means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Plain k-means; centres without rows stay where they are."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        order = np.argsort(at, kind="stable")
        ids, first = np.unique(at[order], return_index=True)
        centres[ids] = np.add.reduceat(x[order], first) / np.diff(np.r_[first, len(x)])[:, None]
    return centres


class Index:
    """Coarse centres and subspace codebooks, fitted on a bounded sample of unit vectors; a few MB at most."""

    def __init__(self, sample: np.ndarray, lists: int):
        sample = np.ascontiguousarray(sample, np.float32)
        self.centres = _means(sample, max(1, lists), 8, 1)
        rest = sample - self.centres[_nearest(sample, self.centres)]
        dims = sample.shape[1]
        self.cuts = [*range(0, dims, SUBSPACE), dims]
        self.books = [_means(np.ascontiguousarray(rest[:, a:b]), CODES, 6, 2 + a) for a, b in zip(self.cuts, self.cuts[1:])]
        gaps = ((self.centres[:, None, :] - self.centres[None, :, :]) ** 2).sum(-1) if len(self.centres) <= 256 else None
        if gaps is None:
            sq = (self.centres ** 2).sum(1)
            gaps = sq[:, None] + sq[None, :] - 2 * self.centres @ self.centres.T
        self.gaps = np.sqrt(np.maximum(gaps, 1e-12))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and reconstruction error of unit vectors."""
        at = _nearest(x, self.centres)
        rest = x - self.centres[at]
        codes = np.stack([_nearest(np.ascontiguousarray(rest[:, a:b]), book)
                          for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], 1).astype(np.uint8)
        near = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], 1)
        return at, codes, np.sqrt(((rest - near) ** 2).sum(1))

    def probes(self, x: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every list whose half-space border lies within ``slack`` of the row."""
        d = (self.centres ** 2).sum(1)[None, :] - 2 * x @ self.centres.T
        at = d.argmin(1)
        border = (d - d[np.arange(len(x)), at][:, None]) / (2 * self.gaps[at])
        return np.nonzero(border <= slack)

    def close(self, queries: np.ndarray, list_no: int, codes: np.ndarray, errors: np.ndarray, radius: float) -> np.ndarray:
        """Mask of pairs that may lie within ``radius``: table-lookup distance, less the code's error."""
        rest = queries - self.centres[list_no]
        total = np.zeros((len(queries), len(codes)), np.float32)
        for m, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            part, book = rest[:, a:b], self.books[m]
            lookup = (part ** 2).sum(1)[:, None] + (book ** 2).sum(1)[None, :] - 2 * part @ book.T
            total += lookup[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0)) <= radius + errors[None, :] + 1e-3


def _units(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _compare(index: Index, cosine: float, radius: float, cell: pd.DataFrame) -> pd.DataFrame:
    q, d = cell[cell.is_query], cell[~cell.is_query]
    empty = pd.DataFrame({"rid": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "peer": pd.Series(dtype="int64")})
    if not len(q) or not len(d):
        return empty
    own = int(cell.list.iloc[0])
    x, y = _units(q.vec.tolist()), _units(d.vec.tolist())
    codes = np.frombuffer(b"".join(d.code), np.uint8).reshape(len(d), -1)
    maybe = index.close(x.astype(np.float32), own, codes, d.err.to_numpy(np.float32), radius)
    i, j = np.nonzero(maybe)
    exact = np.concatenate([np.einsum("ij,ij->i", x[i[k:k + 65536]], y[j[k:k + 65536]])
                            for k in range(0, len(i), 65536)] or [np.zeros(0)])
    qid, did = q.rid.to_numpy(np.int64), d.rid.to_numpy(np.int64)
    ok = (exact >= cosine) & (qid[i] != did[j])
    i, j = i[ok], j[ok]
    if not len(i):
        return empty
    n = np.bincount(i, minlength=len(q))
    # the other side finds the pair by itself if it is in the same list or probes the query's
    homes, base = q.home.to_numpy(np.int64), np.int64(len(index.centres))
    reach = [np.frombuffer(r, "<i4") for r in d.reach]
    seeks = np.repeat(np.arange(len(d)), [len(r) for r in reach]) * base + np.concatenate(reach)
    alone = (homes[i] != own) & ~np.isin(j * base + homes[i], seeks)
    m = np.bincount(j[alone], minlength=len(d))
    a, b = qid.copy(), did.copy()  # the smallest id met through links of this cell
    while True:
        before = a.copy(), b.copy()
        np.minimum.at(a, i, b[j])
        np.minimum.at(b, j, a[i])
        if (a == before[0]).all() and (b == before[1]).all():
            break
    on, there = n > 0, np.bincount(j, minlength=len(d)) > 0
    return pd.DataFrame({"rid": np.r_[qid[on], did[there]], "n": np.r_[n[on], m[there]],
                         "peer": np.r_[a[on], b[there]]})


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                 fit_rows: int = FIT_ROWS, list_rows: int = LIST_ROWS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, zero, or hold null or non-finite components, or have another length than most, link with
    nothing.  Rows with one id are vectors of their own.  The index is fitted on at most ``fit_rows`` vectors, the least by
    a hash; every vector is in it.  Slack of probing: half of the linking distance times 4 / sqrt(dimensions), or of all of
    it; a pair is missed only if it lies further across a plane than four deviations of a random direction.  Other columns
    are not read.
    """
    spark = C.prepare(rows.sparkSession)
    as_double = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    whole = F.forall(as_double, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) \
        & F.exists(as_double, lambda v: v != 0)
    held = C.table(rows.select(F.col(id_col).alias("vec_id"), as_double.alias("v"), F.coalesce(whole, F.lit(False)).alias("ok"))
                   .withColumn("rid", F.monotonically_increasing_id()))
    common = held.where("ok").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return held.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    dims, many = common["n"], common["count"]
    good = held.where(F.col("ok") & (F.size("v") == dims)).select("rid", "v")
    sample = np.array([r["v"] for r in good.orderBy(F.xxhash64("rid"), "rid").limit(fit_rows).select("v").collect()])
    scale = np.abs(sample).max(1)[:, None]
    sample = sample / scale
    sample = sample / np.sqrt((sample ** 2).sum(1))[:, None]
    index = spark.sparkContext.broadcast(Index(sample, min(MOST_LISTS, many // list_rows)))
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    slack = radius * min(1.0, 4 / math.sqrt(dims)) / 2

    def assign(batch: pa.RecordBatch):
        n = batch.num_rows
        if not n:
            return
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
        x = x / np.abs(x).max(1)[:, None]
        unit = (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)
        at, codes, errors = index.value.encode(unit)
        row, lists = index.value.probes(unit, slack)
        take = np.r_[np.arange(n), row]
        ends = np.searchsorted(row, np.arange(n + 1)).tolist()
        reach, low = lists.astype("<i4").tobytes(), ends[:-1]
        raw = [v.tobytes() for v in x.astype("<f8")]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[at, lists].astype(np.int32)), pa.array(np.r_[np.zeros(n, bool), np.ones(len(row), bool)]),
             batch.column("rid").take(pa.array(take)), pa.array([raw[k] for k in take], pa.binary()),
             pa.array([c.tobytes() for c in codes] + [None] * len(row), pa.binary()),
             pa.array(np.r_[errors, np.zeros(len(row))].astype(np.float64)), pa.array(at[take].astype(np.int32)),
             pa.array([reach[a * 4:b * 4] for a, b in zip(low, ends[1:])] + [None] * len(row), pa.binary())],
            names=["list", "is_query", "rid", "vec", "code", "err", "home", "reach"])
    entries = C.table(C.by_arrow(good, assign, "list int, is_query boolean, rid long, vec binary, code binary, err double, "
                                               "home int, reach binary"))
    # blocks of queries and of rows in each list: one small row a list
    sizes = C.table(entries.groupBy("list").agg(*[F.greatest(F.ceil(F.count_if(side) / block), F.lit(1)).cast("int").alias(name)
                                                  for name, side in (("_q", F.col("is_query")), ("_d", ~F.col("is_query")))]))
    both = entries.join(sizes, "list")
    own = F.pmod(F.xxhash64("rid"), F.when(F.col("is_query"), F.col("_q")).otherwise(F.col("_d"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("is_query"), F.col("_d")).otherwise(F.col("_q")) - 1))
    cells = both.withColumn("_own", own).withColumn("_other", other) \
        .withColumn("qb", F.when(F.col("is_query"), F.col("_own")).otherwise(F.col("_other"))) \
        .withColumn("db", F.when(F.col("is_query"), F.col("_other")).otherwise(F.col("_own"))) \
        .select("list", "qb", "db", "is_query", "rid", "vec", "code", "err", "home", "reach")
    found = C.table(cells.groupBy("list", "qb", "db").applyInPandas(
        lambda cell: _compare(index.value, cosine, radius, cell), "rid long, n long, peer long"))
    links = found.groupBy("rid").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("rid").alias("a"), F.col("peer").alias("b")))
    named = held.select("rid", "vec_id").join(links, "rid", "left").join(groups.withColumnRenamed("id", "rid"), "rid", "left") \
                .withColumn("component", F.coalesce("component", "rid"))
    named = C.table(named)
    smallest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return named.join(smallest, "component").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


#: DuckDB twin of the query: all pairs in double precision, groups by walking the links.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT vec_id, x FROM v
  WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) c USING (vec_id)
"""
