"""Exact top-k search by inner product, in three phases with a uniform threshold.

Vectors are whole numbers; a score is the sum of the partial scores of two slices of the dimensions. Queries are taken in
blocks of at most BLOCK rows, which alone are broadcast; each block is answered against all rows where these lie; only if ids repeat are rows moved before, to drop copies.

1. *Gather.* Each task computes the first slice's scores of all its rows and keeps, per query, the list of its k best by them, whose
   other scores it adds. The lists are merged in two steps by query; the k-th best whole score of these is a safe cutoff: k rows reach
   it, so no row below it can be among the k best.
2. *Collect.* The block's cutoffs are broadcast. Of an entry only the first slice's score is known; by Cauchy and Schwarz the other adds no more than the
   product of the two lengths there. Entries whose bound doesn't reach the cutoff are passed over; the others are sufficient.
3. *Resolve.* The second slice's scores are computed for the sufficient entries alone (in whole blocks where these are most of the block), and
   those that reach the cutoff count. Each task returns its k best of them for each query, ties to the smaller id, so that neither ties nor a low
   cutoff make many rows.

Scores are exact: float32 products where every sum stays below 2 ** 24, float64 below 2 ** 53, whole numbers of any size otherwise (and then
held to the range of long).

Defined cases: vectors null, or holding null or non-finite components, take no part. Of vectors of unequal lengths the shorter ends in
zeros. Ties go to the smaller vec_id. A row isn't its own candidate, nor is any row with its vec_id; rows repeated in full count once. Queries with one vec_id are one question, whose candidates are ranked together. A null
vec_id takes no part. Fewer candidates than k give all. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, share, shared_dir, table, written

K, EVERY, BLOCK, GROUPS, ROWS, DENSE = 20, 20, 4096, 64, 2048, 0.05


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that are whole, and floor(64 * x) of them, shorter ones ending in zeros."""
    lists = column.to_pylist() if column.null_count or column.values.null_count else None
    if lists is not None:
        keep = [i for i, x in enumerate(lists) if x is not None and all(y is not None for y in x)]
        lists = [lists[i] for i in keep]
        sizes, flat = np.array([len(x) for x in lists], np.int64), np.array([y for x in lists for y in x], np.float64)
    else:
        offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        keep, sizes = np.arange(len(column)), np.diff(offsets)
        flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
    out = np.zeros((len(sizes), int(sizes.max()) if len(sizes) else 0))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    finite = np.isfinite(out).all(axis=1)
    return np.asarray(keep, np.int64)[finite], np.floor(out[finite] * 64)


class Slices:
    """Rows against queries: whole numbers in a type that holds every sum exactly, cut into two slices of the dimensions."""

    def __init__(self, rows: np.ndarray, queries: np.ndarray):
        d = max(rows.shape[1], queries.shape[1], 1)
        rows, queries = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (rows, queries))
        most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * d
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
        change = (lambda x: x.astype(kind)) if kind is not object else (lambda x: np.array([[int(y) for y in r] for r in x], object).reshape(x.shape))
        half = -(-d // 2)
        self.first, self.second = ((change(rows[:, at]), change(queries[:, at])) for at in (slice(0, half), slice(half, d)))
        # Lengths, a little too long, so that rounding can't make a bound too low.
        self.lengths = [np.sqrt((x[:, half:] ** 2).sum(axis=1)) * (1 + 1e-9) for x in (rows, queries)]

    def known(self) -> np.ndarray:
        """The first slice's scores of all rows and queries."""
        return self.first[0] @ self.first[1].T

    def rest(self, r: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The second slice's scores of some rows and queries."""
        x, y = self.second
        if not len(r) or not x.shape[1]:
            return np.zeros(len(r), x.dtype)
        if x.dtype == object or len(r) > DENSE * len(x) * len(y):
            return (x @ y.T)[r, q]
        out = np.empty(len(r), x.dtype)
        for i in range(0, len(r), 65_536):
            out[i : i + 65_536] = np.einsum("ij,ij->i", x[r[i : i + 65_536]], y[q[i : i + 65_536]])
        return out

    def bound(self) -> np.ndarray:
        """The most that the second slice can add."""
        return self.lengths[0][:, None] * self.lengths[1][None, :]


def _long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if x.dtype != object else np.array([min(max(int(y), -(2**63)), 2**63 - 1) for y in x.ravel()], np.int64).reshape(x.shape)


def _blocks_of_rows(batches):
    for b in batches:
        at, vectors = whole(b.column("embedding"))
        ids = b.column("vec_id").to_numpy(zero_copy_only=False)[at]
        for i in range(0, len(at), ROWS):
            yield ids[i : i + ROWS], vectors[i : i + ROWS]


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """rows and queries(vec_id, embedding) to (query_id, rank, vec_id, score)."""
    spark = rows.sparkSession
    keep = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    rows, queries = keep(rows), keep(queries)
    rows, queries = _once(rows), _once(queries)
    n = queries.count()
    blocks = max(1, -(-n * 5 // (BLOCK * 4)))
    path = f"{shared_dir(spark)}/tracelake-{uuid.uuid4().hex}"  # one table for all blocks, so that their number doesn't weigh on the plan
    written(spark, path)
    for block in range(blocks):
        ids, vectors = _collected(queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block))
        _search(spark, rows, ids, vectors, k).write.mode("append").parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _once(df: DataFrame) -> DataFrame:
    """Rows repeated in full once; they are moved only if an id repeats."""
    n, distinct = df.agg(F.count(F.lit(1)), F.count_distinct("vec_id")).first()
    return df if n == distinct else cut(df.distinct())


def _collected(own: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A block's queries; at most about BLOCK rows."""
    t = own.toArrow()
    parts = [(b.column("vec_id").to_numpy(zero_copy_only=False)[at], v) for b in t.to_batches() for at, v in [whole(b.column("embedding"))]]
    d = max([v.shape[1] for _, v in parts], default=0)
    ids = np.concatenate([i for i, _ in parts]) if parts else np.empty(0, np.int64)
    vectors = np.concatenate([np.pad(v, ((0, 0), (0, d - v.shape[1]))) for _, v in parts]) if parts else np.empty((0, 0))
    return ids.astype(np.int64), vectors


def _search(spark: SparkSession, rows: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    shared, low = share(spark, (ids, vectors)), np.iinfo(np.int64).min

    def gather(batches):
        own, queries = shared()
        best = np.full((len(own), 0), low, np.int64)
        for row_ids, x in _blocks_of_rows(batches):
            both = Slices(x, queries)
            known = both.known()
            same = own[None, :] == row_ids[:, None]
            least = known.astype(np.float64)
            least[same] = -np.inf
            m = min(k, len(row_ids))
            r = np.argpartition(least, len(row_ids) - m, axis=0)[-m:]  # the best rows of each query, by the first slice
            q = np.broadcast_to(np.arange(len(own)), r.shape)
            score = _long(known[r, q] + both.rest(r.ravel(), q.ravel()).reshape(r.shape)).T
            score[same[r, q].T] = low
            best = np.concatenate([best, score], axis=1)
            if best.shape[1] > k:
                best = np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
        if best.shape[1]:
            lists = pa.ListArray.from_arrays(np.arange(0, best.size + 1, best.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(best).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), lists], ["q", "scores"])

    best_of = F.slice(F.sort_array(F.flatten(F.collect_list("scores")), asc=False), 1, k).alias("scores")
    lists = rows.mapInArrow(gather, "q long, scores array<long>").withColumn("g", F.spark_partition_id() % GROUPS)
    merged = lists.groupBy("q", "g").agg(best_of).groupBy("q").agg(best_of)
    cutoffs = np.full(len(ids), low, np.int64)
    for r in merged.filter(F.size("scores") >= k).select("q", F.element_at("scores", k).alias("cut")).collect():
        cutoffs[r.q] = r.cut
    limits = share(spark, cutoffs)

    def collect(batches):
        own, queries = shared()
        cut = limits()
        kept = [np.empty(0, np.int64)] * 3  # query, id, score
        for row_ids, x in _blocks_of_rows(batches):
            both = Slices(x, queries)
            known = both.known()
            reach = known.astype(np.float64) + both.bound() * (1 + 1e-6) + 1
            r, q = np.nonzero((reach >= cut.astype(np.float64)[None, :]) & (row_ids[:, None] != own[None, :]))
            score = _long(known[r, q] + both.rest(r, q))
            over = score >= cut[q]
            new = q[over], row_ids[r[over]], score[over]
            kept = _best([np.concatenate(z) for z in zip(kept, new)], k)
        yield _entries(own[kept[0]], kept[1], kept[2])

    return rows.mapInArrow(collect, "query_id long, vec_id long, score long")


def _best(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of rows (query, id, score) the k of each query with the highest scores, ties to the smaller id."""
    q, v, s = rows
    order = np.lexsort((v, ~s, q))
    q = q[order]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])[: len(q)])
    turn = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
    order = order[turn < k]
    return [rows[0][order], v[order], s[order]]


def _entries(q, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (q, v, s)], ["query_id", "vec_id", "score"])


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0))


OP1_SQL = """
WITH v AS (SELECT DISTINCT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
