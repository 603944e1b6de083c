"""Exact top-k search by columnar branch-and-bound on quantised vectors.

Candidates lie in groups in vertical layout: one array a dimension.  Dimensions
are taken in the order of the candidates' spread, BLOCK at a time.  After each
step a query's partial inner products, plus the most that the dimensions left
can add - the product of the remaining norms of query and candidate
(Cauchy-Schwarz) -, are compared with the k-th best score known so far; what
can't reach it is compacted away.  Ties at the k-th score are kept for the
smaller id, so the result is exact.

Candidates are written once and never shuffled: each task reads its own as
groups of about GROUP_BYTES.  Queries first get a bound, their k-th best score
among the SEEDS longest vectors; then they go to all tasks as broadcasts of at
most QUERY_BYTES each, one pass over the candidates for each broadcast.  A group
yields a query's k best that reach its bound, and the k best of those are the
result: per query at most k * groups rows are shuffled.

Nulls: vectors that are null or empty, or hold null or non-finite components,
take no part, nor do rows without an id.  Only vectors of a query's own length are its
candidates.  Components beyond 64 bits are cut to their limits, and so are scores;
sums beyond 2**53 are done in exact integers.  Repeated rows of one id and vector
are one query, and candidates of their own; an id with several vectors is a query
for each.  Ties go to the smaller vec_id.  Empty tables give no rows.  Only the id
and vector columns are read, so extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.shared import lean, table, written

BLOCK = 16
GROUP_BYTES = 64 << 20
QUERY_ROWS = 32
QUERY_BYTES = 16 << 20
SEEDS = 2048


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, v array<long>: floor(scale * x) of usable vectors."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
    ok = ok & (F.size("embedding") > 0) & F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return vectors.where(ok).select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _exact(queries: np.ndarray, vectors: np.ndarray) -> bool:
    """Whether all inner products are below 2**53, so that doubles hold them."""
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    return most(queries) * most(vectors) * queries.shape[1] < 2**53


def best_of(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the query, candidate id, score) of each query's k best among the candidates that reach its bound, its own id left out."""
    none = np.zeros(0, np.int64)
    if not len(ids) or not len(query_ids):
        return none, none, none
    if not _exact(queries, vectors):
        return _best_of_large(ids, vectors, query_ids, queries, bounds, k)
    columns = np.ascontiguousarray(vectors.T.astype(np.float64))
    order = np.argsort(-columns.var(axis=1), kind="stable")
    columns, queries = columns[order], queries[:, order].astype(np.float64)
    dims = len(order)
    steps = [*range(0, dims, BLOCK), dims]
    rest_c = [np.sqrt((columns[d:] ** 2).sum(0)) for d in steps]
    rest_q = [np.sqrt((queries[:, d:] ** 2).sum(1)) for d in steps]
    out, longest = [(none, none, none)], rest_c[0].max()
    for at in range(0, len(queries), QUERY_ROWS):
        first = queries[at : at + QUERY_ROWS, :BLOCK] @ columns[:BLOCK]
        for q in range(at, at + len(first)):
            bound = bounds[q]
            pad = 1e-6 + 1e-12 * rest_q[0][q] * longest  # more than the bounds' rounding
            live = np.flatnonzero((first[q - at] + rest_q[1][q] * rest_c[1] + pad >= bound) & (ids != query_ids[q]))
            sums = first[q - at][live]
            for j in range(1, len(steps) - 1):
                a, b = steps[j], steps[j + 1]
                sums = sums + queries[q, a:b] @ columns[a:b, live]
                slack = rest_q[j + 1][q] * rest_c[j + 1][live]
                if len(live) > k:
                    bound = max(bound, np.partition(sums - slack, -k)[-k] - pad)  # k candidates reach this at least
                stay = sums + slack + pad >= bound
                live, sums = live[stay], sums[stay]
            if len(live) > k:
                cut = np.partition(sums, -k)[-k]
                live, sums = live[sums >= cut], sums[sums >= cut]
            top = np.lexsort((ids[live], -sums))[:k]
            top = top[sums[top] >= bounds[q]]
            out.append((np.full(len(top), q), ids[live][top], np.rint(sums[top]).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _best_of_large(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_of() in integers of any size."""
    out = [(np.zeros(0, np.int64),) * 3]
    for q in range(len(queries)):
        score = np.clip((vectors.astype(object) * queries[q].astype(object)).sum(1), -(2**63), 2**63 - 1).astype(np.int64)
        live = np.flatnonzero((ids != query_ids[q]) & (score >= bounds[q]))
        top = np.array(sorted(live.tolist(), key=lambda i: (-int(score[i]), ids[i]))[:k], np.int64)
        out.append((np.full(len(top), q), ids[top], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _by_length(vectors: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: the rows that have it, and their components."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = vectors.value_lengths().to_numpy()
    flat, start = vectors.flatten().to_numpy(), np.cumsum(size) - size
    out = {}
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        out[n] = rows, flat[(start[rows][:, None] + np.arange(n)).ravel()].reshape(len(rows), n)
    return out


def _bounded(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query, query_id, v, bound: each query's k-th best score among the longest vectors (the least there is where they are fewer)."""
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    seeds = vectors.orderBy(norm.desc(), "vec_id").limit(SEEDS).toArrow()
    seed_ids, seed_vectors = seeds.column("vec_id").to_numpy(), _by_length(seeds.column("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy()
            bound = np.full(b.num_rows, -(2**63), np.int64)
            for n, (rows, queries) in _by_length(b.column(1)).items():
                if n in seed_vectors:
                    among, vectors = seed_vectors[n]
                    q, _, score = best_of(seed_ids[among], vectors, own[rows], queries, bound[rows], k)
                    kth = np.flatnonzero(np.bincount(q, minlength=len(rows)) == k)
                    last = np.searchsorted(q, kth, side="right") - 1
                    bound[rows[kth]] = score[last]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(bound)], ["query_id", "v", "bound"])

    found = queries.select("vec_id", "v").dropDuplicates().mapInArrow(lean(run), "query_id long, v array<long>, bound long")
    return written(found.select(F.monotonically_increasing_id().alias("query"), "query_id", "v", "bound"), "topk-queries")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of each query (vec_id, v) against all vectors (vec_id, v) but those of its own id."""
    spark = vectors.sparkSession
    vectors = written(vectors, "topk-vectors")
    asked = _bounded(queries, vectors, k)
    total = asked.agg(F.sum(24 + 8 * F.size("v").cast("long")).alias("n")).first().n or 0
    passes = -(-total // QUERY_BYTES)
    found = None
    for i in range(passes):
        some = asked.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == i).toArrow()  # about QUERY_BYTES
        shared = spark.sparkContext.broadcast((*(some.column(x).to_numpy() for x in ("query", "query_id", "bound")), _by_length(some.column("v"))))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            no, query_ids, bounds, by_length = shared.value

            def of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                rows = pa.Table.from_batches(held)
                ids = rows.column(0).to_numpy()
                for n, (own, columns) in _by_length(rows.column(1)).items():
                    if n in by_length:
                        which, asked = by_length[n]
                        q, i, s = best_of(ids[own], columns, query_ids[which], asked, bounds[which], k)
                        yield pa.RecordBatch.from_arrays([pa.array(no[which][q]), pa.array(query_ids[which][q]), pa.array(i), pa.array(s)], ["query", "query_id", "vec_id", "score"])

            held, size = [], 0
            for b in batches:
                held.append(b)
                size += b.nbytes
                if size >= GROUP_BYTES:
                    yield from of(held)
                    held, size = [], 0
            if held:
                yield from of(held)

        best = written(vectors.mapInArrow(lean(search), "query long, query_id long, vec_id long, score long"), "topk-best")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every 20th vector with all others."""
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


ORACLE_SQL = {
    "op8_topk": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM (SELECT DISTINCT vec_id, v FROM e WHERE vec_id % 20 = 0) q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
}
