"""Operator 7: exact top-k search by term-at-a-time accumulation.

Vectors are made of integers; a component is a term, a candidate block the postings of its terms.  Query rows, term by
term, scatter their weight times the posting weights into dense arrays of scores, one for each query of a tile.  Each
task keeps the k best of every query while it streams over its blocks; those of all tasks are then merged.

Queries go out in chunks of bounded size, one pass over the candidates for each chunk; candidates never move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK, TILE = 4096, 32
#: Bytes of query vectors that one pass broadcasts.
CHUNK_BYTES = 64 << 20


def integer_vector(col: Column, scale: int = 1024) -> Column:
    return F.transform(col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(col: Column) -> Column:
    inf = F.lit(float("inf"))
    return col.isNotNull() & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row for each list; shorter ones end in zeros, longer ones are cut: the queries have no such terms."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    start = np.cumsum(size) - size
    for i, (s, n) in enumerate(zip(start, size, strict=True)):
        n = min(n, width)
        out[i, :n] = flat[s : s + n]
    return out


def accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Scores of every query of a tile (rows) against every candidate of a block (columns)."""
    scores = np.zeros((len(queries), len(block)), np.int64)
    for t in range(queries.shape[1]):
        rows = np.flatnonzero(queries[:, t])
        posting = block[:, t]
        ids = np.flatnonzero(posting)
        if not len(rows) or not len(ids):
            continue
        if len(ids) * 2 > len(posting):
            if len(rows) == len(queries):
                scores += queries[:, t, None] * posting
            else:
                scores[rows] += queries[rows, t, None] * posting
        else:
            scores[np.ix_(rows, ids)] += queries[rows, t, None] * posting[ids]
    return scores


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) for each row of ``vectors(vec_id, embedding)`` whose vec_id ``every`` divides.

    Candidates are all rows with another vec_id.  Rows with null vec_id, null vectors and vectors with null, NaN or
    infinite components take no part; empty vectors score 0.  Of repeated vec_ids each row is a candidate and, if it
    qualifies, one of them (the smallest vector) is the query.  Scores are 64-bit; components that could
    exceed them are an error.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), integer_vector(F.col("embedding")).alias("v"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    facts = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).first()
    width = max(1, facts.w or 0)
    passes = max(1, -(-facts.n * (8 * width + 8) // chunk_bytes))
    found = None
    for p in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).toArrow()
        part = _one_pass(spark, rows, mine, width, k)
        found = part if found is None else found.unionAll(part)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one_pass(spark, rows: DataFrame, mine: pa.Table, width: int, k: int) -> DataFrame:
    mine = mine.combine_chunks().sort_by("vec_id")
    ids = mine.column(0).to_numpy().copy()
    q = _matrix(mine.column(1).combine_chunks(), width) if len(ids) else np.zeros((0, width), np.int64)
    sent = spark.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        largest = int(np.abs(q).max(initial=0))
        best_s, best_i = [np.empty((0,), np.int64)] * len(ids), [np.empty((0,), np.int64)] * len(ids)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                piece = b.slice(at, BLOCK)
                who, block = piece.column(0).to_numpy(), np.asfortranarray(_matrix(piece.column(1), width))
                if largest * int(np.abs(block).max(initial=0)) * width >= 1 << 63:
                    raise OverflowError("components too large for 64-bit scores")
                for lo in range(0, len(ids), TILE):
                    scores = accumulate(q[lo : lo + TILE], block)
                    for r, row in enumerate(scores):
                        n = lo + r
                        top = _best(row, who, k + 1)
                        top = top[who[top] != ids[n]] if (who[top] == ids[n]).any() else top
                        if len(top) < k < len(row):  # the query's own rows stood among the best
                            others = np.flatnonzero(who != ids[n])
                            top = others[_best(row[others], who[others], k)]
                        s, i = np.concatenate([best_s[n], row[top]]), np.concatenate([best_i[n], who[top]])
                        keep = _best(s, i, k)
                        best_s[n], best_i[n] = s[keep], i[keep]
        if len(ids):
            n = [len(s) for s in best_s]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n), pa.int64()), pa.array(np.concatenate(best_i), pa.int64()), pa.array(np.concatenate(best_s), pa.int64())], ["query_id", "vec_id", "score"])

    tasks = max(1, 2 * spark.sparkContext.defaultParallelism)
    return rows.coalesce(tasks).mapInArrow(run, "query_id long, vec_id long, score long")


def oracle() -> str:
    return """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
