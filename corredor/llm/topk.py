"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Components become integer weights floor(scale * x). Each query is a sparse row of (term, weight) entries.
A task turns its block of candidates into one posting list per term; every term's weights of a block of
queries are scattered into a dense score array (queries x candidates), term after term. Partition
selection keeps k candidates of each query and block; a merge over the blocks gives the result.

Queries travel in blocks of at most ``query_block`` rows, whose broadcast is therefore bounded; a larger
query set makes more blocks, each with a pass of its own over the candidates.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without id. A query
does not meet rows of its own id; repeated candidate rows count as rows; of repeated query ids the smallest
vector asks. Where lengths differ the shorter vector counts as padded with zeros. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of one dense score array.
CELLS = 1 << 21


def quantised(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, q): integer weights of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select("vec_id", x.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: F.floor(v * scale)).alias("q"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; longer ones are cut, shorter ones padded with zeros."""
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lens) and (lens == width).all():
        return flat.reshape(len(lens), width)
    out, at = np.zeros((len(lens), width), dtype=np.int64), 0
    for i, n in enumerate(lens):
        out[i, : min(n, width)] = flat[at : at + min(n, width)]
        at += n
    return out


def accumulate(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Dense scores (queries x rows), one term at a time over postings of non-zero weights."""
    scores = np.zeros((len(query), len(rows)), dtype=np.int64)
    for term in range(query.shape[1]):
        has, asks = np.flatnonzero(rows[:, term]), np.flatnonzero(query[:, term])
        if not len(has) or not len(asks):
            continue
        weights = np.multiply.outer(query[asks, term], rows[has, term])
        if len(has) == len(rows) and len(asks) == len(query):
            scores += weights
        else:
            scores[np.ix_(asks, has)] += weights
    return scores


def best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best scores among rows of other ids; ties to the smaller id."""
    place = np.flatnonzero(ids != own)
    if len(place) > k:
        cut = np.partition(scores[place], len(place) - k)[len(place) - k]
        place = place[scores[place] >= cut]  # all ties at the cut stay for the order by id
    return place[np.lexsort((ids[place], -scores[place]))][:k]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, query_block: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best rows of ``vectors``; both have vec_id, embedding."""
    spark = vectors.sparkSession
    rows = quantised(vectors, scale)
    asked = quantised(queries, scale).groupBy("vec_id").agg(F.min("q").alias("q"))
    blocks = -(-asked.count() // query_block)
    found = None
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        part = rows.mapInArrow(_scorer(spark, own, k), "query_id long, vec_id long, score long")
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def _scorer(spark, own: pa.Table, k: int):
    ids = own.column("vec_id").to_numpy()
    q = own.column("q").combine_chunks()
    width = int(max(np.diff(q.offsets.to_numpy()), default=0))
    shared = spark.sparkContext.broadcast((ids, _matrix(q, width)))

    def score(batches):
        query_ids, query = shared.value
        kept: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(query_ids)
        for batch in batches:
            step = max(1, CELLS // max(1, len(query_ids)))
            for lo in range(0, batch.num_rows, step):
                cut = batch.slice(lo, step)
                row_ids = cut.column(0).to_numpy()
                scores = accumulate(query, _matrix(cut.column(1), query.shape[1]))
                for i, own_id in enumerate(query_ids):
                    mine = np.concatenate([kept[i][0], row_ids]), np.concatenate([kept[i][1], scores[i]])
                    place = best(*mine, own_id, k)
                    kept[i] = mine[0][place], mine[1][place]
        n = [len(x[0]) for x in kept]
        if sum(n):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(query_ids, n)), pa.array(np.concatenate([x[0] for x in kept])), pa.array(np.concatenate([x[1] for x in kept]))],
                ["query_id", "vec_id", "score"],
            )

    return score
