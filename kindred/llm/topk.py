"""Operator 9, exact top-k inner products by term-at-a-time accumulation.

Blocks of queries meet blocks of candidates, each pair in one group of bounded size. There each nonzero component (term) of a
query row scatters its weight times the term's postings into a dense array of scores; a partition selection keeps the best, and
the blocks' lists are merged. Ties go to the smaller id; a repeated id is a candidate each time, and asks once.
Null vectors and ids and vectors with null or non-finite components take no part; vectors of other lengths score over the
components that both have. An id never matches itself. Quantised components are held to the range of a long; sums that could
pass 64 bits are added up in whole numbers of any size, and scores are held to the range of a long before they are ranked. Other
columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.plans.store import materialize

LONG = (1 << 63) - 1


def quantised(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    fine = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.col("vec_id").isNotNull()
    return vectors.filter(fine).select("vec_id", F.transform(x, lambda v: F.floor(v.cast("double") * 1024).cast("long")).alias("x"))


def columns_of(x: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """(terms, rows) of the lists in the given rows, missing components 0."""
    lists = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    lists = lists.take(pa.array(rows))
    lengths, values = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten().to_numpy()
    wide = int(lengths.max(initial=0))
    if (lengths == wide).all():
        return np.ascontiguousarray(values.reshape(len(rows), wide).T)
    out = np.zeros((wide, len(rows)), np.int64)
    row = np.repeat(np.arange(len(rows)), lengths)
    out[np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths), row] = values
    return out


def scores(query: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The dense array of scores, term by term. Whole numbers of Python where the query is of them."""
    out = np.zeros(n, query.dtype)
    for term in np.nonzero(query[: len(postings)])[0]:
        rows, weights = postings[term]
        if len(rows) == n:
            out += query[term] * weights
        else:
            out[rows] += query[term] * weights
    return out if out.dtype != object else np.clip(out, -LONG - 1, LONG).astype(np.int64)


def best_of(table: pa.Table, k: int) -> pa.Table:
    """Rows (vec_id, x, q) of a block of queries (q) and one of candidates -> query_id, vec_id, score: each query's best k here."""
    is_q, ids = table.column("q").to_numpy(), table.column("vec_id").to_numpy()
    asked, c = np.nonzero(is_q)[0], np.nonzero(~is_q)[0]
    cid, weights, queries = ids[c], columns_of(table.column("x"), c), columns_of(table.column("x"), asked)
    bound = lambda m: max(-int(m.min(initial=0)), int(m.max(initial=0)))
    if bound(weights) * bound(queries) * max(1, len(weights)) > LONG:
        weights, queries = weights.astype(object), queries.astype(object)
    postings = [(at, row[at]) for row in weights for at in (np.nonzero(row)[0],)]
    found: list[list[np.ndarray]] = [[], [], []]
    for i, query in zip(asked, queries.T):
        s = scores(query, postings, len(c))
        keep = np.nonzero(cid != ids[i])[0]
        if len(keep) > k:
            least = np.partition(s[keep], len(keep) - k)[len(keep) - k]
            keep = keep[s[keep] >= least]
        keep = keep[np.lexsort((cid[keep], ~s[keep]))[:k]]
        for to, v in zip(found, (np.full(len(keep), ids[i]), cid[keep], s[keep])):
            to.append(v)
    return pa.table({name: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64()) for name, v in zip(("query_id", "vec_id", "score"), found)})


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, block: int = 8192, asked: int = 1024) -> DataFrame:
    """(vec_id, x) twice -> query_id, rank, vec_id, score."""
    long = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    candidates, queries = materialize(long(candidates)), materialize(long(queries).dropDuplicates(["vec_id"]))
    n, m = max(1, -(-candidates.count() // block)), max(1, -(-queries.count() // asked))
    own = lambda of: F.pmod(F.xxhash64("vec_id", "x"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    rows = candidates.select("vec_id", "x", own(n).alias("b"), every(m).alias("a"), F.lit(False).alias("q")).union(queries.select("vec_id", "x", every(n).alias("b"), own(m).alias("a"), F.lit(True).alias("q")))
    best = rows.groupBy("a", "b").applyInArrow(lambda t: best_of(t, k), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(rows.filter("vec_id % 100 = 0"), rows)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
