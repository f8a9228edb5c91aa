"""Operator 6, exact top-k inner products by a three-phase uniform threshold.

A score is the sum of the entries that ``LISTS`` groups of dimensions have for a pair. Phase one: in every block of rows each list names
a query's best rows by its own entries; these few are resolved exactly, and the k-th best score of a query over all blocks is a safe
cutoff, as at least k rows reach it. Phase two: the cutoff is shared uniformly among the lists. Where a score reaches the cutoff, one of its
entries at least reaches its share, so a list sends on the entries at or above the share, unless even the greatest rest that the vectors' lengths
allow is too little. Phase three: what the other lists have for these pairs is added, and a block sends on the best k of those that
reach the cutoff. Queries and rows meet in blocks of bounded size; cutoffs travel with their query block, so nothing that grows with the
data is broadcast or brought to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stash, table

#: Groups of dimensions; most rows and queries of a block.
LISTS, ROWS, QUERIES = 4, 65_536, 8_192
#: Blocks of rows that are made of smaller tables, too, for as many tasks, and the rows that a block has at least.
SPREAD, FEW = 16, 4_096
#: Scores held at once by a task, as 4- or 8-byte numbers.
HELD = 1 << 21
#: The cutoff of a query with fewer than k rows.
NONE = -(1 << 62)


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v = floor(64 * x) of every component; vectors null, empty of id, or with a null or non-finite component are left out."""
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(good).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)).alias("v"))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False)).reshape(len(lists), dim)


def exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as float32 or float64 while every sum of products fits, else as 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most >= 2.0**62:
        raise OverflowError("scores of these vectors do not fit a 64-bit integer")
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return q.astype(kind), x.astype(kind)


def _some(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (i, j), some at a time."""
    out, step = np.empty(len(i), np.int64), max(1, HELD // max(1, q.shape[1]))
    for at in range(0, len(i), step):
        out[at : at + step] = (q[i[at : at + step]] * x[j[at : at + step]]).sum(1)
    return out


def lists(dim: int) -> list[slice]:
    """The groups of dimensions; vectors without any have one empty group."""
    edges = np.linspace(0, dim, min(LISTS, max(1, dim)) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def local_lists(q: np.ndarray, x: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase one: (query, row, score) of the rows that are among the ``many`` best of a list, each once."""
    many, named = min(many, len(x)), []
    for at in lists(q.shape[1]):
        best = np.argpartition(q[:, at] @ x[:, at].T, len(x) - many, axis=1)[:, len(x) - many :]
        named.append((np.arange(len(q))[:, None] * len(x) + best).ravel())
    i, j = np.divmod(np.unique(np.concatenate(named)), len(x))
    return i, j, _some(q, x, i, j)


def sufficient(q: np.ndarray, x: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases two and three: (query, row, score) of all pairs that reach the query's cutoff, and how many were sent on by a list."""
    groups, kind = lists(q.shape[1]), np.float32 if q.dtype == np.float32 else np.float64
    share = np.ceil(cutoff / len(groups)) - (0 if kind == np.float32 else 1 + np.abs(cutoff) * 1e-15)  # what rounding of large numbers can cost
    eps = 1e-5 if kind == np.float32 else 1e-9
    low = np.maximum(cutoff - np.abs(cutoff) * eps - 4, -(2.0**62)).astype(kind)
    squares = lambda a: a.astype(np.float64) ** 2
    q2, x2 = squares(q), squares(x)
    sent, total = np.zeros((len(q), len(x)), bool), np.zeros((len(q), len(x)), q.dtype)
    for at in groups:
        entries = q[:, at] @ x[:, at].T
        rest = lambda a, at=at: np.sqrt(np.maximum(a.sum(1) - a[:, at].sum(1), 0)) * (1 + eps)
        sent |= (entries >= share[:, None].astype(kind)) & (entries >= low[:, None] - rest(q2).astype(kind)[:, None] * rest(x2).astype(kind))
        total += entries
    i, j = np.nonzero(sent)
    score = total[i, j].astype(np.int64)
    keep = score >= (cutoff if kind == np.float32 else low)[i]  # a large cutoff may have been rounded up
    return i[keep], j[keep], score[keep], len(i)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of every query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    new = np.flatnonzero(np.diff(query[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order)))) < k]


def _pairs(k: int, with_cutoff: bool):
    """Scores a block of queries against a block of rows; without cutoffs phase one, with them phases two and three."""
    names = ["query_id", "vec_id", "score"]

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list[np.ndarray]] = {n: [np.zeros(0, np.int64)] for n in names}
        if queries.num_rows and rows.num_rows:
            lengths = np.asarray(pa.compute.list_value_length(rows.column("v")))
            q_lengths = np.asarray(pa.compute.list_value_length(queries.column("v")))
            for dim in np.unique(q_lengths):  # vectors of unlike length have no inner product
                qs, xs = queries.filter(pa.array(q_lengths == dim)), rows.filter(pa.array(lengths == dim))
                if xs.num_rows:
                    score(qs, xs, int(dim), out)
        return pa.table({n: np.concatenate(out[n]) for n in names})

    def score(queries: pa.Table, rows: pa.Table, dim: int, out: dict) -> None:
        q_ids, x_ids = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
        q, x = exact(*(_matrix(t.column("v").combine_chunks(), dim) for t in (queries, rows)))
        cutoff = queries.column("cutoff").to_numpy() if with_cutoff else None
        step = max(1, HELD // len(x_ids))
        for at in range(0, len(q_ids), step):
            # a list of phase one takes one more, as the query itself may be among them
            i, j, total = sufficient(q[at : at + step], x, cutoff[at : at + step])[:3] if with_cutoff else local_lists(q[at : at + step], x, k + 1)
            keep = np.flatnonzero(q_ids[at + i] != x_ids[j])
            keep = keep[_best(i[keep], x_ids[j[keep]], total[keep], k)]
            for name, values in zip(names, (q_ids[at + i[keep]], x_ids[j[keep]], total[keep])):
                out[name].append(values)

    return run


def _blocks(key: str, rows: int, salt: int):
    return F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(rows)).cast("int")


def _narrow(df: DataFrame) -> tuple[DataFrame, int]:
    """Vectors as 16-bit integers if all fit, and the number of rows."""
    n, most = df.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    return (df.withColumn("v", F.col("v").cast("array<smallint>")) if (most or 0) < 1 << 15 else df), n


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """For every row of ``queries(vec_id, embedding)`` its k best rows of ``vectors(vec_id, embedding)``: query_id, rank, vec_id, score.

    A row never answers itself (its own vec_id); ties go to the smaller vec_id; fewer rows give fewer answers. Vectors that are
    null or have null or non-finite components, and null ids, take no part; vectors of another length than the query's do not
    answer it, and empty vectors score 0 with each other. A vec_id that is repeated with equal vectors counts once; with unlike vectors
    each is an answer of its own, and the answers of query rows of one id are ranked together. Other columns are ignored; empty tables give no rows.
    """
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("query_id", "vec_id", "score")])
    (x, n), (q, m) = _narrow(stash(quantised(vectors).distinct(), "vectors")), _narrow(stash(quantised(queries).distinct(), "queries"))
    row_blocks, query_blocks = max(1, -(-n // ROWS), min(SPREAD, n // FEW)), max(1, -(-m // QUERIES))
    # every block of queries meets every block of rows once, each in a group of its own
    dealt = x.withColumn("r", _blocks("vec_id", row_blocks, 1)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = q.withColumn("c", _blocks("vec_id", query_blocks, 2))
    to_all = lambda d: d.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    first = to_all(asked).groupBy("r", "c").cogroup(dealt.groupBy("r", "c")).applyInArrow(_pairs(k, False), schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count("*").alias("n"))
    # fewer than k answers are known: nothing may be cut
    least = kth.where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("cutoff").cast("double").alias("cutoff"))
    asked = stash(asked.join(least, "vec_id", "left").fillna({"cutoff": float(NONE)}), "cutoffs")
    full = to_all(asked).groupBy("r", "c").cogroup(dealt.groupBy("r", "c")).applyInArrow(_pairs(k, True), schema)
    ranked = full.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score: the 20 best of all ``embeddings`` for every one whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
