"""Exact cosine search of many query vectors over many vectors.

While there are few queries (``FEW``, counted first), they are sent to the tasks that scan the vectors; vectors stay where they are read, and a task
sends on the best ``k`` of each query. With more queries both sides are dealt into blocks by length and a hash of their id, and each pair of blocks is a group of bounded size: one
matrix product, of which the best ``k`` of each query go on. So neither side is broadcast, and what is
ranked at the end is ``k`` rows for each query and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VECTOR_BLOCK, QUERY_BLOCK = 8192, 1024
SALT = 17
#: Queries, and bytes of their vectors, that are sent to every task; scores that a task holds at once.
FEW, FEW_BYTES = 4096, 64 << 20
SCORES = 4_000_000


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
    """Rows in blocks of their own side, once for each block of the other side."""
    return rows.withColumn(own, F.pmod(F.xxhash64("id", F.lit(SALT)), F.col(f"{own}_blocks"))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_blocks") - 1))).select("size", "i", "j", "id", "v")


def matrices(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and unit vectors by length, of vectors that are there and hold finite numbers alone; vectors of zeros stay so."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
    flat = lists.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    for n in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero(lengths == n)
        m = values[(ends[rows] - n)[:, None] + np.arange(n)]
        fine = np.isfinite(m).all(axis=1)
        m, rows = m[fine], rows[fine]
        if len(rows):
            m /= np.maximum(np.abs(m).max(axis=1, keepdims=True, initial=0), np.finfo(float).tiny)  # so that squares stay finite
            norm = np.linalg.norm(m, axis=1, keepdims=True)
            yield ids.take(pa.array(rows)), m / np.where(norm, norm, 1)


class Best:
    """The ``k`` best of each query so far, by falling score and rising id."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.query, self.score, self.ids = np.zeros(0, dtype=np.int64), np.zeros(0), []
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def add(self, first: int, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores of queries from ``first`` on, with all of ``ids``; what isn't allowed is ``-inf``."""
        n = scores.shape[1]
        own = self.least[first : first + len(scores)]
        if n > self.k:
            own = np.maximum(own, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        q, i = np.nonzero((scores >= own[:, None]) & (scores > -np.inf))
        self.held.append((q + first, scores[q, i], ids.take(pa.array(i))))
        if sum(len(h[0]) for h in self.held) > SCORES // 4:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, pa.Array | None]:
        if not self.held:
            return self.query, self.score, None
        query, score = (np.concatenate([h[i] for h in self.held]) for i in (0, 1))
        ids = pa.concat_arrays([h[2] for h in self.held])
        place, _ = pd.factorize(ids.to_pandas(), sort=True)  # nulls are -1, and come first
        order = np.lexsort((place, -score, query))
        at = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, at = order[at < self.k], at[at < self.k]
        query, score, ids = query[order], score[order], ids.take(pa.array(order))
        self.least[query[at == self.k - 1]] = score[at == self.k - 1]
        self.held = [(query, score, ids)]
        return query, score, ids


def _scan(vectors: DataFrame, sides: list[tuple[pa.Array, np.ndarray]], asked: str, key: str, top_k: int, min_score: float | None, exclude_self: bool) -> DataFrame:
    """``(query_id, chunk_id, score)``: of each task of ``vectors(id, v)`` the best of each query. Queries, by length of their vectors, are in each task's memory."""
    sent = vectors.sparkSession.sparkContext.broadcast(sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = {m.shape[1]: (ids, m, Best(len(m), top_k)) for ids, m in sent.value}
        own = {n: {} for n in by_size}
        for n, (ids, _, _) in by_size.items() if exclude_self else ():
            for i, x in enumerate(ids.to_pylist()):
                own[n].setdefault(x, []).append(i)
        for batch in batches:
            for ids, m in matrices(batch.column(0), batch.column(1)):
                if m.shape[1] not in by_size:
                    continue
                _, asking, best = by_size[m.shape[1]]
                places = [(i, q) for i, x in enumerate(ids.to_pylist()) for q in own[m.shape[1]].get(x, ())] if exclude_self else []
                some = max(1, SCORES // len(m))
                for first in range(0, len(asking), some):
                    scores = np.round(asking[first : first + some] @ m.T, 6)
                    if min_score is not None:
                        scores[scores <= min_score] = -np.inf
                    for i, q in places:
                        if first <= q < first + len(scores):
                            scores[q - first, i] = -np.inf
                    best.add(first, scores, ids)
        for asking, _, best in by_size.values():
            query, score, ids = best.settle()
            if ids is not None and len(query):
                yield pa.RecordBatch.from_arrays([asking.take(pa.array(query)), ids, pa.array(score)], names=["query_id", "chunk_id", "score"])

    return vectors.mapInArrow(run, f"query_id {asked}, chunk_id {key}, score double")


def search(vectors: DataFrame, queries: DataFrame, top_k: int = 10, min_score: float | None = 0.0, id_col: str = "chunk_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """``(query_id, chunk_id, score, rank)`` by cosine to six places, equals by chunk id; only scores above ``min_score``, if one is
    set. Vectors that are null or hold null or non-finite components take no part, on either side; a query is compared with vectors of its own length; vectors
    of zeros score zero. ``exclude_self`` leaves out chunks with the query's id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
    pair = lambda df, key, v: df.select(F.col(key).alias("id"), F.col(v).alias("v"))
    key, asked = vectors.select(id_col).dtypes[0][1], queries.select(query_id).dtypes[0][1]
    few = pair(queries, query_id, query_vector).limit(FEW + 1).toArrow()
    if len(few) <= FEW and few.nbytes <= FEW_BYTES:
        sides = [*matrices(few.column(0).combine_chunks(), few.column(1))] if len(few) else []
        return ranked(_scan(pair(vectors, id_col, vector_col), sides, asked, key, top_k, min_score, exclude_self))
    side = lambda df, key, v: pair(df, key, v).withColumn("v", F.col("v").cast("array<double>")).where(usable(F.col("v"))).withColumn("size", F.size("v"))
    left, right = side(vectors, id_col, vector_col), side(queries, query_id, query_vector)
    count = lambda df, name, block: df.groupBy("size").agg(F.ceil(F.count(F.lit(1)) / block).alias(name))
    blocks = count(left, "i_blocks", VECTOR_BLOCK).join(count(right, "j_blocks", QUERY_BLOCK), "size")

    def best(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if x.empty or q.empty:
            return pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        a, b = np.stack(x["v"].to_numpy()), np.stack(q["v"].to_numpy())
        for m in (a, b):
            m /= np.maximum(np.abs(m).max(axis=1, keepdims=True), np.finfo(float).tiny)  # so that squares stay finite
            length = np.linalg.norm(m, axis=1, keepdims=True)
            m /= np.where(length, length, 1)
        scores = np.round(b @ a.T, 6)
        ids, asking = x["id"].to_numpy(), q["id"].to_numpy()
        allowed = scores > (-np.inf if min_score is None else min_score)
        if exclude_self:
            allowed &= asking[:, None] != ids[None, :]
        scores[~allowed] = -np.inf
        k = min(top_k, len(ids))
        least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        i, j = np.nonzero(allowed & (scores >= least[:, None]))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1][j], -scores[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[place < k], j[place < k]
        return pd.DataFrame({"query_id": asking[i], "chunk_id": ids[j], "score": scores[i, j]})

    pairs = _dealt(left.join(blocks, "size"), "i", "j").groupBy("size", "i", "j").cogroup(_dealt(right.join(blocks, "size"), "j", "i").groupBy("size", "i", "j"))
    return ranked(pairs.applyInPandas(best, f"query_id {asked}, chunk_id {key}, score double"))


def search_within(vectors: DataFrame, queries: DataFrame, filters: dict, top_k: int = 5, **names) -> DataFrame:
    """Filters on the vectors' columns first, then cosine without a least score."""
    kept = vectors
    for column, value in filters.items():
        kept = kept.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column).eqNullSafe(value))
    return search(kept, queries, top_k, None, **names)


def similar(vectors: DataFrame, of: DataFrame, top_k: int = 5, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The ``top_k`` chunks most like each chunk of ``of``, itself left out."""
    return search(vectors, of, top_k, None, id_col, vector_col, id_col, vector_col, exclude_self=True)
