"""Approximate nearest neighbours by inner product: multi-index hashing of learned binary codes.

Vectors are stretched to one length with an extra component, which turns the largest inner product
into the smallest angle. A rotation of the centred vectors is learned from a sample of at most ``SAMPLE`` rows (iterative
quantisation: signs and the best rotation onto them by turns); further rotations of it give longer
codes. Every row gets a code of ``bits`` bits, split into substrings of ``SUBSTRING`` bits.

Rows are dealt into blocks of about ``INDEX_BLOCK`` rows by id, queries into blocks of about ``QUERY_BLOCK``, and each
pair of blocks is a unit of work, so nothing is broadcast and no unit grows. Within a unit each
substring is indexed: the block's rows sorted by its value. By the pigeonhole principle a code
within radius ``r`` of a query's differs by at most ``r // m`` bits in one of its ``m`` substrings, so the probe of
each substring's values that near finds every code within ``r``; those are compared bit by bit and the
ones within ``r`` reranked by the original vectors in double precision. A unit sends on the best ``k``
of each query.

The radius is learned too: the one that held ``COVER`` of the sample's true neighbours, measured with sample rows
as queries. A query for which fewer than ``k`` rows lie within it compares with all rows of the unit.

Defined cases: vectors that are null, zero or hold null or non-finite components and rows without an id take no part; vectors are
compared with those of their own length, each length with codes of its own; ties go to the smaller id; rows with a query's own id aren't its
candidates; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .embeddings import usable

SAMPLE = 4000
ROTATIONS = 4
SUBSTRING = 8
COVER = 0.97
INDEX_BLOCK = 8192
QUERY_BLOCK = 16384
SEED = 31


def stretched(x: np.ndarray, longest: float) -> np.ndarray:
    """All of one length; ``longest`` is the greatest length there is."""
    more = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    return np.concatenate([x, more[:, None]], axis=1) / longest


def learn_rotation(x: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Iterative quantisation: the rotation that brings vectors nearest to the corners of a cube."""
    rng = np.random.default_rng(SEED)
    r, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
        r = (u @ v).T
    return r


class Coder:
    """Learned from a sample of vectors: mean, rotations and radius."""

    def __init__(self, sample: np.ndarray, longest: float, k: int):
        self.longest = longest
        x = stretched(sample, longest)
        self.mean = x.mean(axis=0)
        first = learn_rotation(x - self.mean)
        rng = np.random.default_rng(SEED + 1)
        turns = [np.eye(first.shape[0])] + [np.linalg.qr(rng.standard_normal(first.shape))[0] for _ in range(ROTATIONS - 1)]
        planes = first @ np.concatenate(turns, axis=1)
        self.planes = planes[:, : planes.shape[1] // SUBSTRING * SUBSTRING]
        self.radius = self._radius(sample, k)

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = np.concatenate([x / self.longest, np.zeros((len(x), 1))], axis=1) if query else stretched(x, self.longest)
        return np.packbits((x if query else x - self.mean) @ self.planes > (self.mean @ self.planes if query else 0), axis=1)

    def _radius(self, sample: np.ndarray, k: int) -> int:
        if len(sample) < 2:
            return 8 * self.planes.shape[1]
        queries = sample[:: max(1, len(sample) // 400)]
        scores = queries @ sample.T
        scores[np.arange(len(queries)), np.arange(0, len(sample), max(1, len(sample) // 400))] = -np.inf
        n = min(k, len(sample) - 1)
        near = np.argpartition(-scores, n - 1, axis=1)[:, :n]
        a, b = self.codes(queries, True), self.codes(sample)
        away = hamming(a, b)[np.arange(len(queries))[:, None], near]
        return int(np.quantile(away, COVER))


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pad = -a.shape[1] % 8
    wide_a, wide_b = (np.pad(x, ((0, 0), (0, pad))).copy().view(np.uint64) for x in (a, b))
    out = np.zeros((len(a), len(b)), dtype=np.uint16)
    for k in range(wide_a.shape[1]):
        out += np.bitwise_count(wide_a[:, k][:, None] ^ wide_b[:, k][None, :])
    return out


@lru_cache(maxsize=16)
def values_within(radius: int) -> np.ndarray:
    """Differences of at most ``radius`` bits between two values of a substring."""
    x = np.arange(1 << SUBSTRING, dtype=np.uint16)
    return x[np.bitwise_count(x) <= radius]


class Index:
    """The substrings of a block's codes, each with its rows sorted by value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.starts = [np.searchsorted(c[o], np.arange(257)).tolist() for c, o in zip(codes.T, self.order)]
        self.probed: dict[tuple[int, int, int], np.ndarray] = {}

    def probe(self, j: int, value: int, radius: int) -> np.ndarray:
        """Which rows have a value within the radius in substring ``j``; queries that share it share the answer."""
        if (found := self.probed.get((j, value, radius))) is None:
            order, starts = self.order[j], self.starts[j]
            found = np.zeros(len(self.codes), dtype=bool)
            found[np.concatenate([order[starts[v] : starts[v + 1]] for v in (values_within(radius) ^ value).tolist()])] = True
            self.probed[j, value, radius] = found
        return found

    def near(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows of all codes within the radius."""
        found = np.zeros(len(self.codes), dtype=bool)
        for j, value in enumerate(code.tolist()):
            found |= self.probe(j, value, radius // len(code))
        rows = np.flatnonzero(found)
        return rows[hamming(code[None, :], self.codes[rows])[0] <= radius]


def search_block(coder: Coder, index_ids: np.ndarray, index_rows: np.ndarray, x: np.ndarray, query_rows: np.ndarray, q: np.ndarray, k: int):
    """``(query row, id, row, score)`` of the best ``k`` of the block for each query; a row isn't its own neighbour."""
    index, codes = Index(coder.codes(x)), coder.codes(q, query=True)
    rough = (x / coder.longest).astype(np.float32)
    rough_q = (q / np.sqrt((q * q).sum(axis=1, keepdims=True))).astype(np.float32)
    for own, vector, direction, code in zip(query_rows.tolist(), q, rough_q, codes):
        rows = index.near(code, coder.radius)
        rows = rows[index_rows[rows] != own]
        if len(rows) < k:
            rows = np.flatnonzero(index_rows != own)
        if len(rows) > 2 * k:  # double precision settles the order; this leaves room for single precision's rounding
            scores = rough[rows] @ direction
            rows = rows[scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - 1e-5]
        scores = (x[rows] * vector).sum(axis=1)
        best = np.lexsort((index_rows[rows], index_ids[rows], -scores))[:k]
        yield np.full(len(best), own), index_ids[rows[best]], index_rows[rows[best]], scores[best]


def search(embeddings: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """``(query_id, rank, <id>, score)`` for the rows where ``is_query`` holds, against all other rows. Rows are numbered when they are stored, as ids may repeat: each
    query row has a list of its own, and another row with its id is a candidate."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("is_query"))
    rows = storage.keep(rows.where(usable(F.col("vector")) & F.col("id").isNotNull()).withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())
    found = [_search(rows.where(F.size("vector") == n), n, k) for n in lengths]
    if not found:
        return embeddings.select(F.lit(0).cast("long").alias("query_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias(id_col), F.lit(0.0).alias("score")).limit(0)
    return reduce(DataFrame.union, found).withColumnRenamed("id", id_col)


def _search(rows: DataFrame, length: int, k: int) -> DataFrame:
    """``rows``: ``id, vector, is_query``, vectors of one length."""
    picked = rows.select("vector").orderBy(F.xxhash64("id")).limit(SAMPLE).toPandas()["vector"].tolist()  # bounded
    squares = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("is_query", F.lit(False))).alias("q"), F.sqrt(F.max(squares)).alias("longest")).first()
    coder = Coder(np.array(picked, dtype=np.float64), stats["longest"] * (1 + 1e-12), k)
    index_blocks, query_blocks = max(1, -(-stats["n"] // INDEX_BLOCK)), max(1, -(-stats["q"] // QUERY_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(held):
            table = pa.Table.from_batches(held).combine_chunks()
            ids, numbers, query = (table.column(c).to_numpy() for c in ("id", "row", "query"))
            flat = table.column("vector").chunk(0).flatten().to_numpy(zero_copy_only=False)
            x = flat.astype(np.float64).reshape(len(ids), length)
            if query.all() or not query.any():
                return
            parts = [*zip(*search_block(coder, ids[~query], numbers[~query], x[~query], numbers[query], x[query], k))]
            columns = [np.concatenate(p) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query", "id", "row", "score"])

        held, unit = [], None
        for batch in batches:
            if not len(batch):
                continue
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            cuts = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)]):
                if unit is not None and unit != (i[a], j[a]):
                    yield from work(held)
                    held = []
                unit = (i[a], j[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(held)

    block = lambda n: F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(n)).cast("int")
    columns = ["i", "j", "query", "id", "row", "vector"]
    indexed = rows.withColumns({"i": block(index_blocks), "j": F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))), "query": F.lit(False)}).select(columns)
    asked = rows.where("is_query").withColumns({"j": block(query_blocks), "i": F.explode(F.sequence(F.lit(0), F.lit(index_blocks - 1))), "query": F.lit(True)}).select(columns)
    tasks = max(index_blocks * query_blocks, 1)
    dealt = indexed.union(asked).repartition(min(tasks, 100_000), "i", "j").sortWithinPartitions("i", "j", "query")
    best = dealt.mapInArrow(run, "query long, id long, row long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score")
    return ranked.join(rows.where("is_query").select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query").select("query_id", "rank", "id", "score")
