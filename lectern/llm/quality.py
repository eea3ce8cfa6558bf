"""A quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Words are runs of letters, of digits or of other signs, hashed to ``BUCKETS`` buckets. Each bucket has a sparse random index
vector; a bucket's context vector is the sum of the index vectors of its neighbours within
``REACH`` words, over all documents. Each task sums its own matrix of whole numbers and the matrices are
added up block by block, in two steps, so the vectors are the same however the rows are split, and of a fixed size
whatever the corpus's. A document is the mean of its words' vectors, centred and brought to one length, with the
length of that mean and the logarithm of the number of words.

The network (one hidden layer, numpy) learns from at most ``TRAIN_ROWS`` labelled rows, taken in
the order of a hash of their id; a fifth of them sets the temperature that calibrates the probabilities.

Defined cases: a null text is an empty one and is scored as having no words; texts of any length are read whole, a piece at
a time, and words and pairs of words count across pieces; equal texts get equal scores; of labelled rows that share an id the
first text in order is learned from; without labelled
rows of both kinds every score is the share of label 1 (0.5 without any); a null id isn't held out; other columns are left
alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .suffix import text_bytes

BUCKETS = 1 << 14
SIZE = 64
NONZERO = 4
REACH = 2
PIECE = 1 << 19
TRAIN_ROWS = 20_000
HIDDEN = 32
EPOCHS = 40
BLOCK = 256
TEAM, SPLITS = 64, 8

_KIND = np.full(256, 3, dtype=np.uint8)  # other signs
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket's index vector isn't zero, and the signs there."""
    rng = np.random.default_rng(97)
    places = np.argsort(rng.random((BUCKETS, SIZE)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text, bucket)`` of the words of texts laid end to end, about ``PIECE`` bytes at a time; words are never cut."""
    a, last = int(offsets[0]), int(offsets[-1])
    while a < last:
        b = min(a + PIECE, last)
        end = int(offsets[np.searchsorted(offsets, b)])  # of the text that b is in
        while b < end and _KIND[data[b]] == _KIND[data[b - 1]]:  # the word that b is in ends there
            run = _KIND[data[b : min(b + PIECE, end)]] != _KIND[data[b - 1]]
            b += int(run.argmax()) if run.any() else len(run)
        kind = _KIND[data[a:b]]
        new = np.ones(b - a + 1, dtype=bool)
        new[1:-1] = kind[1:] != kind[:-1]
        first = offsets[np.searchsorted(offsets, a, side="right") : np.searchsorted(offsets, b)] - a
        new[first] = True
        edges = np.flatnonzero(new)
        starts, ends = edges[:-1], edges[1:]
        real = kind[starts] > 0
        starts, ends = starts[real], ends[real]
        hashed = hashing.run_hashes(data[a:b], starts, ends)
        yield np.searchsorted(offsets[1:], a + starts, side="right"), (hashed >> np.uint64(50)).astype(np.int64)
        a = b


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's matrix of context vectors and, as a last column, word counts, in blocks of rows."""
    places, signs = index_vectors()
    total, counts = np.zeros(BUCKETS * SIZE), np.zeros(BUCKETS, dtype=np.int64)  # whole numbers, exact below 2**53
    for batch in batches:
        before = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)  # the last words of the piece before
        for text, bucket in words(*text_bytes(batch.column(0))):
            counts += np.bincount(bucket, minlength=BUCKETS)
            held = len(before[0])
            text, bucket = np.concatenate([before[0], text]), np.concatenate([before[1], bucket])
            pairs = []
            for reach in range(1, REACH + 1):
                since = max(held - reach, 0)  # pairs with a new word
                near = text[since + reach :] == text[since : len(text) - reach]
                a, b = bucket[since : len(text) - reach][near], bucket[since + reach :][near]
                pairs += [(a, b), (b, a)]
            x, y = (np.concatenate(p) for p in zip(*pairs))
            total += np.bincount((x[:, None] * SIZE + places[y]).ravel(), weights=signs[y].ravel(), minlength=BUCKETS * SIZE)
            before = text[-REACH:], bucket[-REACH:]
    if counts.any():
        whole = np.concatenate([total.astype(np.int64).reshape(BUCKETS, SIZE), counts[:, None]], axis=1)
        for k in range(0, BUCKETS, BLOCK):
            yield pa.RecordBatch.from_pydict({"block": pa.array([k // BLOCK], pa.int32()), "team": pa.array([TaskContext.get().partitionId() // TEAM], pa.int32()), "part": pa.array([whole[k : k + BLOCK].astype("<i8").tobytes()], pa.binary())})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for *key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            x = np.frombuffer(part.as_buffer(), dtype="<i8")
            own = sums.get(tuple(key))
            sums[tuple(key)] = x if own is None else own + x
    for (block, team), x in sums.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "team": pa.array([team], pa.int32()), "part": pa.array([x.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors of all buckets (8 MiB at most, whatever the corpus). Each task sends one matrix, so a task takes up to ``SPLITS`` splits of the
    input; those of ``TEAM`` tasks are added up first, then those of all teams."""
    texts = docs.select(text_col)
    tasks = max(8 * docs.sparkSession.sparkContext.defaultParallelism, -(-texts.rdd.getNumPartitions() // SPLITS))
    schema = "block int, team int, part binary"
    teams = texts.coalesce(tasks).mapInArrow(_contexts, schema).repartition("block", "team").mapInArrow(_summed, schema)
    rows = teams.withColumn("team", F.lit(0)).repartition("block").mapInArrow(_summed, schema).collect()
    whole = np.zeros((BUCKETS, SIZE + 1), dtype=np.float64)
    for row in rows:
        own = np.frombuffer(row["part"], dtype="<i8").reshape(-1, SIZE + 1)
        whole[row["block"] * BLOCK : row["block"] * BLOCK + len(own)] += own
    counts = whole[:, SIZE:]
    mean = whole[:, :SIZE].sum(axis=0) / max(counts.sum(), 1)
    vectors = whole[:, :SIZE] / np.maximum(counts, 1) - mean
    vectors *= counts / (counts + 20)  # rare buckets say little
    return (vectors / np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-9)).astype(np.float32)


def features(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text."""
    n = len(offsets) - 1
    sums, counts = np.zeros((n, SIZE)), np.zeros(n)
    wide = vectors.astype(np.float64)
    for text, bucket in words(data, offsets):
        cuts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]])) if len(text) else text
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = text[a]
            counts[own] += b - a
            for k in range(a, b, 1 << 14):
                sums[own] += wide.take(bucket[k : min(k + (1 << 14), b)], axis=0).sum(axis=0)
    mean = sums / np.maximum(counts, 1)[:, None]
    return np.concatenate([mean, np.sqrt((mean**2).sum(axis=1, keepdims=True)), np.log1p(counts)[:, None]], axis=1)


@dataclass
class Network:
    """``sigmoid((relu(x w1 + b1) w2 + b2) / temperature)`` of scaled features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam over shuffled batches; every fifth row is kept for the temperature."""
    rng = np.random.default_rng(5)
    held = np.arange(len(y)) % 5 == 4
    xt, yt = x[~held], y[~held]
    net = Network(xt.mean(axis=0), xt.std(axis=0) + 1e-6, rng.standard_normal((x.shape[1], HIDDEN)) * np.sqrt(2 / x.shape[1]), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) * np.sqrt(1 / HIDDEN), 0.0)
    z = (xt - net.mean) / net.scale
    values = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(yt))
        rate = 0.005 * (1 - epoch / EPOCHS)
        for k in range(0, len(order), 256):
            own = order[k : k + 256]
            hidden = np.maximum(z[own] @ values[0] + values[1], 0)
            out = 1 / (1 + np.exp(-np.clip(hidden @ values[2] + values[3], -500, 500)))
            d = (out - yt[own]) / len(own)
            back = d[:, None] * values[2] * (hidden > 0)
            slopes = [z[own].T @ back + 1e-4 * values[0], back.sum(axis=0), hidden.T @ d + 1e-4 * values[2], np.array([d.sum()])]
            step += 1
            for v, g, m, s in zip(values, slopes, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = values[0], values[1], values[2], float(values[3][0])
    if held.any():
        logits = net.logits(x[held])
        net.temperature = min(np.exp(np.linspace(np.log(0.25), np.log(8), 121)), key=lambda t: loss(logits / t, y[held]))
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None
    share: float

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.network is None:
            return np.full(len(offsets) - 1, self.share)
        return self.network(features(self.vectors, data, offsets))


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Vectors from all of ``docs``, the network from labelled rows that aren't held out. Of an id with several labels the greatest counts."""
    vectors = word_vectors(docs, text_col)
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    sample = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label")).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(vectors, *text_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "label", "x"])

    # TRAIN_ROWS rows of two numbers are a bounded broadcast
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("raw")).join(F.broadcast(sample), "id").select("id", "label", "raw")
    kind = dict(labels.dtypes)[id_col]
    once = found.groupBy("id").agg(F.max("label").alias("label"), F.min("raw").alias("raw"))
    rows = once.mapInArrow(run, f"id {kind}, label {dict(labels.dtypes)[label_col]}, x binary").collect()
    rows.sort(key=lambda r: r["id"])
    y = np.array([r["label"] for r in rows], dtype=np.float64)
    if len(y) < 10 or y.min() == y.max():
        return Model(vectors, None, float(y.mean()) if len(y) else 0.5)
    x = np.stack([np.frombuffer(r["x"]) for r in rows])
    order = np.random.default_rng(3).permutation(len(y))
    return Model(vectors, fit(x[order], y[order]), float(y.mean()))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows and columns with a ``score`` (in place of a column of that name)."""
    rows = docs.drop("score")
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model(*text_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row."""
    out = score(docs.select(id_col, text_col), train(docs, labels, id_col, text_col), text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
