"""Comparing rows that share a bucket, without emitting pairs and without a task per bucket.

A row has a long ``id``, some bytes to compare by, and the keys of the buckets it is in. Buckets of
one row are dropped before anything large moves. A bucket of up to ``block`` rows is one unit of
work; a larger one is dealt by id into blocks of about that size, and every pair of its blocks is a unit (a row goes to as many
units as its bucket has blocks), so no unit holds over some two blocks of rows whatever share of the
table its bucket holds. Units are hashed over the tasks; a task sorts its rows by unit and compares
one unit after another with numpy.

``compare(x, y)`` gets the bytes of two blocks as matrices (the same one twice within a block) and
returns a boolean matrix of which rows are linked. What comes out of a unit is one row for each
linked row at most: its id, the smallest id it is tied to within the unit, directly or not, and how many links it has there. So the
output grows with rows, not with pairs, and still connects all that links connect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

BLOCK = 512


def matrix(column: pa.Array) -> np.ndarray:
    """Binary values as rows of bytes; where they differ in length, shorter ones end in zeros."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    lengths = np.diff(offsets)
    if (lengths == lengths[0]).all():
        return data[offsets[0] : offsets[-1]].reshape(len(column), -1)
    out = np.zeros((len(column), lengths.max()), dtype=np.uint8)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(row)) - (offsets[:-1] - offsets[0])[row]] = data[offsets[0] : offsets[-1]]
    return out


def arrays(column: pa.Array) -> np.ndarray:
    """Binary values of any length, each as an array of unsigned 64-bit numbers."""
    out = np.empty(len(column), dtype=object)
    for k, value in enumerate(column):
        out[k] = np.frombuffer(value.as_buffer(), dtype="<u8")
    return out


def tied(linked: np.ndarray, ids_x: np.ndarray, ids_y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a boolean matrix the smallest id they are tied to."""
    mx, my = ids_x.copy(), (ids_x if same else ids_y).copy()
    most = np.iinfo(np.int64).max
    while True:
        nx = np.minimum(mx, np.where(linked, my[None, :], most).min(axis=1))
        if same:
            ny = nx
        else:
            ny = np.minimum(my, np.where(linked, nx[:, None], most).min(axis=0))
        if (nx == mx).all() and (ny == my).all():
            return mx, my
        mx, my = nx, ny


def units(rows: DataFrame, block: int) -> DataFrame:
    """``(id, unit key, lo, hi, own)``: ``lo`` and ``hi`` name the pair of blocks, ``own`` the row's block."""
    keyed = rows.select("id", F.explode("keys").alias("key"))
    # stored, so that Spark may split the join's tasks where one bucket is very large
    sizes = storage.keep(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "sizes")
    kept = keyed.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = kept.select("id", "key", "own", other)
    return paired.select("id", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))


def links(rows: DataFrame, compare: Callable[[np.ndarray, np.ndarray, int], np.ndarray], block: int = BLOCK, weigh: Callable[[np.ndarray], np.ndarray] | None = None, load: Callable[[pa.Array], np.ndarray] = matrix, with_key: bool = False) -> DataFrame:
    """``rows``: ``id long, data binary, keys array<long>``, ids distinct. Returns ``(id, root, n)``, possibly several
    rows for an id, and with ``with_key`` the ``key`` of the bucket they were linked in. A pair of rows that share several buckets is linked in each, so whoever sums
    ``n`` has ``compare`` link it in one only: its third argument is the bucket's key. With
    ``weigh``, a link counts as many times as what it returns for the row at the other end. ``load``
    turns a column of bytes into what ``compare`` gets slices of."""
    names = ["id", "root", "n"] + ["key"] * with_key
    weigh = weigh or (lambda data: np.ones(len(data), dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(part: list[pa.RecordBatch]):
            table = pa.Table.from_batches(part).combine_chunks()
            key, lo, hi, own, ids = (table.column(k).to_numpy() for k in ("key", "lo", "hi", "own", "id"))
            data = load(table.column("data").chunk(0))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
                if b - a < 2:
                    continue
                if lo[a] == hi[a]:
                    linked = compare(data[a:b], data[a:b], int(key[a]))
                    np.fill_diagonal(linked, False)
                    if linked.any():
                        roots, _ = tied(linked, ids[a:b], ids[a:b], True)
                        n = linked @ weigh(data[a:b])
                        some = np.flatnonzero(n)
                        out.append((ids[a:b][some], roots[some], n[some], key[a:b][some]))
                    continue
                m = a + int(np.searchsorted(own[a:b], hi[a]))
                if m in (a, b):
                    continue
                linked = compare(data[a:m], data[m:b], int(key[a]))
                if linked.any():
                    rx, ry = tied(linked, ids[a:m], ids[m:b], False)
                    for i, r, n, own_key in ((ids[a:m], rx, linked @ weigh(data[m:b]), key[a:m]), (ids[m:b], ry, weigh(data[a:m]) @ linked, key[m:b])):
                        some = np.flatnonzero(n)
                        out.append((i[some], r[some], n[some], own_key[some]))
            return [np.concatenate(x) for x in zip(*out)] if out else None

        def whole(part: list[pa.RecordBatch]):
            if part and (found := work(part)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found[: len(names)]], names=names)

        held: list[pa.RecordBatch] = []  # ends with a unit that may go on in the next batch
        for batch in batches:
            if not len(batch):
                continue
            key, lo, hi = (batch.column(k).to_numpy() for k in (0, 1, 2))
            last = int(np.flatnonzero((key != key[-1]) | (lo != lo[-1]) | (hi != hi[-1]))[-1]) + 1 if ((key != key[-1]) | (lo != lo[-1]) | (hi != hi[-1])).any() else 0
            if held:
                first = held[-1]
                same = first.column(0)[-1].as_py() == key[0] and first.column(1)[-1].as_py() == lo[0] and first.column(2)[-1].as_py() == hi[0]
                if last or not same:
                    head = batch.slice(0, last) if last else None
                    yield from whole([*held, *([head] if head is not None else [])])
                    held = []
            elif last:
                yield from whole([batch.slice(0, last)])
            held.append(batch.slice(last))
        yield from whole(held)

    with_data = units(rows, block).join(rows.select("id", "data"), "id").select("key", "lo", "hi", "own", "id", "data")
    dealt = with_data.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "own", "id")
    return dealt.mapInArrow(run, ", ".join(f"{name} long" for name in names))
