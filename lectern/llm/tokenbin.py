"""Token ids as binary matrices, packed best-fit-decreasing.

A task encodes its rows and, whenever it holds ``BLOCK_TOKENS`` ids, packs them offline: documents
of over a row are split into whole rows and a rest, the rests are sorted by falling length, and each
goes to the row with the least room that still holds it. A segment tree over room finds that row in
logarithmic time. Each block becomes four ``.npy`` files in the shared folder:

    <block>.ids.npy       unsigned 16-bit matrix, rows padded with ``PAD_ID``
    <block>.lengths.npy   for each row its segments' cumulative lengths from 0, one row after another
    <block>.resets.npy    packed bits, one for each id of the matrix: 1 where positions start again at 0
    <block>.segments.npy  (row, doc_id, has_id, start, doc_tokens) of each segment, in the order of ``lengths``

A file's name holds the task's attempt, so a task that runs again never meets another's files. Only
blocks in the returned manifest count; what a lost attempt left behind is never read.

Defined cases: null and empty texts are documents of the end id alone; equal rows are kept one by
one; a null ``doc_id`` is kept; other columns are left alone; an empty table writes no block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, storage
from .packing import END_ID

WIDTH = 2048
PAD_ID = 0
BLOCK_TOKENS = 8_000_000
SEGMENT = np.dtype([("row", "<i4"), ("doc_id", "<i8"), ("has_id", "?"), ("start", "<i8"), ("doc_tokens", "<i8")])


class RoomTree:
    """How many rows have each amount of room; finds the least amount of at least ``n`` that some row has."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.counts = [0] * (2 * self.leaves)

    def change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.counts[i] += by
            i >>= 1

    def least(self, n: int) -> int | None:
        i = n + self.leaves
        if self.counts[i]:
            return n
        while i > 1:
            if not i & 1 and self.counts[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.counts[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(lengths: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """The row of each piece (none longer than ``width``), and the number of rows."""
    rows = np.zeros(len(lengths), dtype=np.int32)
    tree, by_room, n = RoomTree(width), [[] for _ in range(width + 1)], 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        room = tree.least(size)
        if room is None:
            row, room, n = n, width, n + 1
        else:
            row = by_room[room].pop()
            tree.change(room, -1)
        rows[k] = row
        if room > size:
            by_room[room - size].append(row)
            tree.change(room - size, 1)
    return rows, n


def pack_block(docs: list[tuple[int | None, np.ndarray]], width: int) -> dict[str, np.ndarray]:
    """The four arrays of a block."""
    pieces = [(key, at, ids[at : at + width], len(ids)) for key, ids in docs for at in range(0, len(ids), width)]
    rows, n = best_fit_decreasing(np.array([len(p[2]) for p in pieces], dtype=np.int64), width)
    matrix = np.full((n, width), PAD_ID, dtype="<u2")
    resets = np.zeros((n, width), dtype=bool)
    fill = np.zeros(n, dtype=np.int64)
    order = np.argsort(rows, kind="stable").tolist()
    segments, lengths = np.zeros(len(pieces), dtype=SEGMENT), []
    for to, k in enumerate(order):
        key, start, ids, total = pieces[k]
        row = int(rows[k])
        at = int(fill[row])
        if not at:
            lengths.append(0)
        matrix[row, at : at + len(ids)] = ids
        resets[row, at] = True
        fill[row] += len(ids)
        lengths.append(at + len(ids))
        segments[to] = (row, key or 0, key is not None, start, total)
    return {"ids": matrix, "lengths": np.array(lengths, dtype="<i4"), "resets": np.packbits(resets, axis=1), "segments": segments}


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, width: int = WIDTH) -> DataFrame:
    """Writes blocks below ``folder``; returns the manifest ``(block, sequence_base, n_rows, n_tokens)``, already stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task = bpe.tokenizer(path), TaskContext.get()
        fs, root = storage.filesystem(folder)
        fs.create_dir(root, recursive=True)
        held: list[tuple[int | None, np.ndarray]] = []
        rows = size = 0

        def flush(k: int) -> pa.RecordBatch:
            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{k:04d}"
            arrays = pack_block(held, width)
            for what, x in arrays.items():
                with fs.open_output_stream(f"{root}/{name}.{what}.npy", compression=None) as f:
                    np.lib.format.write_array(f, x, allow_pickle=False)
            n = len(arrays["ids"])
            return pa.RecordBatch.from_pydict({"block": [f"{folder}/{name}"], "sequence_base": [(task.partitionId() << 33) + rows], "n_rows": [n], "n_tokens": [size]})

        k = 0
        for batch in batches:
            keys = batch.column(0)
            for at, texts in bpe.in_blocks(batch):
                for i, data in enumerate(tokenizer.packed(texts)):
                    held.append((keys[at + i].as_py(), np.append(np.frombuffer(data, dtype="<u2"), np.uint16(END_ID))))
                    size += len(held[-1][1])
                    if size >= BLOCK_TOKENS:
                        out = flush(k)
                        yield out
                        rows, k, size = rows + out.column("n_rows")[0].as_py(), k + 1, 0
                        held.clear()
        if held:
            yield flush(k)

    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be a whole number")
    manifest = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "block string, sequence_base long, n_rows long, n_tokens long")
    return storage.keep(manifest)


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Reads blocks back, one row for each segment: ``(doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset)``. Fails if position resets and cumulative lengths disagree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, root = storage.filesystem(block)
                got = {}
                for what in ("ids", "lengths", "resets", "segments"):
                    with fs.open_input_file(f"{root}.{what}.npy") as f:
                        got[what] = np.lib.format.read_array(f, allow_pickle=False)
                segments, ends = got["segments"], got["lengths"]
                before = np.flatnonzero(ends == 0)  # where each row's lengths begin
                offsets = np.delete(ends, np.append(before[1:] - 1, len(ends) - 1)) if len(ends) else ends
                lengths = np.delete(ends, before) - offsets
                marks = np.unpackbits(got["resets"], axis=1)
                if marks.sum() != len(segments) or not marks[segments["row"], offsets].all():
                    raise ValueError(f"{block}: position resets don't match the segments")
                ids = [got["ids"][r, o : o + n] for r, o, n in zip(segments["row"].tolist(), offsets.tolist(), lengths.tolist())]
                columns = {
                    "doc_id": pa.array(segments["doc_id"], pa.int64(), mask=~segments["has_id"]),
                    "start": pa.array(segments["start"]), "length": pa.array(lengths.astype(np.int64)),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    "doc_tokens": pa.array(segments["doc_tokens"]), "sequence_id": pa.array(base + segments["row"].astype(np.int64)), "offset": pa.array(offsets.astype(np.int64)),
                }
                if with_ids:
                    columns["ids"] = pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    # a block's files are read by whichever task gets its row; rows are few and small, so one task may be given several
    spread = manifest.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2)
    return spread.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
