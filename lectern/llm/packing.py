"""Sum-of-squares online packing of token ids into windows.

Each task packs its own rows as they come. ``level[h]`` counts the open windows filled to ``h``. A
document's last piece of ``r`` ids goes to the fill level where the sum of the squared counts grows
least (a new window is level 0); everything that fills a window whole goes out at once. A piece may also be cut: its beginning fills a window
of the level with the most windows (among those with a gap smaller than the piece), and the rest is placed in turn. That counts as a choice like the others, at a price of
``CUT`` squares, so it is taken where a level has grown high. A level that lengths can't fill otherwise therefore stays about that high, and a task holds some
``CUT`` windows for each level at most. When a task has no more rows, the emptiest open windows are cut up
to fill the fullest, and the one that may remain is cut into windows of a power of two, which need
no padding. Nothing is shuffled. Lengths are as good as random, so a new level is rarely the complement of an old one: the more documents a task has, the larger the share of
windows that placing alone fills (``placed``, ``cut`` and ``settled`` of ``SumOfSquares`` count them).

Defined cases: null and empty texts are documents of the end id alone; documents of over a window are cut
into whole windows and a rest, so any length works; equal rows are packed one by one; a null
``doc_id`` is carried along; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import bpe

CAPACITY = 2048
END_ID = 1
#: What a cut costs, in squares of counts.
CUT = 2.0
COLUMNS = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


class SumOfSquares:
    """Places pieces; ``emit(piece, start, ids, window, offset)`` gets each when its window is settled."""

    def __init__(self, capacity: int, emit: Callable, price: float = CUT):
        self.capacity, self.emit, self.windows, self.price = capacity, emit, 0, price
        self.placed = self.cut = self.settled = 0  # windows filled by a piece that fits, by the beginning of one, and by cutting up others at the end
        self.level = np.zeros(capacity + 1, dtype=np.int64)
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0

    def new_window(self) -> int:
        self.windows += 1
        return self.windows - 1

    def add(self, tag, ids: np.ndarray) -> None:
        size, whole = self.capacity, len(ids) // self.capacity * self.capacity
        for at in range(0, whole, size):
            self.emit(tag, at, ids[at : at + size], self.new_window(), 0)
        rest = ids[whole:]
        while len(rest):
            rest, whole = self.place(tag, whole, rest)

    def place(self, tag, start: int, ids: np.ndarray) -> tuple[np.ndarray, int]:
        """Puts a piece, or its beginning, where the sum of squares grows least; returns what is left of it, and where that starts."""
        size, r, level = self.capacity, len(ids), self.level
        # change of the sum of squares, halved: N[h+r] - N[h] + 1; a filled window no longer counts
        change = level[r:size] - level[: size - r] + 1.0
        change[level[: size - r] == 0] = np.inf
        change[0] = level[r] + 0.5
        h = int(change.argmin())
        least = change[h]
        if level[size - r] and 0.5 - level[size - r] <= least:
            h, least = size - r, 0.5 - level[size - r]
        if r > 1:
            fullest = size - 1 - int(level[size - r + 1 : size][::-1].argmax())
            left = r - (size - fullest)
            if level[fullest] and 0.5 - level[fullest] + level[left] + 0.5 + self.price < least:
                gap = size - fullest
                pieces = self.open[fullest].pop()
                pieces.append((tag, start, ids[:gap]))
                level[fullest] -= 1
                self.n_open -= 1
                self.cut += 1
                self.close(pieces)
                return ids[gap:], start + gap
        pieces = self.open[h].pop() if h else []
        pieces.append((tag, start, ids))
        level[h] -= h > 0
        self.n_open -= h > 0
        if h + r == size:
            self.placed += 1
            self.close(pieces)
        else:
            self.open[h + r].append(pieces)
            level[h + r] += 1
            self.n_open += 1
        return ids[r:], start + r

    def close(self, pieces: list) -> None:
        window, at = self.new_window(), 0
        for tag, start, ids in pieces:
            self.emit(tag, start, ids, window, at)
            at += len(ids)

    def settle(self) -> None:
        """Fill the fullest open windows with ids cut from the emptiest."""
        held = [p for h in range(self.capacity, 0, -1) for p in self.open[h]]
        self.open = [[] for _ in range(self.capacity + 1)]
        self.level[:] = 0
        self.n_open = 0
        fills = [sum(len(x[2]) for x in p) for p in held]
        first, last = 0, len(held) - 1
        while first < last:
            gap = self.capacity - fills[first]
            if not gap:
                self.settled += 1
                self.close(held[first])
                first += 1
                continue
            tag, start, ids = held[last].pop()
            taken = min(gap, len(ids))
            # the end of the piece moves; its beginning stays where it was
            held[first].append((tag, start + len(ids) - taken, ids[len(ids) - taken :]))
            if taken < len(ids):
                held[last].append((tag, start, ids[: len(ids) - taken]))
            fills[first] += taken
            fills[last] -= taken
            if not fills[last]:
                last -= 1
        if first == last:
            rest, fill = held[first], fills[first]
            if fill == self.capacity:
                self.close(rest)
            else:
                self.powers_of_two(rest, fill)

    def powers_of_two(self, pieces: list, fill: int) -> None:
        pieces = pieces[::-1]
        for bit in range(fill.bit_length() - 1, -1, -1):
            room, own = fill & (1 << bit), []
            while room:
                tag, start, ids = pieces.pop()
                own.append((tag, start, ids[:room]))
                if len(ids) > room:
                    pieces.append((tag, start + room, ids[room:]))
                room -= len(own[-1][2])
            if own:
                self.close(own)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, price: float = CUT) -> DataFrame:
    """One row for each piece of a document: where it starts in the document's ids (each document
    ends with ``END_ID``), its length, the CRC-32 of its ids as little-endian unsigned 32-bit
    numbers, the document's length, and its window and place there; with the ids themselves if
    asked for. Window numbers are unique over all tasks."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe.tokenizer(path)
        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def emit(tag, start, ids, window, offset):
            rows.append((tag[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tag[1], base + window, offset, ids))

        def drain() -> pa.RecordBatch:
            columns = [*zip(*rows)] or [()] * 8
            rows.clear()
            arrays = [pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            if with_ids:
                arrays.append(pa.array([x.tolist() for x in columns[7]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        packer, id_type = SumOfSquares(capacity, emit, price), pa.int64()
        for batch in batches:
            id_type = batch.column(0).type
            keys = batch.column(0)
            for at, texts in bpe.in_blocks(batch):
                for k, data in enumerate(tokenizer.packed(texts)):
                    ids = np.append(np.frombuffer(data, dtype="<u2"), np.uint16(END_ID))
                    packer.add((keys[at + k].as_py(), len(ids)), ids)
                if len(rows) >= 4096:
                    yield drain()
        packer.settle()
        if rows:
            yield drain()

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {COLUMNS}" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)
