"""Removal of repeated strings with suffix arrays sorted deep-shallow.

A byte goes if it lies in a ``window``-byte string that starts somewhere else too. Sorting all suffixes of
a corpus would move each byte of it many times over, so suffixes are sorted only where a repeat is
possible, and only from chosen places:

1. Every window owns an anchor: of its ``GRAM``-byte strings the one with the least hash, the leftmost of
   equals. Equal windows have equal anchors in the same place, so windows can only repeat among occurrences of
   one anchor string. About one position in 70 is an anchor.
2. Anchor strings that occur once are dropped. The others fetch their context (all bytes of the
   windows they own), each distinct context once for each task.
3. Contexts of an anchor string meet in one unit of work, or in several where the string is
   very frequent. There the suffixes that start at the anchors are sorted, and so are the reversed prefixes that
   end there: multikey quicksort down to ``SHALLOW`` bytes, blind tries for groups that
   still agree. Neighbours in both orders give, for every context, the longest repeats to the right for each length of
   repeat to the left, and so exactly the windows that repeat.
4. Where a string's contexts fill several units, each unit also sends the digest of each distinct window; those found in two
   units repeat as well. Partial counts make even a window that all rows share cheap.
5. The windows' byte ranges go back to their documents.

Equal contexts are recognised by 128-bit BLAKE2 digests.

Defined cases: a null text is an empty one; nothing is removed from texts shorter than a window; texts of any
length are read whole; equal rows repeat each other wholly; rows that share an id are
documents of their own; a null id is carried along; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

WINDOW = 200
GRAM = 64
SHALLOW = GRAM + 32
#: Occurrences of an anchor string for each unit of work.
UNIT = 2048
CHUNK = 1 << 17
NO_ID = -(1 << 63)


# --- sorting -------------------------------------------------------------------------------------


def lcp(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    low, high = known, most  # a[:low] agrees, a[:high] doesn't
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """A Patricia trie over byte strings: inner nodes hold a depth and children by the byte there."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings, self.root = strings, [first]

    @staticmethod
    def _at(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, k: int) -> None:
        s, node = self.strings[k], self.root
        path = []
        while isinstance(node, tuple):  # descend blindly to some leaf
            path.append(node)
            children = node[1]
            node = children.get(self._at(s, node[0])) or next(iter(children.values()))
        other = self.strings[node[0]]
        common = lcp(s, other)
        if common == len(s) == len(other):
            node.append(k)
            return
        # the edge on which the strings part
        above, below = None, self.root
        while isinstance(below, tuple) and below[0] < common:
            above, below = below, below[1][self._at(s, below[0])]
        if isinstance(below, tuple) and below[0] == common:
            below[1][self._at(s, common)] = [k]
            return
        new = (common, {self._at(s, common): [k], self._at(other, common): below})
        if above is None:
            self.root = new
        else:
            above[1][self._at(s, above[0])] = new

    def in_order(self) -> Iterator[int]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                yield from node
            else:
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))


def deep_shallow(strings: list[bytes], first_step: int = 8) -> list[int]:
    """The order of the strings: multikey quicksort in steps of 8 bytes (the first may be longer) down to ``SHALLOW``, then blind tries."""
    order: list[int] = []
    todo = [([*range(len(strings))], 0, False)]
    while todo:
        group, depth, done = todo.pop()
        if len(group) < 2 or done:
            order.extend(group)
            continue
        if depth >= SHALLOW:
            trie = BlindTrie(strings, group[0])
            for k in group[1:]:
                trie.add(k)
            order.extend(trie.in_order())
            continue
        step = 8 if depth else first_step
        keys = [strings[k][depth : depth + step] for k in group]
        pivot = keys[len(keys) // 2]
        less = [k for k, x in zip(group, keys) if x < pivot]
        same = [k for k, x in zip(group, keys) if x == pivot]
        more = [k for k, x in zip(group, keys) if x > pivot]
        todo.append((more, depth, False))
        todo.append((same, depth + step, len(pivot) < step))  # a short key is the string's end
        todo.append((less, depth, False))
    return order


def repeated(contexts: list[tuple[bytes, int]], window: int) -> list[list[tuple[int, int]]]:
    """``contexts``: distinct (bytes, place of the anchor). For each the first and last starts of runs of windows that another has too."""
    n = len(contexts)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    rights = [c[r:] for c, r in contexts]
    lefts = [c[:r][::-1] for c, r in contexts]

    def meet(i: int, j: int, left: int, right: int) -> None:
        if left + right < window:
            return
        for k in (i, j):
            c, r = contexts[k]
            a, b = max(0, r - left), min(len(c), r + right) - window
            if a <= b:
                runs[k].append((a, b))

    if n == 2:
        meet(0, 1, lcp(*lefts), lcp(*rights))
        return runs
    order = deep_shallow(rights, GRAM)
    rank = [0] * n
    for at, k in enumerate(order):
        rank[k] = at
    beside = [lcp(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    table = [np.array(beside, dtype=np.int64)]  # least of 1, 2, 4, ... neighbours
    while len(table[-1]) > (step := 1 << (len(table) - 1)):
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))

    def right_of(a: int, b: int) -> int:
        """Common length of the suffixes of ranks ``a < b``."""
        level = (b - a).bit_length() - 1
        return int(min(table[level][a], table[level][b - (1 << level)]))

    left_order = deep_shallow(lefts)
    joins = sorted(((lcp(lefts[a], lefts[b]), a, b) for a, b in zip(left_order, left_order[1:])), reverse=True)
    owner = [*range(n)]
    members = [[rank[k]] for k in range(n)]
    longest = max(map(len, rights))
    for left, a, b in joins:
        if left + longest < window:
            break
        while owner[a] != a:
            owner[a] = owner[owner[a]]
            a = owner[a]
        while owner[b] != b:
            owner[b] = owner[owner[b]]
            b = owner[b]
        if len(members[a]) > len(members[b]):
            a, b = b, a
        large, pairs = members[b], []
        for x in members[a]:
            at = bisect_left(large, x)
            if at:
                pairs.append((large[at - 1], x))
            if at < len(large):
                pairs.append((x, large[at]))
        for x, y in pairs:
            meet(order[x], order[y], left, right_of(x, y))
        for x in members[a]:
            insort(large, x)
        members[a], owner[a] = [], b
    return runs


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of whole numbers, overlapping and adjoining ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


# --- anchors -------------------------------------------------------------------------------------

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BYTES = np.random.default_rng(12345).integers(0, 1 << 64, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of each ``GRAM`` bytes in a row."""
    h, step, power = _BYTES[data], 1, _BASE
    while step < GRAM:
        h = h[:-step] * np.uint64(power) + h[step:]
        step, power = step * 2, power * power % (1 << 64)
    return (h ^ (h >> np.uint64(29))) * _MIX


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: the text of each anchor, its string's hash, its place in the text, and its place after, and number of, the window starts it owns (in one number)."""
    texts, grams, places, owned = [], [], [], []
    span = window - GRAM + 1
    ends = offsets[1:]
    for at in range(int(offsets[0]), int(offsets[-1]), CHUNK):
        stop = min(at + CHUNK, int(offsets[-1]))
        piece = data[at : min(stop + window - 1, int(offsets[-1]))]
        if len(piece) < window:
            continue
        h = gram_hashes(piece)
        least = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        starts = np.arange(len(least))
        text = np.searchsorted(ends, at + starts, side="right")
        fits = np.flatnonzero(at + starts + window <= ends[text])
        if not len(fits):
            continue
        place = (least[fits] & np.uint64(0xFFFFFF)).astype(np.int64)
        begins = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (fits[1:] != fits[:-1] + 1)]))
        count = np.diff(np.append(begins, len(fits)))
        own, first, where = text[fits[begins]], fits[begins], place[begins]
        texts.append(own)
        grams.append(h[where].view(np.int64))
        places.append(where + at - offsets[own])
        owned.append((where - first) << 8 | (count - 1))
    if not texts:
        return (np.zeros(0, dtype=np.int64),) * 4
    return tuple(map(np.concatenate, (texts, grams, places, owned)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column and where each value begins, nulls as empty."""
    column = column.fill_null(pa.scalar("", column.type)) if column.null_count else column
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), offsets


def _anchor_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            text, gram, place, owned = anchors(data, offsets, window)
            order = np.argsort(text, kind="stable")
            text, gram, packed = text[order], gram[order], (place << 16 | owned)[order]
            have, starts = np.unique(text, return_index=True)
            lists = np.append(starts, len(text)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(have)), batch.column(1).take(pa.array(have)), pa.ListArray.from_arrays(lists, pa.array(gram)), pa.ListArray.from_arrays(lists, pa.array(packed))], names=["d", "h", "grams", "places"])

    return run


# --- contexts ------------------------------------------------------------------------------------

_CONTEXT = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("start", pa.int64()), ("gram", pa.int64()), ("c", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32()), ("twice", pa.bool_()), ("context", pa.binary())])
REMEMBERED = 300_000


def _context_rows(window: int):
    """A row for each anchor: the first of a task with a context carries it, the second says that it repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bool] = {}
        for batch in batches:
            if len(seen) > REMEMBERED:
                seen.clear()
            data, offsets = text_bytes(batch.column("raw"))
            raw = data.tobytes() if len(data) < 1 << 28 else memoryview(data)
            d, h = batch.column("d").to_pylist(), batch.column("h").to_pylist()
            lists = batch.column("found")
            for row in range(len(batch)):
                found = lists[row].values
                base = int(offsets[row])
                places, grams, counts = (found.field(k).to_numpy() for k in range(3))
                before = places >> 8 & 0xFF
                starts = (places >> 16) - before
                ends = starts + (places & 0xFF) + window
                contexts, digests, twice = [], [], []
                for g, a, b, at in zip(grams.tolist(), starts.tolist(), ends.tolist(), before.tolist()):
                    context = bytes(raw[base + a : base + b])
                    digest = hashlib.blake2b(context, digest_size=16, salt=g.to_bytes(8, "little", signed=True) + at.to_bytes(8, "little")).digest()
                    again = seen.get(digest)
                    if again is None:
                        seen[digest] = False
                    elif not again:
                        seen[digest] = True
                    digests.append(digest)
                    contexts.append(context if again is None else None)
                    twice.append(again is False)
                keys = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                n = len(digests)
                yield pa.RecordBatch.from_arrays([pa.array([d[row]] * n, pa.int64()), pa.array([h[row]] * n, pa.int64()), pa.array(starts), pa.array(grams), pa.array(counts), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array(before.astype(np.int32)), pa.array(twice, pa.bool_()), pa.array(contexts, pa.binary())], schema=_CONTEXT)

    return run


def _resolve(window: int):
    """Rows sorted by unit and key -> for each distinct context the runs of repeated windows (``first`` to
    ``last`` start, a missing ``w1``), and in units that share their anchor string with others a row for each distinct window
    (``w1``, ``w2`` its digest; with a key if it didn't repeat in the unit)."""

    def unit(blocks: int, contexts: dict[tuple[int, int], list]) -> list[tuple]:
        keys = [k for k, x in contexts.items() if x[0] is not None]
        items = [(contexts[k][0], contexts[k][1]) for k in keys]
        runs = repeated(items, window) if len(items) > 1 else [[]]
        out = []
        for k, (context, _), own in zip(keys, items, runs):
            if contexts[k][2]:
                own.append((0, len(context) - window))
            out.extend((*k, a, b, None, None) for a, b in merged(own))
        if blocks > 1:
            sent = set()
            for k, (context, _), own in zip(keys, items, runs):
                known = np.zeros(len(context) - window + 1, dtype=bool)
                for a, b in own:
                    known[a : b + 1] = True
                for a, repeats in enumerate(known.tolist()):
                    digest = hashlib.blake2b(context[a : a + window], digest_size=16).digest()
                    w1, w2 = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
                    if not repeats:
                        out.append((*k, a, a, w1, w2))
                    elif digest not in sent:
                        sent.add(digest)
                        out.append((None, None, None, None, w1, w2))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def drain():
            columns = [*zip(*rows)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["k1", "k2", "first", "last", "w1", "w2"])

        rows: list[tuple] = []
        now, contexts = None, {}
        for batch in batches:
            for gram, block, blocks, k1, k2, at, twice, context in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now[:2] != (gram, block):
                    if now is not None:
                        rows += unit(now[2], contexts)
                        if len(rows) > 20_000:
                            yield drain()
                    now, contexts = (gram, block, blocks), {}
                have = contexts.get((k1, k2))
                if have is None:
                    contexts[k1, k2] = [context, at, twice]
                else:
                    have[2] = True
                    if have[0] is None:
                        have[0] = context
        if now is not None:
            rows += unit(now[2], contexts)
        if rows:
            yield drain()

    return run


def _cut(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            view = memoryview(data)
            marks = batch.column(2)
            n_removed, n_spans, digests, kept_texts = [], [], [], []
            for row in range(len(batch)):
                a, b = int(offsets[row]), int(offsets[row + 1])
                sha, removed, spans, at, kept = hashlib.sha256(), 0, 0, a, []
                if marks[row].is_valid:
                    found = marks[row].values
                    starts, ends = found.field(0).to_numpy(), found.field(1).to_numpy() + window
                    order = np.argsort(starts, kind="stable")
                    starts, reach = starts[order], np.maximum.accumulate(ends[order])
                    opens = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
                    closes = np.append(opens[1:] - 1, len(starts) - 1)
                    for x, y in zip((starts[opens] + a).tolist(), (reach[closes] + a).tolist()):
                        kept.append(view[at:x])
                        removed, spans, at = removed + y - x, spans + 1, y
                kept.append(view[at:b])
                for part in kept:
                    sha.update(part)
                n_removed.append(removed)
                n_spans.append(spans)
                digests.append(sha.hexdigest())
                if with_text:
                    kept_texts.append(b"".join(kept).decode("utf-8", "ignore"))
            columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept_texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(k) for k in range(3, batch.num_columns))], names=[*names, *batch.schema.names[3:]])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row; ``with_text`` adds ``kept_text`` (what is left, without characters that a cut
    went through), ``carry`` further columns."""
    ids = docs.select(F.col(id_col).cast("long").alias("d"))
    ambiguous = ids.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), (F.xxhash64(text) if ambiguous else F.lit(0).cast("long")).alias("h"), text.cast("binary").alias("raw"), F.col(id_col).alias("id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    # one row for each text with anchors
    anchored = storage.keep(keyed.where(F.octet_length("raw") >= window).select("d", "h", "raw").mapInArrow(_anchor_rows(window), "d long, h long, grams array<long>, places array<long>"), "anchors")
    single = anchored.select("d", "h", F.explode(F.arrays_zip("places", "grams")).alias("x")).select("d", "h", F.col("x.places").alias("place"), F.col("x.grams").alias("gram"))
    # stored, so that Spark may split the join's tasks where one string is very frequent
    often = storage.keep(anchored.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "often")
    found = single.join(often, "gram").groupBy("d", "h").agg(F.collect_list(F.struct("place", "gram", "c")).alias("found"))
    # equal rows of one id have one list; distinct rows for it suffice, as their contexts are equal
    rows = keyed.select("d", "h", "raw").join(found, ["d", "h"]).select("d", "h", "raw", "found")
    contexts = storage.keep(rows.mapInArrow(_context_rows(window), "d long, h long, start long, gram long, c long, k1 long, k2 long, at int, twice boolean, context binary"), "contexts")
    storage.discard(anchored, often)
    blocks = F.ceil(F.col("c") / UNIT).cast("int")
    units = contexts.where("context IS NOT NULL OR twice").select("gram", F.pmod(F.xxhash64("k1"), blocks).cast("int").alias("block"), blocks.alias("blocks"), "k1", "k2", "at", "twice", "context")
    resolved = storage.keep(units.repartition("gram", "block").sortWithinPartitions("gram", "block", "k1", "k2").mapInArrow(_resolve(window), "k1 long, k2 long, first int, last int, w1 long, w2 long"), "resolved")
    windows = resolved.where("w1 IS NOT NULL")
    shared = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2")
    across = windows.where("k1 IS NOT NULL").join(shared, ["w1", "w2"]).select("k1", "k2", "first", "last")
    runs = resolved.where("w1 IS NULL").select("k1", "k2", "first", "last").union(across)
    marks = contexts.select("d", "h", "start", "k1", "k2").join(runs, ["k1", "k2"]).groupBy("d", "h").agg(F.collect_list(F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last")).alias("b"))).alias("marks"))
    extra = [f"c{i}" for i in range(len(carry))]
    out = keyed.join(marks, ["d", "h"], "left").select("id", "raw", "marks", *extra)
    kinds = dict(docs.dtypes)
    schema = f"id {kinds[id_col]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text + "".join(f", c{i} {kinds[c]}" for i, c in enumerate(carry))
    out = out.mapInArrow(_cut(window, with_text), schema)
    return out.withColumnsRenamed({"id": id_col} | {f"c{i}": c for i, c in enumerate(carry)})
