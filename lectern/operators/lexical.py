"""BM25 over a table of chunks, for many questions at once.

The index is made of blocks of chunks. A task counts the words of its own chunks, so nothing is shuffled to build it. A block has a row with its
chunks' ids and lengths, and a row for each of its terms: the chunks that hold it, by their place in the block, how often, and the
greatest count and least length among them, from which a bound on what the term can add to a score follows whatever the corpus' mean length comes to be.

A search sends the questions' terms to the blocks' rows of these terms, brings a block's rows together, and there goes through each
question's terms by falling bounds (MaxScore): once the best ``k`` so far can't be reached by the terms that are left, chunks not seen yet are passed over, and the
lists that are left, those of the most frequent words, are only looked up for the chunks that may still come among the best. A block whose bounds don't reach the
best of blocks before it is passed over. A task sends on its ``k`` best for each question.

Of ``MANY`` questions and more, their terms would be repeated at every block's rows. They go the other way then: chunks are dealt into lanes, a task for each, and a lane's task takes
its lists once and then the questions as they come, a batch at a time. There all of a question's lists are added up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, FLOOR = 1.5, 0.75, 0.25

#: Question terms that are sent to every task; more than that are joined by shuffling. Of so many, files are asked for these terms alone.
MOST_TERMS, PUSHED_TERMS = 200_000, 500
#: Rows of questions and terms that a block is searched for at once.
ASKED_AT_ONCE = 500_000
#: Chunks and tokens of a block, at most (but for one chunk of more tokens).
BLOCK, BLOCK_TOKENS = 16_384, 1_000_000
#: Tokens that a task holds as strings at once; the others of a block it holds as numbers of terms.
STRINGS = 65_536
#: Chunks of blocks that are searched as one, at most; a lane has ``BLOCK`` on the average.
TOGETHER = 2 * BLOCK
#: Bytes for each core below which chunks are dealt anew.
SMALL = 16 << 20
#: Scores count to six places; pruning leaves that much room.
ROOM = 2e-6
#: Questions from which on they are brought to lanes of chunks; chunks of a lane at most on the average, and where there are cores enough, at least.
MANY, LANE, SMALL_LANE = 4096, 32_768, 8192
#: Tasks for each core that lanes make where there are chunks enough.
LANES_A_CORE = 2
#: A list that holds one of so many chunks of a lane is held as a number for every chunk.
FREQUENT = 8
#: What ``functions.text.tokens`` finds, in Python.
TOKEN = re.compile(r"\b[a-z]{3,}\b")

LIST, CHUNKS, DEAD, KEPT = "list", "chunks", "dead", "kept"
#: In what order a lane's rows come.
TURNS = [CHUNKS, KEPT, DEAD, LIST, "asked"]


@dataclass
class LexicalIndex:
    """``rows(block, kind, term, df, most_tf, least_length, places, tfs, ids, lengths)``, ``terms(term, df, idf)`` and ``totals(n, length, avg_length)`` (one row).

    Rows are of a ``kind``: a term's list; a block's chunks; places that were deleted; places that a filter keeps."""

    rows: DataFrame
    terms: DataFrame
    totals: DataFrame
    filtered: bool = False

    def postings(self) -> DataFrame:
        """``(block, place, term, tf)`` of all lists, deleted chunks included."""
        return self.rows.where(F.col("kind") == LIST).select("block", "term", F.explode(F.arrays_zip("places", "tfs")).alias("x")).select("block", "x.places", "term", "x.tfs").toDF("block", "place", "term", "tf")

    def places(self) -> DataFrame:
        """``(block, place, chunk_id, length)`` of all chunks, deleted ones included."""
        return self.rows.where(F.col("kind") == CHUNKS).select("block", F.posexplode(F.arrays_zip("ids", "lengths")).alias("place", "x")).select("block", "place", F.col("x.ids").alias("chunk_id"), F.col("x.lengths").alias("length"))

    def within(self, chunk_ids: DataFrame) -> LexicalIndex:
        """Searches find these chunks alone; statistics stay. Blocks' numbers follow from how chunks were dealt, so the index has to be stored or built of a table that is read as it lies."""
        kept = self.places().join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("block").agg(F.collect_list("place").alias("places"))
        return LexicalIndex(self.rows.unionByName(kept.select("block", F.lit(KEPT).alias("kind"), "places"), allowMissingColumns=True), self.terms, self.totals, True)


def give_back() -> None:
    """Memory that is free again goes to the system; a worker is used for many tasks and would hold it. Arrow is to use C's allocator, as NumPy does, so that one can use what the other freed."""
    pa.set_memory_pool(pa.system_memory_pool())
    pa.default_memory_pool().release_unused()


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    base, number = TaskContext.get().partitionId() << 20, 0
    ids: list[pa.Array] = []
    flat: list[str] = []
    sizes: list[int] = []
    coded: list[pa.DictionaryArray] = []  # the block's tokens but those in flat

    def code() -> None:
        coded.append(pa.array(flat, pa.string()).dictionary_encode())
        flat.clear()

    def block() -> Iterator[pa.RecordBatch]:
        nonlocal number
        lengths = np.array(sizes, dtype=np.int32)
        n = len(lengths)
        code()
        unified = pa.chunked_array(coded).unify_dictionaries()
        coded.clear()
        give_back()
        terms = unified.chunk(0).dictionary
        order = pc.sort_indices(terms).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) * n
        keys, at = np.repeat(np.arange(n), lengths), 0
        for part in unified.chunks:
            keys[at : at + len(part)] += rank[part.indices.to_numpy()]
            at += len(part)
        del unified, part
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        tfs, term = np.diff(first, append=len(keys)).astype(np.int32), keys[first]
        del keys, first  # what is as long as the block's tokens isn't held while rows are handed on
        places = (term % n).astype(np.int32)
        term //= n
        starts = np.searchsorted(term, np.arange(len(order)))
        ends = np.append(starts, len(term)).astype(np.int32)
        del term
        df = np.diff(ends)
        own = base + number
        number += 1
        chunk_ids = pa.concat_arrays(ids)
        yield rows([own], CHUNKS, [None], [None], [None], [None], None, None, pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), chunk_ids), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(lengths)))
        if not len(order):
            return
        highest, least = np.maximum.reduceat(tfs, starts), np.minimum.reduceat(lengths[places], starts)
        names = terms.take(pa.array(order))
        for i in range(0, len(order), 8192):
            j = min(i + 8192, len(order))
            lists = [pa.ListArray.from_arrays(pa.array(ends[i : j + 1] - ends[i]), pa.array(x[ends[i] : ends[j]])) for x in (places, tfs)]
            yield rows([own] * (j - i), LIST, names[i:j], df[i:j], highest[i:j], least[i:j], *lists, None, None)

    def rows(own, kind, term, df, highest, least, places, tfs, chunk_ids, lengths):
        numbers = pa.list_(pa.int32())
        none = lambda x, t: pa.nulls(len(own), t) if x is None else x
        arrays = [pa.array(own, pa.int64()), pa.array([kind] * len(own)), pa.array(term, pa.string()), *(pa.array(x, pa.int32()) for x in (df, highest, least)), none(places, numbers), none(tfs, numbers), none(chunk_ids, pa.list_(id_type)), none(lengths, numbers)]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "kind", "term", "df", "most_tf", "least_length", "places", "tfs", "ids", "lengths"])

    give_back()
    id_type, held = pa.string(), 0
    for batch in batches:
        batch_ids, begin = pa.concat_arrays([batch.column(0)]), 0  # copied, since a batch is one buffer: what keeps its ids keeps its texts
        id_type = batch_ids.type
        for i, text in enumerate(batch.column(1)):
            found = TOKEN.findall((text.as_py() or "").lower())
            flat += found
            sizes.append(len(found))
            held += len(found)
            if len(flat) >= STRINGS:
                code()
            if len(sizes) == most or held >= BLOCK_TOKENS:
                ids.append(batch_ids.slice(begin, i + 1 - begin))
                begin = i + 1
                yield from block()
                ids.clear(), sizes.clear()
                held = 0
        if begin < len(batch):
            ids.append(batch_ids.slice(begin))
        give_back()
    if sizes:
        yield from block()
        give_back()


def spread(chunks: DataFrame, id_col: str) -> DataFrame:
    """Chunks as they lie; where they are so few that a file or two holds them, and few tasks would do all, dealt over all cores first."""
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    size = int(str(chunks._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return chunks.repartition(cores, id_col) if size < cores * SMALL else chunks


def block_rows(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content", block: int = BLOCK) -> DataFrame:
    """The rows of an index of these chunks. Each row of ``chunks`` is a chunk of its own."""
    kind = chunks.select(id_col).schema[0].dataType.simpleString()
    numbers = "array<int>"
    return spread(chunks.select(id_col, text_col), id_col).mapInArrow(partial(_blocks, most=block), f"block long, kind string, term string, df int, most_tf int, least_length int, places {numbers}, tfs {numbers}, ids array<{kind}>, lengths {numbers}")


def frequencies(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind") == LIST).groupBy("term").agg(F.sum("df").alias("df"))


def sums(rows: DataFrame) -> DataFrame:
    """``(n, length)``: chunks and their tokens."""
    chunks = rows.where(F.col("kind") == CHUNKS)
    zero = F.lit(0).cast("long")
    total = F.aggregate("lengths", zero, lambda a, x: a + x)
    return chunks.agg(F.coalesce(F.sum(F.size("lengths")), zero).alias("n"), F.coalesce(F.sum(total), zero).alias("length"))


def build_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content", block: int = BLOCK) -> LexicalIndex:
    """Counts of the chunks' tokens. Chunks without tokens count for the totals. Nothing is stored here: store
    the index (``sources.lexical_store``) where it is used more than once."""
    rows = block_rows(chunks, id_col, text_col, block)
    return of_rows(rows, frequencies(rows), sums(rows))


def of_rows(rows: DataFrame, frequencies: DataFrame, sums: DataFrame) -> LexicalIndex:
    totals = sums.withColumn("avg_length", F.try_divide(F.col("length"), F.col("n")))
    return LexicalIndex(rows, with_idf(frequencies, totals), totals)


def with_idf(frequencies: DataFrame, totals: DataFrame) -> DataFrame:
    """``ln((n - df + 0.5) / (df + 0.5))``; where that is negative, a quarter of its mean over all terms."""
    raw = frequencies.join(F.broadcast(totals.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, FLOOR * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


class Block:
    """The lists of a block's terms that are asked for, as ``{number: (places, tfs, bound of the part)}``, and what normalizes its chunks' counts."""

    def __init__(self, lengths: np.ndarray, average: float, barred: np.ndarray | None):
        self.norm = K1 * (1 - B + B * lengths / average)
        self.average, self.barred = average, barred
        self.lists: list[tuple[np.ndarray, np.ndarray, float]] = []
        self.parts: dict[int, np.ndarray] = {}  # of lists of many chunks a number for every chunk
        self.seen = self.looked_up = 0

    def add(self, places: np.ndarray, tfs: np.ndarray, most_tf: int, least_length: int) -> None:
        self.lists.append((places, tfs, most_tf * (K1 + 1) / (most_tf + K1 * (1 - B + B * least_length / self.average))))

    def dense(self, i: int) -> bool:
        return len(self.lists[i][0]) * 4 > len(self.norm)

    def part(self, i: int) -> np.ndarray:
        if i not in self.parts:
            places, tfs, _ = self.lists[i]
            own = tfs * (K1 + 1) / (tfs + self.norm[places])
            if self.dense(i):
                every = np.zeros(len(self.norm))
                every[places] = own
                own = every
            self.parts[i] = own
        return self.parts[i]

    def best(self, asked: list[tuple[float, int]], k: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores, to six places, of chunks that may be among the ``k`` best for ``(weight, list)`` of a question; those that tie with the last included. Scores
        below ``floor``, the last of the ``k`` best of other blocks, don't matter."""
        n = len(self.norm)
        score = np.zeros(n)
        if self.barred is not None:
            score[self.barred] = -np.inf
        # what lowers scores comes first, so that from there on they only grow
        order = sorted(asked, key=lambda x: (x[0] > 0, -x[0] * self.lists[x[1]][2]))
        bounds = np.array([max(0.0, w) * self.lists[i][2] for w, i in order])
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0.0)
        at, least = 0, floor
        if rest[0] < floor - ROOM:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        for at, (weight, i) in enumerate(order):
            places = self.lists[i][0]
            # counting is cheap where finding the k-th best isn't
            if weight > 0 and at and len(places) * 8 > n and n > k and (floor - ROOM > rest[at] or np.count_nonzero(score > rest[at] + ROOM) >= k):
                least = max(floor, float(np.partition(score, n - k)[n - k]))
                if least - ROOM > rest[at]:
                    break
            if self.dense(i):
                score += weight * self.part(i)
            else:
                score[places] += weight * self.part(i)
            self.seen += len(places)
        else:
            at = len(order)
        if at == len(order):
            least = max(floor, float(np.partition(score, n - k)[n - k])) if n > k else floor
            open_ = np.flatnonzero((score > 0) & (score >= least - ROOM))
        else:
            open_ = np.flatnonzero(score + rest[at] >= least - ROOM)
            for left, (weight, i) in enumerate(order[at:], at):
                if self.dense(i):
                    score[open_] += weight * self.part(i)[open_]
                else:
                    places = self.lists[i][0]
                    where = np.searchsorted(places, open_)
                    hit = where < len(places)
                    hit[hit] = places[where[hit]] == open_[hit]
                    score[open_[hit]] += weight * self.part(i)[where[hit]]
                self.looked_up += len(open_)
                if len(open_) > k:
                    own = score[open_]
                    least = max(least, float(np.partition(own, len(own) - k)[len(own) - k]))
                    open_ = open_[own + rest[left + 1] >= least - ROOM]
        found = np.round(score[open_], 6)
        if len(found) > k:
            kept = found >= np.partition(found, len(found) - k)[len(found) - k]
            open_, found = open_[kept], found[kept]
        return open_[found > 0], found[found > 0]


def _searcher(top_k: int, filtered: bool):
    """Searches a few blocks, as one as long as they have no more than ``TOGETHER`` chunks: what a question costs in a block besides its lists' length is paid once then. What the first ones gave lets later ones be passed over."""

    def blocks(table: pa.Table) -> Iterator[tuple[Block, pa.Array, dict]]:
        """Of blocks put together their lists, their ids, and the ``(weight, list)`` of each question."""
        kinds, numbers = np.array(table.column("kind").to_pylist()), table.column("block").to_numpy()
        column = lambda c: table.column(c).combine_chunks()
        places, tfs, all_ids, all_lengths, asking = (column(c) for c in ("places", "tfs", "ids", "lengths", "asking"))
        most, least = table.column("most_tf").to_pylist(), table.column("least_length").to_pylist()
        terms = column("term").dictionary_encode().indices.fill_null(-1).to_numpy()
        average = table.column("avg_length")[0].as_py()
        flat = lambda c, i: c[int(i)].values.to_numpy(zero_copy_only=False)
        order = np.lexsort((terms, numbers))
        held: list[tuple[np.ndarray, int, np.ndarray, pa.Array, np.ndarray]] = []  # of a block: its lists, where its places begin, lengths, ids, what is barred

        def together() -> tuple[Block, pa.Array, dict]:
            barred = np.concatenate([x[4] for x in held])
            block, questions = Block(np.concatenate([x[2] for x in held]), average, barred if barred.any() else None), {}
            lists, begins = np.concatenate([x[0] for x in held]), np.concatenate([np.full(len(x[0]), x[1], dtype=np.int32) for x in held])
            by_term = np.argsort(terms[lists], kind="stable")
            lists, begins = lists[by_term], begins[by_term]
            cuts = [0, *(np.flatnonzero(np.diff(terms[lists])) + 1).tolist(), len(lists)]
            for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                own = lists[i:j].tolist()
                block.add(np.concatenate([flat(places, x) + y for x, y in zip(own, begins[i:j])]), np.concatenate([flat(tfs, x) for x in own]), max(most[x] for x in own), min(least[x] for x in own))
                for x in asking[own[0]].as_py():
                    key = x["query_id"]
                    questions.setdefault(tuple(key.values()) if isinstance(key, dict) else key, (key, []))[1].append((x["weight"], k))
            return block, pa.concat_arrays([x[3] for x in held]), questions

        size = 0
        for own in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1):
            chunks, lists = own[kinds[own] == CHUNKS], own[kinds[own] == LIST]
            if not len(chunks) or not len(lists) or not average:
                continue
            lengths = flat(all_lengths, chunks[0])
            barred = np.full(len(lengths), filtered)
            for i in own[kinds[own] == KEPT]:
                barred[flat(places, i)] = False
            for i in own[kinds[own] == DEAD]:
                barred[flat(places, i)] = True
            if barred.all():
                continue
            if held and size + len(lengths) > TOGETHER:
                yield together()
                held, size = [], 0
            held.append((lists, size, lengths, all_ids[int(chunks[0])].values, barred))
            size += len(lengths)
        if held:
            yield together()

    def best(table: pa.Table) -> pa.Table:
        give_back()
        table = table.combine_chunks()
        query_type, id_type = table.schema.field("asking").type.value_type.field("query_id").type, table.schema.field("ids").type.value_type
        found: dict = {}  # of each question: itself, and its best as (-score, whether there is an id, id)
        for block, ids, questions in blocks(table):
            for name, (key, asked) in questions.items():
                held = found.setdefault(name, (key, []))[1]
                at, scores = block.best(asked, top_k, -held[-1][0] if len(held) == top_k else 0.0)
                if len(at):
                    held += [(-s, i is not None, i) for s, i in zip(scores.tolist(), ids.take(pa.array(at)).to_pylist())]
                    held.sort()
                    del held[top_k:]
        rows = [(key, x[2], -x[0]) for key, held in found.values() for x in held]
        keys, ids, scores = zip(*rows) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(keys, query_type), "chunk_id": pa.array(ids, id_type), "score": pa.array(scores, pa.float64())})

    return best


class Lane:
    """The lists of a lane's chunks, for many questions one after the other. ``of``: by ``TURNS`` the batches of its chunks' rows, of places kept and deleted, and of lists by term and block."""

    def __init__(self, of: list[list[pa.RecordBatch]], average: float, filtered: bool):
        chunks, flat = pa.Table.from_batches(of[0]), lambda x: x.flatten().to_numpy(zero_copy_only=False)
        blocks, sizes = chunks.column("block").to_numpy(), pc.list_value_length(chunks.column("ids")).to_numpy()
        begins = np.cumsum(sizes) - sizes
        base = lambda batch: np.repeat(begins[np.searchsorted(blocks, batch.column("block").to_numpy())], pc.list_value_length(batch.column("places")).to_numpy())
        lengths, self.ids = (chunks.column(c).combine_chunks().flatten() for c in ("lengths", "ids"))
        self.n = n = len(lengths)
        #: Places of the ids in their order, null first.
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[pc.sort_indices(self.ids, null_placement="at_start").to_numpy()] = np.arange(n)
        barred = np.full(n, filtered)
        for turn in (1, 2):
            for batch in of[turn]:
                barred[flat(batch.column("places")) + base(batch)] = turn == 2
        self.barred = np.flatnonzero(barred)
        norm, lists = K1 * (1 - B + B * lengths.to_numpy() / average), of[3]
        empty = pa.array([], pa.string())
        coded = pa.chunked_array([b.column("term") for b in lists] or [empty]).combine_chunks().dictionary_encode()
        self.terms = coded.dictionary
        self.places, self.parts, sizes = [np.zeros(0, dtype=np.intp)], [np.zeros(0)], [np.zeros(0, dtype=np.int64)]
        while lists:
            batch = lists.pop(0)
            places, tfs = flat(batch.column("places")) + base(batch).astype(np.intp), flat(batch.column("tfs"))
            sizes.append(pc.list_value_length(batch.column("places")).to_numpy())
            self.places.append(places)
            self.parts.append(tfs * (K1 + 1) / (tfs + norm[places]) * np.repeat(batch.column("idf").to_numpy(), sizes[-1]))
        self.places, self.parts = np.concatenate(self.places), np.concatenate(self.parts)
        df = np.bincount(coded.indices.to_numpy(), np.concatenate(sizes), len(self.terms)).astype(np.int64)
        self.starts = np.append(0, np.cumsum(df)).tolist()
        #: Of a frequent word a number for every chunk.
        self.frequent: dict[int, np.ndarray] = {}
        for t in np.flatnonzero(df * FREQUENT > n).tolist():
            own = slice(self.starts[t], self.starts[t + 1])
            self.frequent[t] = np.zeros(n)
            self.frequent[t][self.places[own]] = self.parts[own]

    def best(self, asked: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores, to six places, of the ``k`` best for ``(term, how often)`` of a question; of equals those with the least ids. All scores are added up: passing over some
        costs more here than it saves."""
        own = [(slice(self.starts[t], self.starts[t + 1]), times) for t, times in asked if t not in self.frequent]
        if own:
            score = np.bincount(np.concatenate([self.places[x] for x, _ in own]), np.concatenate([self.parts[x] if times == 1 else times * self.parts[x] for x, times in own]), self.n)
        else:
            score = np.zeros(self.n)
        for t, times in asked:
            if t in self.frequent:
                score += self.frequent[t] if times == 1 else times * self.frequent[t]
        score[self.barred] = -np.inf
        # the k-th of the best of groups of chunks is no more than the k-th best
        groups = self.n // 64
        some = score[: groups * 64].reshape(64, groups).max(axis=0) if groups >= 8 * k else score
        least = float(np.partition(some, len(some) - k)[len(some) - k]) if len(some) > k else 0.0
        open_ = np.flatnonzero(score >= max(least - ROOM, ROOM / 8))
        found = np.round(score[open_], 6)
        if len(found) > k:
            first = np.lexsort((self.rank[open_], -found))[:k]
            open_, found = open_[first], found[first]
        return open_[found > 0], found[found > 0]

    def answers(self, rows: pa.RecordBatch, k: int) -> pa.RecordBatch:
        words = pc.split_pattern(rows.column("words"), " ")
        codes = pc.index_in(words.flatten(), self.terms)
        asking = np.repeat(np.arange(len(rows)), pc.list_value_length(words).to_numpy())[codes.is_valid().to_numpy(zero_copy_only=False)]
        pairs, times = np.unique(asking * len(self.terms) + codes.drop_null().to_numpy(), return_counts=True)
        asking, terms = np.divmod(pairs, max(1, len(self.terms)))
        ends = np.cumsum(np.bincount(asking, minlength=len(rows))).tolist()
        asked, begin, best = list(zip(terms.tolist(), times.tolist())), 0, []
        for end in ends:
            best.append(self.best(asked[begin:end], k) if end > begin else (np.zeros(0, dtype=np.int64), np.zeros(0)))
            begin = end
        at = np.repeat(np.arange(len(rows)), [len(x[0]) for x in best])
        places, scores = (np.concatenate(x) for x in zip(*best))
        return pa.RecordBatch.from_arrays([rows.column("query_id").take(pa.array(at)), self.ids.take(pa.array(places)), pa.array(scores)], names=["query_id", "chunk_id", "score"])


def _in_lanes(batches: Iterator[pa.RecordBatch], top_k: int, average: float, filtered: bool) -> Iterator[pa.RecordBatch]:
    """Rows come by lane and turn, so that a lane's lists are there before its questions."""
    give_back()
    lane, of, own = -1, [], None
    for batch in batches:
        lanes, turns = batch.column("lane").to_numpy(), batch.column("turn").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(lanes) != 0) | (np.diff(turns) != 0)) + 1).tolist(), len(batch)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if lanes[i] != lane:
                lane, of, own = lanes[i], [[] for _ in TURNS], None
            if turns[i] + 1 < len(TURNS):
                of[turns[i]].append(batch.slice(i, j - i))
            elif of[0] and average:
                if own is None:
                    own = Lane(of, average, filtered)
                    give_back()
                yield own.answers(batch.slice(i, j - i), top_k)


def _search_many(index: LexicalIndex, queries: DataFrame, top_k: int) -> DataFrame:
    """``(query_id, chunk_id, score)``: the best of each lane. A question goes to each lane once, as its words; words' weights come with the lists."""
    spark = queries.sparkSession
    asked = queries.groupBy("query_id").agg(F.array_join(F.flatten(F.collect_list(tokens(F.col("question")))), " ").alias("words")).where("words <> ''")
    wanted = asked.select(F.explode(F.split("words", " ")).alias("term")).distinct()
    some = F.broadcast if wanted.limit(MOST_TERMS + 1).count() <= MOST_TERMS else lambda df: df
    total = index.totals.first()
    lanes = max(1, -(-total.n // LANE), min(LANES_A_CORE * spark.sparkContext.defaultParallelism, -(-total.n // SMALL_LANE)))
    known = index.terms.select("term", "idf").join(wanted, "term", "left_semi")
    rows = index.rows.join(some(known), "term", "left").where("idf IS NOT NULL OR term IS NULL")
    # a block's number is made of its place in a task, the task and the segment; each is spread over the lanes
    number = lambda shift, bits: F.shiftrightunsigned("block", shift).bitwiseAND((1 << bits) - 1)
    lane = F.pmod(31 * number(0, 20) + number(20, 12) + number(32, 12) + 5 * number(44, 20), F.lit(lanes)).cast("int").alias("lane")
    turn = F.array_position(F.array(*map(F.lit, TURNS)), F.col("kind")).cast("int") - 1
    kind = dict(index.rows.dtypes)
    # empty lists, not null ones: Spark goes through a batch's last nulls for every row that it adds
    full = lambda c: F.coalesce(F.col(c), F.array().cast(kind[c])).alias(c)
    arrays = ["places", "tfs", "ids", "lengths"]
    lists = rows.select(lane, turn.alias("turn"), "block", "term", "idf", *map(full, arrays))
    questions = asked.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(len(TURNS) - 1).alias("turn"), "query_id", "words", *(F.array().cast(kind[c]).alias(c) for c in arrays))
    dealt = lists.unionByName(questions, allowMissingColumns=True).repartitionById(lanes, "lane").sortWithinPartitions("lane", "turn", "term", "block")
    types = dict(asked.dtypes)["query_id"], kind["ids"].removeprefix("array<")[:-1]
    return dealt.mapInArrow(partial(_in_lanes, top_k=top_k, average=total.avg_length, filtered=index.filtered), f"query_id {types[0]}, chunk_id {types[1]}, score double")


def search(index: LexicalIndex, queries: DataFrame, top_k: int = 10, query_id: str = "query_id", question: str = "question") -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: scores above zero, to six places, the best ``top_k`` of each question. A
    repeated word of a question counts each time. Before the last sort there are at most ``top_k`` rows for each question and
    ``BLOCK`` chunks: small blocks are searched by one task."""
    queries = queries.select(F.col(query_id).alias("query_id"), F.col(question).alias("question"))
    if queries.limit(MANY).count() == MANY:
        return ranked(_search_many(index, queries, top_k), top_k)
    asked = queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = asked.select("term").distinct().limit(MOST_TERMS + 1).toArrow().column("term")
    few = len(wanted) <= MOST_TERMS
    some = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    weighted = some(asked).join(index.terms.select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
    # a block is searched for so many questions at once that its task stays small
    parts = asked.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / ASKED_AT_ONCE)).alias("parts"))
    dealt = weighted.join(F.broadcast(parts)).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")))
    by_term = dealt.groupBy("part", "term").agg(F.collect_list(F.struct("query_id", "weight")).alias("asking"))
    rows = index.rows
    if few and len(wanted) <= PUSHED_TERMS:
        rows = rows.where(F.col("term").isNull() | F.col("term").isin(wanted.to_pylist()))
    lists = rows.join(some(by_term), "term", "left").where("asking IS NOT NULL OR term IS NULL")
    every = lists.join(F.broadcast(parts)).withColumn("part", F.explode(F.when(F.col("part").isNull(), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("part"))))
    lanes = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).alias("lanes")
    grouped = every.join(F.broadcast(index.totals.select("avg_length", lanes))).withColumn("lane", F.pmod(F.xxhash64("block"), F.col("lanes")))
    grouped = grouped.select("part", "lane", "block", "kind", "term", "most_tf", "least_length", "places", "tfs", "ids", "lengths", "asking", "avg_length")
    types = dict(asked.dtypes)["query_id"], dict(index.rows.dtypes)["ids"].removeprefix("array<")[:-1]
    found = grouped.groupBy("part", "lane").applyInArrow(_searcher(top_k, index.filtered), f"query_id {types[0]}, chunk_id {types[1]}, score double")
    # columns of their own, as Spark doesn't tell the two sides of a self-join of such groups apart
    return ranked(found.select(*(F.col(c).alias(c) for c in found.columns)), top_k)


def ranked(scored: DataFrame, top_k: int | None) -> DataFrame:
    """``rank`` from 1 by falling score, equals by chunk id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if top_k is None else out.where(F.col("rank") <= top_k)
