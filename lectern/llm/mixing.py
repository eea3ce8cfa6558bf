"""A mix of sources by target weights, drawn in blocks of words.

A source's words, in the order of its documents, are cut into blocks of ``block`` words. The mix is a number of shards of ``shard`` slots. How
many of a shard's slots each source gets is a multinomial draw, seeded by the shard's number. Slots of a source are numbered over all shards;
a slot's number in its epoch goes through a pseudorandom permutation of the source's full blocks (a Feistel network on the block numbers, one for
each source and epoch; the short block at a source's end comes last), and slots are joined to documents by source and
block. So no text is sorted at random and a block can be found without looking at others.

A source is to give its target in words, rounded, so it has a fixed number of slots, of which the last takes what is still missing. Draws
miss that number by about its square root: slots drawn beyond it go, in order, to the sources that got too few. A block is
therefore taken at most twice where a target stops at twice the source's size, and the words taken are the rounded target.

Documents are ordered and dealt by source, id and text, in ranges: a source with a third of all rows is many ranges, whose
sums make the documents' places. Where there are many sources, draws are made for groups of 1,024 sources first and then inside each.

Defined cases: null texts have size 0; a null source is one source, the last; documents without words are never taken; rows that share an id are
documents of their own, in the order of their texts; equal rows can't be told apart, so which of them is taken more often is left open; without any word all
targets are 0; an empty table gives no rows. Results depend on the rows and the seed alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.catalog import placed
from . import storage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Words of a block, slots of a shard.
BLOCK, SHARD = 512, 8192
SEED = 20
#: Sources that a multinomial draw is over at once.
GROUP = 1024
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds ``target`` to ``name, source_size, place``. Weights follow the places and share ``share`` of all sizes; where a target is above ``most`` times the source's
    size it stops there, and the excess is shared again among the others, until none is above."""
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    most_of = F.col("source_size") * F.lit(most)
    weighted = sources.select("*", weight.alias("weight"), most_of.alias("most"))
    total, heights = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1.0))).first()
    level, full = share * total / heights, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("most")
        n, stopped, open_ = weighted.agg(F.count_if(above), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == full or not open_:
            return weighted.withColumn("target", F.when(above, F.col("most")).otherwise(F.col("weight") * F.lit(level))).drop("weight", "most")
        full, level = n, (share * total - (stopped or 0.0)) / open_


def _documents(docs: DataFrame, id_col: str, text_col: str, source_col: str, with_text: bool) -> DataFrame:
    """Stored: ``part, at`` (rising within a part), ``id, name, source, size`` and the text if asked for. Names sort by code point, the null source last."""
    name = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), name.alias("name"), F.size(words(F.col(text_col))).cast("long").alias("size"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"), *([F.col(text_col).alias("text")] if with_text else []))
    # equal rows are dealt to several tasks too
    order = ["name", "id", "digest", F.monotonically_increasing_id()]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions("name", "id", "digest").drop("digest")
    return storage.keep(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "dealt")


def _sources(dealt: DataFrame, block: int, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Stored, by source: ``place`` from 1, ``target``, its blocks, slots, and the words of the last slot."""
    sizes = storage.keep(dealt.groupBy("name").agg(F.sum("size").alias("source_size")), "sizes")
    found = targets(placed(sizes, [F.col("name")]), weights, share, most)
    size, wanted = F.col("source_size"), F.floor(F.col("target") + 0.5)
    epochs = F.coalesce(F.floor(F.try_divide(wanted, size)), F.lit(0))
    rest = wanted - epochs * size
    out = found.select("name", "source_size", "place", "target", F.ceil(size / block).alias("blocks"), F.floor(size / block).alias("whole"), epochs.alias("epochs"), rest.alias("rest"), F.ceil(rest / block).alias("more"))
    out = out.select("*", (F.col("epochs") * F.col("blocks") + F.col("more")).alias("slots"), F.when(F.col("rest") > 0, F.col("rest") - (F.col("more") - 1) * block).alias("last_words"))
    kept = storage.keep(out.drop("epochs", "rest", "more"), "sources")
    storage.discard(sizes)
    return kept


def _draws(sources: DataFrame, shard: int, seed: int) -> DataFrame:
    """``(shard, place, n)``: how many of a shard's slots each source gets."""
    spark = sources.sparkSession
    def lists(key: str) -> list[Column]:
        pairs = F.array_sort(F.collect_list(F.struct(key, "slots")))
        return [F.transform(pairs, lambda x: x[key]).alias("keys"), F.transform(pairs, lambda x: x["slots"]).alias("weights")]

    grouped = sources.where("slots > 0").groupBy(F.floor((F.col("place") - 1) / GROUP).alias("group")).agg(*lists("place"), F.sum("slots").alias("slots"))
    tops = grouped.agg(*lists("group"))
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards = spark.range(-(-total // shard)).select(F.col("id").alias("shard"), F.least(F.lit(shard), F.lit(total) - F.col("id") * shard).alias("n"))

    def draw(salt: int):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for number, n, keys, weights, group in zip(*(frame[c] for c in ("shard", "n", "keys", "weights", "group"))):
                    rng = np.random.default_rng([seed, salt, int(number), int(group)])
                    counts = rng.multinomial(int(n), weights / weights.sum())
                    some = np.flatnonzero(counts)
                    out.append(pd.DataFrame({"shard": number, "member": np.asarray(keys)[some], "n": counts[some]}))
                yield pd.concat(out) if out else pd.DataFrame({"shard": [], "member": [], "n": []})

        return run

    schema = "shard long, member long, n long"
    of_groups = shards.join(F.broadcast(tops)).withColumn("group", F.lit(0)).mapInPandas(draw(0), schema)  # one row
    inside = of_groups.withColumnRenamed("member", "group").join(grouped.drop("slots"), "group").select("shard", "n", "keys", "weights", "group")
    return inside.mapInPandas(draw(1), schema).withColumnRenamed("member", "place")


def _slots(sources: DataFrame, shard: int, seed: int) -> tuple[DataFrame, list[DataFrame]]:
    """``(shard, place, k)``: slots with their numbers within the source, from 0, as many as each source is to have; and the stored tables that they depend on.
    What is numbered for a source in one task is a row for each shard."""
    draws = storage.keep(_draws(sources, shard, seed), "draws")
    before = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0))
    numbered = draws.withColumn("first", first).select("shard", "place", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("k"))
    marked = numbered.join(F.broadcast(sources.select("place", "slots")) if _few(sources) else sources.select("place", "slots"), "place")
    fine = marked.where("k < slots").select("shard", "place", "k")
    drawn = draws.groupBy("place").agg(F.sum("n").alias("drawn"))
    missing = sources.join(drawn, "place", "left").select("place", "slots", F.coalesce("drawn", F.lit(0)).alias("drawn")).where("drawn < slots")
    missing = missing.select("place", F.explode(F.sequence("drawn", F.col("slots") - 1)).alias("k"))
    spare = storage.keep(marked.where("k >= slots").select("shard", "place", "k"), "spare")
    given = placed(spare, [F.col("place"), F.col("k")], "number").select("shard", "number")
    wanted = storage.keep(missing, "wanted")
    wanting = placed(wanted, [F.col("place"), F.col("k")], "number")
    return fine.unionByName(given.join(wanting, "number").select("shard", "place", "k")), [draws, spare, wanted]


def _few(sources: DataFrame) -> bool:
    """Whether the table of sources may be sent to every task."""
    return sources.limit(100_001).count() <= 100_000


def permuted(numbers: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Each number below its size to another, one to one for each key: four Feistel rounds on enough bits, again while the result isn't below the size."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64) + 1) // 2)
    half = np.where((np.int64(1) << (2 * half)) < sizes, half + 1, half).astype(np.uint64)
    mask, keys = (np.uint64(1) << half) - np.uint64(1), keys.astype(np.uint64)
    out, open_ = numbers.astype(np.uint64), np.arange(len(numbers))
    with np.errstate(over="ignore"):
        while len(open_):
            h, m, key = half[open_], mask[open_], keys[open_]
            left, right = out[open_] >> h, out[open_] & m
            for turn in range(4):
                x = (right + key + np.uint64(turn * 0x632BE5AB)) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & m)
            out[open_] = left << h | right
            open_ = open_[out[open_] >= sizes[open_].astype(np.uint64)]
    return out.astype(np.int64)


def _indexed(slots: DataFrame, sources: DataFrame, block: int, seed: int) -> DataFrame:
    """Adds the block that a slot takes, its epoch, and how many of the block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, place, k, size, blocks, whole, slots, last = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            epoch, at = k // blocks, k % blocks
            index = np.where(at < whole, 0, whole)
            inner = np.flatnonzero(at < whole)
            key = (place * np.int64(1_000_003) + epoch) * np.int64(1_000_003) + seed
            index[inner] = permuted(at[inner], whole[inner], key[inner])
            length = np.minimum(block, size - index * block)
            length = np.where((k == slots - 1) & (last > 0), last, length)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (shard, place, k, epoch, index, length)], names=["shard", "place", "k", "epoch", "index", "length"])

    table = sources.select("place", "source_size", "blocks", "whole", "slots", F.coalesce("last_words", F.lit(0)).alias("last"))
    joined = slots.join(F.broadcast(table) if _few(sources) else table, "place").select("shard", "place", "k", "source_size", "blocks", "whole", "slots", "last")
    return joined.mapInArrow(run, "shard long, place long, k long, epoch long, index long, length long")


def _pieces(dealt: DataFrame, sources: DataFrame, block: int, with_text: bool) -> DataFrame:
    """``(place, index, at, start, n)``: the words of a document that lie in a block, with the text if asked for."""
    parts = dealt.groupBy("name", "part").agg(F.sum("size").alias("sum"))
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("name", "part", F.coalesce(F.sum("sum").over(before(Window.partitionBy("name").orderBy("part"))), F.lit(0)).alias("offset"))  # a row for each range
    own = F.coalesce(F.sum("size").over(before(Window.partitionBy("name", "part").orderBy("at"))), F.lit(0))
    rows = dealt.where("size > 0").withColumn("own", own).join(offsets, ["name", "part"]).withColumn("begin", F.col("own") + F.col("offset"))
    rows = rows.join(F.broadcast(sources.select("name", "place")) if _few(sources) else sources.select("name", "place"), "name")
    index = F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block)))
    if not with_text:
        cut = rows.select("place", "at", "begin", "size", index.alias("index"))
    else:
        def part(i: Column) -> Column:
            first = F.greatest(i * block, F.col("begin")) - F.col("begin")
            last = F.least((i + 1) * block, F.col("begin") + F.col("size")) - F.col("begin")
            return F.struct(i.alias("index"), F.array_join(F.slice("words", (first + 1).cast("int"), (last - first).cast("int")), " ").alias("text"))

        every = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))
        cut = rows.withColumn("words", words(F.col("text"))).select("place", "at", "begin", "size", F.explode(F.transform(every, part)).alias("x")).select("place", "at", "begin", "size", "x.index", "x.text")
    start = F.greatest(F.lit(0), F.col("begin") - F.col("index") * block)
    end = F.least(F.lit(block), F.col("begin") + F.col("size") - F.col("index") * block)
    return cut.select("place", "index", "at", start.alias("start"), (end - start).alias("n"), *(["text"] if with_text else []))


class Mix:
    """``documents``, ``sources`` and the drawn ``slots``, all stored."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, with_text: bool = True):
        self.id_col, self.block, self.seed, self.with_text = id_col, block, seed, with_text
        self.documents = _documents(docs, id_col, text_col, source_col, with_text)
        self.sources = _sources(self.documents, block, weights, share, most)
        slots, steps = _slots(self.sources, shard, seed)
        self.slots = storage.keep(_indexed(slots, self.sources, block, seed), "slots")
        storage.discard(*steps)

    def pieces(self) -> DataFrame:
        """``(shard, place, k, epoch, index, at, start, used)``, with text if there is any: what each slot takes of each document."""
        joined = self.slots.join(_pieces(self.documents, self.sources, self.block, self.with_text), ["place", "index"])
        return joined.withColumn("used", F.least("n", F.col("length") - F.col("start"))).where("used > 0").drop("n")

    def blocks(self) -> DataFrame:
        """``(shard, slot, source, n_words, text)``: the mix itself. A shard's slots are in a pseudorandom order."""
        if not self.with_text:
            raise ValueError("made without text")
        short = F.when(F.col("used") < F.size(F.split("text", " ")), F.array_join(F.slice(F.split("text", " "), 1, F.col("used").cast("int")), " ")).otherwise(F.col("text"))
        rows = self.pieces().withColumn("text", short).groupBy("shard", "place", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "at", "text"))), lambda x: x["text"]), " ").alias("text"), F.sum("used").alias("n_words"))
        order = Window.partitionBy("shard").orderBy(F.xxhash64("place", "k", F.lit(self.seed)), "place", "k")
        names = self.sources.select("place", F.when(F.startswith("name", F.lit("s")), F.substring("name", 2, 1 << 30)).alias("source"))
        return rows.withColumn("slot", F.row_number().over(order) - 1).join(names, "place").select("shard", "slot", "source", "n_words", "text")

    def write(self, path: str) -> None:
        """The mix as Parquet, shards in order."""
        self.blocks().repartitionByRange("shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").option("compression", "zstd").parquet(path)

    def taken(self) -> DataFrame:
        """``(id, size, source_size, target, taken)`` of every document: ``taken`` are its words in the mix, repeats counted."""
        sums = self.pieces().groupBy("at").agg(F.sum("used").alias("taken"))
        rows = self.documents.select("at", F.col("id").alias(self.id_col), "name", "size")
        table = self.sources.select("name", "source_size", "target")
        out = rows.join(F.broadcast(table) if _few(self.sources) else table, "name").join(sums, "at", "left")
        return out.select(self.id_col, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
