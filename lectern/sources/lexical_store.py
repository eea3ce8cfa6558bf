"""A lexical index kept in a folder, as segments that don't change.

``<path>/g=<generation>/segment=<n>`` holds ``rows`` (blocks of chunks and their terms' lists), ``terms(term, df)`` and ``totals(n, length)``, written
in that order: a segment counts once its totals are there. Adding chunks writes a segment of their own. Deleting chunk ids
writes one too: the places of these chunks in older blocks, and their part of the statistics, taken off; lists stay as they are.
Loading adds up the segments' statistics, so scores are those of an index built anew of the chunks that are left, and no text is read again.
``compact`` writes all segments into one of a new generation: small blocks are put together and deleted chunks leave the lists. The generation before it is
deleted by the next one, so that readers can finish.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import lexical

#: Blocks of a segment have numbers below 2^44; the segment's number goes above.
SHIFT = 44
#: Old blocks are put together within so many lanes.
LANES = 64


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    where, fs = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n.removeprefix(f"{kind}=")) for n in names if n.startswith(f"{kind}="))


def _complete(spark: SparkSession, path: str) -> list[int]:
    """Segments of a generation that are written whole."""
    done = lambda n: _folder(spark, f"{path}/segment={n}/totals/_SUCCESS")
    return [n for n in _numbers(spark, path, "segment") if (lambda x: x[1].exists(x[0]))(done(n))]


def generation(spark: SparkSession, path: str) -> int | None:
    """The latest one whose first segment is complete."""
    found = [g for g in _numbers(spark, path, "g") if 0 in _complete(spark, f"{path}/g={g}")]
    return found[-1] if found else None


def segments(spark: SparkSession, path: str) -> list[str]:
    """Folders of the segments that count."""
    g = generation(spark, path)
    return [] if g is None else [f"{path}/g={g}/segment={n}" for n in _complete(spark, f"{path}/g={g}")]


def _write(rows: DataFrame, folder: str, terms: DataFrame | None = None, totals: DataFrame | None = None) -> None:
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{folder}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/rows")
    (lexical.frequencies(stored) if terms is None else terms).write.mode("overwrite").parquet(f"{folder}/terms")
    (lexical.sums(stored) if totals is None else totals).coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")


def _new_generation(spark: SparkSession, path: str, rows: DataFrame) -> None:
    now = generation(spark, path)
    _write(rows, f"{path}/g={0 if now is None else now + 1}/segment=0")
    for g in _numbers(spark, path, "g"):
        if now is not None and g < now:
            where, fs = _folder(spark, f"{path}/g={g}")
            fs.delete(where, True)


def _next(spark: SparkSession, path: str) -> tuple[str, int]:
    g = generation(spark, path)
    if g is None:
        return f"{path}/g=0", 0
    return f"{path}/g={g}", _complete(spark, f"{path}/g={g}")[-1] + 1


def save(chunks: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "content") -> None:
    """An index of these chunks and no others; their texts are read once."""
    _new_generation(chunks.sparkSession, path, lexical.block_rows(chunks, id_col, text_col))


def add(chunks: DataFrame, path: str, id_col: str = "chunk_id", text_col: str = "content") -> None:
    """Further chunks, as a segment; the first if there is none. Ids that are there already are to be deleted before."""
    folder, n = _next(chunks.sparkSession, path)
    _write(lexical.block_rows(chunks, id_col, text_col), f"{folder}/segment={n}")


def delete(chunk_ids: DataFrame, path: str) -> None:
    """Takes chunks out. Read are the blocks' ids, and the lists of the blocks that hold one of them. Ids that aren't there do no harm."""
    spark = chunk_ids.sparkSession
    folder, n = _next(spark, path)
    rows = _rows(spark, path)
    if rows is None:
        return
    gone = lexical.LexicalIndex(rows, rows, rows).places().join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    before = rows.where(F.col("kind") == lexical.DEAD).select("block", F.explode("places").alias("place"))
    gone = gone.join(before, ["block", "place"], "left_anti").groupBy("block").agg(F.collect_list("place").alias("places"), F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"))
    dropped = gone.select("block", F.lit(lexical.DEAD).alias("kind"), "places", "n", "length")
    dropped.write.mode("overwrite").parquet(f"{folder}/segment={n}/rows")
    dead = spark.read.schema(dropped.schema).parquet(f"{folder}/segment={n}/rows")
    lists = rows.where(F.col("kind") == lexical.LIST).select("block", "term", "places")
    hit = lists.join(dead.select("block", F.col("places").alias("dead")), "block").select("term", F.size(F.array_intersect("places", "dead")).alias("n")).where("n > 0")
    hit.groupBy("term").agg((-F.sum("n")).alias("df")).write.mode("overwrite").parquet(f"{folder}/segment={n}/terms")
    zero = F.lit(0).cast("long")
    dead.agg((-F.coalesce(F.sum("n"), zero)).alias("n"), (-F.coalesce(F.sum("length"), zero)).alias("length")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/segment={n}/totals")


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of all segments, blocks numbered over all of them."""
    out = None
    for folder in segments(spark, path):
        rows = spark.read.parquet(f"{folder}/rows")
        number = int(folder.rsplit("=", 1)[1])
        if "ids" in rows.columns:
            rows = rows.withColumn("block", F.col("block") + F.lit(number << SHIFT))
        else:  # deletions name blocks as they are numbered over all segments
            rows = rows.select("block", "kind", "places")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def load(spark: SparkSession, path: str, chunks: DataFrame | None = None) -> lexical.LexicalIndex:
    """The stored index; one built anew of ``chunks`` where there is none. Other failures are raised."""
    rows = _rows(spark, path)
    if rows is None:
        if chunks is None:
            raise FileNotFoundError(path)
        return lexical.build_index(chunks)
    folders = segments(spark, path)
    read = lambda name, schema: spark.read.schema(schema).parquet(*(f"{f}/{name}" for f in folders))
    df = read("terms", "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    totals = read("totals", "n long, length long").agg(F.sum("n").alias("n"), F.sum("length").alias("length"))
    return lexical.of_rows(rows, df, totals)


def compact(spark: SparkSession, path: str, chunks_of_block: int = lexical.BLOCK) -> None:
    """All segments as one of a new generation. Old blocks are dealt into new ones by their running number of chunks, of which there is one for each block; a task merges the lists
    of one new block."""
    rows = _rows(spark, path)
    if rows is None:
        return
    sizes = rows.where(F.col("kind") == lexical.CHUNKS).select("block", F.size("ids").alias("size"))
    lane = F.pmod(F.xxhash64("block"), F.lit(LANES))
    running = F.sum("size").over(Window.partitionBy(lane).orderBy("block"))
    target = sizes.select("block", lane.alias("lane"), F.floor((running - 1) / chunks_of_block).alias("turn"))
    id_type = dict(rows.dtypes)["ids"]

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        own = key[0].as_py() << 32 | key[1].as_py()
        table = table.combine_chunks()
        column = lambda c: table.column(c).combine_chunks()
        kinds, blocks = np.array(table.column("kind").to_pylist()), column("block").to_numpy()
        places, tfs, ids, lengths = (column(c) for c in ("places", "tfs", "ids", "lengths"))
        flat = lambda c, i: c[int(i)].values.to_numpy(zero_copy_only=False)
        number, kept_ids, kept_lengths, n = {}, [], [], 0
        for i in sorted(np.flatnonzero(kinds == lexical.CHUNKS).tolist(), key=lambda i: blocks[i]):
            live = np.ones(len(ids[i].values), dtype=bool)
            for j in np.flatnonzero((kinds == lexical.DEAD) & (blocks == blocks[i])):
                live[flat(places, j)] = False
            new = np.where(live, np.cumsum(live) - 1 + n, -1)
            number[blocks[i]] = new
            n += int(live.sum())
            kept_ids.append(ids[i].values.filter(pa.array(live)))
            kept_lengths.append(flat(lengths, i)[live])
        size = np.concatenate(kept_lengths)
        by_term: dict[str, list[int]] = {}
        names = table.column("term").to_pylist()
        for i in np.flatnonzero(kinds == lexical.LIST).tolist():
            by_term.setdefault(names[i], []).append(i)
        out = {c: [] for c in ("kind", "term", "df", "most_tf", "least_length", "places", "tfs", "ids", "lengths")}

        def put(*values):
            for c, v in zip(out, values):
                out[c].append(v)

        put(lexical.CHUNKS, None, None, None, None, None, None, pa.concat_arrays(kept_ids), size)
        for term in sorted(by_term):
            at = np.concatenate([number[blocks[i]][flat(places, i)] for i in by_term[term]])
            tf = np.concatenate([flat(tfs, i) for i in by_term[term]])
            at, tf = at[at >= 0], tf[at >= 0]
            if len(at):
                order = np.argsort(at)
                at, tf = at[order], tf[order]
                put(lexical.LIST, term, len(at), int(tf.max()), int(size[at].min()), at.astype(np.int32), tf, None, None)
        types = table.schema
        arrays = [pa.array([own] * len(out["kind"]), pa.int64()), *(pa.array(v, types.field(c).type) if c != "ids" else pa.array([None if x is None else x.to_pylist() for x in v], types.field(c).type) for c, v in out.items())]
        return pa.Table.from_arrays(arrays, names=["block", *out])

    numbers = "array<int>"
    merged = rows.join(target, "block").groupBy("lane", "turn").applyInArrow(merge, f"block long, kind string, term string, df int, most_tf int, least_length int, places {numbers}, tfs {numbers}, ids {id_type}, lengths {numbers}")
    _new_generation(spark, path, merged)
