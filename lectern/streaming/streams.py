"""Documents that keep arriving. The job writes through ``foreachBatch`` and may be given a batch again without effect.

What is stored lies in buckets by the low bits of a hash of its key (extendible hashing): a bucket named ``<depth>-<bits>`` has the keys whose hash ends with these
bits, and one that would come to hold more than ``most`` rows is split by further bits as it is written. So a batch of ``n`` rows writes ``n`` buckets of some ``most`` rows at worst, however large
the index has grown. A batch reads and writes the buckets that it has rows for, into a folder of
its own (``v=<batch>``), and then a list that says which folder holds each bucket's latest rows, and how many (``m=<batch>``).
The list before it is kept for readers; older lists, and folders that neither names, are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import store

#: Rows that a bucket is to have at most (keys whose hashes agree in ``DEEPEST`` bits stay together).
MOST = 100_000
DEEPEST = 30
SEED = 11


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str, kind: str) -> list[int]:
    where, fs = _files(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    done = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(where, f"{name}/_SUCCESS"))
    return sorted(int(n[2:]) for n in names if n.startswith(f"{kind}=") and done(n))


def _list(spark: SparkSession, path: str, before: int | None = None) -> dict[str, tuple[int, int]]:
    """Of each bucket the batch that wrote it last (before a batch), and its rows."""
    lists = [n for n in _numbers(spark, path, "m") if before is None or n < before]
    return {r.bucket: (r.version, r.n) for r in spark.read.parquet(f"{path}/m={lists[-1]}").collect()} if lists else {}


def _read(spark: SparkSession, path: str, held: dict[str, tuple[int, int]]) -> DataFrame | None:
    files = [f"{path}/v={v}/bucket={b}" for b, (v, n) in sorted(held.items()) if n]
    return spark.read.parquet(*files) if files else None


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """All that is stored."""
    return _read(spark, path, _list(spark, path))


def _named(depth: int, bits: int) -> str:
    return f"{depth}-{bits}"


def _in_buckets(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Adds the ``bucket`` of each row, of names that leave no gap."""
    spark = rows.sparkSession
    depths = sorted({int(n.split("-")[0]) for n in names})
    at = F.xxhash64(*keys, F.lit(SEED))
    own = F.explode(F.array(*(F.concat(F.lit(f"{d}-"), at.bitwiseAND((1 << d) - 1).cast("string")) for d in depths))).alias("bucket")
    # a row for each bucket, as in the list that is read whole for every batch
    return rows.select("*", own).join(F.broadcast(spark.createDataFrame([(n,) for n in names], "bucket string")), "bucket", "left_semi")


def _split(names: dict[str, int], most: int) -> list[str]:
    """Buckets of so many rows, those of more than ``most`` split by as many bits as bring them below."""
    out = []
    for name, n in names.items():
        depth, bits = map(int, name.split("-"))
        more = min(DEEPEST - depth, max(0, (-(-n // most) - 1).bit_length()))
        out += [_named(depth + more, bits | high << depth) for high in range(1 << more)]
    return out


def _run(rows: DataFrame, path: str, keys: list[str], prepare: Callable[[DataFrame, int], DataFrame], merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str, most: int) -> StreamingQuery:
    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = prepare(batch, number).persist()
        held = _list(spark, path, number)
        touched = {r.bucket: r.n for r in _in_buckets(new, keys, [*held] or [_named(0, 0)]).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # no more than the list
        if touched:
            old = {b: held.pop(b) for b in touched if b in held}
            merged = merge(_read(spark, path, old), new)
            names = _split({b: n + old.get(b, (0, 0))[1] for b, n in touched.items()}, most)
            located = _in_buckets(merged, keys, names)
            located.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")
            schema = located.schema
            counts = {r.bucket: r.n for r in spark.read.schema(schema).parquet(f"{path}/v={number}").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
            held |= {b: (number, counts.get(b, 0)) for b in names}
            spark.createDataFrame([(b, v, n) for b, (v, n) in sorted(held.items())], "bucket string, version long, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/m={number}")
        new.unpersist()
        lists = [n for n in _numbers(spark, path, "m") if n <= number]
        named = {v for n in lists[-2:] for v, _ in _list(spark, path, n + 1).values()}
        for kind, gone in (("m", lists[:-2]), ("v", [v for v in _numbers(spark, path, "v") if v < number and v not in named])):
            for n in gone:
                where, fs = _files(spark, f"{path}/{kind}={n}")
                fs.delete(where, True)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(blocks: DataFrame, path: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame], index: str = "pdf-qa-shared", most: int = MOST) -> StreamingQuery:
    """Streamed documents (or their blocks) are chunked by ``chunk``, which gets a batch as a table, and stored in an index by chunk id; what belongs to a document must arrive together."""
    prepare = lambda batch, number: chunk(batch).withColumns({"index_name": F.lit(index), "ingest_seq": F.lit(number).cast("long")})
    return _run(blocks, path, ["index_name", "chunk_id"], prepare, store.upsert, checkpoint, most)
