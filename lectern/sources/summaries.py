"""Figures of a stored table, kept beside it and added up instead of scanning it.

Each change of the table writes a summary into a folder of its own (``batch=<id>``, so that the same change again counts once): by some columns the number of rows that came, and sums over
them; of rows that go the same with a minus. Which values a column has follows from the groups that have rows left. So summaries grow with groups and
changes, not with rows, and ``compact`` makes one of all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def summary(rows: DataFrame, keys: list[str], sums: dict[str, str], gone: bool = False) -> DataFrame:
    """``(keys, n, sums)`` of rows that came, or went. ``sums`` names expressions; nulls add nothing."""
    sign = -1 if gone else 1
    return rows.groupBy(*keys).agg((F.count(F.lit(1)) * sign).alias("n"), *((F.coalesce(F.sum(F.expr(e)), F.lit(0)) * sign).cast("long").alias(name) for name, e in sums.items()))


def record(rows: DataFrame, path: str, batch: str, keys: list[str], sums: dict[str, str], gone: bool = False) -> None:
    """Writes what a change of the table adds to its figures, or takes off."""
    summary(rows, keys, sums, gone).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _batches(spark: SparkSession, path: str) -> list[str]:
    where, fs = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    done = lambda n: fs.exists(_files(spark, f"{path}/{n}/_SUCCESS")[0])
    return sorted(n for n in names if n.startswith("batch=") and done(n))


def merged(spark: SparkSession, path: str, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """``(keys, n, sums)`` of the groups that have rows left."""
    rows = spark.read.parquet(*(f"{path}/{n}" for n in _batches(spark, path)))
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in sums)).where("n <> 0")


def compact(spark: SparkSession, path: str, keys: list[str], sums: dict[str, str], into: str) -> None:
    """All summaries as the one of batch ``into``, which has none yet. No change may be recorded meanwhile, and one that came before isn't to be repeated afterwards."""
    old = _batches(spark, path)
    merged(spark, path, keys, sums).coalesce(1).write.mode("overwrite").parquet(f"{path}/_next")
    for n in old:
        where, fs = _files(spark, f"{path}/{n}")
        fs.delete(where, True)
    where, fs = _files(spark, f"{path}/_next")
    fs.rename(where, _files(spark, f"{path}/batch={into}")[0])


#: What is kept of an index's chunks, and of catalog entries.
CHUNK_KEYS, CHUNK_SUMS = ["index_name", "content_type", "section_id"], {"embeddings": "int(embedding IS NOT NULL)"}
CATALOG_KEYS, CATALOG_SUMS = ["index_name"], {"bytes": "file_size", "chunks": "chunk_count"}


def search_stats(figures: DataFrame, has_lexical: bool = True, rrf_k: int = 60) -> DataFrame:
    """As ``store.search_stats``, of ``merged`` figures by ``CHUNK_KEYS``."""
    zero = F.lit(0).cast("long")
    return figures.agg(F.coalesce(F.sum("n"), zero).alias("total_documents"), F.coalesce(F.sum("embeddings"), zero).alias("total_embeddings"), F.lit(has_lexical).alias("has_bm25_index"), F.lit(rrf_k).alias("rrf_k_parameter"), F.array_sort(F.collect_set(F.coalesce("content_type", F.lit("unknown")))).alias("content_types"), F.array_sort(F.collect_set(F.when(F.col("section_id") != "", F.col("section_id")))).alias("sections"))


def catalog_stats(figures: DataFrame, shared: str, personal: str) -> DataFrame:
    """As ``catalog.statistics``, of ``merged`` figures by ``CATALOG_KEYS``."""
    zero = F.lit(0)
    some = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), zero).cast("long")
    return figures.agg(some(F.lit(True)).alias("total_documents"), F.round(F.coalesce(F.sum("bytes"), zero) / (1024 * 1024), 6).alias("total_size_mb"), F.coalesce(F.sum("chunks"), zero).cast("long").alias("total_chunks"), some(F.col("index_name") == shared).alias("shared_documents"), some(F.contains("index_name", F.lit(personal))).alias("personal_documents"))
