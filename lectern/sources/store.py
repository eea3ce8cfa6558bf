"""Stored tables: chunk vectors in named indexes, citations. The lexical index is in ``lexical_store``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_BYTES = 50 * 1024 * 1024


def admit(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Files with ``accepted`` and, where they are too large, a ``reason``."""
    fits = F.col("file_size") <= most
    return files.withColumns({"accepted": fits, "reason": F.when(~fits, F.format_string("file too large: %.1f MB", F.col("file_size") / (1024 * 1024)))})


def files_in(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """Names and sizes of the files below a path, without reading them."""
    return admit(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("modified")), most)


def upsert(stored: DataFrame | None, new: DataFrame, keys: tuple[str, ...] = ("index_name", "chunk_id"), version: str = "ingest_seq") -> DataFrame:
    """One row for each key: that of the latest version."""
    both = new if stored is None else stored.unionByName(new, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(F.desc(version), *(F.col(c).desc() for c in ("document_id",) if c in both.columns))
    return both.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def vector_rows(chunks: DataFrame, embeddings: DataFrame, index: str | Column, user: str | None = None, sequence: int = 0) -> DataFrame:
    """Rows for an index (or for one by each row's own column): chunks joined to their embeddings, with who stored them and when."""
    name = F.lit(index) if isinstance(index, str) else index
    return chunks.join(embeddings.select("chunk_id", "embedding"), "chunk_id").withColumns({"index_name": name, "upload_user": F.lit(user).cast("string"), "upload_date": F.current_timestamp(), "ingest_seq": F.lit(sequence).cast("long")})


#: What searches filter by, within an index.
CLUSTERED = ["section_id", "content_type", "document_id"]


def write_indexes(vectors: DataFrame, path: str) -> None:
    """Replaces the indexes that ``vectors`` holds; others stay. An index is a folder; its files are ranges of section, type and document, so
    a filter on them leaves most files and row groups unread. A large index, or section, is several files."""
    order = ["index_name", *(c for c in CLUSTERED if c in vectors.columns), "chunk_id"]
    dealt = vectors.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index_name").parquet(path)


def read_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """An index that was written; the folders of others aren't opened."""
    return spark.read.parquet(path).where(F.col("index_name") == index)


def clear(vectors: DataFrame, index: str) -> DataFrame:
    return vectors.where(~F.col("index_name").eqNullSafe(F.lit(index)))


def sample(vectors: DataFrame, index: str, n: int = 5) -> DataFrame:
    """The first rows of an index by chunk id."""
    return vectors.where(F.col("index_name") == index).orderBy("chunk_id").limit(n)


def index_stats(vectors: DataFrame) -> DataFrame:
    """``(index_name, total_vectors, dimension)``."""
    return vectors.groupBy("index_name").agg(F.count(F.lit(1)).alias("total_vectors"), F.max(F.size("embedding")).alias("dimension"))


def index_names(vectors: DataFrame) -> DataFrame:
    return vectors.select("index_name").distinct()


def search_stats(chunks: DataFrame, has_lexical: bool = True, rrf_k: int = 60) -> DataFrame:
    """One row: chunks, embeddings, whether there is a lexical index, its constant, content types and sections."""
    return chunks.agg(F.count(F.lit(1)).alias("total_documents"), F.count("embedding").alias("total_embeddings"), F.lit(has_lexical).alias("has_bm25_index"), F.lit(rrf_k).alias("rrf_k_parameter"), F.array_sort(F.collect_set(F.coalesce("content_type", F.lit("unknown")))).alias("content_types"), F.array_sort(F.collect_set(F.when(F.col("section_id") != "", F.col("section_id")))).alias("sections"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share. Where a session on a single machine (tests) has none, one is made and set; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder of its own inside the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str = "kept") -> DataFrame:
    """Rows written to the shared folder and read from there: made once however often they are used, and of a size that Spark knows, so that few of them are sent
    to the scan of a large table they are joined with, and many aren't."""
    path = fresh_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def export_citations(citations: DataFrame, document_id=None) -> DataFrame:
    """Citations, of one document if asked, with their number and the time."""
    out = citations if document_id is None else citations.where(F.col("document_id") == F.lit(document_id))
    total = out.agg(F.count(F.lit(1)).alias("citation_count"))
    return out.join(F.broadcast(total)).withColumn("exported_at", F.current_timestamp())
