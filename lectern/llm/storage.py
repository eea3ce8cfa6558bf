"""Where the operators read tables and keep what must outlive an executor.

Everything a job writes goes to the folder in ``spark.checkpoint.dir``, which the driver and all
executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import fresh_dir


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; columns that a file lacks come back as an error from Spark."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """Cut the lineage: write once as Parquet to the shared folder, read from there afterwards."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``keep`` wrote, once everything made from it has been written too."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """``(pyarrow filesystem, path)`` of a URI or a plain path; used inside tasks."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
