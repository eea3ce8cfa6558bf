"""The register of documents: adding, selecting, deleting and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of indexes.
SHARED_INDEX = "pdf-qa-shared"
PERSONAL_PREFIX = "pdf-qa-personal-"
BUCKETS = 256


def user_index_id(user: Column, mapping: dict[str, str] | None = None) -> Column:
    """The mapped name, else the user's in lower case. ``mapping`` names the users whose index has another name."""
    named = F.element_at(F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)), user) if mapping else F.lit(None).cast("string")
    return F.coalesce(named, F.lower(user))


def index_name(user: Column, kind: Column, mapping: dict[str, str] | None = None) -> Column:
    """Name of the personal index of a user, or of the shared one."""
    personal = (kind == "personal") & (F.coalesce(user, F.lit("")) != "")
    return F.when(personal, F.concat(F.lit(PERSONAL_PREFIX), user_index_id(user, mapping))).otherwise(F.lit(SHARED_INDEX))


def add(catalog: DataFrame, new: DataFrame, key: str = "filename") -> DataFrame:
    """The catalog with new documents, whose ids go on from the greatest without gaps. Rows are numbered within
    ``BUCKETS`` buckets of a hash of ``key``, and a bucket's numbers follow those of the buckets before it, so no task sees all rows."""
    start = catalog.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_start"))
    rows = new.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over BUCKETS rows at most
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    numbered = rows.join(F.broadcast(offsets), "_bucket").join(F.broadcast(start)).withColumn("id", (F.col("_start") + F.col("_offset") + place).cast("long"))
    return catalog.unionByName(numbered.drop("_bucket", "_offset", "_start"), allowMissingColumns=True)


def of_user(catalog: DataFrame, user: str) -> DataFrame:
    return catalog.where(F.col("upload_user") == user)


def of_index(catalog: DataFrame, name: str) -> DataFrame:
    return catalog.where(F.col("index_name") == name)


def shared(catalog: DataFrame) -> DataFrame:
    return of_index(catalog, SHARED_INDEX)


def personal(catalog: DataFrame, user: str, mapping: dict[str, str] | None = None) -> DataFrame:
    return of_index(catalog, PERSONAL_PREFIX + (mapping or {}).get(user, user.lower()))


def by_id(catalog: DataFrame, id_: int) -> DataFrame:
    return catalog.where(F.col("id") == id_)


def delete(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Without the documents of ``requests`` (``id, upload_user``) that belong to who asks."""
    return catalog.join(requests.select("id", "upload_user").distinct(), ["id", "upload_user"], "left_anti")


def statistics(catalog: DataFrame) -> DataFrame:
    """One row: documents, megabytes, chunks, shared and personal documents."""
    zero = F.lit(0)
    return catalog.agg(F.count(F.lit(1)).alias("total_documents"), F.round(F.coalesce(F.sum("file_size"), zero) / (1024 * 1024), 6).alias("total_size_mb"), F.coalesce(F.sum("chunk_count"), zero).cast("long").alias("total_chunks"), F.count_if(F.col("index_name") == SHARED_INDEX).alias("shared_documents"), F.count_if(F.contains(F.col("index_name"), F.lit(PERSONAL_PREFIX))).alias("personal_documents"))


def listing(catalog: DataFrame, user: str | None = None, kind: str | None = None) -> DataFrame:
    """Documents by user and kind of index (``shared`` or ``personal``), newest first."""
    out = catalog if user is None else of_user(catalog, user)
    if kind == "shared":
        out = shared(out)
    elif kind == "personal":
        out = out.where(F.contains(F.col("index_name"), F.lit(PERSONAL_PREFIX)))
    return out.orderBy(F.desc("upload_date"), "id")


def placed(rows: DataFrame, keys: list[Column], name: str = "place") -> DataFrame:
    """Adds the place, from 1, by rising ``keys``, which no two rows share. Rows are dealt by a bounded sample of keys into ranges, which follow each other,
    so no task sees all rows, even where they agree in all keys but the last."""
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    marked = rows.withColumn("_key", key)
    sample = marked.select("_key").orderBy(F.xxhash64("_key")).limit(40 * BUCKETS).agg(F.array_sort(F.collect_list("_key")).alias("_all"))
    bounds = sample.select(F.filter("_all", lambda x, i: i % 40 == 39).alias("_bounds"))
    ranged = marked.join(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= F.col("_key")))).drop("_bounds")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over BUCKETS + 1 rows at most
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    return ranged.join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_offset") + own).cast("int")).drop("_key", "_range", "_offset")


def users(catalog: DataFrame) -> DataFrame:
    return catalog.select("upload_user").distinct()


def ingest_report(results: DataFrame) -> DataFrame:
    """By status and method: files, chunks, seconds, sections, documents with formulas and with tables."""
    zero = F.lit(0)
    return results.groupBy("status", "processing_method").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("chunks"), zero).cast("long").alias("total_chunks"), F.round(F.coalesce(F.sum("processing_time"), F.lit(0.0)), 6).alias("total_time"), F.coalesce(F.sum("sections"), zero).cast("long").alias("total_sections"), F.count_if("has_formulas").alias("formula_docs"), F.count_if("has_tables").alias("table_docs"))


def failures(results: DataFrame) -> DataFrame:
    return results.where("status = 'error'").select("file", F.coalesce("processing_method", F.lit("unknown")).alias("processing_method"), "error")
