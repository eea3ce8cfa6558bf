"""Laid-out pages as files: a line of JSON for each page, with blocks, their lines and the spans of these.

    {"doc_id": 7, "page_num": 1, "width": 500.0, "height": 800.0, "blocks": [{"type": "text", "lines": [{"spans": [
        {"text": "Some ", "size": 11.0, "flags": 0, "font": "serif", "bbox": {"x0": 0.0, "y0": 0.0, "x1": 40.0, "y1": 10.0}}]}]}]}

Files are read with a declared schema, so nothing is read to find it out. Plain files are split by lines; those written here are compressed (every span repeats the names of its fields) and of
a bounded number of pages instead. A line that isn't such a page
is set apart with its file (``bad_pages``) and doesn't end the job. Places within a block, and on a page, are those in the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
SPAN = f"struct<text: string, size: double, flags: int, font: string, bbox: {BOX}>"
PAGE = f"doc_id long, page_num int, width double, height double, blocks array<struct<type: string, lines: array<struct<spans: array<{SPAN}>>>>>"
BAD = "_bad"
#: Pages of a file that is written, at most.
FILE_PAGES = 5_000


def pages(spark: SparkSession, path: str) -> DataFrame:
    """All lines as pages, with what they hold in ``_bad`` where they aren't one, and ``file``."""
    rows = spark.read.schema(f"{PAGE}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("recursiveFileLookup", "true").json(path)
    fine = F.col("doc_id").isNotNull() & F.col("page_num").isNotNull() & F.col(BAD).isNull()
    return rows.withColumns({"file": F.input_file_name(), "is_page": fine})


def bad_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line)`` of lines that aren't pages; of a line that is JSON without a document or page what was understood of it."""
    rows = pages(spark, path).where("NOT is_page")
    return rows.select("file", F.coalesce(F.col(BAD), F.to_json(F.struct("doc_id", "page_num", "width", "height", "blocks"))).alias("line"))


def page_sizes(spark: SparkSession, path: str) -> DataFrame:
    return pages(spark, path).where("is_page").select("doc_id", "page_num", "width", "height")


def spans(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """``(doc_id, page_num, block_no, line_no, span_no, text, size, flags, font, bbox)`` of blocks of a type."""
    blocks = pages(spark, path).where("is_page").select("doc_id", "page_num", F.posexplode("blocks").alias("block_no", "block"))
    lines = blocks.where(F.col("block.type") == kind).select("doc_id", "page_num", "block_no", F.posexplode("block.lines").alias("line_no", "line"))
    return lines.select("doc_id", "page_num", "block_no", "line_no", F.posexplode("line.spans").alias("span_no", "span")).select("doc_id", "page_num", "block_no", "line_no", "span_no", "span.*")


def write(spans: DataFrame, path: str) -> None:
    """Spans as such files. Numbers of blocks, lines and spans become places, so they are to begin with 0 and leave no gap."""
    one = lambda rows: F.transform(F.array_sort(rows), lambda x: x["what"])
    gather = lambda place, what: one(F.collect_list(F.struct(F.col(place).alias("place"), what.alias("what"))))
    lines = spans.groupBy("doc_id", "page_num", "block_no", "line_no").agg(gather("span_no", F.struct("text", "size", "flags", "font", "bbox")).alias("spans"))
    blocks = lines.groupBy("doc_id", "page_num", "block_no").agg(gather("line_no", F.struct("spans")).alias("lines"))
    rows = blocks.groupBy("doc_id", "page_num").agg(gather("block_no", F.struct(F.lit("text").alias("type"), "lines")).alias("blocks"))
    write_pages(rows, path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages that hold their blocks as such files."""
    pages.write.mode("overwrite").option("ignoreNullFields", "false").option("compression", "gzip").option("maxRecordsPerFile", FILE_PAGES).json(path)
