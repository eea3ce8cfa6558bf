"""The given tables in the roles of the operators' inputs: documents as chunks, lines as blocks, events and conversations as messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import layout

PEOPLE = ["Ann Smith", "Bob Jones", "Carl M. Quinn", "Dora 2 Lind"]
PAGE_LINES = 20
BLOCK_LINES = 4
COMMON_TERMS = ["the", "that", "and", "der", "und", "les", "que", "tion", "for", "with"]
QUERY_STEP = 50  # searches take every row whose id is divisible by this


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chunk_id, content)``: a document is a chunk."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chunk_id, content, lang, source, section_id, content_type, embedding)``; a document is a chunk, its vector that of the same number, if there is one."""
    docs = read(spark, sf_dir, "documents")
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "lang", "source", F.col("source").alias("section_id"), F.col("lang").alias("content_type")).join(vectors, "chunk_id", "left")


def questions(spark: SparkSession, sf_dir: str, with_vectors: bool = False) -> DataFrame:
    """``(query_id, question[, embedding])``: benchmark texts, with the vector of the same number."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    if not with_vectors:
        return asked
    return asked.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "left")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, page_num, block_no, block_type, text, bbox)``: lines as blocks, twenty to a page, ten points high."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    y = (F.col("block_no") % PAGE_LINES * 10).cast("double")
    box = F.struct(F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 10).alias("y1"))
    return lines.select("doc_id", (F.floor(F.col("block_no") / PAGE_LINES) + 1).cast("int").alias("page_num"), "block_no", F.lit("text").alias("block_type"), "text", box.alias("bbox"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as spans whose size follows from their length, so that some stand out."""
    return blocks(spark, sf_dir).select("doc_id", "page_num", "block_no", F.lit(0).alias("line_no"), F.lit(0).alias("span_no"), "text", (F.lit(9.0) + F.length("text") % 7).alias("size"), F.lit(0).alias("flags"), F.lit("serif").alias("font"), "bbox")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lines as section starts: ``(doc_id, section_seq, section_id, title, page_num, y)``."""
    short = blocks(spark, sf_dir).where(F.length("text").between(3, 60))
    number = F.concat((F.col("block_no") % 4 + 1).cast("string"), F.when(F.col("block_no") % 3 == 1, ".1").when(F.col("block_no") % 3 == 2, ".1.2").otherwise(""))
    return short.select("doc_id", F.col("block_no").alias("section_seq"), number.alias("section_id"), F.col("text").alias("title"), "page_num", F.col("bbox")["y0"].alias("y"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as catalog entries: sources as users, each third in the shared index."""
    docs = read(spark, sf_dir, "documents")
    index = F.when(F.col("doc_id") % 3 == 0, "pdf-qa-shared").otherwise(F.concat(F.lit("pdf-qa-personal-"), F.col("source")))
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("upload_user"), F.col("n_chars").alias("file_size"), F.ceil(F.col("n_chars") / 1000).alias("chunk_count"), index.alias("index_name"))


def messages(spark: SparkSession, sf_dir: str, by_day: bool) -> DataFrame:
    """Events as messages; a conversation is a user's day, or all of a user's events."""
    events = read(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    conversation = F.date_format("ts", "yyyy-MM-dd") if by_day else user
    return events.select(user.alias("username"), conversation.alias("conversation_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.col("props").alias("content"), "ts")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, page_num, page_text)``: pages of lines, the first below a head like that of a paper, made of the document's own values."""
    docs = read(spark, sf_dir, "documents")
    n, doc = F.col("n_chars"), F.col("doc_id").cast("string")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    year = F.concat(F.lit("20"), F.lpad((F.col("doc_id") % 25).cast("string"), 2, "0"))
    head = F.concat_ws(
        "\n",
        F.when(n % 4 != 0, F.concat(F.lit("Title: Study "), doc, F.lit(" of "), F.col("source"))),
        F.concat(F.lit("By: Dr. "), pick(PEOPLE, n), F.lit(", "), pick(PEOPLE, n + 1), F.lit(" and "), pick(PEOPLE, F.col("doc_id")), F.lit(" & X1")),
        F.when(n % 3 != 0, F.concat(F.lit("Abstract\n"), F.regexp_replace(F.substring("text", 1, 700), "\n", " "), F.lit(". First. Second."))),
        F.concat(F.lit("Keywords: lang "), F.col("lang"), F.lit(", "), F.col("source"), F.lit("; que")),
        F.when(n % 2 == 0, F.concat(F.lit("Journal: Annals of "), F.col("source"))).otherwise(F.concat(F.lit("Quarterly Review of "), F.col("lang"), F.lit(", Vol. 3"))),
        F.when(n % 5 != 0, F.concat(F.lit("DOI: 10.1000/"), doc)),
        F.when(n % 3 == 0, F.concat(F.lit("Published: March "), year)).when(n % 3 == 1, F.concat(F.lit("Revised: "), year, F.lit("-05-17"))),
    )
    pages = layout.page_texts(blocks(spark, sf_dir)).join(docs.select("doc_id", head.alias("head")), "doc_id")
    return pages.select("doc_id", "page_num", F.when(F.col("page_num") == 1, F.concat("head", F.lit("\n"), "page_text")).otherwise(F.col("page_text")).alias("page_text"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, path, page_count, pdf_meta)``: documents as files with properties, of which some have a title and a date."""
    n, doc = F.col("n_chars"), F.col("doc_id").cast("string")
    meta = F.map_filter(F.create_map(F.lit("title"), F.when(n % 2 == 0, F.concat(F.lit("Property title "), doc)), F.lit("author"), F.col("source"), F.lit("creationDate"), F.when(n % 7 == 0, F.concat(F.lit("D:2020"), doc))), lambda k, v: v.isNotNull())
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/in/"), F.col("source"), F.lit("/file"), doc, F.lit(".pdf")).alias("path"), F.size(F.split("text", "\n")).alias("page_count"), meta.alias("pdf_meta"))


def word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as spans (each with a space after it), lines as lines, four of them to a block."""
    lines = blocks(spark, sf_dir)
    words = lines.select("doc_id", "page_num", F.floor(F.col("block_no") / BLOCK_LINES).cast("int").alias("block_no"), (F.col("block_no") % BLOCK_LINES).alias("line_no"), "bbox", F.posexplode(F.split("text", " ")).alias("span_no", "word"))
    return words.select("doc_id", "page_num", "block_no", "line_no", "span_no", F.concat("word", F.lit(" ")).alias("text"), "bbox")


def laid_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, page_num, blocks)``: the same as pages that hold blocks, their lines and the spans of these. A page is cut from its document's row."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    cut = lambda rows, n: F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / n).cast("int")), lambda i: F.slice(rows, i * n + 1, n))
    pages = lines.select("doc_id", F.posexplode(cut(F.col("lines"), PAGE_LINES)).alias("page", "lines")).select("doc_id", (F.col("page") + 1).alias("page_num"), cut(F.col("lines"), BLOCK_LINES).alias("parts"))

    def line(text: Column, place: Column) -> Column:
        y = (place * 10).cast("double")
        box = F.struct(F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(500.0).alias("x1"), (y + 10).alias("y1")).alias("bbox")
        return F.struct(F.transform(F.split(text, " "), lambda w: F.struct(F.concat(w, F.lit(" ")).alias("text"), F.lit(10.0).alias("size"), F.lit(0).alias("flags"), F.lit("serif").alias("font"), box)).alias("spans"))

    blocks = F.transform("parts", lambda part, b: F.struct(F.lit("text").alias("type"), F.transform(part, lambda text, i: line(text, b * BLOCK_LINES + i)).alias("lines")))
    return pages.select("doc_id", "page_num", blocks.alias("blocks"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns wrapped as raw answers, each with the user turn before it (``''`` without one): ``(query_id struct(conv_id, turn), question, raw_response)``."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    said = read(spark, sf_dir, "conversations").withColumn("question", F.coalesce(asked, F.lit(""))).where("role = 'assistant'").withColumnRenamed("text", "said")
    raw = F.concat(F.lit("Answer: "), F.col("said"), F.lit("\n\nExplanation: "), F.col("said"), F.lit("\n\nSources:\n1. [Paper "), F.col("conv_id").cast("string"), F.lit(', Page 2] - "'), F.substring("said", 1, 40), F.lit('"\n2. nothing in brackets\n\nConfidence: High - stated'))
    return said.select(F.struct("conv_id", "turn").alias("query_id"), "question", raw.alias("raw_response"))
