"""Documents from laid-out text: blocks, pages, headings, sections and what belongs to them.

Everything is keyed by ``doc_id``, so one shuffle by document serves the windows of all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gathered

DEFAULT_BODY_SIZE = 11.0
HEADER_RATIO = 1.2

#: Fixed values: (pattern, group of the title) of headings, tried in this order, letter case ignored.
HEADING_PATTERNS = [
    (r"^(?:\d+\.)\s*([A-Z][^\n]+)$", 1),
    (r"^([A-Z][A-Z\s]+)$", 1),
    (r"^(?:\d+\.\d+)\s*([A-Z][^\n]+)$", 1),
    (r"^(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*$", 0),
]
#: The same with groups that give nothing back: what they give back can't match here, and Java would go a level deeper for each repetition, to a stack overflow on long lines.
_FLAT = {HEADING_PATTERNS[3][0]: r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*+\s*$"}


def blocks_from_spans(spans: DataFrame) -> DataFrame:
    """Text blocks of ``spans``: spans of a line end to end, lines one below the other, blank blocks dropped."""
    lines = spans.groupBy("doc_id", "page_num", "block_no", "line_no").agg(gathered(F.col("span_no"), F.col("text"), "").alias("line"), *_box_of("bbox"))
    blocks = lines.groupBy("doc_id", "page_num", "block_no").agg(F.trim(gathered(F.col("line_no"), F.col("line"))).alias("text"), *_box_of("bbox"))
    return blocks.where("text <> ''").withColumn("block_type", F.lit("text"))


def blocks_of_pages(pages: DataFrame) -> DataFrame:
    """The same of pages that hold their blocks, lines and spans as arrays, in order (``doc_id, page_num, blocks``, as in ``sources.layouts``): each page lies in one row, so nothing is
    shuffled. A page is a row's: pages that share their number aren't put together."""
    lines = lambda b: F.filter(b["lines"], lambda x: F.size(x["spans"]) > 0)
    text = lambda b: F.trim(F.array_join(F.transform(lines(b), lambda x: F.array_join(F.transform(x["spans"], lambda s: s["text"]), "")), "\n"))
    edge = lambda b, of, side: of(F.flatten(F.transform(lines(b), lambda x: F.transform(x["spans"], lambda s: s["bbox"][side])))).alias(side)
    box = lambda b: F.struct(edge(b, F.array_min, "x0"), edge(b, F.array_min, "y0"), edge(b, F.array_max, "x1"), edge(b, F.array_max, "y1"))
    kept = lambda b, i: F.when(b["type"] == "text", F.struct(i.alias("block_no"), text(b).alias("text"), box(b).alias("bbox")))
    each = pages.select("doc_id", "page_num", F.explode(F.transform("blocks", kept)).alias("b"))
    return each.select("doc_id", "page_num", "b.block_no", "b.text", "b.bbox").where("text <> ''").withColumn("block_type", F.lit("text"))


def _box_of(box: str) -> list[Column]:
    b = F.col(box)
    return [F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1")).alias(box)]


def page_texts(blocks: DataFrame) -> DataFrame:
    """``(doc_id, page_num, page_text)``."""
    return blocks.where("block_type = 'text'").groupBy("doc_id", "page_num").agg(gathered(F.col("block_no"), F.col("text")).alias("page_text"))


def full_texts(blocks: DataFrame) -> DataFrame:
    """``(doc_id, full_text)``: all text blocks by page and block, one below the other."""
    return blocks.where("block_type = 'text'").groupBy("doc_id").agg(gathered([F.col("page_num"), F.col("block_no")], F.col("text")).alias("full_text"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value)``: the value in the middle, of two middle ones the greater."""
    by = Window.partitionBy(key)
    counted = rows.where(F.col(value).isNotNull()).withColumns({"_at": F.row_number().over(by.orderBy(value)), "_n": F.count(F.lit(1)).over(by)})
    return counted.where(F.col("_at") == F.floor(F.col("_n") / 2) + 1).select(key, value)


def body_sizes(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """``(doc_id, body_size)``: upper median of the sizes of spans of over 20 characters on the first three pages, else the default."""
    long = spans.where((F.col("page_num") <= 3) & (F.length(F.trim("text")) > 20))
    median = upper_median(long, "doc_id", "size")
    return documents.select("doc_id").join(median, "doc_id", "left").select("doc_id", F.coalesce("size", F.lit(DEFAULT_BODY_SIZE)).alias("body_size"))


def is_header(text: Column, size: Column, body_size: Column) -> Column:
    """Large, short, and beginning with a capital letter or a digit."""
    return (F.length(F.trim(text)) >= 3) & (size >= body_size * HEADER_RATIO) & (F.length(text) <= 100) & text.rlike(r"^[\p{Lu}\p{Nd}]")


def heading_title(text: Column, patterns: list[tuple[str, int]] | None = None) -> Column:
    """Title of the first pattern that the text matches, null if none does."""
    clean = F.trim(text)
    found = [F.when(clean.rlike("(?i)" + _FLAT.get(p, p)), F.trim(F.regexp_extract(clean, "(?i)" + _FLAT.get(p, p), g))) for p, g in (HEADING_PATTERNS if patterns is None else patterns)]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def section_id(text: Column) -> Column:
    """The number at the beginning, else the capital letter there, else an id from the text's hash."""
    clean = F.trim(text)
    number = F.regexp_extract(clean, r"^(\d+(?:\.\d+)*+)", 1)
    letter = F.regexp_extract(clean, r"^([A-Z])", 1)
    return F.when(number != "", number).when(letter != "", letter).otherwise(F.concat(F.lit("sec_"), F.pmod(F.xxhash64(text), F.lit(1000)).cast("string")))


def hierarchy_level(id_: Column) -> Column:
    """1 to 3 by the number of parts of a dotted number; 1 for all else."""
    return F.when(id_.rlike(r"^\d+\.\d+$"), 2).when(id_.rlike(r"^\d+\.\d+\.\d+$"), 3).otherwise(1)


def find_sections(spans: DataFrame, documents: DataFrame, patterns: list[tuple[str, int]] | None = None) -> DataFrame:
    """Headings among the spans, in reading order, with their place in the hierarchy."""
    sized = spans.join(body_sizes(spans, documents), "doc_id")
    text = F.trim("text")
    heads = sized.where(is_header(text, F.col("size"), F.col("body_size"))).withColumn("title", heading_title(text, patterns)).where("title IS NOT NULL")
    order = Window.partitionBy("doc_id").orderBy("page_num", F.col("bbox")["y0"], "block_no", "line_no", "span_no")
    found = heads.select("doc_id", F.row_number().over(order).alias("section_seq"), section_id(text).alias("section_id"), "title", "page_num", F.col("bbox")["x0"].alias("x"), F.col("bbox")["y0"].alias("y"), "bbox", F.struct("size", "flags", "font").alias("font_info"))
    return with_hierarchy(found.withColumn("hierarchy_level", hierarchy_level(F.col("section_id"))))


def with_hierarchy(sections: DataFrame) -> DataFrame:
    """Adds ``parent_seq``, ``parent_section`` (nearest section before of a lower level) and ``child_sections``."""
    before = Window.partitionBy("doc_id").orderBy("section_seq").rowsBetween(Window.unboundedPreceding, -1)
    here = F.struct("section_seq", "section_id")
    nearest = [F.when(F.col("hierarchy_level") > level, F.last(F.when(F.col("hierarchy_level") == level, here), True).over(before)) for level in (1, 2)]
    parent = F.greatest(*nearest)  # by section_seq: the latest
    own = sections.withColumn("parent", parent).withColumns({"parent_seq": F.col("parent.section_seq"), "parent_section": F.col("parent.section_id")}).drop("parent")
    children = own.where("parent_seq IS NOT NULL").groupBy("doc_id", F.col("parent_seq").alias("section_seq")).agg(F.transform(F.array_sort(F.collect_list(here)), lambda x: x["section_id"]).alias("child_sections"))
    return own.join(children, ["doc_id", "section_seq"], "left").withColumn("child_sections", F.coalesce("child_sections", F.array().cast("array<string>")))


def assign_sections(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Text blocks with the ``section_seq`` they stand in: that of the last section that begins at or above them; blocks before the first are dropped. Section starts
    and blocks are sorted together, so no range join is needed."""
    starts = sections.select("doc_id", "page_num", "y", F.lit(0).alias("is_block"), F.col("section_seq").alias("start"), F.lit(None).cast("int").alias("block_no"), F.lit(None).cast("string").alias("text"))
    texts = blocks.where("block_type = 'text'").select("doc_id", "page_num", F.col("bbox")["y0"].alias("y"), F.lit(1).alias("is_block"), F.lit(None).cast(dict(sections.dtypes)["section_seq"]).alias("start"), F.col("block_no").cast("int").alias("block_no"), "text")
    order = Window.partitionBy("doc_id").orderBy("page_num", "y", "is_block", "start", "block_no").rowsBetween(Window.unboundedPreceding, 0)
    both = starts.unionByName(texts).withColumn("section_seq", F.last("start", True).over(order))
    return both.where("is_block = 1 AND section_seq IS NOT NULL").select("doc_id", "section_seq", "page_num", "y", "block_no", "text")


def section_texts(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """``(doc_id, section_seq, section_text)`` of every section, ``''`` for one without blocks."""
    joined = assign_sections(blocks, sections).groupBy("doc_id", "section_seq").agg(gathered([F.col("page_num"), F.col("block_no")], F.col("text")).alias("section_text"))
    return sections.select("doc_id", "section_seq").join(joined, ["doc_id", "section_seq"], "left").withColumn("section_text", F.coalesce("section_text", F.lit("")))


def text_between(blocks: DataFrame, sections: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests``: ``request_id, doc_id, start_id, end_id`` (null: to the end). Of sections that share an id the last
    counts; an unknown start gives ``''``."""
    places = sections.groupBy("doc_id", "section_id").agg(F.max_by(F.struct("page_num", "y"), "section_seq").alias("place"))
    first = places.select("doc_id", F.col("section_id").alias("start_id"), F.col("place").alias("first"))
    last = places.select("doc_id", F.col("section_id").alias("end_id"), F.col("place").alias("last"))
    asked = requests.join(first, ["doc_id", "start_id"]).join(last, ["doc_id", "end_id"], "left")
    texts = blocks.where("block_type = 'text'").select("doc_id", F.struct("page_num", F.col("bbox")["y0"].alias("y")).alias("at"), "page_num", "block_no", "text")
    inside = asked.join(texts, "doc_id").where((F.col("at") >= F.col("first")) & (F.col("last").isNull() | (F.col("at") < F.col("last"))))
    found = inside.groupBy("request_id").agg(gathered([F.col("page_num"), F.col("block_no")], F.col("text")).alias("text"))
    return requests.select("request_id").join(found, "request_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def section_of_chunks(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks with ``found_seq``: the first section of their ``section_id``, else the first of those on the greatest page that isn't after theirs."""
    exact = sections.groupBy("doc_id", "section_id").agg(F.min("section_seq").alias("exact_seq"))
    by_page = sections.groupBy("doc_id", "page_num").agg(F.min("section_seq").alias("page_seq"))
    kind = dict(sections.dtypes)["section_seq"]
    starts = by_page.select("doc_id", F.col("page_num").cast("int").alias("page_num"), F.lit(0).alias("is_chunk"), "page_seq")
    asked = chunks.select("doc_id", F.col("page_num").cast("int").alias("page_num"), F.lit(1).alias("is_chunk"), F.lit(None).cast(kind).alias("page_seq")).distinct()
    order = Window.partitionBy("doc_id").orderBy("page_num", "is_chunk").rowsBetween(Window.unboundedPreceding, 0)
    near = starts.unionByName(asked).withColumn("near_seq", F.last("page_seq", True).over(order)).where("is_chunk = 1").select("doc_id", "page_num", "near_seq")
    out = chunks.join(exact, ["doc_id", "section_id"], "left").join(near, ["doc_id", "page_num"], "left")
    return out.withColumn("found_seq", F.coalesce("exact_seq", "near_seq")).drop("exact_seq", "near_seq")
