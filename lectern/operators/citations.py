"""Citations of chunks: building, looking up, formatting, grouping and the text around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gathered, snippet
from .layout import section_of_chunks

UNKNOWN = "Unknown Document"
AROUND = 50  # points that a citation's box is widened by on each side
#: Height of the bands that boxes and blocks meet in, and the last band's number.
BAND, LAST_BAND = 50.0, 4095
#: Height of the strips of a page whose blocks are put together for its citations: most pages are one.
STRIP = 1000.0


def build(chunks: DataFrame, documents: DataFrame, sections: DataFrame | None = None, boxes: DataFrame | None = None) -> DataFrame:
    """One row for each document and chunk. ``documents``: ``doc_id, title``; ``boxes``: ``doc_id, chunk_id, coordinates`` where known. Section id and title are the chunk's own, else those of the section that owns it."""
    rows = chunks if sections is None else section_of_chunks(chunks, sections).join(sections.select("doc_id", F.col("section_seq").alias("found_seq"), F.col("section_id").alias("own_id"), F.col("title").alias("own_title")), ["doc_id", "found_seq"], "left")
    if sections is None:
        rows = rows.withColumns({"own_id": F.lit(None).cast("string"), "own_title": F.lit(None).cast("string")})
    rows = rows.join(documents.select("doc_id", F.col("title").alias("doc_title")), "doc_id", "left")
    nowhere = F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>")
    rows = rows.withColumn("coordinates", nowhere) if boxes is None else rows.join(boxes, ["doc_id", "chunk_id"], "left")
    out = rows.select("chunk_id", F.col("doc_id").alias("document_id"), F.coalesce("doc_title", F.lit(UNKNOWN)).alias("document_title"), F.col("page_num").alias("page_number"), F.coalesce("section_id", "own_id").alias("section_id"), F.coalesce("section_title", "own_title").alias("section_title"), snippet(F.col("content")).alias("text_snippet"), "coordinates")
    return out.dropDuplicates(["document_id", "chunk_id"])


def look_up(results: DataFrame, citations: DataFrame) -> DataFrame:
    """Results with the citation of their chunk; of several documents with the chunk the greatest id, null without any."""
    one = citations.groupBy("chunk_id").agg(F.max_by(F.struct(*(c for c in citations.columns if c != "chunk_id")), "document_id").alias("c"))
    return results.join(one, "chunk_id", "left").select(*results.columns, *(F.col(f"c.{c}").alias(c) for c in citations.columns if c != "chunk_id"))


def formatted(title: Column, page: Column, section: Column, quoted: Column | None = None) -> Column:
    """``title, p. N, section - "quote"``; empty parts are left out."""
    some = lambda c: F.when(c.cast("string") != "", c)
    base = F.concat_ws(", ", title, F.when(page > 0, F.concat(F.lit("p. "), page.cast("string"))), some(section))
    if quoted is None:
        return base
    return F.concat(base, F.when(F.coalesce(quoted, F.lit("")) != "", F.concat(F.lit(' - "'), quoted, F.lit('"'))).otherwise(F.lit("")))


def with_text(citations: DataFrame, include_quote: bool = True) -> DataFrame:
    """Adds ``citation``."""
    return citations.withColumn("citation", formatted(F.col("document_title"), F.col("page_number"), F.col("section_title"), F.col("text_snippet") if include_quote else None))


def of_document(citations: DataFrame, document_id) -> DataFrame:
    return citations.where(F.col("document_id") == F.lit(document_id))


def of_section(citations: DataFrame, document_id, section_id: str) -> DataFrame:
    return of_document(citations, document_id).where(F.col("section_id") == F.lit(section_id))


def of_page(citations: DataFrame, document_id, page_number: int) -> DataFrame:
    return of_document(citations, document_id).where(F.col("page_number") == F.lit(page_number))


def context_window(text: Column, wanted: Column, around: int = 200) -> Column:
    """``struct(before, chunk, after, full_context)``: where the first 50 characters of ``wanted`` occur in ``text``, with so many characters on either side; if they don't, nothing before or after and the whole text."""
    at = F.instr(text, F.substring(wanted, 1, 50)) - 1
    start = F.greatest(F.lit(0), at - around)
    end = F.least(F.length(text), at + F.length(wanted) + around)
    cut = lambda a, b: text.substr(a + 1, F.greatest(b - a, F.lit(0)))
    found = F.struct(cut(start, at).alias("before"), wanted.alias("chunk"), cut(at + F.length(wanted), end).alias("after"), cut(start, end).alias("full_context"))
    missing = F.struct(F.lit("").alias("before"), wanted.alias("chunk"), F.lit("").alias("after"), text.alias("full_context"))
    return F.when(at >= 0, found).otherwise(missing)


def band_of(y: Column, height: float = BAND) -> Column:
    """What lies above the last band or below the first counts to it."""
    return F.least(F.greatest(F.floor(y / height), F.lit(0)), F.lit(LAST_BAND))


def bands(low: Column, high: Column, height: float = BAND) -> tuple[Column, Column]:
    """The band that ``low`` is in, and all from there to that of ``high``."""
    place = lambda y: band_of(y, height)
    return place(low), F.sequence(F.least(place(low), place(high)), F.greatest(place(low), place(high)))


def touching(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of ``boxes`` (``low, high``) and ``texts`` (``y0, y1``) of a page whose heights overlap. Both are dealt into bands of the page and meet in bands alone, each pair in that where the later of them begins;
    so what a page with many blocks costs grows with its blocks and not with their square."""
    first, every = bands(F.col("low"), F.col("high"))
    left = boxes.withColumn("first", first).withColumn("band", F.explode(every))
    begin, of_text = bands(F.col("y0"), F.col("y1"))
    right = texts.withColumn("begin", begin).withColumn("band", F.explode(of_text))
    met = left.join(right, ["document_id", "page_number", "band"]).where("band = greatest(first, begin) AND y1 >= low AND y0 <= high")
    return met.drop("band", "first", "begin")


def contexts(citations: DataFrame, blocks: DataFrame, pages: DataFrame, around: int = 200) -> DataFrame:
    """Citations with ``context`` from the blocks of their page that touch their box, widened and kept to the page (from the whole page where the box isn't known).

    A page's blocks are put together once, by strips, and a citation cuts its own out of the strip that it lies in, so the text around it isn't shuffled for each citation. Boxes that
    reach over several strips meet the blocks in bands, one by one."""
    box, b = F.col("coordinates"), F.col("bbox")
    wide = citations.join(pages.select(F.col("doc_id").alias("document_id"), F.col("page_num").alias("page_number"), "width", "height", F.lit(True).alias("placed")), ["document_id", "page_number"], "left")
    low, high = F.greatest(F.lit(0.0), box["y1"] - AROUND), F.least(F.col("height"), box["y2"] + AROUND)
    wide = wide.select(*citations.columns, "placed", low.alias("low"), high.alias("high"), F.greatest(F.lit(0.0), box["x1"] - AROUND).alias("left"), F.least(F.col("width"), box["x2"] + AROUND).alias("right"))
    wide = wide.withColumn("strip", F.when(F.col("placed"), band_of(F.col("low"), STRIP)))
    tall = F.coalesce(F.col("strip") != band_of(F.col("high"), STRIP), F.lit(False))
    texts = blocks.where("block_type = 'text'").select(F.col("doc_id").alias("document_id"), F.col("page_num").alias("page_number"), "block_no", "text", b["x0"].alias("x0"), b["x1"].alias("x1"), b["y0"].alias("y0"), b["y1"].alias("y1"))
    strips = texts.withColumn("strip", F.explode(bands(F.col("y0"), F.col("y1"), STRIP)[1])).groupBy("document_id", "page_number", "strip")
    strips = strips.agg(F.sort_array(F.collect_list(F.struct("block_no", F.col("text").alias("value"), "x0", "x1", "y0", "y1"))).alias("texts"))
    touched = F.filter("texts", lambda t: (t["y1"] >= F.col("low")) & (t["y0"] <= F.col("high")) & (t["x1"] >= F.col("left")) & (t["x0"] <= F.col("right")))
    low_ones = wide.where(~tall).join(strips, ["document_id", "page_number", "strip"], "left")
    found = low_ones.select(*citations.columns, F.array_join(F.transform(touched, lambda t: t["value"]), "\n").alias("area"))
    tall_ones = wide.where(tall)
    boxes = tall_ones.select("document_id", "page_number", "chunk_id", "low", "high", "left", "right")
    near = touching(boxes, texts).where("x1 >= left AND x0 <= right").groupBy("document_id", "chunk_id").agg(gathered(F.col("block_no"), F.col("text")).alias("area"))
    every = found.unionByName(tall_ones.select(*citations.columns).join(near, ["document_id", "chunk_id"], "left"))
    return every.withColumn("context", context_window(F.coalesce("area", F.lit("")), F.col("text_snippet"), around)).drop("area")


def detailed(cited: DataFrame, key: str = "query_id") -> DataFrame:
    """``cited``: citations with ``key`` and ``rank``. For each key its documents in order of first rank, with
    page references (``p. N (sections)``), the citation and quotes, and the numbers of citations and documents."""
    known = cited.where("document_id IS NOT NULL")
    pages = known.groupBy(key, "document_id", "document_title", "page_number").agg(F.array_sort(F.collect_set(F.when(F.col("section_title") != "", F.col("section_title")))).alias("s"))
    page = F.concat(F.lit("p. "), F.col("page_number").cast("string"), F.when(F.size("s") > 0, F.concat(F.lit(" ("), F.array_join("s", ", "), F.lit(")"))).otherwise(F.lit("")))
    refs = pages.groupBy(key, "document_id", "document_title").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_number", page.alias("ref")))), lambda x: x["ref"]).alias("page_references"))
    quotes = known.groupBy(key, "document_id").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("text_snippet") != "", F.struct("rank", "text_snippet")))), lambda x: x["text_snippet"]).alias("quotes"))
    each = refs.join(quotes, [key, "document_id"]).withColumn("citation_string", F.concat(F.col("document_title"), F.lit(", "), F.array_join("page_references", ", ")))
    sources = F.array_sort(F.collect_list(F.struct("first", "document_id", "document_title", "page_references", "citation_string", "quotes")))
    return each.groupBy(key).agg(sources.alias("sources"), F.sum("n").alias("citation_count"), F.count(F.lit(1)).alias("document_count"))


def as_sources(citations: DataFrame) -> DataFrame:
    """``(citation, quote, document_title, page_number, section_title)`` of the citations that exist."""
    known = citations.where("document_title IS NOT NULL")
    plain = formatted(F.col("document_title"), F.col("page_number"), F.col("section_title"))
    keep = [c for c in ("query_id", "rank") if c in citations.columns]
    return known.select(*keep, plain.alias("citation"), F.col("text_snippet").alias("quote"), "document_title", "page_number", "section_title")


def totals(citations: DataFrame) -> DataFrame:
    return citations.agg(F.count(F.lit(1)).alias("total_citations"), F.countDistinct("document_id").alias("documents_with_citations"))


def import_citations(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Imported citations replace stored ones of the same document and chunk."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy("document_id", "chunk_id").orderBy(F.desc("_new"))
    return both.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_new", "_at")

