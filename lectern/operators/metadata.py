"""Bibliographic metadata from the first pages of documents.

``pages``: ``doc_id, page_num`` (from 1), ``page_text``; ``documents``: ``doc_id, path, page_count, pdf_meta map<string,string>``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import gathered, occurrences, terms_in, word_count

#: Patterns and words of bibliographic text.
TITLE_PATTERNS = [r"^([A-Z][^\n]{10,200})$", r"(?:TITLE|Title):\s*([^\n]+)", r"^([A-Z][A-Z\s]{5,100})$"]
AUTHOR_PATTERNS = [
    r"(?:Author|AUTHORS?|By)s?\s*:\s*([^\n]+)",
    r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]*\.?)+(?:\s*,\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]*\.?)+)*)\s*$",
    r"([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s*,\s*[A-Z][a-z]+\s+[A-Z][a-z]+)*)",
]
KEYWORD_PATTERNS = [r"(?:Keywords?|KEY\s*WORDS?):\s*([^\n]+)", r"(?:JEL\s*Classification|JEL\s*Codes?):\s*([^\n]+)"]
ABSTRACT_PATTERNS = [
    r"(?:ABSTRACT|Abstract)\s*[:.]?\s*\n(.*?)(?:\n\s*(?:Keywords?|JEL|1\.|Introduction|INTRODUCTION))",
    r"(?:ABSTRACT|Abstract)\s*[:.]?\s*(.*?)(?:Keywords?|JEL|1\.|Introduction)",
]
JOURNAL_PATTERNS = [r"(?:Journal|Published\s+in|Forthcoming\s+in):\s*([^\n]+)", r"([A-Z][a-z]+\s+(?:Journal|Review|of).*?)\s*,?\s*(?:Vol|Volume)"]
DOI_PATTERNS = [r"(?:DOI|doi):\s*(10\.\d+/[^\s]+)"]
DATE_PATTERNS = [
    r"(?:Date|Published|Revised):\s*([A-Z][a-z]+\s+\d{4})",
    r"(?:Date|Published|Revised):\s*(\d{1,2}/\d{1,2}/\d{4})",
    r"(?:Date|Published|Revised):\s*(\d{4}-\d{2}-\d{2})",
    r"(\d{4})",
]
FINANCE_TERMS = [
    "asset pricing", "capm", "volatility", "portfolio", "options", "derivatives",
    "risk management", "market efficiency", "behavioral finance", "corporate finance",
    "capital structure", "dividend policy", "merger", "acquisition", "ipo",
    "credit risk", "liquidity", "hedge fund", "mutual fund", "pension fund",
    "interest rate", "bond", "equity", "stock", "return", "alpha", "beta",
    "sharpe ratio", "var", "stress test", "basel", "regulation", "compliance",
]

PROPERTIES = ["title", "author", "subject", "creator", "producer", "creationDate", "modDate"]


def properties(documents: DataFrame) -> DataFrame:
    """``(doc_id, page_count, <property>...)``, missing ones ``''``."""
    return documents.select("doc_id", "page_count", *(F.coalesce(F.element_at("pdf_meta", F.lit(p)), F.lit("")).alias(p) for p in PROPERTIES))


def valid_title(text: Column) -> Column:
    """10 to 300 characters, not over 100 of capitals only, at most three tenths odd signs."""
    capitals = text.rlike(r"\p{Lu}") & (text == F.upper(text))
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{N} :\-.,()\[\]]", ""))
    return F.length(text).between(10, 300) & ~(capitals & (F.length(text) > 100)) & (odd / F.length(text) <= 0.3)


def title_by_font(spans: DataFrame) -> DataFrame:
    """``(doc_id, page_num, candidate)``: of the page's largest type the longest span, the first of equals; spans of over 10 characters count. Null if not a valid title."""
    text = F.trim("text")
    order = Window.partitionBy("doc_id", "page_num").orderBy(F.desc("size"), F.desc(F.length(text)), "block_no", "line_no", "span_no")
    best = spans.where(F.length(text) > 10).withColumn("_at", F.row_number().over(order)).where("_at = 1")
    return best.select("doc_id", "page_num", F.when(valid_title(text), text).alias("candidate"))


def _first(text: Column, pattern: str, flags: str) -> Column:
    """Group 1 of the first match, trimmed; null without one."""
    return F.when(text.rlike(f"(?{flags}){pattern}") if flags else text.rlike(pattern), F.trim(F.regexp_extract(text, f"(?{flags}){pattern}" if flags else pattern, 1)))


def _earliest(pages: DataFrame, candidates: list[Column], name: str) -> DataFrame:
    """``(doc_id, name)``: the first candidate that isn't null, on the earliest page."""
    found = pages.select("doc_id", "page_num", F.coalesce(*candidates).alias(name)).where(F.col(name).isNotNull())
    return found.groupBy("doc_id").agg(F.min_by(name, "page_num").alias(name))


def _head(pages: DataFrame, most: int) -> DataFrame:
    return pages.where(F.col("page_num") <= most)


def titles(documents: DataFrame, pages: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """``(doc_id, title)``: on the first three pages by font, then by pattern; else the document's property, else null."""
    head = _head(pages, 3)
    if spans is not None:
        head = head.join(title_by_font(_head(spans, 3)), ["doc_id", "page_num"], "left")
    else:
        head = head.withColumn("candidate", F.lit(None).cast("string"))
    tries = [F.col("candidate")]
    for p in TITLE_PATTERNS:
        found = _first(F.col("page_text"), p, "im")
        tries.append(F.when(valid_title(found), found))
    named = properties(documents).select("doc_id", F.when(valid_title(F.col("title")), F.col("title")).alias("property"))
    return named.join(_earliest(head, tries, "found"), "doc_id", "left").select("doc_id", F.coalesce("found", "property").alias("title"))


def clean_author(name: Column) -> Column:
    no_titles = F.regexp_replace(name, r"(?i)\b(?:Dr|Prof|Professor|PhD|Ph\.D\.)\b\.?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(no_titles, r"\d+", ""), r"(?U)\s+", " "))


def valid_author(name: Column) -> Column:
    """5 to 50 characters, two words at least, three odd signs at most."""
    return F.length(name).between(5, 50) & (word_count(name) >= 2) & (F.length(F.regexp_replace(name, r"[\p{L} .\-]", "")) <= 3)


def authors(pages: DataFrame) -> DataFrame:
    """``(doc_id, authors)``: names on the first three pages by page, pattern and place, each once, ten at most."""
    text = F.col("page_text")
    matches = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f"(?m){p}"), F.lit(1)) for p in AUTHOR_PATTERNS)))
    by_page = _head(pages, 3).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", matches.alias("found")))).alias("p"))
    names = F.flatten(F.transform(F.flatten(F.transform("p", lambda x: x["found"])), lambda m: F.split(m, r",| and |&|\n|\\n")))
    cleaned = F.transform(names, lambda n: clean_author(n))
    return by_page.select("doc_id", F.slice(F.array_distinct(F.filter(cleaned, lambda n: valid_author(n))), 1, 10).alias("authors"))


def abstracts(pages: DataFrame) -> DataFrame:
    """``(doc_id, abstract)``: 50 to 2000 characters with two full stops at least."""
    tries = []
    for p in ABSTRACT_PATTERNS:
        found = _first(F.col("page_text"), p, "ims")
        tries.append(F.when(F.length(found).between(50, 2000) & (F.length(found) - F.length(F.replace(found, F.lit("."), F.lit(""))) >= 2), found))
    return _earliest(_head(pages, 3), tries, "abstract")


def keywords(pages: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """``(doc_id, keywords)``: those listed on the first three pages, then the terms that the first five hold; each once, longer than two characters, twenty at most."""
    text = F.col("page_text")
    listed = F.flatten(F.array(*(F.filter(F.transform(F.split(F.coalesce(_first(text, p, "im"), F.lit("")), "[,;]"), lambda k: F.trim(k)), lambda k: k != "") for p in KEYWORD_PATTERNS)))
    own = F.when(F.col("page_num") <= 3, listed).otherwise(F.array().cast("array<string>"))
    by_doc = _head(pages, 5).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", own.alias("listed")))).alias("p"), gathered(F.col("page_num"), F.lower("page_text"), "").alias("text"))
    every = F.concat(F.flatten(F.transform("p", lambda x: x["listed"])), terms_in(F.col("text"), FINANCE_TERMS if terms is None else terms))
    return by_doc.select("doc_id", F.slice(F.filter(F.array_distinct(every), lambda k: F.length(k) > 2), 1, 20).alias("keywords"))


def publication_info(pages: DataFrame) -> DataFrame:
    """``(doc_id, publication_info)``: journal and DOI, later pages and patterns over earlier ones; the other fields are null."""
    text = F.col("page_text")
    last = lambda patterns: F.coalesce(*(_first(text, p, "im") for p in reversed(patterns)))
    found = _head(pages, 3).select("doc_id", "page_num", last(JOURNAL_PATTERNS).alias("journal"), last(DOI_PATTERNS).alias("doi"))
    each = found.groupBy("doc_id").agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("page_num"))).alias(c) for c in ("journal", "doi")))
    empty = lambda name: F.lit(None).cast("string").alias(name)
    return each.select("doc_id", F.struct("journal", empty("volume"), empty("issue"), empty("pages"), "doi", empty("publisher")).alias("publication_info"))


def dates(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """``(doc_id, date)``: the creation date of the properties, else the first date on the first three pages."""
    found = _earliest(_head(pages, 3), [_first(F.col("page_text"), p, "") for p in DATE_PATTERNS], "found")
    created = F.when(F.col("creationDate") != "", F.col("creationDate"))
    return properties(documents).join(found, "doc_id", "left").select("doc_id", F.coalesce(created, F.col("found")).alias("date"))


def indicators(pages: DataFrame, terms: list[str] | None = None, most_pages: int = 10) -> DataFrame:
    """``(doc_id, has_mathematical_formulas, has_financial_terms, financial_term_count, has_tables, has_references, estimated_academic_level)``."""
    text = _head(pages, most_pages).groupBy("doc_id").agg(gathered(F.col("page_num"), F.lower("page_text"), "").alias("t"))
    n = occurrences(F.col("t"), FINANCE_TERMS if terms is None else terms)
    t = F.col("t")
    return text.select("doc_id", t.rlike(r"\$.*?\$|\\[a-zA-Z]+\{.*?\}").alias("has_mathematical_formulas"), (n > 5).alias("has_financial_terms"), n.alias("financial_term_count"), t.rlike(r"table\s+\d+|figure\s+\d+").alias("has_tables"), t.rlike("references|bibliography").alias("has_references"), F.lit("research").alias("estimated_academic_level"))


def document_stats(pages: DataFrame) -> DataFrame:
    """``(doc_id, page_count, total_characters, total_words, avg_words_per_page, estimated_reading_time_minutes)``."""
    words = word_count(F.col("page_text"))
    each = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"), F.sum(F.length("page_text")).alias("total_characters"), F.sum(words).alias("total_words"))
    return each.withColumns({"avg_words_per_page": F.round(F.col("total_words") / F.col("page_count"), 6), "estimated_reading_time_minutes": F.round(F.col("total_words") / 200, 6)})


def document_id(path: Column, title: Column, author_list: Column) -> Column:
    """16 hex digits that depend on the file's name, the title (the name if there is none) and the authors."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    shown = F.concat(F.lit("["), F.array_join(F.coalesce(author_list, F.array().cast("array<string>")), ", "), F.lit("]"))
    return F.substring(F.md5(F.concat_ws("_", name, F.coalesce(title, name), shown).cast("binary")), 1, 16)


def extract(documents: DataFrame, pages: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """One row for each document with all of the above."""
    stats = document_stats(pages).select("doc_id", F.struct("page_count", "total_characters", "total_words", "avg_words_per_page", "estimated_reading_time_minutes").alias("document_stats"))
    finance = indicators(pages)
    finance = finance.select("doc_id", F.struct(*(c for c in finance.columns if c != "doc_id")).alias("financial_indicators"))
    parts = [titles(documents, pages, spans), authors(pages), abstracts(pages), keywords(pages), publication_info(pages), dates(documents, pages), finance, stats]
    out = reduce(lambda a, b: a.join(b, "doc_id", "left"), parts, documents.select("doc_id", "path"))
    return out.withColumn("document_id", document_id(F.col("path"), F.col("title"), F.col("authors")))
