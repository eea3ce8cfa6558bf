"""Cutting texts into content-addressed chunks that keep formulas and captions whole.

Masking and packing walk through a text in order, so they are small helpers that work on batches; finding
related neighbours, grouping them and the chunks' records are column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, chunk_id, long_words, word_count

SIZE, OVERLAP = 1000, 100
#: Characters that a task hands on at once.
FRAME = 1 << 20

#: What formulas, amounts of money and captions look like, and LaTeX commands as words.
FORMULA_PATTERNS = [
    r"\$\$.+?\$\$",
    r"\\begin\{equation\}.+?\\end\{equation\}",
    r"\\begin\{align\}.+?\\end\{align\}",
    r"\\\[.+?\\\]",
    r"\\\(.+?\\\)",
    r"\$[^$\n]{2,50}\$",
]
CURRENCY_PATTERN = r"\$\d+(?:,\d{3})*(?:\.\d{2})?(?:\s*(?:million|billion|trillion|thousand|k|m|b))?"
CAPTION_PATTERN = r"(?:Table|Figure)\s+\d+"
FORMULA_DELIMITERS = ["$$", "$", "\\[", "\\]", "\\(", "\\)", "\\begin{equation}", "\\end{equation}", "\\begin{align}", "\\end{align}"]
FORMULA_WORDS = [("\\alpha", "alpha"), ("\\beta", "beta"), ("\\sigma", "sigma"), ("\\mu", "mu"), ("\\sum", "sum"), ("\\int", "integral"), ("\\frac", "fraction"), ("\\sqrt", "square_root")]

_CURRENCY = re.compile(CURRENCY_PATTERN, re.IGNORECASE)
_SPECIAL = re.compile("|".join(f"(?P<f{i}>{p})" for i, p in enumerate(FORMULA_PATTERNS[:5])) + f"|(?P<money>(?i:{CURRENCY_PATTERN}))|(?P<inline>{FORMULA_PATTERNS[5]})|(?P<caption>(?i:{CAPTION_PATTERN}))", re.DOTALL)
#: What every formula, amount and caption begins with. A search for it passes over most texts many times faster.
_MAYBE = re.compile(r"[$\\]|[Tt][Aa][Bb][Ll][Ee]|[Ff][Iiıİ][Gg][Uu][Rr][Ee]")
_CAPTION_END = re.compile(r"\n\s*\n|\n\s*[A-Z]")
_PLACEHOLDER = r"__(?:FORMULA|TABLE)_\d+__"


def mask_special(text: str) -> tuple[str, dict[str, str]]:
    """The text with placeholders, and what they stand for; one pass from left to right. Putting the
    originals back gives the text again."""
    out, kept, at, number = [], {}, 0, 0
    if not _MAYBE.search(text):
        return text, kept
    while found := _SPECIAL.search(text, at):
        start, end, kind = found.start(), found.end(), found.lastgroup
        if kind == "caption":
            end = min(end + 200, len(text))
            if cut := _CAPTION_END.search(text, min(start + 50, end), end):
                end = cut.start()
            name = "TABLE"
        elif kind == "money" or _CURRENCY.search(found.group()):
            out.append(text[at:end])
            at = end
            continue
        else:
            name = "FORMULA"
        while (mark := f"__{name}_{number}__") in text:
            number += 1
        out += [text[at:start], mark]
        kept[mark] = text[start:end]
        number += 1
        at = max(end, start + 1)
    return "".join([*out, text[at:]]), kept


def restore_special(text: str, kept: dict[str, str]) -> str:
    return re.sub(_PLACEHOLDER, lambda m: kept.get(m.group(), m.group()), text)


def _cuts(ends: np.ndarray, room: Callable[[int], int]) -> list[tuple[int, int]]:
    """Runs of neighbours: from each start as many as end within ``room(start)``, one at least. ``ends`` are cumulative."""
    runs, at = [], 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + room(at), side="right")))
        runs.append((at, to))
        at = to
    return runs


def split_paragraphs(text: str, size: int = SIZE) -> list[str]:
    """At blank lines; paragraphs of over one and a half sizes at sentence ends, so many sentences together (each with a space after it) that all but the last
    space stay below a size."""
    out = []
    for part in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        sentences = re.split(r"(?<=[.!?])\s+", part) if len(part) > size * 1.5 else [part]
        ends = np.cumsum([len(s) + 1 for s in sentences])
        out += [" ".join(sentences[a:b]).strip() for a, b in _cuts(ends, lambda _: size)]
    return [p for p in out if p]


def pack_paragraphs(paragraphs: list[str], size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """A group as one chunk if it fits, else as many paragraphs together as fit (not counting the last blank line); where a chunk's last paragraph is short, the next chunk
    begins with it."""
    lengths = [len(p) for p in paragraphs]
    if sum(lengths) + 2 * (len(lengths) - 1) <= size:
        return ["\n\n".join(paragraphs)]
    again = [k > 0 and lengths[k - 1] < overlap for k in range(len(lengths))]
    ends = np.cumsum(lengths) + 2 * np.arange(1, len(lengths) + 1)
    runs = _cuts(ends, lambda k: size + 4 - (lengths[k - 1] + 2 if again[k] else 0))
    return ["\n\n".join(paragraphs[a - again[a] : b]) for a, b in runs]


def normalize_formula(formula: Column) -> Column:
    """Without delimiters, with single spaces, common commands as words."""
    out = formula
    for d in FORMULA_DELIMITERS:
        out = F.replace(out, F.lit(d), F.lit(""))
    out = F.trim(F.regexp_replace(out, r"(?U)\s+", " "))
    for command, word in FORMULA_WORDS:
        out = F.replace(out, F.lit(command), F.lit(word))
    return out


def related(before: Column, here: Column, size: int = SIZE) -> Column:
    """Whether neighbouring paragraphs belong together: short enough, at most one placeholder, and
    three tenths of the smaller set of long words shared."""
    marks = F.size(F.regexp_extract_all(F.concat(before, here), F.lit(f"({_PLACEHOLDER})"), F.lit(1)))
    smaller = lambda w: F.least(F.size(w["a"]), F.size(w["b"]))
    alike = lambda w: (smaller(w) > 0) & (F.size(F.array_intersect(w["a"], w["b"])) * 10 >= smaller(w) * 3)
    words = F.struct(long_words(before).alias("a"), long_words(here).alias("b"))
    short = F.length(before) + F.length(here) <= size * 0.8
    return F.coalesce(F.when(short, F.when(marks <= 1, bound(words, alike))), F.lit(False))


def group_paragraphs(paragraphs: DataFrame, keys: list[str], order: str = "para_no", text: str = "paragraph", size: int = SIZE) -> DataFrame:
    """Adds ``group_no`` from 0: runs of neighbours that are related."""
    by = Window.partitionBy(*keys).orderBy(order)
    same = related(F.lag(text).over(by), F.col(text), size)
    first = F.row_number().over(by) == 1
    return paragraphs.withColumn("_new", F.when(first | same, 0).otherwise(1)).withColumn("group_no", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_new")


def in_frames(rows: Iterator[tuple], columns: list[str], at: int) -> Iterator[pd.DataFrame]:
    """Rows as tables of some ``FRAME`` characters in column ``at`` each, so that what a task holds of its results doesn't follow the length of its texts."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[at]) + 100
        if size >= FRAME:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def paragraphs(texts: DataFrame, keys: list[str], text: str = "text", size: int = SIZE, mask: bool = True) -> DataFrame:
    """``(keys, para_no, paragraph, kept)``: paragraphs, masked unless ``mask`` is false, and what their placeholders stand for."""
    kinds = dict(texts.dtypes)

    def rows(pdf: pd.DataFrame) -> Iterator[tuple]:
        for row in pdf.itertuples(index=False):
            masked, kept = mask_special(row[-1] or "") if mask else (row[-1] or "", {})
            for n, p in enumerate(split_paragraphs(masked, size)):
                yield *row[:-1], n, p, {m: kept[m] for m in re.findall(_PLACEHOLDER, p) if m in kept} if kept else {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield from in_frames(rows(pdf), [*keys, "para_no", "paragraph", "kept"], -2)

    return texts.select(*keys, text).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", para_no int, paragraph string, kept map<string,string>")


def chunk_texts(texts: DataFrame, keys: list[str], text: str = "text", size: int = SIZE, overlap: int = OVERLAP, mask: bool = True) -> DataFrame:
    """``texts``: a row for each section (or document). Returns ``(keys, chunk_seq, chunk_id, content,
    content_type, placeholders, formula_count, table_count, character_count, word_count, group_index)``."""
    kinds = dict(texts.dtypes)
    grouped = group_paragraphs(paragraphs(texts, keys, text, size, mask), keys, size=size)
    groups = grouped.groupBy(*keys, "group_no").agg(F.array_sort(F.collect_list(F.struct("para_no", "paragraph", F.map_entries("kept").alias("kept")))).alias("rows"))
    groups = groups.select(*keys, "group_no", F.transform("rows", lambda r: r["paragraph"]).alias("paragraphs"), F.flatten(F.transform("rows", lambda r: r["kept"])).alias("kept"))

    def rows(pdf: pd.DataFrame) -> Iterator[tuple]:
        for *key, group, own, kept in pdf.itertuples(index=False):
            originals = {k["key"]: k["value"] for k in kept}
            for n, masked in enumerate(pack_paragraphs(list(own), size, overlap)):
                whole, marks = (restore_special(masked, originals), [m for m in re.findall(_PLACEHOLDER, masked) if m in originals]) if originals else (masked, [])
                yield *key, group, n, whole, marks

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield from in_frames(rows(pdf), [*keys, "group_index", "_n", "content", "placeholders"], -2)

    cut = groups.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", group_index int, _n int, content string, placeholders array<string>")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("group_index", "_n"))
    count = lambda what: F.size(F.filter("placeholders", lambda p: F.contains(p, F.lit(what))))
    counted = cut.withColumns({"chunk_seq": number, "formula_count": count("FORMULA"), "table_count": count("TABLE")})
    kind = F.when(F.col("formula_count") > 0, "formula").when(F.col("table_count") > 0, "table").otherwise("text")
    return counted.select(*keys, "chunk_seq", chunk_id(F.col("content")).alias("chunk_id"), "content", kind.alias("content_type"), "placeholders", "formula_count", "table_count", F.length("content").alias("character_count"), word_count(F.col("content")).alias("word_count"), "group_index")


def chunk_documents(documents: DataFrame, sections: DataFrame, section_texts: DataFrame, full_texts: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of every section, of the whole text where a document has no sections, with the section's id, title and first page (1 without one)."""
    named = section_texts.join(sections.select("doc_id", "section_seq", "section_id", F.col("title").alias("section_title"), "page_num"), ["doc_id", "section_seq"])
    bare = full_texts.join(sections.select("doc_id").distinct(), "doc_id", "left_anti")
    kind = dict(sections.dtypes)
    whole = bare.select("doc_id", F.lit(0).cast(kind["section_seq"]).alias("section_seq"), F.col("full_text").alias("text"))
    texts = named.select("doc_id", "section_seq", F.col("section_text").alias("text")).unionByName(whole)
    chunks = chunk_texts(texts, ["doc_id", "section_seq"], size=size, overlap=overlap)
    about = named.select("doc_id", "section_seq", "section_id", "section_title", "page_num")
    out = chunks.join(about, ["doc_id", "section_seq"], "left")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("section_seq", "chunk_seq"))
    return out.withColumns({"chunk_seq": number, "page_num": F.coalesce("page_num", F.lit(1))})


def recursive_pieces(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Split at the coarsest separator that occurs, finer ones where a piece is still too long; pieces are merged up to ``size``
    with up to ``overlap`` characters of the one before."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    out: list[str] = []
    fitting: list[str] = []

    def merge() -> None:
        held: list[str] = []
        length = 0
        for p in fitting:
            added = len(p) + (len(sep) if held else 0)
            if held and length + added > size:
                if whole := sep.join(held).strip():
                    out.append(whole)
                while held and (length > overlap or length + len(p) + len(sep) > size):
                    length -= len(held[0]) + (len(sep) if len(held) > 1 else 0)
                    held.pop(0)
                added = len(p) + (len(sep) if held else 0)
            held.append(p)
            length += added
        if whole := sep.join(held).strip():
            out.append(whole)
        fitting.clear()

    for piece in text.split(sep) if sep else list(text):
        if len(piece) < size or (not finer and len(piece) <= size):
            if piece:
                fitting.append(piece)
            continue
        merge()
        out += recursive_pieces(piece, size, overlap, finer) if finer else [piece]
    merge()
    return out


def split_fixed(pages: DataFrame, keys: list[str], text: str = "page_text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``(keys, piece_no, content)`` of each page's text."""
    kinds = dict(pages.dtypes)

    def rows(pdf: pd.DataFrame) -> Iterator[tuple]:
        for row in pdf.itertuples(index=False):
            for n, p in enumerate(recursive_pieces(row[-1] or "", size, overlap)):
                yield *row[:-1], n, p

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield from in_frames(rows(pdf), [*keys, "piece_no", "content"], -1)

    return pages.select(*keys, text).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", piece_no int, content string")


def ingest_stats(documents: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """For each document: chunks, mean length (0 without chunks), chunks with formulas and with tables, sections."""
    each = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), F.avg(F.length("content")).alias("mean"), F.count_if(F.col("formula_count") > 0).alias("f"), F.count_if(F.col("table_count") > 0).alias("t"))
    counted = sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("s"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = documents.select("doc_id").join(each, "doc_id", "left").join(counted, "doc_id", "left")
    return out.select("doc_id", n("c").alias("total_chunks"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("average_chunk_size"), n("f").alias("formula_chunks"), n("t").alias("table_chunks"), (n("f") > 0).alias("has_formulas"), (n("t") > 0).alias("has_tables"), n("s").alias("sections_detected"))


def embed(chunks: DataFrame, embed_fn: Callable[[list[str]], object], batch: int = 100, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """``(chunk_id, embedding)`` by a function of the caller's, which gets up to ``batch`` texts and returns a row of numbers for each."""
    kind = dict(chunks.dtypes)[id_col]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"id": part.iloc[:, 0], "embedding": [list(map(float, v)) for v in embed_fn(part.iloc[:, 1].fillna("").tolist())]})

    return chunks.select(id_col, text_col).mapInPandas(run, f"id {kind}, embedding array<float>").withColumnRenamed("id", id_col)
