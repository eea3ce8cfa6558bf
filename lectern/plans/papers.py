"""Registered queries over pages and files, for what is found in papers, and for what is looked up one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers, catalog, chat, chunking, citations, layout, lexical, metadata
from ..functions import text as tx
from ..sources import layouts, store
from ..streaming import messages, streams
from . import tables
from .queries import _BM25, _CATALOG, _LINES, _LONG, _PAGES, _SPACE, _TERMS, _index, _short
from .registry import query
from .tables import COMMON_TERMS

_PICK = "(['" + "', '".join(tables.PEOPLE) + f"'])[{{0}} % {len(tables.PEOPLE)} + 1]"
_PAPERS = _PAGES + f""",
heads AS (SELECT doc_id, concat_ws(chr(10),
  CASE WHEN n_chars % 4 <> 0 THEN 'Title: Study ' || doc_id || ' of ' || source END,
  'By: Dr. ' || {_PICK.format("n_chars")} || ', ' || {_PICK.format("(n_chars + 1)")} || ' and ' || {_PICK.format("doc_id")} || ' & X1',
  CASE WHEN n_chars % 3 <> 0 THEN 'Abstract' || chr(10) || replace(substr(text, 1, 700), chr(10), ' ') || '. First. Second.' END,
  'Keywords: lang ' || lang || ', ' || source || '; que',
  CASE WHEN n_chars % 2 = 0 THEN 'Journal: Annals of ' || source ELSE 'Quarterly Review of ' || lang || ', Vol. 3' END,
  CASE WHEN n_chars % 5 <> 0 THEN 'DOI: 10.1000/' || doc_id END,
  CASE n_chars % 3 WHEN 0 THEN 'Published: March 20' || lpad((doc_id % 25)::VARCHAR, 2, '0') WHEN 1 THEN 'Revised: 20' || lpad((doc_id % 25)::VARCHAR, 2, '0') || '-05-17' END) AS head FROM documents),
papers AS (SELECT doc_id, page_num, CASE WHEN page_num = 1 THEN head || chr(10) || page_text ELSE page_text END AS t FROM pages_of JOIN heads USING (doc_id))"""
_FILES = "files AS (SELECT doc_id, '/in/' || source || '/file' || doc_id || '.pdf' AS path, len(string_split(text, chr(10))) AS page_count, CASE WHEN n_chars % 2 = 0 THEN 'Property title ' || doc_id ELSE '' END AS title, source AS author, CASE WHEN n_chars % 7 = 0 THEN 'D:2020' || doc_id ELSE '' END AS creation FROM documents)"
#: Whether a column of text can be a title.
_VALID = r"(length({0}) BETWEEN 10 AND 300 AND NOT (regexp_matches({0}, '\p{{Lu}}') AND {0} = upper({0}) AND length({0}) > 100) AND length(regexp_replace({0}, '[\p{{L}}\p{{N}} :\-.,()\[\]]', '', 'g')) / greatest(length({0}), 1) <= 0.3)"


def _group(pattern: str, flags: str, text: str = "t") -> str:
    """SQL of group 1 of the first match, trimmed, null without a match."""
    p = f"'(?{flags}{'' if 's' in flags else '-s'}){pattern}'"
    return f"CASE WHEN regexp_matches({text}, {p}) THEN trim(regexp_extract({text}, {p}, 1)) END"


def _papers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tables.files(spark, sf_dir), tables.papers(spark, sf_dir)


# --- metadata ------------------------------------------------------------------------------------


@query(f"WITH {_FILES} SELECT doc_id, page_count, title, author, '' AS subject, '' AS creator, '' AS producer, creation AS \"creationDate\", '' AS \"modDate\" FROM files", ints="page_count")
def document_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.properties(tables.files(spark, sf_dir))


_FONT = f"font AS (SELECT doc_id, page_num, CASE WHEN {_VALID.format('w')} THEN w END AS candidate FROM (SELECT *, trim(text) AS w, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY 9.0 + length(text) % 7 DESC, length(trim(text)) DESC, block_no) AS k FROM lines WHERE length(trim(text)) > 10) WHERE k = 1)"


@query(f"WITH {_LINES}, {_FONT} SELECT * FROM font")
def font_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.title_by_font(tables.spans(spark, sf_dir))


_TITLES = f"""{_PAPERS}, {_FILES}, {_FONT},
tries AS (SELECT doc_id, page_num, candidate, {', '.join(f"{_group(p, 'im')} AS c{k}" for k, p in enumerate(metadata.TITLE_PATTERNS))} FROM papers LEFT JOIN font USING (doc_id, page_num) WHERE page_num <= 3),
found AS (SELECT doc_id, page_num, coalesce(@FONT, {', '.join(f"CASE WHEN {_VALID.format(f'c{k}')} THEN c{k} END" for k in range(len(metadata.TITLE_PATTERNS)))}) AS title FROM tries),
best AS (SELECT doc_id, min_by(title, page_num) AS title FROM found WHERE title IS NOT NULL GROUP BY 1),
titles AS (SELECT doc_id, coalesce(best.title, CASE WHEN {_VALID.format('files.title')} THEN files.title END) AS title FROM files LEFT JOIN best USING (doc_id))"""


@query(f"WITH {_TITLES.replace('@FONT', 'candidate')} SELECT * FROM titles")
def paper_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By font first."""
    return metadata.titles(*_papers(spark, sf_dir), tables.spans(spark, sf_dir))


@query(f"WITH {_TITLES.replace('@FONT', 'NULL')} SELECT * FROM titles")
def pattern_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By pattern alone."""
    return metadata.titles(*_papers(spark, sf_dir))


_AUTHORS = rf"""
matched AS (SELECT doc_id, page_num, {' || '.join(f"regexp_extract_all(t, '(?m-s){p}', 1)" for p in metadata.AUTHOR_PATTERNS)} AS m FROM papers WHERE page_num <= 3),
named AS (SELECT doc_id, flatten(list_transform(flatten(list(m ORDER BY page_num)), lambda x: string_split_regex(x, ',| and |&|\n|\\n'))) AS names FROM matched GROUP BY 1),
cleaned AS (SELECT doc_id, list_filter(list_transform(names, lambda n: trim(regexp_replace(regexp_replace(regexp_replace(n, '(?i)\b(?:Dr|Prof|Professor|PhD|Ph\.D\.)\b\.?', '', 'g'), '[0-9]+', '', 'g'), '{_SPACE}+', ' ', 'g'))),
  lambda n: length(n) BETWEEN 5 AND 50 AND len(list_filter(regexp_split_to_array(n, '{_SPACE}+'), lambda w: w <> '')) >= 2 AND length(regexp_replace(n, '[\p{{L}} .\-]', '', 'g')) <= 3) AS a FROM named),
authors AS (SELECT doc_id, list_filter(a, lambda n, i: list_position(a, n) = i)[1:10] AS a FROM cleaned)"""


@query(f"WITH {_PAPERS}, {_AUTHORS} SELECT doc_id, array_to_string(a, '|') AS authors FROM authors")
def paper_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.authors(tables.papers(spark, sf_dir)).withColumn("authors", F.array_join("authors", "|"))


@query(f"""WITH {_PAPERS}, tries AS (SELECT doc_id, page_num, {', '.join(f"{_group(p, 'ims')} AS c{k}" for k, p in enumerate(metadata.ABSTRACT_PATTERNS))} FROM papers WHERE page_num <= 3),
found AS (SELECT doc_id, page_num, coalesce({', '.join(f"CASE WHEN length(c{k}) BETWEEN 50 AND 2000 AND length(c{k}) - length(replace(c{k}, '.', '')) >= 2 THEN c{k} END" for k in range(len(metadata.ABSTRACT_PATTERNS)))}) AS abstract FROM tries)
SELECT doc_id, min_by(abstract, page_num) AS abstract FROM found WHERE abstract IS NOT NULL GROUP BY 1""")
def paper_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.abstracts(tables.papers(spark, sf_dir))


@query(f"""WITH {_PAPERS}, listed AS (SELECT doc_id, page_num, lower(t) AS low, CASE WHEN page_num <= 3 THEN {' || '.join(f"list_filter(list_transform(regexp_split_to_array(coalesce({_group(p, 'im')}, ''), '[,;]'), lambda k: trim(k)), lambda k: k <> '')" for p in metadata.KEYWORD_PATTERNS)} ELSE [] END AS own FROM papers WHERE page_num <= 5),
every AS (SELECT doc_id, flatten(list(own ORDER BY page_num)) AS own, string_agg(low, '' ORDER BY page_num) AS low FROM listed GROUP BY 1),
both_ AS (SELECT doc_id, own || list_filter({_TERMS}, lambda w: contains(low, w)) AS k FROM every)
SELECT doc_id, array_to_string(list_filter(k, lambda w, i: list_position(k, w) = i AND length(w) > 2)[1:20], '|') AS keywords FROM both_""")
def paper_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.keywords(tables.papers(spark, sf_dir), COMMON_TERMS).withColumn("keywords", F.array_join("keywords", "|"))


@query(f"""WITH {_PAPERS}, found AS (SELECT doc_id, page_num, coalesce({', '.join(_group(p, 'im') for p in reversed(metadata.JOURNAL_PATTERNS))}) AS journal, coalesce({', '.join(_group(p, 'im') for p in reversed(metadata.DOI_PATTERNS))}) AS doi FROM papers WHERE page_num <= 3)
SELECT doc_id, max_by(journal, page_num) FILTER (journal IS NOT NULL) AS journal, max_by(doi, page_num) FILTER (doi IS NOT NULL) AS doi FROM found GROUP BY 1""")
def paper_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.publication_info(tables.papers(spark, sf_dir)).select("doc_id", "publication_info.journal", "publication_info.doi")


@query(f"""WITH {_PAPERS}, {_FILES}, found AS (SELECT doc_id, page_num, coalesce({', '.join("CASE WHEN regexp_matches(t, '" + p + "') THEN trim(regexp_extract(t, '" + p + "', 1)) END" for p in metadata.DATE_PATTERNS)}) AS date FROM papers WHERE page_num <= 3),
best AS (SELECT doc_id, min_by(date, page_num) AS date FROM found WHERE date IS NOT NULL GROUP BY 1)
SELECT doc_id, coalesce(CASE WHEN creation <> '' THEN creation END, date) AS date FROM files LEFT JOIN best USING (doc_id)""")
def paper_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.dates(*_papers(spark, sf_dir))


@query(f"""WITH {_TITLES.replace('@FONT', 'NULL')}, {_AUTHORS} SELECT doc_id, substr(md5('file' || doc_id || '.pdf_' || coalesce(titles.title, 'file' || doc_id || '.pdf') || '_[' || coalesce(array_to_string(a, ', '), '') || ']'), 1, 16) AS document_id FROM files JOIN titles USING (doc_id) LEFT JOIN authors USING (doc_id)""")
def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.extract(*_papers(spark, sf_dir)).select("doc_id", "document_id")


# --- structure -----------------------------------------------------------------------------------


@query(f"WITH {_LINES}, l AS (SELECT doc_id, page_num, block_no // 4 AS block_no, string_agg(text || ' ', chr(10) ORDER BY block_no) AS t FROM lines GROUP BY doc_id, page_num, lines.block_no // 4) SELECT doc_id, page_num, block_no, md5(trim(t)) AS digest FROM l WHERE trim(t) <> ''", ints="block_no")
def blocks_from_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks by digest, from words."""
    return layout.blocks_from_spans(tables.word_spans(spark, sf_dir)).select("doc_id", "page_num", "block_no", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {_LINES}, b AS (SELECT doc_id, page_num, block_no // 4 - (page_num - 1) * 5 AS block_no, trim(string_agg(text || ' ', chr(10) ORDER BY block_no)) AS t, min(y) AS y0, max(y) + 10 AS y1 FROM lines GROUP BY doc_id, page_num, lines.block_no // 4 - (page_num - 1) * 5) SELECT doc_id, page_num, block_no, md5(t) AS digest, CAST(y0 AS DOUBLE) AS y0, CAST(y1 AS DOUBLE) AS y1 FROM b WHERE t <> ''", ints="block_no")
def blocks_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks, by digest and place, of pages that were written as files of laid-out text and read from there."""
    folder = store.fresh_dir(spark, "layouts")
    layouts.write_pages(tables.laid_out(spark, sf_dir), folder)
    blocks = layout.blocks_of_pages(layouts.pages(spark, folder).where("is_page"))
    return blocks.select("doc_id", "page_num", "block_no", F.md5(F.col("text").cast("binary")).alias("digest"), F.col("bbox.y0").alias("y0"), F.col("bbox.y1").alias("y1"))


@query(rf"""WITH {_LINES}, c AS (SELECT doc_id, block_no, text, trim(text) AS w FROM lines)
SELECT doc_id, block_no, coalesce({', '.join(f"CASE WHEN regexp_matches(w, '(?i){p}') THEN trim(regexp_extract(w, '(?i){p}', {g})) END" for p, g in layout.HEADING_PATTERNS)}) AS title,
CASE WHEN regexp_matches(w, '^[0-9]+') THEN regexp_extract(w, '^([0-9]+(?:\.[0-9]+)*)', 1) WHEN regexp_matches(w, '^[A-Z]') THEN substr(w, 1, 1) ELSE 'sec' END AS section_id FROM c""")
def section_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every line: its title if it is a heading, and its section id (of hashed ones the beginning)."""
    own = layout.section_id(F.col("text"))
    return tables.blocks(spark, sf_dir).select("doc_id", "block_no", layout.heading_title(F.col("text")).alias("title"), F.when(F.startswith(own, F.lit("sec_")), "sec").otherwise(own).alias("section_id"))


# --- chunks --------------------------------------------------------------------------------------


def _packed(items: str, add: str, fits: str, start: str) -> str:
    """SQL that goes through a list and keeps what is closed (``done``) and what is open (``held``, its last item ``last``)."""
    kind = "STRUCT(done VARCHAR[], held VARCHAR, last VARCHAR)"
    listed = f"list_transform({items}, lambda x: CAST({{'done': [], 'held': x, 'last': x}} AS {kind}))"
    step = f"lambda s, x: CAST({{'done': CASE WHEN s.held = '' OR {fits} THEN s.done ELSE list_append(s.done, s.held) END, 'held': CASE WHEN s.held = '' THEN x.held WHEN {fits} THEN {add} ELSE {start} END, 'last': x.held}} AS {kind})"
    return f"list_reduce({listed}, {step}, CAST({{'done': [], 'held': '', 'last': ''}} AS {kind}))"


_SENTENCES = rf"regexp_split_to_array(regexp_replace(p, '([.!?]){_SPACE}+', '\1' || chr(1), 'g'), chr(1))"
_PARTS = rf"""
parts AS (SELECT doc_id, j, regexp_replace(l[j], '^{_SPACE}+|{_SPACE}+$', '', 'g') AS p FROM (SELECT doc_id, regexp_split_to_array(t, '\n\s*\n') AS l FROM src), unnest(range(1, len(l) + 1)) AS u(j)),
closed AS (SELECT doc_id, j, p, CASE WHEN length(p) > 1500 THEN {_packed(_SENTENCES, "s.held || ' ' || x.held", "length(s.held) + 1 + length(x.held) < 1000", "x.held")} END AS r FROM parts WHERE p <> ''),
pieces AS (SELECT doc_id, j, CASE WHEN r IS NULL THEN [p] ELSE list_append(r.done, r.held) END AS l FROM closed),
paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j, k) - 1 AS para_no, trim(l[k]) AS paragraph FROM pieces, unnest(range(1, len(l) + 1)) AS u(k) WHERE trim(l[k]) <> '')"""
_CHUNKS = f"""{_PARTS},
w AS (SELECT *, {_LONG.format('paragraph')} AS ws, lag(paragraph) OVER (PARTITION BY doc_id ORDER BY para_no) AS before FROM paras), v AS (SELECT *, lag(ws) OVER (PARTITION BY doc_id ORDER BY para_no) AS wb FROM w),
n AS (SELECT doc_id, para_no, paragraph, CASE WHEN before IS NULL OR (length(before) + length(paragraph) <= 800 AND len(regexp_extract_all(before || paragraph, '__(?:FORMULA|TABLE)_[0-9]+__')) <= 1 AND least(len(ws), len(wb)) > 0 AND len(list_intersect(ws, wb)) * 10 >= least(len(ws), len(wb)) * 3) THEN 0 ELSE 1 END AS new FROM v),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY para_no) AS INT) AS group_index FROM n),
t AS (SELECT doc_id, group_index, list(paragraph ORDER BY para_no) AS l FROM g GROUP BY ALL),
r AS (SELECT doc_id, group_index, array_to_string(l, chr(10) || chr(10)) AS whole, {_packed("l", "s.held || chr(10) || chr(10) || x.held", "length(s.held) + length(x.held) <= 1000", "CASE WHEN length(s.last) < 100 THEN s.last || chr(10) || chr(10) || x.held ELSE x.held END")} AS r FROM t),
c AS (SELECT doc_id, group_index, CASE WHEN length(whole) <= 1000 THEN [whole] ELSE list_append(r.done, r.held) END AS l FROM r),
chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY group_index, k) AS INT) AS chunk_seq, group_index, l[k] AS content FROM c, unnest(range(1, len(l) + 1)) AS u(k))"""
_WORDS_IN = f"CAST(len(list_filter(regexp_split_to_array(@, '{_SPACE}+'), lambda x: x <> '')) AS INT)"
_DOUBLED = "replace(text, chr(10), chr(10) || chr(10))"


@query(f"WITH src AS (SELECT doc_id, {_DOUBLED} AS t FROM documents), {_PARTS} SELECT doc_id, para_no, md5(paragraph) AS digest FROM paras", ints="para_no")
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at lines, and at sentences where lines are long; by digest, before anything is masked."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.paragraphs(docs, ["doc_id"], mask=False).select("doc_id", "para_no", F.md5(F.col("paragraph").cast("binary")).alias("digest"))


@query(f"WITH src AS (SELECT doc_id, {_DOUBLED} AS t FROM documents), {_CHUNKS} SELECT doc_id, chunk_seq, group_index, 'chunk_' || substr(md5(content), 1, 12) AS chunk_id, 'text' AS content_type, 0 AS formula_count, CAST(length(content) AS INT) AS character_count, {_WORDS_IN.replace('@', 'content')} AS word_count FROM chunks")
def plain_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into chunks, lines taken as paragraphs, nothing masked."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.chunk_texts(docs, ["doc_id"], mask=False).select("doc_id", "chunk_seq", "group_index", "chunk_id", "content_type", "formula_count", "character_count", "word_count")


_SPECIAL = "(?s)" + "|".join(chunking.FORMULA_PATTERNS[:5]) + f"|(?i:{chunking.CURRENCY_PATTERN})|" + chunking.FORMULA_PATTERNS[5]
#: Texts with formulas masked, and what the marks stand for. Captions aren't in it: no given text has "Table" or "Figure" with a number.
_MASKED = f"""
found AS (SELECT doc_id, {_DOUBLED} AS t, regexp_extract_all({_DOUBLED}, '{_SPECIAL}') AS m, string_split_regex({_DOUBLED}, '{_SPECIAL}') AS between FROM documents),
flagged AS (SELECT *, list_transform(m, lambda x: NOT regexp_matches(x, '(?i){chunking.CURRENCY_PATTERN}')) AS f FROM found),
numbered AS (SELECT *, list_transform(f, lambda b, i: CASE WHEN b THEN '__FORMULA_' || (len(list_filter(f[1:i], lambda z: z)) - 1) || '__' END) AS k FROM flagged),
src AS (SELECT doc_id, between[1] || coalesce(array_to_string(list_transform(m, lambda x, i: coalesce(k[i], x) || between[i + 1]), ''), '') AS t, list_filter(list_transform(m, lambda x, i: {{'a': k[i], 'b': x}}), lambda x: x.a IS NOT NULL) AS kept FROM numbered)"""


@query(f"""WITH {_MASKED}, {_CHUNKS}, whole AS (SELECT chunks.*, len(regexp_extract_all(content, '__FORMULA_[0-9]+__')) AS n, list_reduce(kept, lambda s, x: {{'a': replace(s.a, x.a, x.b), 'b': ''}}, {{'a': content, 'b': ''}}).a AS text FROM chunks JOIN src USING (doc_id))
SELECT doc_id, chunk_seq, 'chunk_' || substr(md5(text), 1, 12) AS chunk_id, CASE WHEN n > 0 THEN 'formula' ELSE 'text' END AS content_type, CAST(n AS INT) AS formula_count, CAST(length(text) AS INT) AS character_count, {_WORDS_IN.replace('@', 'text')} AS word_count, group_index FROM whole""")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into chunks, lines taken as paragraphs, formulas kept whole."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.chunk_texts(docs, ["doc_id"]).select("doc_id", "chunk_seq", "chunk_id", "content_type", "formula_count", "character_count", "word_count", "group_index")


_SECTION_DOCS = """
sec AS (SELECT doc_id, block_no AS section_seq, (block_no % 4 + 1) || CASE block_no % 3 WHEN 1 THEN '.1' WHEN 2 THEN '.1.2' ELSE '' END AS section_id, text AS title, page_num FROM lines WHERE length(text) BETWEEN 3 AND 60),
held AS (SELECT l.doc_id, l.block_no, max(section_seq) AS section_seq FROM lines l JOIN sec s ON s.doc_id = l.doc_id AND s.section_seq <= l.block_no GROUP BY ALL),
section_docs AS (SELECT doc_id * 10000000 + section_seq AS doc_id, string_agg(text, chr(10) ORDER BY block_no) AS text FROM held JOIN lines USING (doc_id, block_no) GROUP BY doc_id, section_seq
  UNION ALL SELECT doc_id * 10000000, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sec))"""


@query(f"""WITH {_LINES}, {_SECTION_DOCS}, {_MASKED.replace('FROM documents', 'FROM section_docs')}, {_CHUNKS}, whole AS (SELECT chunks.*, list_reduce(kept, lambda s, x: {{'a': replace(s.a, x.a, x.b), 'b': ''}}, {{'a': content, 'b': ''}}).a AS text FROM chunks JOIN src USING (doc_id))
SELECT whole.doc_id // 10000000 AS doc_id, CAST(row_number() OVER (PARTITION BY whole.doc_id // 10000000 ORDER BY whole.doc_id, chunk_seq) AS INT) AS chunk_seq, 'chunk_' || substr(md5(text), 1, 12) AS chunk_id, section_id, title AS section_title, CAST(coalesce(page_num, 1) AS INT) AS page_num
FROM whole LEFT JOIN sec ON sec.doc_id = whole.doc_id // 10000000 AND sec.section_seq = whole.doc_id % 10000000""")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every section, with its id, title and page; of the whole text where a document has no section."""
    docs, sections, blocks = tables.read(spark, sf_dir, "documents"), tables.sections(spark, sf_dir), tables.blocks(spark, sf_dir)
    doubled = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit("\n\n"))
    texts = layout.section_texts(blocks, sections).withColumn("section_text", doubled("section_text"))
    out = chunking.chunk_documents(docs, sections, texts, layout.full_texts(blocks).withColumn("full_text", doubled("full_text")))
    return out.select("doc_id", "chunk_seq", "chunk_id", "section_id", "section_title", "page_num")


def _merged(items: str, sep: str) -> str:
    """SQL that merges a list of pieces up to 1000 characters, each beginning with up to 100 of the one before."""
    kind = "STRUCT(done VARCHAR[], held VARCHAR[])"
    joined = lambda l: f"coalesce(array_to_string({l}, {sep}), '')"
    closed = lambda l: f"regexp_replace({joined(l)}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"
    added = lambda done, l: f"CASE WHEN {closed(l)} = '' THEN {done} ELSE list_append({done}, {closed(l)}) END"
    rest = "s.held[k + 1:]"
    first = f"(list_filter(range(0, len(s.held) + 1), lambda k: k = len(s.held) OR (length({joined(rest)}) <= 100 AND length({joined(rest)}) + length(x.held[1]) + length({sep}) <= 1000)))[1]"
    step = f"""lambda s, x: CASE WHEN len(s.held) > 0 AND length({joined("list_append(s.held, x.held[1])")}) > 1000
      THEN CAST({{'done': {added("s.done", "s.held")}, 'held': list_append(s.held[{first} + 1:], x.held[1])}} AS {kind}) ELSE CAST({{'done': s.done, 'held': list_append(s.held, x.held[1])}} AS {kind}) END"""
    listed = f"list_transform({items}, lambda x: CAST({{'done': [], 'held': [x]}} AS {kind}))"
    return f"(SELECT {added('r.done', 'r.held')} FROM (SELECT list_reduce({listed}, {step}, CAST({{'done': [], 'held': []}} AS {kind})) AS r))"


def _level(name: str, source: str, keys: str, place: str, sep: str) -> str:
    """SQL of one separator: ``<name>_long`` are the pieces left to the next one, ``<name>`` the merged ones."""
    return f"""
{name}_parts AS (SELECT {keys}, i AS {place}, l[i] AS part, NOT contains(t, {sep}) OR length(l[i]) >= 1000 AS long FROM (SELECT {keys}, t, string_split(t, {sep}) AS l FROM {source}), unnest(range(1, len(l) + 1)) AS u(i)),
{name}_long AS (SELECT {keys}, {place}, part AS t FROM {name}_parts WHERE long),
{name}_runs AS (SELECT *, sum(long::INT) OVER (PARTITION BY {keys} ORDER BY {place}) AS run FROM {name}_parts),
{name}_lists AS (SELECT {keys}, min({place}) AS {place}, list(part ORDER BY {place}) AS l FROM {name}_runs WHERE NOT long AND part <> '' GROUP BY {keys}, run),
{name} AS (SELECT {keys}, {place}, {_merged('l', sep)} AS l FROM {name}_lists)"""


@query(f"""WITH {_PAGES}, texts AS (SELECT doc_id, page_num, page_text AS t FROM pages_of), {_level('line', 'texts', 'doc_id, page_num', 'j1', 'chr(10)')}, {_level('word', 'line_long', 'doc_id, page_num, j1', 'j2', "' '")},
sign AS (SELECT doc_id, page_num, j1, j2, {_merged("string_split(t, '')", "''")} AS l FROM word_long WHERE t <> ''),
every AS (SELECT doc_id, page_num, j1, 0 AS j2, l FROM line UNION ALL SELECT doc_id, page_num, j1, j2, l FROM word UNION ALL SELECT doc_id, page_num, j1, j2, l FROM sign)
SELECT doc_id, page_num, CAST(row_number() OVER (PARTITION BY doc_id, page_num ORDER BY j1, j2, k) - 1 AS INT) AS piece_no, CAST(length(l[k]) AS INT) AS n, 'chunk_' || substr(md5(l[k]), 1, 12) AS chunk_id FROM every, unnest(range(1, len(l) + 1)) AS u(k)""")
def split_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in pieces of a thousand characters. The SQL has no blank lines as separators; no given text has them."""
    pages = layout.page_texts(tables.blocks(spark, sf_dir))
    return chunking.split_fixed(pages, ["doc_id", "page_num"]).select("doc_id", "page_num", "piece_no", F.length("content").alias("n"), tx.chunk_id(F.col("content")).alias("chunk_id"))


# --- looked up one by one ------------------------------------------------------------------------


@query(f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM br WHERE rank <= 10", ints="rank")
def saved_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through an index that was saved and loaded again."""
    return lexical.search(_index(spark, sf_dir), tables.questions(spark, sf_dir), 10)


def _line_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a chunk that is cited, with its box; sources as sections."""
    lines = tables.blocks(spark, sf_dir)
    sources = tables.read(spark, sf_dir, "documents").select("doc_id", "source")
    chunks = lines.join(sources, "doc_id").select("doc_id", F.col("block_no").alias("chunk_id"), F.col("text").alias("content"), "page_num", F.col("source").alias("section_id"), F.lit(None).cast("string").alias("section_title"))
    b = F.col("bbox")
    boxes = lines.select("doc_id", F.col("block_no").alias("chunk_id"), F.struct(b["x0"].alias("x1"), b["y0"].alias("y1"), b["x1"].alias("x2"), b["y1"].alias("y2")).alias("coordinates"))
    return citations.build(chunks, sources.select("doc_id", F.lit("T").alias("title")), boxes=boxes)


@query(f"""WITH {_LINES}, src AS (SELECT doc_id, page_num, block_no, y, text FROM lines), snip AS ({_short('text', 200, 120)}),
near AS (SELECT a.doc_id, a.block_no, string_agg(b.text, chr(10) ORDER BY b.block_no) AS area FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND b.y + 10 >= greatest(0, a.y - 50) AND b.y <= least(200, a.y + 10 + 50) GROUP BY ALL),
placed AS (SELECT snip.doc_id, snip.block_no, area, short, instr(area, substr(short, 1, 50)) - 1 AS pos FROM snip JOIN near USING (doc_id, block_no))
SELECT doc_id AS document_id, block_no AS chunk_id, md5(CASE WHEN pos < 0 THEN '' ELSE substr(area, CAST(greatest(0, pos - 200) + 1 AS BIGINT), CAST(pos - greatest(0, pos - 200) AS BIGINT)) END) AS before,
md5(CASE WHEN pos < 0 THEN area ELSE substr(area, CAST(greatest(0, pos - 200) + 1 AS BIGINT), CAST(least(length(area), pos + length(short) + 200) - greatest(0, pos - 200) AS BIGINT)) END) AS full_context FROM placed""")
def citation_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text around every line, from the lines whose boxes touch its own."""
    lines = tables.blocks(spark, sf_dir)
    pages = lines.select("doc_id", "page_num").distinct().withColumns({"width": F.lit(500.0), "height": F.lit(200.0)})
    out = citations.contexts(_line_citations(spark, sf_dir), lines, pages)
    return out.select("document_id", "chunk_id", F.md5(F.col("context.before").cast("binary")).alias("before"), F.md5(F.col("context.full_context").cast("binary")).alias("full_context"))


@query(f"WITH {_LINES} SELECT doc_id AS document_id, block_no AS chunk_id, page_num AS page_number FROM lines JOIN documents d USING (doc_id) WHERE doc_id = 7 AND d.source = (SELECT source FROM documents WHERE doc_id = 7 LIMIT 1)")
def citations_of_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = tables.read(spark, sf_dir, "documents").where("doc_id = 7").select("source").first()
    return citations.of_section(_line_citations(spark, sf_dir), 7, source[0] if source else "").select("document_id", "chunk_id", "page_number")


@query(f"WITH {_CATALOG} SELECT id, upload_user, index_name FROM cat WHERE id = 42")
def catalog_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.by_id(tables.catalog(spark, sf_dir), 42).select("id", "upload_user", "index_name")


@query("SELECT CAST(user_id AS VARCHAR) AS username, event_id AS seq, props AS content FROM events WHERE user_id = 7")
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.history(tables.messages(spark, sf_dir, by_day=False), "7", "7").select("username", "seq", "content")


@query(f"WITH src AS (SELECT * FROM documents), s AS ({_short('text', 300, 210)}) SELECT doc_id, '**Title ' || source || CASE WHEN n_chars // 1000 > 0 THEN ', стр. ' || n_chars // 1000 ELSE '' END || ', ' || lang || '**' || CASE WHEN text <> '' THEN ' - \"' || short || '\"' ELSE '' END AS citation FROM s")
def quoted_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = answers.citation_with_quote(F.concat(F.lit("Title "), F.col("source")), F.floor(F.col("n_chars") / 1000), F.col("lang"), F.col("text"))
    return tables.read(spark, sf_dir, "documents").select("doc_id", cited.alias("citation"))


@query("SELECT user AS username, index_name FROM (SELECT DISTINCT source AS user, 'pdf-qa-personal-' || CASE source WHEN 'src1' THEN 'first' WHEN 'src2' THEN 'second' ELSE lower(source) END AS index_name FROM documents)")
def mapped_user_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = tables.read(spark, sf_dir, "documents").select(F.col("source").alias("username")).distinct()
    return users.withColumn("index_name", catalog.index_name(F.col("username"), F.lit("personal"), {"src1": "first", "src2": "second"}))


# --- streams -------------------------------------------------------------------------------------


@query("SELECT username, seq FROM (SELECT CAST(user_id AS VARCHAR) AS username, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS pos FROM events) WHERE pos <= 50")
def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last messages of each user after all events have come by as a stream."""
    folder = store.fresh_dir(spark, "messages")
    events = spark.readStream.schema(tables.read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    user = F.col("user_id").cast("string")
    rows = events.select(user.alias("username"), user.alias("conversation_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.col("props").alias("content"), "ts")
    messages.keep_messages(rows, folder).awaitTermination()
    return messages.kept_messages(spark, folder).select("username", "seq")


@query(f"""WITH {_MASKED}, {_CHUNKS}, whole AS (SELECT doc_id, list_reduce(kept, lambda s, x: {{'a': replace(s.a, x.a, x.b), 'b': ''}}, {{'a': content, 'b': ''}}).a AS text FROM chunks JOIN src USING (doc_id))
SELECT 'chunk_' || substr(md5(text), 1, 12) AS chunk_id, max(doc_id) AS document_id, CAST(length(any_value(text)) AS INT) AS character_count FROM whole GROUP BY 1""")
def stream_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index after all documents have come by as a stream and were cut into chunks on their way."""
    folder = store.fresh_dir(spark, "documents")
    docs = spark.readStream.schema(tables.read(spark, sf_dir, "documents").schema).parquet(f"{sf_dir}/documents.parquet*")

    def cut(rows: DataFrame) -> DataFrame:
        doubled = rows.select(F.col("doc_id").alias("document_id"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
        return chunking.chunk_texts(doubled, ["document_id"]).select("document_id", "chunk_id", "content", "character_count")

    streams.ingest(docs, f"{folder}/out", f"{folder}/state", cut).awaitTermination()
    return streams.latest(spark, f"{folder}/out").select("chunk_id", "document_id", "character_count")
