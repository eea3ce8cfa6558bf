"""Registered queries on the given tables, each with SQL that DuckDB can run, where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import answers, catalog, chat, chunking, citations, hybrid, layout, lexical, metadata, vectors
from ..sources import lexical_store, store, summaries
from . import tables
from .registry import QUERIES, SQL, query  # noqa: F401
from .tables import COMMON_TERMS, QUERY_STEP

# --- pieces of SQL -------------------------------------------------------------------------------

_TOKENS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}'))"
_LINES = "lines AS (SELECT doc_id, CAST(i - 1 AS INT) AS block_no, CAST((i - 1) // 20 + 1 AS INT) AS page_num, ((i - 1) % 20) * 10.0 AS y, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i))"
_PAGES = f"{_LINES}, pages_of AS (SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY block_no) AS page_text FROM lines GROUP BY ALL)"
_SPACE = r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]"
_TERMS = "[" + ", ".join(f"'{t}'" for t in COMMON_TERMS) + "]"
_ITEMS = "SELECT item_id AS query_id, text FROM benchmark"


def _lexical(asked: str) -> str:
    """SQL of lexical search; ``br`` are the ranked results of ``asked`` (``query_id, text``)."""
    return f"""
tok AS (SELECT doc_id, unnest({_TOKENS.format("text")}) AS term FROM documents),
lens AS (SELECT doc_id, len({_TOKENS.format("text")}) AS length FROM documents),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
tot AS (SELECT count(*) AS n, avg(length) AS avg_length FROM lens),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, tot GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOKENS.format("text")}) AS term FROM ({asked})) GROUP BY ALL),
bs AS (SELECT query_id, doc_id AS chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg_length))), 6) AS score
       FROM q JOIN idf USING (term) JOIN post USING (term) JOIN lens USING (doc_id), tot GROUP BY ALL),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bs WHERE score > 0)"""


_BM25 = _lexical(_ITEMS)
_COSINE = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)"
_HYBRID = (
    _BM25
    + f""",
vs AS (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, {_COSINE} AS score FROM embeddings b JOIN benchmark ON item_id = b.vec_id, embeddings a JOIN documents ON doc_id = a.vec_id),
vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vs WHERE score > 0) WHERE rank <= 20),
has AS (SELECT DISTINCT query_id FROM vr),
parts AS (SELECT query_id, chunk_id, 0.5 / (60 + rank) AS part FROM br WHERE rank <= 20 AND query_id IN (FROM has) UNION ALL SELECT query_id, chunk_id, 0.5 / (60 + rank) FROM vr),
fs AS (SELECT query_id, chunk_id, round(sum(part), 6) AS score FROM parts GROUP BY ALL),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fs
          UNION ALL SELECT query_id, chunk_id, score, rank FROM br WHERE rank <= 20 AND query_id NOT IN (FROM has)),
hyb AS (SELECT * FROM fused WHERE rank <= 10)"""
)


def _short(text: str, most: int, least: int) -> str:
    """SQL of ``functions.text.shortened``; ``least`` is the last place that is too early for a sentence's end."""
    clean = rf"regexp_replace(regexp_replace({text}, '[\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')"
    place = lambda s: f"CASE WHEN instr(reverse(cut), '{s}') = 0 THEN -1 ELSE length(cut) - instr(reverse(cut), '{s}') END"
    return f"""SELECT *, CASE WHEN length(clean) <= {most} THEN clean WHEN sentence > {least} THEN substr(cut, 1, sentence + 1) WHEN space > 0 THEN substr(cut, 1, space) || '...' ELSE cut || '...' END AS short
    FROM (SELECT *, greatest({place('.')}, {place('!')}, {place('?')}) AS sentence, {place(' ')} AS space FROM (SELECT *, substr(clean, 1, {most}) AS cut FROM (SELECT *, {clean} AS clean FROM src)))"""


# --- lexical and vector search -------------------------------------------------------------------


def _index(spark: SparkSession, sf_dir: str) -> lexical.LexicalIndex:
    """Of all documents, stored, so that their texts are read and cut into words once."""
    folder = store.fresh_dir(spark, "lexical")
    lexical_store.save(tables.contents(spark, sf_dir), folder)
    return lexical_store.load(spark, folder)


@query(f"WITH {_BM25}, src AS (SELECT br.*, text, 'chunk_' || substr(md5(text), 1, 12) AS content_id FROM br JOIN documents ON doc_id = chunk_id WHERE rank <= 10) SELECT query_id, chunk_id, content_id, score, rank, short AS snippet FROM ({_short('text', 200, 120)})", ints="rank")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten documents of every benchmark text, with content id and snippet."""
    found = store.kept(lexical.search(_index(spark, sf_dir), tables.questions(spark, sf_dir), 10), "found")
    rows = found.join(tables.contents(spark, sf_dir), "chunk_id")
    return rows.select("query_id", "chunk_id", tx.chunk_id(F.col("content")).alias("content_id"), "score", "rank", tx.snippet(F.col("content")).alias("snippet"))


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf, CAST(sum(tf) AS BIGINT) AS total FROM idf JOIN post USING (term) GROUP BY ALL")
def postings_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    totals = index.postings().groupBy("term").agg(F.sum("tf").alias("total"))
    return index.terms.join(totals, "term").select("term", "df", F.round("idf", 6).alias("idf"), "total")


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = tables.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return rows, rows.where(F.col("chunk_id") % QUERY_STEP == 0)


_ASKED = f"SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, {_COSINE} AS score FROM embeddings a, embeddings b WHERE b.vec_id % {QUERY_STEP} = 0"
_TOP = "SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s {0}) WHERE rank <= {1}"


@query(f"WITH s AS ({_ASKED}) {_TOP.format('WHERE score > 0', 10)}", ints="rank")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = _asked(spark, sf_dir)
    return vectors.search(rows, asked.withColumnRenamed("chunk_id", "query_id"), 10)


@query(f"WITH s AS ({_ASKED} AND a.vec_id <> b.vec_id) {_TOP.format('', 5)}", ints="rank")
def similar_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar(*_asked(spark, sf_dir), 5)


@query(f"WITH s AS ({_ASKED} AND a.label = 3) {_TOP.format('', 5)}", ints="rank")
def prefiltered_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, asked = _asked(spark, sf_dir)
    return vectors.search_within(rows, asked.withColumnRenamed("chunk_id", "query_id"), {"label": 3}, 5)


def _hybrid(spark: SparkSession, sf_dir: str, filters: dict | None = None) -> DataFrame:
    return hybrid.search(_index(spark, sf_dir), tables.chunks(spark, sf_dir), tables.questions(spark, sf_dir, True), 10, 0.5, filters)


@query(f"WITH {_HYBRID} SELECT * FROM fused", ints="rank")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lists of each question, twenty long, fused and not cut."""
    asked = tables.questions(spark, sf_dir, True)
    return hybrid.fuse(lexical.search(_index(spark, sf_dir), asked, 20), vectors.search(tables.chunks(spark, sf_dir), asked, 20))


@query(f"WITH {_HYBRID} SELECT * FROM hyb", ints="rank")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir)


@query(f"WITH {_HYBRID}, kept AS (SELECT fused.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM fused JOIN documents ON doc_id = chunk_id WHERE lang IN ('en', 'fr') AND source <> '') SELECT query_id, chunk_id, score, rank FROM kept WHERE pos <= 10", ints="rank")
def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, {"lang": ["en", "fr"], "unknown": "passed over"})


@query(f"WITH {_HYBRID}, kept AS (SELECT fused.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM fused JOIN documents ON doc_id = chunk_id WHERE source = 'src0') SELECT query_id, chunk_id, score, rank FROM kept WHERE pos <= 10", ints="rank")
def section_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.search_section(_index(spark, sf_dir), tables.chunks(spark, sf_dir), tables.questions(spark, sf_dir, True), "src0")


@query(f"WITH {_HYBRID}, kept AS (SELECT fused.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS pos FROM fused JOIN documents ON doc_id = chunk_id WHERE lang = 'de') SELECT query_id, chunk_id, score, rank FROM kept WHERE pos <= 10", ints="rank")
def content_type_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.search_content_type(_index(spark, sf_dir), tables.chunks(spark, sf_dir), tables.questions(spark, sf_dir, True), "de")


@query("SELECT conv_id, turn, m AS is_math, CASE WHEN m THEN 8 ELSE 5 END AS k FROM (SELECT conv_id, turn, len(list_filter(['ting', 'essa', 'quel', 'schaft'], lambda t: contains(lower(text), t))) > 0 AS m FROM conversations WHERE role = 'user')")
def question_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.read(spark, sf_dir, "conversations").where("role = 'user'")
    return hybrid.route(asked, "text", ["ting", "essa", "quel", "schaft"]).select("conv_id", "turn", "is_math", "k")


@query("SELECT item_id AS query_id, contains(lower(text), 'tion') AS is_first, CASE WHEN contains(lower(text), 'tion') THEN text ELSE 'second ' || item_id END AS answer FROM benchmark")
def answer_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.questions(spark, sf_dir)
    good = F.contains(F.lower("question"), F.lit("tion"))
    none = F.lit(None).cast("string")
    first = asked.select("query_id", F.when(good, F.col("question")).otherwise(F.lit("Нет информации по вопросу")).alias("answer"), none.alias("error"))
    second = asked.select("query_id", F.concat(F.lit("second "), F.col("query_id").cast("string")).alias("answer"), none.alias("error"))
    return hybrid.with_fallback(asked, first, second).select("query_id", (F.col("method") == "first").alias("is_first"), "answer")


@query(f"WITH {_HYBRID}, r AS (SELECT item_id AS query_id, h.score, n_chars FROM benchmark LEFT JOIN hyb h ON h.query_id = item_id LEFT JOIN documents ON doc_id = chunk_id) SELECT query_id, count(score) AS chunks_retrieved, round(coalesce(avg(score), 0), 6) AS mean_score, coalesce(bool_or(n_chars % 2 = 1), false) AS has_formulas, coalesce(bool_or(n_chars % 3 = 1), false) AS has_tables FROM r GROUP BY 1")
def retrieval_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("n_chars") % 2).alias("formula_count"), F.when(F.col("n_chars") % 3 == 1, 1).otherwise(0).alias("table_count"))
    return hybrid.retrieval_stats(tables.questions(spark, sf_dir), _hybrid(spark, sf_dir), counted)


# --- store ---------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.chunks(spark, sf_dir).withColumn("index_name", F.col("source"))


@query(f"""WITH s AS ({_ASKED} AND a.vec_id IN (SELECT doc_id FROM documents WHERE source = 'src1' AND lang = 'de')) {_TOP.format('', 5)}""", ints="rank")
def stored_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as named indexes and read back; files of other indexes aren't opened, and within one row groups of other types are passed over."""
    folder = store.fresh_dir(spark, "indexes")
    docs = tables.contents(spark, sf_dir).join(tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.col("lang").alias("content_type")), "chunk_id")
    embeddings = tables.read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    store.write_indexes(store.vector_rows(docs, embeddings, F.col("source")), folder)
    asked = _asked(spark, sf_dir)[1].withColumnRenamed("chunk_id", "query_id")
    return vectors.search_within(store.read_index(spark, folder, "src1"), asked, {"content_type": "de"}, 5)


@query("SELECT source AS index_name, count(*) AS total_vectors, max(len(embedding)) AS dimension FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1", ints="dimension")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.index_stats(_vectors(spark, sf_dir))


@query("SELECT count(*) AS total_documents, count(embedding) AS total_embeddings, true AS has_bm25_index, 60 AS rrf_k_parameter, array_to_string(list_sort(list(DISTINCT lang)), ',') AS content_types, array_to_string(list_sort(list(DISTINCT source)), ',') AS sections FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.search_stats(tables.chunks(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("content_types", "sections")})


@query("SELECT count(*) AS total_documents, count(embedding) AS total_embeddings, true AS has_bm25_index, 60 AS rrf_k_parameter, array_to_string(list_sort(list(DISTINCT lang)), ',') AS content_types, array_to_string(list_sort(list(DISTINCT source)), ',') AS sections FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE source NOT IN ('src0', 'src7')")
def kept_search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures from summaries alone, after documents came in two lots, one of them twice, and those of two sources went."""
    folder = store.fresh_dir(spark, "figures")
    rows = _vectors(spark, sf_dir).withColumn("lot", F.col("chunk_id") % 2)
    keys, sums = summaries.CHUNK_KEYS, summaries.CHUNK_SUMS
    for batch, lot in (("a", 0), ("b", 1), ("b", 1)):
        summaries.record(rows.where(F.col("lot") == lot), folder, batch, keys, sums)
    for batch, source in (("c", "src0"), ("d", "src7")):
        summaries.record(rows.where(F.col("index_name") == source), folder, batch, keys, sums, gone=True)
    out = summaries.search_stats(summaries.merged(spark, folder, keys, sums))
    return out.withColumns({c: F.array_join(c, ",") for c in ("content_types", "sections")})


@query("SELECT DISTINCT source AS index_name FROM documents WHERE source <> 'src0'")
def clear_and_list_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.index_names(store.clear(_vectors(spark, sf_dir), "src0"))


@query("SELECT doc_id AS chunk_id, lang FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 5")
def sample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.sample(_vectors(spark, sf_dir), "src1").select("chunk_id", F.col("content_type").alias("lang"))


@query("SELECT source AS index_name, 'chunk_' || substr(md5(text), 1, 12) AS chunk_id, max(doc_id) AS document_id FROM documents GROUP BY ALL")
def upsert_by_content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "documents").select(F.col("source").alias("index_name"), tx.chunk_id(F.col("text")).alias("chunk_id"), F.col("doc_id").alias("document_id"), F.col("doc_id").alias("ingest_seq"))
    even = F.col("document_id") % 2 == 0
    return store.upsert(store.upsert(None, rows.where(even)), rows.where(~even)).select("index_name", "chunk_id", "document_id")


@query("SELECT doc_id, n_chars, n_chars <= 5000 AS accepted FROM documents")
def admit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("n_chars").alias("file_size"))
    return store.admit(files, 5000).select("doc_id", "n_chars", "accepted")


@query("SELECT DISTINCT upload AS source, 'pdf-qa-personal-' || lower(upload) AS index_name FROM (SELECT upper(source) AS upload FROM documents)")
def user_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = tables.read(spark, sf_dir, "documents").select(F.upper("source").alias("source")).distinct()
    return users.withColumn("index_name", catalog.index_name(F.col("source"), F.lit("personal")))


_LEFT = "left_docs AS (SELECT * FROM documents WHERE source NOT IN ('src0', 'src3'))"


@query(f"WITH {_LEFT}, {_BM25.replace('FROM documents', 'FROM left_docs')} SELECT query_id, chunk_id, score, rank FROM br WHERE rank <= 10", ints="rank")
def incremental_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents come to a stored index in two lots, and those of two sources are taken out, one before and one after the second lot."""
    folder = store.fresh_dir(spark, "segments")
    docs = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source", (F.col("doc_id") % 2).alias("lot"))
    lexical_store.add(docs.where("lot = 0"), folder)
    lexical_store.delete(docs.where("lot = 0 AND source IN ('src0', 'src3')"), folder)
    lexical_store.add(docs.where("lot = 1"), folder)
    lexical_store.delete(docs.where("source IN ('src0', 'src3')"), folder)
    return lexical.search(lexical_store.load(spark, folder), tables.questions(spark, sf_dir), 10)


# --- structure and metadata ----------------------------------------------------------------------


@query(f"WITH {_LINES} SELECT doc_id, string_agg(text, chr(10) ORDER BY block_no) AS full_text FROM lines GROUP BY 1")
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.full_texts(tables.blocks(spark, sf_dir))


@query(rf"WITH {_LINES}, p AS (SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY block_no) AS t FROM lines GROUP BY ALL), c AS (SELECT doc_id, count(*) AS page_count, CAST(sum(length(t)) AS BIGINT) AS total_characters, CAST(sum(len(list_filter(regexp_split_to_array(t, '[\s\x0b\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+'), lambda w: w <> ''))) AS BIGINT) AS total_words FROM p GROUP BY 1) SELECT *, round(total_words / page_count, 6) AS avg_words_per_page, round(total_words / 200, 6) AS estimated_reading_time_minutes FROM c")
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.document_stats(layout.page_texts(tables.blocks(spark, sf_dir)))


@query(rf"WITH {_PAGES}, p AS (SELECT doc_id, lower(string_agg(page_text, '' ORDER BY page_num)) AS t FROM pages_of WHERE page_num <= 10 GROUP BY 1), n AS (SELECT doc_id, list_sum(list_transform({_TERMS}, lambda w: CAST((length(t) - length(replace(t, w, ''))) / length(w) AS INT))) AS n, t FROM p) SELECT doc_id, regexp_matches(t, '\$[^\n]*?\$|\\[a-zA-Z]+\{{[^\n]*?\}}') AS has_mathematical_formulas, n > 5 AS has_financial_terms, CAST(n AS BIGINT) AS financial_term_count, regexp_matches(t, 'table\s+[0-9]+|figure\s+[0-9]+') AS has_tables, regexp_matches(t, 'references|bibliography') AS has_references FROM n")
def term_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metadata.indicators(layout.page_texts(tables.blocks(spark, sf_dir)), COMMON_TERMS)
    return found.select("doc_id", "has_mathematical_formulas", "has_financial_terms", F.col("financial_term_count").cast("long").alias("financial_term_count"), "has_tables", "has_references")


#: More terms than are looked for one by one: every pair of letters.
_PAIRS = [a + b for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]


@query(f"""SELECT doc_id, CAST(list_sum(list_transform(p, lambda w: (length(t) - length(replace(t, w, ''))) // 2)) AS INT) AS n, CAST(len(list_filter(p, lambda w: contains(t, w))) AS INT) AS n_terms
FROM (SELECT doc_id, lower(text) AS t, [{", ".join(f"'{t}'" for t in _PAIRS)}] AS p FROM documents)""")
def many_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often 676 terms occur in each text, and how many of them do."""
    text = F.lower("text")
    return tables.read(spark, sf_dir, "documents").select("doc_id", tx.occurrences(text, _PAIRS).alias("n"), F.size(tx.terms_in(text, _PAIRS)).alias("n_terms"))


@query(f"WITH {_LINES}, p AS (SELECT doc_id, lower(string_agg(text, chr(10) ORDER BY block_no)) AS t FROM lines WHERE page_num <= 5 GROUP BY 1) SELECT doc_id, array_to_string(list_filter({_TERMS}, lambda w: contains(t, w)), ',') AS keywords FROM p")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.keywords(layout.page_texts(tables.blocks(spark, sf_dir)), COMMON_TERMS).withColumn("keywords", F.array_join("keywords", ","))


@query("SELECT l_orderkey, l_quantity AS median_quantity FROM (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE pos = n // 2 + 1")
def body_size_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.upper_median(tables.read(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity").withColumnRenamed("l_quantity", "median_quantity")


_BODY = "sz AS (SELECT *, 9.0 + length(text) % 7 AS size FROM lines), md AS (SELECT doc_id, size FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY size) AS pos, count(*) OVER (PARTITION BY doc_id) AS n FROM sz WHERE page_num <= 3 AND length(trim(text)) > 20) WHERE pos = n // 2 + 1), body AS (SELECT doc_id, coalesce(size, 11.0) AS body_size FROM documents LEFT JOIN md USING (doc_id))"


@query(rf"WITH {_LINES}, {_BODY} SELECT doc_id, block_no, CAST(size AS DOUBLE) AS size, CAST(body_size AS DOUBLE) AS body_size FROM sz JOIN body USING (doc_id) WHERE length(trim(text)) >= 3 AND size >= body_size * 1.2 AND length(text) <= 100 AND regexp_matches(text, '^[\p{{Lu}}\p{{Nd}}]')")
def header_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = tables.spans(spark, sf_dir).join(layout.body_sizes(tables.spans(spark, sf_dir), tables.read(spark, sf_dir, "documents")), "doc_id")
    return spans.where(layout.is_header(F.col("text"), F.col("size"), F.col("body_size"))).select("doc_id", "block_no", "size", "body_size")


_SECTIONS = "sec AS (SELECT doc_id, block_no AS section_seq, (block_no % 4 + 1) || CASE block_no % 3 WHEN 1 THEN '.1' WHEN 2 THEN '.1.2' ELSE '' END AS section_id, block_no % 3 + 1 AS lv, page_num, y FROM lines WHERE length(text) BETWEEN 3 AND 60)"


@query(f"WITH {_LINES}, {_SECTIONS}, p AS (SELECT a.doc_id, a.section_seq, max(b.section_seq) AS parent_seq FROM sec a LEFT JOIN sec b ON b.doc_id = a.doc_id AND b.section_seq < a.section_seq AND b.lv < a.lv GROUP BY ALL), k AS (SELECT p.doc_id, p.parent_seq AS section_seq, string_agg(s.section_id, ',' ORDER BY p.section_seq) AS children FROM p JOIN sec s USING (doc_id, section_seq) WHERE parent_seq IS NOT NULL GROUP BY ALL) SELECT sec.doc_id, sec.section_seq, sec.section_id, CAST(sec.lv AS INT) AS hierarchy_level, par.section_id AS parent_section, coalesce(children, '') AS children FROM sec JOIN p USING (doc_id, section_seq) LEFT JOIN sec par ON par.doc_id = sec.doc_id AND par.section_seq = p.parent_seq LEFT JOIN k ON k.doc_id = sec.doc_id AND k.section_seq = sec.section_seq")
def section_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = tables.sections(spark, sf_dir).withColumn("hierarchy_level", layout.hierarchy_level(F.col("section_id")))
    out = layout.with_hierarchy(sections)
    return out.select("doc_id", "section_seq", "section_id", "hierarchy_level", "parent_section", F.array_join("child_sections", ",").alias("children"))


@query(f"WITH {_LINES}, {_SECTIONS}, a AS (SELECT l.doc_id, l.block_no, max(section_seq) AS section_seq FROM lines l JOIN sec s ON s.doc_id = l.doc_id AND s.section_seq <= l.block_no GROUP BY ALL), t AS (SELECT doc_id, section_seq, md5(string_agg(text, chr(10) ORDER BY block_no)) AS digest, count(*) AS n_blocks FROM a JOIN lines USING (doc_id, block_no) GROUP BY ALL) SELECT * FROM t")
def asof_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each section by digest, and its number of blocks."""
    blocks, sections = tables.blocks(spark, sf_dir), tables.sections(spark, sf_dir)
    counts = layout.assign_sections(blocks, sections).groupBy("doc_id", "section_seq").agg(F.count(F.lit(1)).alias("n_blocks"))
    texts = layout.section_texts(blocks, sections)
    return texts.join(counts, ["doc_id", "section_seq"]).select("doc_id", "section_seq", F.md5(F.col("section_text").cast("binary")).alias("digest"), "n_blocks")


@query(f"WITH {_LINES}, {_SECTIONS}, c AS (SELECT doc_id, page_num, CASE WHEN block_no % 2 = 0 THEN (block_no % 4 + 1)::VARCHAR END AS section_id, block_no FROM lines), ex AS (SELECT doc_id, section_id, min(section_seq) AS e FROM sec GROUP BY ALL), pg AS (SELECT doc_id, page_num, min(section_seq) AS s FROM sec GROUP BY ALL), nr AS (SELECT c.doc_id, c.block_no, max_by(s, pg.page_num) AS s FROM c JOIN pg ON pg.doc_id = c.doc_id AND pg.page_num <= c.page_num GROUP BY ALL) SELECT c.doc_id, c.block_no, coalesce(e, s) AS found_seq FROM c LEFT JOIN ex USING (doc_id, section_id) LEFT JOIN nr ON nr.doc_id = c.doc_id AND nr.block_no = c.block_no")
def section_of_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("block_no") % 2 == 0, (F.col("block_no") % 4 + 1).cast("string"))
    chunks = tables.blocks(spark, sf_dir).select("doc_id", "page_num", "block_no", own.alias("section_id"))
    return layout.section_of_chunks(chunks, tables.sections(spark, sf_dir)).select("doc_id", "block_no", "found_seq")


@query(f"WITH {_LINES}, {_SECTIONS}, f AS (SELECT doc_id, section_id, max(section_seq) AS s FROM sec GROUP BY ALL), r AS (SELECT d.doc_id, a.s AS s, b.s AS e FROM documents d LEFT JOIN f a ON a.doc_id = d.doc_id AND a.section_id = '1' LEFT JOIN f b ON b.doc_id = d.doc_id AND b.section_id = '2.1') SELECT r.doc_id AS request_id, md5(coalesce(string_agg(text, chr(10) ORDER BY block_no), '')) AS digest FROM r LEFT JOIN lines l ON l.doc_id = r.doc_id AND block_no >= s AND (e IS NULL OR block_no < e) GROUP BY 1")
def text_between_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "doc_id", F.lit("1").alias("start_id"), F.lit("2.1").alias("end_id"))
    out = layout.text_between(tables.blocks(spark, sf_dir), tables.sections(spark, sf_dir), requests)
    return out.select("request_id", F.md5(F.col("text").cast("binary")).alias("digest"))


# --- chunks --------------------------------------------------------------------------------------

_LONG = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{4,}}')))"


@query(f"WITH {_LINES}, w AS (SELECT *, {_LONG.format('text')} AS ws, lag(text) OVER o AS before FROM lines WINDOW o AS (PARTITION BY doc_id ORDER BY block_no)), v AS (SELECT *, lag(ws) OVER (PARTITION BY doc_id ORDER BY block_no) AS wb FROM w), n AS (SELECT doc_id, block_no, CASE WHEN before IS NULL OR (length(before) + length(text) <= 800 AND least(len(ws), len(wb)) > 0 AND len(list_intersect(ws, wb)) * 10 >= least(len(ws), len(wb)) * 3) THEN 0 ELSE 1 END AS new FROM v) SELECT doc_id, block_no, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY block_no) AS INT) AS group_no FROM n")
def paragraph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.group_paragraphs(tables.blocks(spark, sf_dir), ["doc_id"], "block_no", "text").select("doc_id", "block_no", "group_no")


@query("SELECT d.doc_id, count(l.block_no) AS total_chunks, round(coalesce(avg(length(l.text)), 0), 6) AS average_chunk_size, count_if(contains(l.text, '$')) AS formula_chunks, count_if(contains(l.text, '|')) AS table_chunks, count_if(contains(l.text, '$')) > 0 AS has_formulas, count_if(contains(l.text, '|')) > 0 AS has_tables, count_if(length(l.text) BETWEEN 3 AND 60) AS sections_detected FROM documents d LEFT JOIN lines l USING (doc_id) GROUP BY 1".replace("SELECT d.doc_id", f"WITH {_LINES} SELECT d.doc_id", 1), longs="formula_chunks sections_detected table_chunks")
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda c: F.contains("text", F.lit(c)).cast("int")
    chunks = tables.blocks(spark, sf_dir).select("doc_id", F.col("text").alias("content"), has("$").alias("formula_count"), has("|").alias("table_count"))
    return chunking.ingest_stats(tables.read(spark, sf_dir, "documents"), chunks, tables.sections(spark, sf_dir))


@query(r"SELECT doc_id, trim(regexp_replace(replace(replace(text, '$$', ''), '$', ''), '[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')) AS normalized FROM documents")
def normalized_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select("doc_id", chunking.normalize_formula(F.col("text")).alias("normalized"))


_LATEX = r"'$\alpha_' || doc_id || ' + \beta$ \frac{\sigma}{\sqrt{\mu}} \[ \sum  x \] \begin{align}\int y\end{align} ' || text"
_WITH_WORDS = "replace({0}, '{1}', '{2}')"


def _plain_latex(text: str) -> str:
    """SQL of ``chunking.normalize_formula``."""
    for d in chunking.FORMULA_DELIMITERS:
        text = _WITH_WORDS.format(text, d, "")
    text = f"trim(regexp_replace({text}, '{_SPACE}+', ' ', 'g'))"
    for command, word in chunking.FORMULA_WORDS:
        text = _WITH_WORDS.format(text, command, word)
    return text


@query(f"SELECT doc_id, md5({_plain_latex(_LATEX)}) AS digest, contains({_plain_latex(_LATEX)}, 'fraction{{sigma}}{{square_root{{mu}}}}') AS has_words FROM documents")
def latex_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts behind a formula of commands and delimiters of every kind."""
    head = F.concat(F.lit("$\\alpha_"), F.col("doc_id").cast("string"), F.lit(" + \\beta$ \\frac{\\sigma}{\\sqrt{\\mu}} \\[ \\sum  x \\] \\begin{align}\\int y\\end{align} "), F.col("text"))
    plain = chunking.normalize_formula(head)
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.md5(plain.cast("binary")).alias("digest"), F.contains(plain, F.lit("fraction{sigma}{square_root{mu}}")).alias("has_words"))


_CAPTIONED = "SELECT doc_id, 'Table ' || (doc_id % 90 + 1) || ': ' || text AS t, length('Table ' || (doc_id % 90 + 1)) AS n FROM documents"
_ENDS = r"\n\s*\n|\n\s*[A-Z]"


@query(f"""WITH c AS ({_CAPTIONED}), w AS (SELECT doc_id, t, least(n + 200, length(t)) AS e FROM c), v AS (SELECT *, substr(t, 51, greatest(0, e - 50)) AS tail FROM w)
SELECT doc_id, CASE WHEN regexp_matches(tail, '{_ENDS}') THEN 50 + length(regexp_split_to_array(tail, '{_ENDS}')[1]) ELSE e END AS n, md5(substr(t, 1, CASE WHEN regexp_matches(tail, '{_ENDS}') THEN 50 + length(regexp_split_to_array(tail, '{_ENDS}')[1]) ELSE e END)) AS digest FROM v""", ints="n")
def caption_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a caption goes that stands at the beginning of each text."""
    text = F.concat(F.lit("Table "), (F.col("doc_id") % 90 + 1).cast("string"), F.lit(": "), F.col("text"))
    masked = chunking.paragraphs(tables.read(spark, sf_dir, "documents").select("doc_id", text.alias("text")), ["doc_id"])
    kept = masked.select("doc_id", F.explode("kept").alias("mark", "caption")).where(F.col("mark").rlike("^__TABLE_0__$"))
    return kept.select("doc_id", F.length("caption").alias("n"), F.md5(F.col("caption").cast("binary")).alias("digest"))


def _marks(texts: list[str]) -> list[list[float]]:
    """A vector for each text that SQL can say too."""
    return [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts]


@query("SELECT doc_id AS chunk_id, CAST(length(text) AS BIGINT) AS signs, CAST(length(text) - length(replace(text, 'e', '')) AS BIGINT) AS letters, CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS spaces FROM documents")
def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents embedded in batches by a function that counts."""
    out = chunking.embed(tables.contents(spark, sf_dir), _marks)
    return out.select("chunk_id", *(F.col("embedding")[k].cast("long").alias(c) for k, c in enumerate(("signs", "letters", "spaces"))))


# --- citations -----------------------------------------------------------------------------------


@query(f"WITH src AS (SELECT doc_id, text FROM documents) SELECT doc_id, short AS snippet FROM ({_short('text', 200, 120)})")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query(f"WITH src AS (SELECT doc_id, text FROM documents) SELECT doc_id, short AS quote FROM ({_short('text', 300, 210)})")
def clean_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "documents").select("doc_id", tx.quote(F.col("text")).alias("quote"))


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid results with citations: sources as documents, languages as sections, thousands of characters as pages."""
    docs = tables.read(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("text").alias("content"), (F.floor(F.col("n_chars") / 1000)).alias("page_num"), F.lit(None).cast("string").alias("section_id"), F.col("lang").alias("section_title"))
    titles = docs.select(F.col("source").alias("doc_id"), F.concat(F.lit("Title "), F.col("source")).alias("title")).distinct()
    found = store.kept(_hybrid(spark, sf_dir), "found")
    wanted = chunks.join(found.select("chunk_id").distinct(), "chunk_id", "left_semi")  # snippets of what was found alone
    return citations.look_up(found, citations.build(wanted, titles))


_CITED = f"{_HYBRID}, src AS (SELECT hyb.*, text, source AS document_id, 'Title ' || source AS document_title, n_chars // 1000 AS page_number, lang AS section_title FROM hyb LEFT JOIN documents ON doc_id = chunk_id), cited AS ({_short('text', 200, 120)})"


@query(f"WITH {_CITED} SELECT query_id, chunk_id, rank, document_id, document_title || CASE WHEN page_number > 0 THEN ', p. ' || page_number ELSE '' END || ', ' || section_title || CASE WHEN short <> '' THEN ' - \"' || short || '\"' ELSE '' END AS citation FROM cited", ints="rank")
def citation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = citations.with_text(_cited(spark, sf_dir))
    return cited.select("query_id", "chunk_id", "rank", "document_id", F.when(F.col("document_id").isNotNull(), F.col("citation")).alias("citation"))


@query(f"""WITH {_CITED}, k AS (SELECT * FROM cited WHERE document_id IS NOT NULL), pg AS (SELECT query_id, document_id, document_title, page_number, string_agg(DISTINCT section_title, ', ' ORDER BY section_title) AS s FROM k GROUP BY ALL),
rf AS (SELECT query_id, document_id, document_title, string_agg('p. ' || page_number || ' (' || s || ')', ', ' ORDER BY page_number) AS r FROM pg GROUP BY ALL),
qt AS (SELECT query_id, document_id, min(rank) AS first, count(*) AS n, count_if(short <> '') AS quotes FROM k GROUP BY ALL)
SELECT query_id, string_agg(document_title || ', ' || r, '; ' ORDER BY first) AS sources, CAST(sum(quotes) AS BIGINT) AS quotes, CAST(sum(n) AS BIGINT) AS citation_count, count(*) AS document_count FROM rf JOIN qt USING (query_id, document_id) GROUP BY 1""")
def detailed_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = citations.detailed(_cited(spark, sf_dir))
    return out.select("query_id", F.array_join(F.transform("sources", lambda s: s["citation_string"]), "; ").alias("sources"), F.aggregate("sources", F.lit(0).cast("long"), lambda n, s: n + F.size(s["quotes"])).alias("quotes"), "citation_count", "document_count")


@query(f"WITH {_CITED} SELECT query_id, rank, document_title || CASE WHEN page_number > 0 THEN ', p. ' || page_number ELSE '' END || ', ' || section_title AS citation, short AS quote FROM cited WHERE document_id IS NOT NULL", ints="rank")
def citation_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.as_sources(_cited(spark, sf_dir)).select("query_id", "rank", "citation", "quote")


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents")
    chunks = docs.select(F.col("source").alias("doc_id"), tx.chunk_id(F.col("text")).alias("chunk_id"), F.col("text").alias("content"), (F.floor(F.col("n_chars") / 1000)).alias("page_num"), F.lit(None).cast("string").alias("section_id"), F.lit(None).cast("string").alias("section_title")).dropDuplicates(["doc_id", "chunk_id"])
    return citations.build(chunks, docs.select(F.col("source").alias("doc_id"), F.lit(None).cast("string").alias("title")).distinct())


@query("SELECT count(*) AS total_citations, count(DISTINCT source) AS documents_with_citations FROM (SELECT DISTINCT source, 'chunk_' || substr(md5(text), 1, 12) AS c FROM documents)")
def citation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.totals(_citations(spark, sf_dir))


@query("SELECT DISTINCT source AS document_id, 'chunk_' || substr(md5(text), 1, 12) AS chunk_id, n_chars // 1000 AS page_number, 'Unknown Document' AS document_title FROM documents WHERE source = 'src2' AND n_chars // 1000 = 1")
def citations_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.of_page(_citations(spark, sf_dir), "src2", 1).select("document_id", "chunk_id", "page_number", "document_title")


@query("SELECT DISTINCT source AS document_id, 'chunk_' || substr(md5(text), 1, 12) AS chunk_id, CASE WHEN source = 'src3' THEN 'imported' ELSE 'Unknown Document' END AS document_title FROM documents")
def import_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = _citations(spark, sf_dir)
    new = citations.of_document(have, "src3").withColumn("document_title", F.lit("imported"))
    return citations.import_citations(have, new).select("document_id", "chunk_id", "document_title")


@query("SELECT source AS document_id, 'chunk_' || substr(md5(text), 1, 12) AS chunk_id, count(*) OVER () AS citation_count FROM (SELECT DISTINCT source, text FROM documents WHERE source = 'src4')")
def export_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.export_citations(_citations(spark, sf_dir), "src4").select("document_id", "chunk_id", "citation_count")


@query(f"WITH {_PAGES}, w AS (SELECT l.doc_id, l.block_no, page_text AS text, l.text AS chunk FROM lines l JOIN pages_of USING (doc_id, page_num)), a AS (SELECT *, instr(text, substr(chunk, 1, 50)) - 1 AS pos FROM w) SELECT doc_id, block_no, md5(CASE WHEN pos < 0 THEN '' ELSE substr(text, CAST(greatest(0, pos - 200) + 1 AS BIGINT), CAST(pos - greatest(0, pos - 200) AS BIGINT)) END) AS before, md5(CASE WHEN pos < 0 THEN '' ELSE substr(text, CAST(pos + length(chunk) + 1 AS BIGINT), CAST(greatest(0, least(length(text), pos + length(chunk) + 200) - pos - length(chunk)) AS BIGINT)) END) AS after FROM a")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line in its page, with the text before and after it."""
    lines = tables.blocks(spark, sf_dir)
    rows = lines.join(layout.page_texts(lines), ["doc_id", "page_num"])
    found = citations.context_window(F.col("page_text"), F.col("text"))
    return rows.select("doc_id", "block_no", F.md5(found["before"].cast("binary")).alias("before"), F.md5(found["after"].cast("binary")).alias("after"))


# --- answers -------------------------------------------------------------------------------------


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cited(spark, sf_dir).join(tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "n_chars", "lang"), "chunk_id")


@query(f"WITH {_CITED} SELECT query_id, md5(string_agg(CASE WHEN cited.document_id IS NOT NULL THEN '[Source: ' || document_title || ', p.' || page_number || ', ' || section_title || ']' || chr(10) ELSE '' END || d.text, chr(10) || chr(10) ORDER BY rank)) AS digest FROM cited JOIN documents d ON d.doc_id = chunk_id GROUP BY 1")
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.contexts(_results(spark, sf_dir)).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"))


@query(f"WITH {_CITED} SELECT item_id AS query_id, md5(coalesce(string_agg('[Документ ' || rank || ' - ' || coalesce(document_title, 'file ' || chunk_id) || ', стр. ' || (d.n_chars // 500) || ', раздел: ' || d.lang || CASE WHEN d.n_chars % 2 = 1 THEN ' (📐 формул: 1)' ELSE '' END || ']' || chr(10) || CASE WHEN d.n_chars % 2 = 1 THEN translate(d.text, '∆δ', 'ΔΔ') ELSE d.text END, chr(10) || chr(10) ORDER BY rank), 'Документы не найдены в базе данных.')) AS digest FROM benchmark LEFT JOIN cited ON query_id = item_id LEFT JOIN documents d ON d.doc_id = chunk_id GROUP BY 1")
def numbered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _results(spark, sf_dir).select("query_id", "rank", "content", "document_title", F.concat(F.lit("file "), F.col("chunk_id").cast("string")).alias("filename"), F.floor(F.col("n_chars") / 500).alias("page_num"), F.col("lang").alias("section_title"), (F.col("n_chars") % 2).alias("formula_count"), F.lit(0).alias("table_count"))
    out = answers.numbered_contexts(tables.questions(spark, sf_dir), rows)
    return out.select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"))


@query("SELECT item_id AS query_id, md5('Answer the following question about financial research based on the provided context.' || chr(10) || chr(10) || 'Context:' || chr(10) || 'context ' || text || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || chr(10) || chr(10) || 'Now provide your answer following the same format, ensuring accuracy and proper citations:' || chr(10)) AS digest FROM benchmark")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.questions(spark, sf_dir)
    out = answers.prompts(asked, asked.select("query_id", F.concat(F.lit("context "), F.col("question")).alias("context")))
    return out.select("query_id", F.md5(F.col("prompt").cast("binary")).alias("digest"))


@query(f"""WITH {_HYBRID}, c AS (SELECT query_id, d.* FROM hyb JOIN documents d ON doc_id = chunk_id),
e AS (SELECT query_id, avg(least(1.0, (CASE WHEN length(text) BETWEEN 100 AND 2000 THEN 0.3 ELSE 0 END)::DOUBLE + (CASE WHEN n_chars % 2 = 1 THEN 0.2 ELSE 0 END)::DOUBLE + 0.3::DOUBLE)) AS q, count(*) AS n, 1.0::DOUBLE / count(DISTINCT source) AS d, 1.0::DOUBLE / count(DISTINCT lang) AS s FROM c GROUP BY 1)
SELECT item_id AS query_id, round(coalesce(q, 0), 6) AS source_quality, round(CASE WHEN coalesce(n, 0) < 2 THEN 1.0 ELSE (d + s) / 2 END, 6) AS source_consistency FROM benchmark LEFT JOIN e ON query_id = item_id""")
def source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("document_title"), F.col("lang").alias("section_id"), (F.col("n_chars") % 2).alias("formula_count"), F.lit(0).alias("table_count"))
    return answers.source_scores(tables.questions(spark, sf_dir), _hybrid(spark, sf_dir).join(docs, "chunk_id"))


_ANY = "len(list_filter([{0}], lambda t: contains({1}, t))) > 0"
_WORDS = ", ".join(f"'{t}'" for t in answers.ANSWER_TERMS)


_ANSWERS = r"""
turns AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM conversations),
said AS (SELECT conv_id, turn, coalesce(asked, '') AS question, text, trim(regexp_replace(text, '^\s+', '')) AS said FROM turns WHERE role = 'assistant')"""
_SAID = "SELECT conv_id || '/' || turn AS query_id, question AS text FROM said"


@query(f"""WITH {_ANSWERS}, {_lexical(_SAID)},
e AS (SELECT query_id, avg(least(1.0, (CASE WHEN length(text) BETWEEN 100 AND 2000 THEN 0.3 ELSE 0 END)::DOUBLE + (CASE WHEN n_chars % 2 = 1 THEN 0.2 ELSE 0 END)::DOUBLE + 0.3::DOUBLE)) AS q, count(*) AS n, 1.0::DOUBLE / count(DISTINCT source) AS d, 1.0::DOUBLE / count(DISTINCT lang) AS s FROM br JOIN documents ON doc_id = chunk_id WHERE rank <= 5 GROUP BY 1),
r AS (SELECT conv_id, turn, question, said, round(coalesce(q, 0), 6) AS source_quality, round(CASE WHEN coalesce(n, 0) < 2 THEN 1.0 ELSE (d + s) / 2 END, 6) AS source_consistency FROM said LEFT JOIN e ON query_id = conv_id || '/' || turn),
f AS (SELECT conv_id, turn, source_quality, source_consistency, round((CASE WHEN length(said) BETWEEN 50 AND 500 THEN 0.3 ELSE 0 END + CASE WHEN length(said) > 100 THEN 0.3 ELSE 0 END + 0.2 + CASE WHEN {_ANY.format(_WORDS, "lower(said || ' ' || said)")} THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS response_coherence,
round((CASE WHEN {_ANY.format(_WORDS, 'lower(question)')} THEN 0.3 ELSE 0 END + CASE WHEN {_ANY.format(_WORDS, 'lower(said)')} THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(lower(said), '[0-9]') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(lower(said), '[α-ωΑ-Ω]|formula|equation') THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS domain_relevance FROM r),
s AS (SELECT *, round(0.3::DOUBLE * source_quality + 0.3::DOUBLE * source_consistency + 0.2::DOUBLE * response_coherence + 0.2::DOUBLE * domain_relevance, 6) AS score FROM f)
SELECT *, CASE WHEN score > 0.8 THEN 'High' WHEN score > 0.6 THEN 'Medium' WHEN score > 0.4 THEN 'Low' ELSE 'Very Low' END AS level FROM s""")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn scored with the best five documents for the question before it."""
    rows = tables.answers(spark, sf_dir)
    docs = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("document_title"), F.col("lang").alias("section_id"), (F.col("n_chars") % 2).alias("formula_count"), F.lit(0).alias("table_count"))
    asked = store.kept(rows.select("query_id", "question"), "asked")
    chunks = store.kept(lexical.search(_index(spark, sf_dir), asked, 5), "found").join(answers.judged(docs), "chunk_id")
    out = answers.score_answers(asked, rows.select("query_id", "raw_response"), chunks)
    return out.select("query_id.conv_id", "query_id.turn", "source_quality", "source_consistency", "response_coherence", "domain_relevance", F.col("confidence.score").alias("score"), F.col("confidence.level").alias("level"))


@query(f"WITH {_BM25}, r AS (SELECT item_id AS query_id, avg(score) AS m, max(score) AS x FROM benchmark LEFT JOIN br ON query_id = item_id AND rank <= 10 GROUP BY 1), s AS (SELECT query_id, round((CASE WHEN m > 1 THEN CASE WHEN x > 0 THEN m / x ELSE 0 END ELSE m END) * 0.7::DOUBLE + 0.24::DOUBLE, 6) AS v FROM r) SELECT query_id, coalesce(v, 0) AS score, CASE WHEN v IS NULL THEN 'Very Low' WHEN v > 0.8 THEN 'High' WHEN v > 0.6 THEN 'Medium' WHEN v > 0.4 THEN 'Low' ELSE 'Very Low' END AS level FROM s")
def retrieval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = tables.questions(spark, sf_dir)
    return answers.retrieval_confidence(asked, lexical.search(_index(spark, sf_dir), asked, 10)).select("query_id", "score", "level")


@query(r"SELECT conv_id, turn, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_replace(s, '^[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g')), lambda s: length(s) > 20)[1:3], lambda s: regexp_replace(s, '^(?:However|Moreover|Furthermore|Additionally|Therefore|Thus),?\s*', '')), '|') AS points FROM conversations")
def key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(answers.key_points(F.col("text")), "|").alias("points"))


@query(f"WITH {_ANSWERS} SELECT conv_id, turn, said AS answer, said AS explanation, 'High - stated' AS confidence_text, 1 AS n_sources, 'Paper ' || conv_id || ', Page 2' AS first_citation FROM said", ints="n_sources")
def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = answers.parse(tables.answers(spark, sf_dir))
    return out.select("query_id.conv_id", "query_id.turn", "answer", "explanation", "confidence_text", F.size("sources").alias("n_sources"), F.col("sources")[0]["citation"].alias("first_citation"))


_FORMATTED = rf"""
items AS (SELECT *, '1. [Paper ' || conv_id || ', Page 2] - "' || substr(text, 1, 40) || '"' AS item FROM said),
quoted AS (SELECT *, regexp_replace(regexp_replace(trim(regexp_extract(item, '(?-s)-\s*["'']?(.*?)["'']?\s*$', 1)), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS quote FROM items),
shown AS (SELECT conv_id, turn, said, '### Ответ' || chr(10) || said || chr(10) || chr(10) || CASE WHEN said <> '' THEN '### Объяснение' || chr(10) || said || chr(10) || chr(10) ELSE '' END
  || '### Источники' || chr(10) || '1. **Paper ' || conv_id || ', Page 2**' || CASE WHEN quote <> '' THEN chr(10) || '   > "' || quote || '"' ELSE '' END
  || chr(10) || chr(10) || '### Уровень уверенности: High' || chr(10) || 'stated' || chr(10) || '*Оценка: 0.85/1.00*' AS formatted FROM quoted)"""


@query(rf"WITH {_ANSWERS}, {_FORMATTED} SELECT conv_id, turn, formatted, '**Краткий ответ:** ' || CASE WHEN said <> '' THEN regexp_replace(said, '\s+$', '') ELSE 'Ответ недоступен.' END || chr(10) || chr(10) || '*Уровень уверенности: High*' AS summary FROM shown")
def formatted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as text and in short."""
    rows = answers.parse(tables.answers(spark, sf_dir))
    none = F.lit(None).cast("string")
    sources = F.transform("sources", lambda s: F.struct(s["citation"].alias("citation"), s["quote"].alias("quote"), none.alias("document_title"), F.lit(0).alias("page_number"), none.alias("section_title")))
    text = answers.formatted(F.col("answer"), F.col("explanation"), sources, F.lit("High"), F.lit("stated"), F.lit(0.85))
    return rows.select("query_id.conv_id", "query_id.turn", text.alias("formatted")).withColumn("summary", answers.summary(F.col("formatted")))


# --- catalog and chat ----------------------------------------------------------------------------

_CATALOG = "cat AS (SELECT doc_id AS id, source AS upload_user, n_chars AS file_size, CAST(ceil(n_chars / 1000) AS BIGINT) AS chunk_count, CASE WHEN doc_id % 3 = 0 THEN 'pdf-qa-shared' ELSE 'pdf-qa-personal-' || source END AS index_name, lang FROM documents)"


@query(f"WITH {_CATALOG} SELECT count(*) AS total_documents, round(sum(file_size) / (1024 * 1024), 6) AS total_size_mb, CAST(sum(chunk_count) AS BIGINT) AS total_chunks, count_if(index_name = 'pdf-qa-shared') AS shared_documents, count_if(contains(index_name, 'pdf-qa-personal-')) AS personal_documents FROM cat", longs="personal_documents shared_documents")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.statistics(tables.catalog(spark, sf_dir))


@query(f"WITH {_CATALOG} SELECT id, upload_user FROM cat WHERE NOT (id % 5 = 0 AND upload_user = 'src5')")
def catalog_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = tables.catalog(spark, sf_dir)
    asked = have.where("id % 5 = 0").select("id", F.lit("src5").alias("upload_user"))
    return catalog.delete(have, asked).select("id", "upload_user")


@query(f"WITH {_CATALOG} SELECT id, index_name FROM cat WHERE index_name = 'pdf-qa-personal-src7'")
def catalog_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.personal(tables.catalog(spark, sf_dir), "src7").select("id", "index_name")


@query(f"WITH {_CATALOG} SELECT id, upload_user, row_number() OVER (ORDER BY file_size DESC, id) AS place FROM cat WHERE upload_user = 'src1' AND index_name = 'pdf-qa-shared'", ints="place")
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = catalog.listing(tables.catalog(spark, sf_dir).withColumn("upload_date", F.col("file_size")), "src1", "shared")
    return catalog.placed(listed, [-F.col("upload_date"), F.col("id")]).select("id", "upload_user", "place")


@query("SELECT c_custkey AS id, c_custkey > (SELECT max(c_custkey) // 2 FROM customer) AS is_new FROM customer")
def catalog_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, the second half of their keys added to the first."""
    rows = tables.read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), "c_custkey")
    half = rows.agg(F.floor(F.max("id") / 2)).first()[0]
    old, new = (rows.where(F.col("id") <= half).withColumn("is_new", F.lit(False)), rows.where(F.col("id") > half).drop("id").withColumn("is_new", F.lit(True)))
    return catalog.add(old, new, "c_custkey").select("id", "is_new")


@query("SELECT CASE WHEN n_chars > 0 AND n_chars % 10 = 0 THEN 'error' ELSE 'success' END AS status, CASE WHEN lang = 'en' THEN 'enhanced_v3' ELSE 'legacy' END AS processing_method, count(*) AS files, CAST(sum(n_chars // 1000) AS BIGINT) AS total_chunks, round(sum(n_chars / 1000)::DOUBLE, 6) AS total_time, CAST(sum(n_chars % 9) AS BIGINT) AS total_sections, count_if(n_chars % 2 = 1) AS formula_docs, count_if(n_chars % 3 = 1) AS table_docs FROM documents GROUP BY 1, 2", longs="formula_docs table_docs")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, n = tables.read(spark, sf_dir, "documents"), F.col("n_chars")
    results = docs.select(F.when((n > 0) & (n % 10 == 0), "error").otherwise("success").alias("status"), F.when(F.col("lang") == "en", "enhanced_v3").otherwise("legacy").alias("processing_method"), F.floor(n / 1000).alias("chunks"), (n / 1000).alias("processing_time"), (n % 9).alias("sections"), (n % 2 == 1).alias("has_formulas"), (n % 3 == 1).alias("has_tables"))
    return catalog.ingest_report(results)


@query("SELECT username, seq FROM (SELECT CAST(user_id AS VARCHAR) AS username, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS pos FROM events) WHERE pos <= 50")
def chat_last50(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.messages(spark, sf_dir, by_day=False)
    old, new = rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1")
    return chat.append(chat.last_messages(rows.where("seq % 2 = 0"), 1_000_000), new.unionByName(old)).select("username", "seq")


@query("SELECT username, seq, CAST(pos AS INT) AS pos FROM (SELECT CAST(user_id AS VARCHAR) AS username, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos FROM events) WHERE pos <= 10")
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.recent_messages(tables.messages(spark, sf_dir, by_day=True))
    return out.select("username", "seq", F.row_number().over(Window.partitionBy("username").orderBy(F.desc("ts"), F.desc("seq"))).alias("pos"))


@query("WITH c AS (SELECT CAST(user_id AS VARCHAR) AS username, strftime(ts, '%Y-%m-%d') AS conversation_id, max_by(props, event_id) AS last_message, count(*) AS message_count, max_by(ts, event_id) AS last_activity FROM events GROUP BY ALL) SELECT username, conversation_id, last_message, message_count FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY last_activity DESC, conversation_id) AS pos FROM c) WHERE pos <= 10")
def user_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.user_conversations(tables.messages(spark, sf_dir, by_day=True)).select("username", "conversation_id", "last_message", "message_count")


@query("SELECT CAST(user_id AS VARCHAR) AS username, event_id AS seq FROM events WHERE strftime(ts, '%d') <> '01'")
def clear_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.messages(spark, sf_dir, by_day=True)
    return chat.without(rows, rows.where("conversation_id LIKE '%-01'")).select("username", "seq")
