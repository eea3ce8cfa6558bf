"""Contexts and prompts for questions; answers parsed, scored and formatted. Answers come as a table from elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, gathered, quote

#: Finance terms of answers, wordings of confidence, and labels of formatted answers.
ANSWER_TERMS = [
    "capm", "capital asset pricing model", "beta", "alpha", "volatility",
    "sharpe ratio", "portfolio", "diversification", "risk premium",
    "efficient frontier", "var", "value at risk", "options", "derivatives",
    "black-scholes", "monte carlo", "regression", "correlation",
    "interest rate", "bond", "equity", "dividend", "yield",
]
LEVELS = [(0.8, "High"), (0.6, "Medium"), (0.4, "Low"), (None, "Very Low")]
ANSWER_WORDINGS = {
    "High": "Multiple high-quality sources provide consistent information with strong domain relevance.",
    "Medium": "Sources provide good information but may have some gaps or inconsistencies.",
    "Low": "Limited or conflicting information in available sources.",
    "Very Low": "Insufficient or unreliable information to support the answer.",
}
RETRIEVAL_WORDINGS = {
    "High": "Multiple high-quality sources provide consistent and reliable information.",
    "Medium": "Sources provide good information with reasonable confidence in the answer.",
    "Low": "Limited source quality or consistency, answer should be verified.",
    "Very Low": "Insufficient or low-quality sources, answer reliability is questionable.",
}
NO_SOURCES = "No sources available for verification."
NO_DOCUMENTS = "Документы не найдены в базе данных."
NO_SOURCE_TEXT = "Источники недоступны."
NO_ANSWER_TEXT = "Ответ недоступен."
CONJUNCTIONS = "However|Moreover|Furthermore|Additionally|Therefore|Thus"
PROMPT_START = "Answer the following question about financial research based on the provided context."
PROMPT_END = "Now provide your answer following the same format, ensuring accuracy and proper citations:"


# --- contexts ------------------------------------------------------------------------------------


def contexts(results: DataFrame) -> DataFrame:
    """``results``: ``query_id, rank, content`` and the citation's title, page and section (null without one). ``(query_id, context)``: contents by rank, each under its source."""
    source = F.concat(F.lit("[Source: "), F.col("document_title"), F.lit(", p."), F.col("page_number").cast("string"), F.when(F.col("section_title") != "", F.concat(F.lit(", "), F.col("section_title"))).otherwise(F.lit("")), F.lit("]\n"))
    return results.groupBy("query_id").agg(gathered(F.col("rank"), F.concat(F.coalesce(source, F.lit("")), F.col("content")), "\n\n").alias("context"))


def numbered_contexts(queries: DataFrame, results: DataFrame) -> DataFrame:
    """``(query_id, context)`` of every question: contents by rank under numbered headers with title (or file name), page, section and what is special; delta
    signs of chunks with formulas made one. A fixed text without results."""
    formulas, tables = F.coalesce("formula_count", F.lit(0)), F.coalesce("table_count", F.lit(0))
    special = F.concat_ws(", ", F.when(formulas > 0, F.concat(F.lit("📐 формул: "), formulas.cast("string"))), F.when(tables > 0, F.concat(F.lit("📊 таблиц: "), tables.cast("string"))))
    part = lambda before, c: F.coalesce(F.concat(F.lit(before), c.cast("string")), F.lit(""))
    header = F.concat(F.lit("[Документ "), F.col("rank").cast("string"), part(" - ", F.coalesce("document_title", "filename")), part(", стр. ", F.col("page_num")), part(", раздел: ", F.col("section_title")), F.when(special != "", F.concat(F.lit(" ("), special, F.lit(")"))).otherwise(F.lit("")), F.lit("]\n"))
    content = F.when(formulas > 0, F.translate("content", "∆δ", "ΔΔ")).otherwise(F.col("content"))
    joined = results.groupBy("query_id").agg(gathered(F.col("rank"), F.concat(header, content), "\n\n").alias("context"))
    return queries.select("query_id").join(joined, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(NO_DOCUMENTS)))


def prompts(queries: DataFrame, context_rows: DataFrame, example: str = "") -> DataFrame:
    """``(query_id, prompt)``."""
    rows = queries.join(context_rows, "query_id", "left")
    text = F.concat(F.lit(f"{PROMPT_START}\n\nContext:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("question"), F.lit(f"\n\n{example}\n\n{PROMPT_END}\n"))
    return rows.select("query_id", text.alias("prompt"))


# --- parsing -------------------------------------------------------------------------------------


def _part(text: Column, name: str, following: str | None) -> Column:
    end = rf"(?=\n\n{following}:|\z)" if following else r"\z"
    return F.trim(F.regexp_extract(text, rf"(?s){name}:\s*(.*?){end}", 1))


def parsed_sources(text: Column) -> Column:
    """``array<struct(citation, quote, full_text)>``: numbered items with something in brackets, and what follows a dash."""
    items = F.transform(F.split(text, r"\n\s*\d+\."), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    with_citation = F.filter(items, lambda x: x.rlike(r"\[[^\n]*?\]"))
    quoted = lambda x: F.trim(F.regexp_extract(x, r"-\s*[\"']?(.*?)[\"']?\s*$", 1))
    return F.transform(with_citation, lambda x: F.struct(F.regexp_extract(x, r"\[(.*?)\]", 1).alias("citation"), quoted(x).alias("quote"), x.alias("full_text")))


def parse(responses: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Adds ``answer, explanation, sources_text, confidence_text`` and ``sources``; parts that aren't there are ``''``."""
    text = F.coalesce(F.col(raw), F.lit(""))
    parts = {"answer": _part(text, "Answer", "Explanation"), "explanation": _part(text, "Explanation", "Sources?"), "sources_text": _part(text, "Sources?", "Confidence"), "confidence_text": _part(text, "Confidence", None)}
    return responses.withColumns(parts).withColumn("sources", parsed_sources(F.col("sources_text")))


# --- confidence ----------------------------------------------------------------------------------


def level(score: Column) -> Column:
    return F.when(score > 0.8, "High").when(score > 0.6, "Medium").when(score > 0.4, "Low").otherwise("Very Low")


def wording(level_: Column, wordings: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in wordings.items() for x in pair)), level_)


def _quality() -> Column:
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    of = lambda test, points: F.when(test, points).otherwise(0.0)
    return F.least(F.lit(1.0), of(F.length("content").between(100, 2000), 0.3) + of(has("formula_count"), 0.2) + of(has("table_count"), 0.2) + of(F.coalesce("section_id", F.lit("")) != "", 0.3))


def judged(chunks: DataFrame) -> DataFrame:
    """Chunks with their ``chunk_quality`` in place of what it follows from, so that texts needn't be joined to questions."""
    return chunks.withColumn("chunk_quality", _quality()).drop("content", "formula_count", "table_count")


def source_scores(queries: DataFrame, chunks: DataFrame, has_title: bool = True, has_section: bool = True) -> DataFrame:
    """``chunks``: a row for each chunk of a question, judged or not. ``(query_id, source_quality, source_consistency)``. Quality is the mean of what each chunk has (fitting length, formulas, tables, a section); consistency that of one over the
    numbers of titles and of sections, null counting as one, 0.5 for a column that isn't there, 1 for fewer than two chunks."""
    quality = F.col("chunk_quality") if "chunk_quality" in chunks.columns else _quality()
    distinct = lambda c, there: (F.lit(1.0) / F.countDistinct(F.struct(F.col(c)))) if there else F.lit(0.5)
    each = chunks.groupBy("query_id").agg(F.avg(quality).alias("q"), F.count(F.lit(1)).alias("n"), distinct("document_title", has_title).alias("d"), distinct("section_id", has_section).alias("s"))
    out = queries.select("query_id").join(each, "query_id", "left")
    consistency = F.when(F.coalesce("n", F.lit(0)) < 2, 1.0).otherwise((F.col("d") + F.col("s")) / 2)
    return out.select("query_id", F.round(F.coalesce("q", F.lit(0.0)), 6).alias("source_quality"), F.round(consistency, 6).alias("source_consistency"))


def coherence(answer: Column, explanation: Column, n_sources: Column, terms: list[str] | None = None) -> Column:
    of = lambda test, points: F.when(test, points).otherwise(0.0)
    both = F.lower(F.concat(answer, F.lit(" "), explanation))
    return F.round(of(F.length(answer).between(50, 500), 0.3) + of(F.length(explanation) > 100, 0.3) + of(n_sources > 0, 0.2) + of(contains_any(both, ANSWER_TERMS if terms is None else terms), 0.2), 6)


def relevance(question: Column, answer: Column, terms: list[str] | None = None) -> Column:
    of = lambda test, points: F.when(test, points).otherwise(0.0)
    terms = ANSWER_TERMS if terms is None else terms
    low = F.lower(answer)
    return F.round(of(contains_any(F.lower(question), terms), 0.3) + of(contains_any(low, terms), 0.3) + of(low.rlike(r"\d"), 0.2) + of(low.rlike("[α-ωΑ-Ω]|formula|equation"), 0.2), 6)


def confidence(rows: DataFrame) -> DataFrame:
    """Adds ``confidence``: score, level, explanation and factors, from the four factors as columns."""
    score = F.round(0.3 * F.col("source_quality") + 0.3 * F.col("source_consistency") + 0.2 * F.col("response_coherence") + 0.2 * F.col("domain_relevance"), 6)
    factors = F.struct("source_quality", "source_consistency", "response_coherence", "domain_relevance")
    return rows.withColumn("confidence", F.struct(level(score).alias("level"), score.alias("score"), wording(level(score), ANSWER_WORDINGS).alias("explanation"), factors.alias("factors")))


def score_answers(queries: DataFrame, responses: DataFrame, chunks: DataFrame) -> DataFrame:
    """Parsed responses with their confidence. ``queries``: ``query_id, question``; ``responses``: ``query_id, raw_response``."""
    rows = queries.join(parse(responses), "query_id").join(source_scores(queries, chunks), "query_id", "left")
    rows = rows.withColumns({"response_coherence": coherence(F.col("answer"), F.col("explanation"), F.size("sources")), "domain_relevance": relevance(F.col("question"), F.col("answer"))})
    return confidence(rows)


def retrieval_confidence(queries: DataFrame, results: DataFrame, consistency: float = 0.8) -> DataFrame:
    """``(query_id, level, score, explanation)`` from retrieval scores: seven tenths of their mean (divided by the greatest if over 1) and three of ``consistency``."""
    each = results.groupBy("query_id").agg(F.avg("score").alias("mean"), F.max("score").alias("most"))
    mean = F.when(F.col("mean") > 1, F.when(F.col("most") > 0, F.col("mean") / F.col("most")).otherwise(0.0)).otherwise(F.col("mean"))
    score = F.round(mean * 0.7 + consistency * 0.3, 6)
    rows = queries.select("query_id").join(each, "query_id", "left").withColumn("score", score)
    return rows.select("query_id", F.when(F.col("score").isNull(), "Very Low").otherwise(level(F.col("score"))).alias("level"), F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("score").isNull(), NO_SOURCES).otherwise(wording(level(F.col("score")), RETRIEVAL_WORDINGS)).alias("explanation"))


# --- formatting ----------------------------------------------------------------------------------


def _title(text: str, markdown: bool) -> str:
    return f"### {text}" if markdown else f"{text}:"


def _source(source: Column, place: Column, markdown: bool) -> Column:
    built = F.concat_ws(", ", *(F.when(c.cast("string") != "", c) for c in (source["document_title"], F.concat(F.lit("стр. "), F.when(source["page_number"] > 0, source["page_number"]).cast("string")), source["section_title"])))
    cited = F.when(F.coalesce(source["citation"], F.lit("")) != "", source["citation"]).otherwise(built)
    mark = "**" if markdown else ""
    quoted = F.concat(F.lit('\n   > "' if markdown else '\n   "'), quote(source["quote"]), F.lit('"'))
    has_quote = F.trim(F.coalesce(source["quote"], F.lit(""))) != ""
    return F.when(cited != "", F.concat(place.cast("string"), F.lit(f". {mark}"), cited, F.lit(mark), F.when(has_quote, quoted).otherwise(F.lit(""))))


def formatted(answer: Column, explanation: Column, sources: Column, level_: Column, wording_: Column, score: Column, markdown: bool = True, most: int = 5) -> Column:
    """A whole answer as text: answer, explanation unless blank, up to ``most`` sources, confidence."""
    listed = F.filter(F.transform(F.slice(sources, 1, most), lambda s, i: _source(s, i + 1, markdown)), lambda x: x.isNotNull())
    shown = F.concat(F.lit(_title("Источники", markdown) + "\n"), F.when(F.size(listed) > 0, F.array_join(listed, "\n")).otherwise(F.lit(NO_SOURCE_TEXT)))
    number = F.concat(F.lit("*" if markdown else "("), F.lit("Оценка: "), F.format_string("%.2f", score), F.lit("/1.00"), F.lit("*" if markdown else ")"))
    sure = F.concat_ws("\n", F.concat(F.lit("### " if markdown else ""), F.lit("Уровень уверенности: "), level_), F.when(wording_ != "", wording_), F.when(score > 0, number))
    return F.concat_ws("\n\n", F.concat(F.lit(_title("Ответ", markdown) + "\n"), F.trim(answer)), F.when(F.trim(explanation) != "", F.concat(F.lit(_title("Объяснение", markdown) + "\n"), F.trim(explanation))), F.when(F.size(sources) > 0, shown), sure)


def citation_with_quote(title: Column, page: Column, section: Column, quoted: Column, markdown: bool = True) -> Column:
    mark = "**" if markdown else ""
    base = F.concat_ws(", ", F.coalesce(title, F.lit("Unknown Document")), F.when(page > 0, F.concat(F.lit("стр. "), page.cast("string"))), F.when(section != "", section))
    return F.concat(F.lit(mark), base, F.lit(mark), F.when(F.coalesce(quoted, F.lit("")) != "", F.concat(F.lit(' - "'), quote(quoted), F.lit('"'))).otherwise(F.lit("")))


def key_points(explanation: Column, most: int = 3) -> Column:
    """The first sentences of over 20 characters, without a conjunction at their start."""
    sentences = F.transform(F.split(F.coalesce(explanation, F.lit("")), "[.!?]+"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    long = F.filter(sentences, lambda s: F.length(s) > 20)
    plain = F.transform(long, lambda s: F.regexp_replace(s, rf"^(?:{CONJUNCTIONS}),?\s*", ""))
    return F.slice(F.filter(plain, lambda s: s != ""), 1, most)


def summary(text: Column, markdown: bool = True) -> Column:
    """Answer and confidence level of a formatted answer."""
    marked = F.regexp_extract(text, r"(?s)### Ответ\n(.*?)(?=\n### |\z)", 1)
    plain = F.regexp_extract(text, r"(?s)Ответ:\n(.*?)(?=\nОбъяснение:|\z)", 1)
    answer = F.coalesce(*(F.when(F.trim(x) != "", F.regexp_replace(x, r"^\s+|\s+$", "")) for x in (marked, plain)), F.lit(NO_ANSWER_TEXT))
    found = F.regexp_extract(text, r"Уровень уверенности: (Very Low|\w+)", 1)
    sure = F.when(found != "", found).otherwise(F.lit("Unknown"))
    return F.concat(F.lit("**Краткий ответ:** " if markdown else "Краткий ответ: "), answer, F.lit("\n\n*Уровень уверенности: " if markdown else "\n\nУровень уверенности: "), sure, F.lit("*" if markdown else ""))
