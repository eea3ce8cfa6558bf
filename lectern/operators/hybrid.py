"""Lexical and vector results fused by weighted reciprocal rank, filtered and routed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_any
from . import lexical, vectors

RRF_K = 60

#: Words that make a question mathematical.
MATH_TERMS = ["delta", "дельта", "vega", "вега", "формула", "formula", "опцион", "option", "волатильность", "volatility", "∆", "Δ", "греки", "greeks"]
#: What an answer says when nothing was found, how a failed one begins, and the last resort.
NOTHING_FOUND = "нет информации"
FAILED = "❌"
NO_ANSWER = "❌ Нет доступных методов поиска"


def fuse(lexical_results: DataFrame, vector_results: DataFrame, alpha: float = 0.5, rrf_k: int = RRF_K) -> DataFrame:
    """``alpha / (k + lexical rank) + (1 - alpha) / (k + vector rank)``, ranked anew. What only one list has
    keeps its own part, even if that is zero; with ``alpha`` 0 lexical hits drop out. A question
    without vector results keeps its lexical scores. Each list is gone through once."""
    words = lexical_results.select("query_id", "chunk_id", (F.lit(alpha) / (rrf_k + F.col("rank"))).alias("part"), F.col("score").alias("own"), F.lit(False).alias("is_vector"))
    near = vector_results.select("query_id", "chunk_id", (F.lit(1 - alpha) / (rrf_k + F.col("rank"))).alias("part"), F.lit(None).cast("double").alias("own"), F.lit(True).alias("is_vector"))
    both = words.unionByName(near).withColumn("fused", F.max("is_vector").over(Window.partitionBy("query_id")))
    if alpha == 0:
        both = both.where("is_vector OR NOT fused")
    each = both.groupBy("query_id", "chunk_id", "fused").agg(F.round(F.sum("part"), 6).alias("sum"), F.max("own").alias("own"))
    return lexical.ranked(each.select("query_id", "chunk_id", F.when(F.col("fused"), F.col("sum")).otherwise(F.col("own")).alias("score")), None)


def matches(columns: list[str], filters: dict | None) -> Column:
    """Equality, or membership for lists; keys that aren't columns are passed over."""
    tests = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k).eqNullSafe(F.lit(v)) for k, v in (filters or {}).items() if k in columns]
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def apply_filters(results: DataFrame, chunks: DataFrame, filters: dict | None) -> DataFrame:
    """Results whose chunk passes; their ranks stay."""
    if not filters:
        return results
    return results.join(chunks.where(matches(chunks.columns, filters)).select("chunk_id"), "chunk_id", "left_semi")


def search(index: lexical.LexicalIndex, chunks: DataFrame, queries: DataFrame, top_k: int = 10, alpha: float = 0.5, filters: dict | None = None, filter_mode: str = "post") -> DataFrame:
    """Twice ``top_k`` from each side, fused, filtered, cut to ``top_k`` for each question.

    ``chunks``: ``chunk_id, embedding`` (may be null) and columns to filter by; ``queries``: ``query_id, question,
    embedding`` (may be null). A question without vector hits keeps its lexical scores. ``alpha`` 0 is vector search alone, 1 ranks
    lexical hits first and vector hits after them with score zero. ``filter_mode="pre"`` filters both
    sides before anything is cut."""
    before = filter_mode == "pre" and filters
    allowed = chunks.where(matches(chunks.columns, filters)) if before else chunks
    if before:
        narrowed = index.within(allowed)
    else:
        narrowed = index
    by_words = lexical.search(narrowed, queries, 2 * top_k)
    by_vector = vectors.search(allowed, queries, 2 * top_k)
    fused = fuse(by_words, by_vector, alpha)
    out = fused if before else apply_filters(fused, chunks, filters)
    best = out.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return best.where(F.col("at") <= top_k).select("query_id", "chunk_id", "score", "rank")


def search_section(index, chunks, queries, section_id: str, **options) -> DataFrame:
    return search(index, chunks, queries, filters={"section_id": section_id}, **options)


def search_content_type(index, chunks, queries, content_type: str, **options) -> DataFrame:
    return search(index, chunks, queries, filters={"content_type": content_type}, **options)


def route(queries: DataFrame, question: str = "question", terms: list[str] | None = None, few: int = 5, many: int = 8) -> DataFrame:
    """Adds ``is_math`` and ``k``, how many chunks the question is to get."""
    wanted = list(dict.fromkeys(t.lower() for t in (MATH_TERMS if terms is None else terms)))
    flagged = queries.withColumn("is_math", contains_any(F.lower(F.coalesce(F.col(question), F.lit(""))), wanted))
    return flagged.withColumn("k", F.when(F.col("is_math"), many).otherwise(few))


def routed_cut(results: DataFrame, routed: DataFrame) -> DataFrame:
    """Results up to each question's own ``k``."""
    return results.join(routed.select("query_id", "k"), "query_id").where(F.col("rank") <= F.col("k")).drop("k")


def with_fallback(queries: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """``(query_id, answer, method)``: the first method's answer unless it failed or found nothing, else the second's, else a fixed one. Both have ``query_id, answer, error``."""
    a = first.select("query_id", F.col("answer").alias("a"), F.col("error").alias("ea"))
    b = second.select("query_id", F.col("answer").alias("b"), F.col("error").alias("eb"))
    fine = F.col("a").isNotNull() & F.col("ea").isNull() & ~F.startswith("a", F.lit(FAILED)) & ~F.contains(F.lower("a"), F.lit(NOTHING_FOUND))
    other = F.col("b").isNotNull() & F.col("eb").isNull()
    out = queries.select("query_id").join(a, "query_id", "left").join(b, "query_id", "left")
    return out.select("query_id", F.when(fine, F.col("a")).when(other, F.col("b")).otherwise(F.lit(NO_ANSWER)).alias("answer"), F.when(fine, F.lit("first")).when(other, F.lit("second")).otherwise(F.lit("none")).alias("method"))


def retrieval_stats(queries: DataFrame, results: DataFrame, chunks: DataFrame) -> DataFrame:
    """For each question: chunks found, mean score (0 if none), and whether any holds formulas or tables."""
    found = results.join(chunks.select("chunk_id", "formula_count", "table_count"), "chunk_id", "left")
    each = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.bool_or(F.col("formula_count") > 0).alias("f"), F.bool_or(F.col("table_count") > 0).alias("t"))
    no = F.lit(False)
    return queries.select("query_id").join(each, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("chunks_retrieved"), F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean_score"), F.coalesce("f", no).alias("has_formulas"), F.coalesce("t", no).alias("has_tables"))
