import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.functions.text import chunk_id
from lectern.operators import answers, catalog, chat
from lectern.plans import queries
from lectern.sources import store
from lectern.streaming import messages as kept
from lectern.streaming import streams

RAW = "Answer: CAPM gives 12%.\n\nExplanation: It uses beta.\n\nSources:\n1. [Paper, Page 4] - \"quoted text\"\n2. no brackets\n3. [Other] - Contains data\n\nConfidence: High - solid"


def test_parse(spark):
    rows = {r.query_id: r for r in answers.parse(spark.createDataFrame([(1, RAW), (2, "Answer: only"), (3, None)], "query_id long, raw_response string")).collect()}
    r = rows[1]
    assert (r.answer, r.explanation, r.confidence_text) == ("CAPM gives 12%.", "It uses beta.", "High - solid")
    assert [(s.citation, s.quote) for s in r.sources] == [("Paper, Page 4", "quoted text"), ("Other", "Contains data")]
    assert rows[2].answer == "only" and rows[2].sources == [] and rows[3].answer == ""


def test_source_scores(spark):
    chunks = spark.createDataFrame([(1, "x" * 100, "t", "s", 1, 1), (2, "x" * 99, "t", None, 0, 0), (2, "x" * 2000, "u", None, 0, 0), (2, "x", None, "s", 0, 0)], "query_id long, content string, document_title string, section_id string, formula_count int, table_count int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: (r.source_quality, r.source_consistency) for r in answers.source_scores(asked, chunks).collect()}
    assert got == {1: (1.0, 1.0), 2: (pytest.approx(0.2), pytest.approx((1 / 3 + 1 / 2) / 2, abs=1e-6)), 3: (0.0, 1.0)}


@pytest.mark.parametrize("score, want", [(0.81, "High"), (0.8, "Medium"), (0.6, "Low"), (0.4, "Very Low"), (0.41, "Low")])
def test_levels(spark, score, want):
    assert spark.range(1).select(answers.level(F.lit(score)).alias("l")).first().l == want


def test_confidence(spark):
    asked = spark.createDataFrame([(1, "What is beta?")], "query_id long, question string")
    chunks = spark.createDataFrame([(1, "x" * 100, "t", "s", 1, 1)], "query_id long, content string, document_title string, section_id string, formula_count int, table_count int")
    c = answers.score_answers(asked, spark.createDataFrame([(1, RAW)], "query_id long, raw_response string"), chunks).first().confidence
    # coherence: sources and terms; relevance: both and digits
    assert (c.factors.response_coherence, c.factors.domain_relevance) == (0.4, 0.8) and c.score == pytest.approx(0.84) and c.level == "High"


def test_chunks_are_judged_before_they_are_joined(spark):
    """A chunk's quality may be found first, so that texts aren't joined to questions."""
    rows = [(1, "x" * 200, "T", "s1", 1, 0), (1, "short", "T", "", 0, 2), (2, None, None, None, None, None)]
    chunks = spark.createDataFrame(rows, "query_id long, content string, document_title string, section_id string, formula_count int, table_count int")
    asked = spark.createDataFrame([(1, "q"), (2, "q"), (3, "q")], "query_id long, question string")
    judged = answers.judged(chunks)
    assert "content" not in judged.columns
    assert sorted(answers.source_scores(asked, judged).collect()) == sorted(answers.source_scores(asked, chunks).collect())


def test_a_text_is_made_once_for_many_terms(spark):
    text = F.when(F.rand(1) < 0.5, "alpha").otherwise("beta")
    rows = spark.range(400).select(tx.contains_any(text, ["alpha", "beta"]).alias("any"), F.size(tx.terms_in(text, ["alpha", "beta"])).alias("n")).collect()
    assert all(r.any and r.n == 1 for r in rows)


def test_retrieval_confidence(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    found = spark.createDataFrame([(1, 0.5), (1, 0.7), (2, 4.0), (2, 2.0)], "query_id long, score double")
    got = {r.query_id: (r.score, r.level) for r in answers.retrieval_confidence(asked, found).collect()}
    assert got == {1: (pytest.approx(0.66), "Medium"), 2: (pytest.approx(0.765), "Medium"), 3: (0.0, "Very Low")}


def test_formatting(spark):
    rows = answers.parse(spark.createDataFrame([(1, RAW)], "query_id long, raw_response string"))
    none = F.lit(None).cast("string")
    sources = F.transform("sources", lambda s: F.struct(F.when(s["citation"] != "Other", s["citation"]).alias("citation"), s["quote"].alias("quote"), F.lit("Doc").alias("document_title"), F.lit(3).alias("page_number"), none.alias("section_title")))
    args = (F.col("answer"), F.col("explanation"), sources, F.lit("Very Low"), F.lit("why"), F.lit(0.351))
    out = rows.select(answers.formatted(*args).alias("m"), answers.formatted(*args, markdown=False).alias("p")).withColumns({"sm": answers.summary(F.col("m")), "sp": answers.summary(F.col("p"), False)}).first()
    assert out.m == '### Ответ\nCAPM gives 12%.\n\n### Объяснение\nIt uses beta.\n\n### Источники\n1. **Paper, Page 4**\n   > "quoted text"\n2. **Doc, стр. 3**\n   > "Contains data"\n\n### Уровень уверенности: Very Low\nwhy\n*Оценка: 0.35/1.00*'
    assert out.p.startswith("Ответ:\nCAPM") and out.p.endswith("(Оценка: 0.35/1.00)")
    assert out.sm == "**Краткий ответ:** CAPM gives 12%.\n\n*Уровень уверенности: Very Low*"
    assert out.sp == "Краткий ответ: CAPM gives 12%.\n\nУровень уверенности: Very Low"


def test_key_points(spark):
    text = "However, this sentence is long enough. Short one. Thus the second is also long! A third sentence is here? And a fourth one comes too."
    assert spark.createDataFrame([(text,)], "t string").select(answers.key_points(F.col("t")).alias("k")).first().k == ["this sentence is long enough", "the second is also long", "A third sentence is here"]


def test_numbered_contexts(spark):
    rows = spark.createDataFrame([(1, 1, "∆ and δ", "T", None, 2, None, 1, 0), (1, 2, "plain δ", None, "f.pdf", None, "s", 0, 2)], "query_id long, rank int, content string, document_title string, filename string, page_num int, section_title string, formula_count int, table_count int")
    got = {r.query_id: r.context for r in answers.numbered_contexts(spark.createDataFrame([(1,), (2,)], "query_id long"), rows).collect()}
    assert got[1] == "[Документ 1 - T, стр. 2 (📐 формул: 1)]\nΔ and Δ\n\n[Документ 2 - f.pdf, раздел: s (📊 таблиц: 2)]\nplain δ" and got[2] == answers.NO_DOCUMENTS


def test_catalog(spark):
    rows = [(1, "a", 50 * 1024 * 1024, 3, "pdf-qa-shared"), (2, "b", 50 * 1024 * 1024 + 1, 2, "pdf-qa-personal-b"), (3, "a", 0, 1, "pdf-qa-personal-a")]
    table = spark.createDataFrame(rows, "id long, upload_user string, file_size long, chunk_count int, index_name string")
    assert [r.accepted for r in store.admit(table).orderBy("id").collect()] == [True, False, True]
    s = catalog.statistics(table).first()
    assert (s.total_documents, s.total_chunks, s.shared_documents, s.personal_documents) == (3, 6, 1, 2) and s.total_size_mb == pytest.approx(100.000001, abs=1e-5)
    asked = spark.createDataFrame([(1, "b"), (3, "a")], "id long, upload_user string")
    assert {r.id for r in catalog.delete(table, asked).collect()} == {1, 2}
    names = spark.createDataFrame([("Анна", "personal"), ("Bob", "personal"), ("Bob", "shared"), (None, "personal")], "u string, k string").select(catalog.index_name(F.col("u"), F.col("k"), {"Анна": "anna"}).alias("n")).collect()
    assert [r.n for r in names] == ["pdf-qa-personal-anna", "pdf-qa-personal-bob", "pdf-qa-shared", "pdf-qa-shared"]
    added = catalog.add(table, spark.createDataFrame([("z", "c"), ("y", "c")], "filename string, upload_user string"))
    assert {r.filename for r in added.where("id > 3").collect()} == {"y", "z"} and sorted(r.id for r in added.collect()) == [1, 2, 3, 4, 5]


def messages(spark, sizes):
    return spark.createDataFrame([(u, c, k, "question", f"m{k}", 1_600_000_000 + k) for u, c, n in sizes for k in range(n)], "username string, conversation_id string, seq long, type string, content string, t long").withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_chat(spark):
    rows = messages(spark, [("a", "x", 49), ("a", "y", 50), ("a", "z", 51), ("a_b", "x", 120)])
    kept = {(r.username, r.conversation_id): (r.n, r.first) for r in chat.last_messages(rows).groupBy("username", "conversation_id").agg(F.count("*").alias("n"), F.min("seq").alias("first")).collect()}
    assert kept == {("a", "x"): (49, 0), ("a", "y"): (50, 0), ("a", "z"): (50, 1), ("a_b", "x"): (50, 70)}
    many = messages(spark, [("u", f"c{k:02d}", k + 1) for k in range(11)])
    latest = chat.user_conversations(many).collect()
    assert len(latest) == 10 and "c00" not in {r.conversation_id for r in latest} and {r.last_message for r in latest if r.conversation_id == "c10"} == {"m10"}
    assert chat.recent_messages(rows).where("username = 'a'").count() == 10
    assert chat.without(rows, rows.where("conversation_id = 'x'")).select("conversation_id").distinct().count() == 2
    assert chat.history(rows, "a", "x").count() == 49


def test_upsert(spark):
    old = spark.createDataFrame([("i", "c1", "a", 1), ("i", "c2", "b", 1), ("j", "c1", "c", 1)], "index_name string, chunk_id string, v string, ingest_seq long")
    new = spark.createDataFrame([("i", "c1", "new", 2)], "index_name string, chunk_id string, v string, ingest_seq long")
    once = store.upsert(old, new)
    assert {tuple(r)[:3] for r in once.collect()} == {("i", "c1", "new"), ("i", "c2", "b"), ("j", "c1", "c")}
    assert {tuple(r) for r in store.upsert(once, new).collect()} == {tuple(r) for r in once.collect()}


def test_filters_leave_files_of_indexes_unread(spark, tmp_path):
    """Other indexes' folders aren't opened; within an index files are ranges of sections, so a section's filter skips most of them."""
    rows = spark.range(4000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("i"), (F.col("id") % 4).cast("string")).alias("index_name"), F.lpad((F.col("id") % 50).cast("string"), 2, "0").alias("section_id"), F.array(F.col("id").cast("float")).alias("embedding"))
    path = str(tmp_path / "indexes")
    store.write_indexes(rows.repartition(6), path)
    store.write_indexes(rows.where("index_name = 'i2' AND section_id < '10'"), path)  # replaces one index
    assert spark.read.parquet(path).groupBy("index_name").count().where("count = 1000").count() == 3
    found = store.read_index(spark, path, "i1").where("section_id = '01'")
    assert found.count() == 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(index_name" in plan and "EqualTo(section_id,01)" in plan
    files = store.read_index(spark, path, "i1").select(F.input_file_name().alias("f"), "section_id").groupBy("f").agg(F.min("section_id").alias("a"), F.max("section_id").alias("b"))
    ranges = sorted((r.a, r.b) for r in files.collect())
    assert all(b <= c for (_, b), (c, _) in zip(ranges, ranges[1:]))  # so footers tell most files apart


def test_streamed_messages_are_those_of_a_batch(spark, tmp_path):
    """Shuffled, repeated and late, and after a restart in between."""
    rows = messages(spark, [("a", "x", 120), ("b", "x", 3)])
    source = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda: kept.keep_messages(source(), str(tmp_path / "state")).awaitTermination(120)
    for k in (2, 0):
        rows.where(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    for k in (1, 0):
        rows.where(F.col("seq") % 3 == k).withColumn("content", F.concat("content", F.lit("" if k else " again"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    want = {tuple(r) for r in chat.last_messages(rows).select("username", "conversation_id", "seq", "type", "content", "ts").collect()}
    stored = kept.kept_messages(spark, str(tmp_path / "state"))
    assert {tuple(r) for r in stored.collect()} == want and stored.count() == 53


def test_messages_repeated_within_a_delay(spark, tmp_path):
    rows = messages(spark, [("a", "x", 60)]).coalesce(1)
    for _ in range(2):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept.keep_messages(source, str(tmp_path / "state"), delay="365 days").awaitTermination(120)
    assert kept.kept_messages(spark, str(tmp_path / "state")).count() == 50


def test_merged_messages():
    held = [(1, "q", "stored", None)]
    new = [(1, "q", "clashes", None), (2, "a", "b", None), (2, "a", "a", None), (None, "a", "x", None)]
    assert kept.merged(held, new, 5) == [(None, "a", "x", None), (1, "q", "stored", None), (2, "a", "a", None)]
    assert kept.merged(held, new, 1) == [(2, "a", "a", None)]


def test_streamed_documents(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{k}", f"text {k % 4}") for k in range(9)], "doc_id string, content string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cut = lambda df: df.select(F.col("doc_id").alias("document_id"), "content", chunk_id(F.col("content")).alias("chunk_id"))
    streams.ingest(source, str(tmp_path / "out"), str(tmp_path / "ck"), cut).awaitTermination(120)
    assert sorted(r.content for r in streams.latest(spark, str(tmp_path / "out")).collect()) == [f"text {k}" for k in range(4)]


def test_lexical_index_is_saved_and_rebuilt(spark, tmp_path):
    from lectern.operators import lexical
    from lectern.sources import lexical_store

    chunks = spark.createDataFrame([("c1", "some words here"), ("c2", "other words")], "chunk_id string, content string")
    asked = spark.createDataFrame([(1, "some other")], "query_id long, question string")
    lexical_store.save(chunks, str(tmp_path / "index"))
    want = lexical.search(lexical.build_index(chunks), asked).collect()
    assert lexical.search(lexical_store.load(spark, str(tmp_path / "index")), asked).collect() == want
    assert lexical.search(lexical_store.load(spark, str(tmp_path / "none"), chunks), asked).collect() == want


def test_entry_runs_and_sql_belongs_to_queries(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stored_messages_stay_as_they_are(spark):
    row = "username string, conversation_id string, seq long, type string, content string, ts timestamp"
    old = spark.createDataFrame([("u", "c", 1, "question", "stored", None)], row)
    new = spark.createDataFrame([("u", "c", 1, "question", "clashes", None), ("u", "c", 2, "answer", "b", None), ("u", "c", 2, "answer", "a", None)], row)
    for parts in (1, 3):
        got = {(r.seq, r.content) for r in chat.append(old, new.repartition(parts)).collect()}
        assert got == {(1, "stored"), (2, "a")}


def test_what_a_batch_writes_does_not_grow_with_the_index(spark, tmp_path):
    """Batches of ten rows while the index grows twentyfold: buckets split (not always into halves), and a batch rewrites its own ones alone."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, content string")
    for k in range(20):
        docs.where(f"doc_id div 10 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cut = lambda df: df.select(F.col("doc_id").alias("document_id"), "content", chunk_id(F.col("content")).alias("chunk_id"))
    out = str(tmp_path / "out")
    streams.ingest(source, out, str(tmp_path / "ck"), cut, most=4).awaitTermination(400)
    stored = streams.latest(spark, out)
    assert sorted(r.document_id for r in stored.collect()) == list(range(200))
    held = streams._list(spark, out)
    assert sum(n for _, n in held.values()) == 200 and max(n for _, n in held.values()) <= 8 and len(held) > 50
    assert sum(2.0 ** -int(b.split("-")[0]) for b in held) == 1  # no key without a bucket
    written = spark.read.parquet(f"{out}/v=19").count()
    assert written <= 10 * 8
    assert len(streams._numbers(spark, out, "m")) == 2  # older lists are gone
    named = {v for n in streams._numbers(spark, out, "m") for v, _ in streams._list(spark, out, n + 1).values()}
    assert set(streams._numbers(spark, out, "v")) == named


def test_every_document_is_cited(spark, tmp_path, monkeypatch):
    docs = [(1, "One.", "en", "a", 10), (2, "Two.", "de", "b", 2500), (3, "Three.", "fr", "a", 1200)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = spark.createDataFrame([(7, 1, 0.5, 1), (7, 2, 0.4, 2), (7, 3, 0.3, 3), (7, 99, 0.2, 4)], "query_id long, chunk_id long, score double, rank int")
    monkeypatch.setattr(queries, "_hybrid", lambda *_: found)
    got = {r.chunk_id: r.citation for r in queries.citation_join(spark, str(tmp_path)).collect()}
    assert got == {1: 'Title a, en - "One."', 2: 'Title b, p. 2, de - "Two."', 3: 'Title a, p. 1, fr - "Three."', 99: None}
    assert queries.citation_sources(spark, str(tmp_path)).count() == 3
    assert queries.detailed_citations(spark, str(tmp_path)).first().citation_count == 3


def test_term_indicators_read_ten_pages(spark, tmp_path):
    lines = ["x"] * 220
    for k in (0, 25, 60, 100, 150, 199):
        lines[k] = "the"
    lines[199] += " references"
    rows = [(1, "\n".join(lines)), (2, "\n".join(["x"] * 200 + ["the references"]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.has_financial_terms, r.financial_term_count, r.has_references) for r in queries.term_indicators(spark, str(tmp_path)).collect())
    assert got == [(1, True, 6, True), (2, False, 0, False)]


def test_every_assistant_turn_is_an_answer(spark, tmp_path):
    long = "y" * 501
    rows = [(1, 0, "user", "beta?"), (1, 1, "assistant", "z" * 130), (1, 2, "user", "why"), (1, 3, "assistant", long), (2, 0, "assistant", "short")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(1, "the beta of it", "en", "s", 14)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    parsed = {(r.conv_id, r.turn): r.answer for r in queries.parse_responses(spark, str(tmp_path)).collect()}
    assert parsed == {(1, 1): "z" * 130, (1, 3): long, (2, 0): "short"}
    scored = {(r.conv_id, r.turn): (r.response_coherence, r.domain_relevance) for r in queries.confidence(spark, str(tmp_path)).collect()}
    assert scored == {(1, 1): (0.8, 0.3), (1, 3): (0.5, 0.0), (2, 0): (0.2, 0.0)}
    shown = {(r.conv_id, r.turn): r.formatted for r in queries.formatted_answers(spark, str(tmp_path)).collect()}
    assert len(shown) == 3 and long in shown[(1, 3)]


def test_quotes_of_long_texts(spark):
    """Of a long text no more is cleaned than is quoted, but where its beginning is white space; a cleaned text is made once."""
    def plain(text, most, share):
        clean = re.sub("^ | $", "", re.sub(r"\s+", " ", text))
        if len(clean) <= most:
            return clean
        cut = clean[:most]
        sentence, space = max(cut.rfind(s) for s in ".!?"), cut.rfind(" ")
        return cut[: sentence + 1] if sentence > most * share else cut[:space] + "..." if space > 0 else cut + "..."

    signs = random.Random(5)
    texts = ["".join(signs.choices("ab \n.", [9, 9, w, w, d], k=k)) for w in (0, 1, 60) for d in (0, 0.1) for k in (10, 299, 301, 1300, 4000)]
    texts += [" " * 5000 + "a b " * 200, "a " + " " * 5000 + "b" * 400, " " * 5000, "", "x" * 1201]
    for most, share in ((300, 0.7), (200, 0.6)):
        short = tx.shortened(F.col("t"), most, share)
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", short.alias("s")).collect()
        assert all(r.s == plain(r.t, most, share) for r in rows)
    assert str(tx.quote(F.col("t"))).count("regexp_replace") <= 4
    assert spark.createDataFrame([(None,)], "t string").select(tx.quote(F.col("t")).alias("s")).first().s is None
