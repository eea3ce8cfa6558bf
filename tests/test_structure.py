import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import catalog, chunking, citations, layout, metadata
from lectern.sources import layouts, summaries


def spans(spark, rows):
    """(doc, page, block, text, size, y)"""
    return spark.createDataFrame([(d, p, b, 0, 0, t, s, 0, "serif", (0.0, y, 100.0, y + 10)) for d, p, b, t, s, y in rows], "doc_id string, page_num int, block_no int, line_no int, span_no int, text string, size double, flags int, font string, bbox struct<x0:double,y0:double,x1:double,y1:double>")


def docs(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id string")


LONG = "a text of more than twenty characters"


def test_body_size_is_the_upper_median(spark):
    rows = [("a", 1, k, LONG, s, 1.0) for k, s in enumerate((9.0, 10.0, 11.0, 12.0))] + [("a", 4, 9, LONG, 50.0, 1.0), ("b", 1, 0, "short", 30.0, 1.0)]
    got = {r.doc_id: r.body_size for r in layout.body_sizes(spans(spark, rows), docs(spark, "a", "b")).collect()}
    assert got == {"a": 11.0, "b": 11.0}


def test_blocks_and_texts(spark):
    raw = spark.createDataFrame([("a", 1, 0, 1, 0, "low", 1.0, (0.0, 20.0, 5.0, 30.0)), ("a", 1, 0, 0, 1, "two", 1.0, (5.0, 0.0, 9.0, 10.0)), ("a", 1, 0, 0, 0, "one ", 1.0, (0.0, 0.0, 5.0, 10.0)), ("a", 1, 1, 0, 0, "  ", 1.0, (0.0, 0.0, 1.0, 1.0)), ("a", 2, 0, 0, 0, "next", 1.0, (0.0, 0.0, 1.0, 1.0))], "doc_id string, page_num int, block_no int, line_no int, span_no int, text string, size double, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    blocks = layout.blocks_from_spans(raw)
    got = {(r.page_num, r.block_no): (r.text, tuple(r.bbox)) for r in blocks.collect()}
    assert got == {(1, 0): ("one two\nlow", (0.0, 0.0, 9.0, 30.0)), (2, 0): ("next", (0.0, 0.0, 1.0, 1.0))}
    assert layout.full_texts(blocks).first().full_text == "one two\nlow\nnext"


HEADINGS = [("1. Introduction", "Introduction", "1", 1), ("METHODOLOGY", "METHODOLOGY", "M", 1), ("Literature Review", "Literature Review", "L", 1), ("2.1 Model Setup", "Model Setup", "2.1", 2), ("1 Introduction", None, "1", 1), ("2.1. Model Setup", None, "2.1", 2), ("2.1.3 Deep", None, "2.1.3", 3), ("Introduction:", None, "I", 1), ("CAPM-Based Models", None, "C", 1)]


@pytest.mark.parametrize("text, title, id_, level", HEADINGS)
def test_headings(spark, text, title, id_, level):
    row = spark.createDataFrame([(text,)], "t string").select(layout.heading_title(F.col("t")).alias("title"), layout.section_id(F.col("t")).alias("id")).withColumn("level", layout.hierarchy_level(F.col("id"))).first()
    assert (row.title, row.id, row.level) == (title, id_, level)


def test_headings_of_long_lines(spark):
    """A line of very many words, or a number of very many parts, doesn't overflow Java's stack; what matches stays the same."""
    words, number = "Word " * 20000, "1." * 20000 + "1"
    signs = random.Random(3)
    texts = [words + "end", words + "end.", number, *("".join(signs.choices("aB \t.1", k=signs.randint(1, 9))) for _ in range(500))]
    rows = spark.createDataFrame(enumerate(texts), "i int, t string").select("i", layout.heading_title(F.col("t"), layout.HEADING_PATTERNS[3:]).alias("title"), layout.section_id(F.col("t")).alias("id")).orderBy("i").collect()
    assert [r.title for r in rows[:3]] == [words + "end", None, None] and rows[2].id == number
    for text, r in zip(texts[3:], rows[3:]):
        found = re.match(r"(?i)(?:[a-z][a-z]+(?:\s+[a-z][a-z]+)*)\s*$", text.strip(" "))
        assert r.title == (found and found.group().strip(" ")), text
        number = re.match(r"\d+(?:\.\d+)*", text.strip(" "))
        assert not number or r.id == number.group(), text


def test_section_ids_without_letters(spark):
    assert spark.createDataFrame([("éclat",)], "t string").select(layout.section_id(F.col("t")).alias("i")).first().i.startswith("sec_")


def test_find_sections(spark):
    rows = [("a", 1, 0, LONG, 10.0, 50.0), ("a", 1, 1, "1. Introduction", 12.0, 10.0), ("a", 1, 2, "2. Just Below", 11.99, 20.0), ("a", 2, 0, "2.1 Model Setup", 14.0, 5.0), ("a", 2, 1, "lower case", 20.0, 6.0), ("a", 3, 0, "2.2 More Setup", 14.0, 5.0), ("a", 3, 1, "3. Results", 14.0, 9.0)]
    got = layout.find_sections(spans(spark, rows), docs(spark, "a")).orderBy("section_seq").collect()
    assert [(r.section_id, r.title, r.hierarchy_level, r.parent_section, r.child_sections) for r in got] == [("1", "Introduction", 1, None, ["2.1", "2.2"]), ("2.1", "Model Setup", 2, "1", []), ("2.2", "More Setup", 2, "1", []), ("3", "Results", 1, None, [])]


@pytest.fixture(scope="module")
def placed(spark):
    sections = spark.createDataFrame([("d", 1, "A", "first", 1, 100.0), ("d", 2, "B", "second", 1, 400.0), ("d", 3, "B", "third", 3, 50.0), ("d", 4, "C", "none", 4, 1.0)], "doc_id string, section_seq int, section_id string, title string, page_num int, y double")
    at = [(1, 40.0), (1, 100.0), (1, 399.0), (1, 400.0), (2, 10.0), (3, 49.0), (3, 50.0)]
    blocks = spark.createDataFrame([("d", p, k, "text", f"b{k}", (0.0, y, 10.0, y + 5)) for k, (p, y) in enumerate(at)], "doc_id string, page_num int, block_no int, block_type string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    return blocks, sections


def test_section_texts(placed):
    got = {r.section_seq: r.section_text for r in layout.section_texts(*placed).collect()}
    assert got == {1: "b1\nb2", 2: "b3\nb4\nb5", 3: "b6", 4: ""}


def test_text_between(spark, placed):
    asked = spark.createDataFrame([(1, "d", "A", "B"), (2, "d", "B", None), (3, "d", "X", None), (4, "d", "A", "X")], "request_id int, doc_id string, start_id string, end_id string")
    got = {r.request_id: r.text for r in layout.text_between(*placed, asked).collect()}
    assert got == {1: "b1\nb2\nb3\nb4\nb5", 2: "b6", 3: "", 4: "b1\nb2\nb3\nb4\nb5\nb6"}


def test_section_of_chunks(spark, placed):
    chunks = spark.createDataFrame([("d", "c1", "B", 1), ("d", "c2", None, 2), ("d", "c3", "Z", 3), ("d", "c4", None, 0), ("e", "c5", "A", 1)], "doc_id string, chunk_id string, section_id string, page_num int")
    got = {r.chunk_id: r.found_seq for r in layout.section_of_chunks(chunks, placed[1]).collect()}
    assert got == {"c1": 2, "c2": 1, "c3": 3, "c4": None, "c5": None}


FIRST = """A Theory of Asset Pricing Under Uncertainty
Authors: Dr. Ann Lee, Bo Chan and Cy Dow
Abstract
This paper studies prices. It shows that risk matters. Evidence is given for it.
Keywords: asset pricing; beta, JEL
JEL Codes: G12, C58
1. Introduction
DOI: 10.1000/xyz.1
Published: March 2021
"""


@pytest.fixture(scope="module")
def papers(spark):
    documents = spark.createDataFrame([("p", "/x/paper.pdf", 2, {"title": "Property Title Long", "author": None}), ("q", "/x/q.pdf", 1, {"creationDate": "D:2020"}), ("r", "/x/r.pdf", 0, None)], "doc_id string, path string, page_count int, pdf_meta map<string,string>")
    pages = spark.createDataFrame([("p", 1, FIRST), ("p", 2, "Journal: Finance Letters\nvar var var Table 3 references $x$"), ("q", 1, "portfolio portfolio bond equity stock")], "doc_id string, page_num int, page_text string")
    return documents, pages


def test_extract(papers):
    got = {r.doc_id: r for r in metadata.extract(*papers).collect()}
    p = got["p"]
    assert p.title == "A Theory of Asset Pricing Under Uncertainty"
    assert p.authors[:3] == ["Ann Lee", "Bo Chan", "Cy Dow"]
    assert p.abstract.startswith("This paper studies") and p.abstract.endswith("given for it.")
    assert p.keywords[:5] == ["asset pricing", "beta", "JEL", "G12", "C58"] and "var" in p.keywords
    assert (p.publication_info.journal, p.publication_info.doi, p.publication_info.volume) == ("Finance Letters", "10.1000/xyz.1", None)
    assert p.date == "March 2021" and got["q"].date == "D:2020" and got["r"].title is None
    assert p.financial_indicators.has_tables and p.financial_indicators.has_references and p.financial_indicators.has_mathematical_formulas
    assert got["q"].financial_indicators.financial_term_count == 5 and not got["q"].financial_indicators.has_financial_terms
    assert got["q"].document_stats.total_words == 5 and len(p.document_id) == 16 and p.document_id != got["q"].document_id


def test_titles(spark):
    texts = {"x" * 9: False, "x" * 10: True, "A" * 101: False, "A" * 100: True, "a" * 301: False, "ab#$%^&*+=": False}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", metadata.valid_title(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == texts
    big = spans(spark, [("a", 1, 0, "Largest Type Wins Here", 20.0, 1.0), ("a", 1, 1, "Largest Type Wins Here Longer", 20.0, 2.0), ("a", 1, 2, "A much longer text of smaller type", 10.0, 3.0), ("a", 1, 3, "short", 40.0, 3.0)])
    assert metadata.title_by_font(big).first().candidate == "Largest Type Wins Here Longer"


SPECIAL = ["$$E = mc^2$$ and text", "\\begin{align}a\\end{align} \\(x\\) \\[y\n\\]", "inline $\\alpha + \\beta$ here", "costs $1,200.50 million and $5 again", "Table 1 " + "caption " * 12 + "\n\nBody starts", "Figure 2 short\nNext", "__FORMULA_0__ then $ab$", "$$ $$ $ $", "plain", ""]


@pytest.mark.parametrize("text", SPECIAL)
def test_masking_can_be_undone(text):
    masked, kept = chunking.mask_special(text)
    assert chunking.restore_special(masked, kept) == text


def test_what_is_masked():
    assert [*chunking.mask_special(SPECIAL[0])[1].values()] == ["$$E = mc^2$$"]
    assert [*chunking.mask_special(SPECIAL[1])[1].values()] == ["\\begin{align}a\\end{align}", "\\(x\\)", "\\[y\n\\]"]
    assert [*chunking.mask_special(SPECIAL[2])[1].values()] == ["$\\alpha + \\beta$"]
    assert chunking.mask_special(SPECIAL[3])[1] == {}
    (caption,) = chunking.mask_special(SPECIAL[4])[1].values()
    assert caption.startswith("Table 1") and "Body" not in caption


def test_paragraphs_and_packing():
    assert chunking.split_paragraphs(" a \n \n\nb\n\n") == ["a", "b"]
    assert chunking.split_paragraphs("x" * 1500) == ["x" * 1500]
    sentences = "One sentence is here. " * 80
    parts = chunking.split_paragraphs(sentences)
    assert len(parts) > 1 and all(len(p) < 1000 for p in parts) and " ".join(parts) == sentences.strip()
    assert chunking.pack_paragraphs(["a" * 499, "b" * 499]) == ["a" * 499 + "\n\n" + "b" * 499]
    assert chunking.pack_paragraphs(["a" * 950, "b" * 99, "c" * 900]) == ["a" * 950, "b" * 99 + "\n\n" + "c" * 900]
    assert chunking.pack_paragraphs(["a" * 800, "b" * 99, "c" * 900]) == ["a" * 800 + "\n\n" + "b" * 99, "b" * 99 + "\n\n" + "c" * 900]
    assert chunking.pack_paragraphs(["a" * 800, "b" * 100, "c" * 900]) == ["a" * 800 + "\n\n" + "b" * 100, "c" * 900]


@pytest.mark.parametrize("a, b, want", [("w" * 400, "w" * 400, True), ("w" * 400, "w" * 401, False), ("aaaa bbbb cccc dddd", "aaaa xxxx yyyy zzzz", False), ("aaaa bbbb cccc", "aaaa xxxx yyyy zzzz", True), ("a b", "a b", False), ("same words __FORMULA_0__", "same words __TABLE_1__", False), ("same words __FORMULA_0__", "same words", True)])
def test_related(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(chunking.related(F.col("a"), F.col("b")).alias("r")).first().r is want


def test_chunks_hold_every_paragraph(spark, placed):
    text = "\n\n".join(["alpha words here once", "alpha words here twice", "unlike $$x + y$$ stuff", "z" * 1200])
    rows = chunking.chunk_texts(spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "doc_id string, text string"), ["doc_id"]).orderBy("chunk_seq").collect()
    assert [r.content for r in rows] == ["alpha words here once\n\nalpha words here twice", "unlike $$x + y$$ stuff", "z" * 1200]
    assert [r.content_type for r in rows] == ["text", "formula", "text"] and rows[1].formula_count == 1
    assert rows[0].chunk_id.startswith("chunk_") and len(rows[0].chunk_id) == 18
    blocks, sections = placed
    whole = layout.full_texts(blocks).withColumn("doc_id", F.lit("bare"))
    cut = chunking.chunk_documents(docs(spark, "d", "bare"), sections, layout.section_texts(blocks, sections), whole).collect()
    assert {(r.doc_id, r.section_id, r.page_num) for r in cut} == {("d", "A", 1), ("d", "B", 1), ("d", "B", 3), ("bare", None, 1)}


def test_fixed_pieces():
    text = "word " * 500
    parts = chunking.recursive_pieces(text, 100, 20)
    assert all(len(p) <= 100 for p in parts) and all(a[-19:].split()[-1] in b for a, b in zip(parts, parts[1:]))
    assert chunking.recursive_pieces("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50]
    assert chunking.recursive_pieces("", 100, 20) == []


def test_embed(spark):
    rows = spark.createDataFrame([(f"c{k}", "x" * k) for k in range(7)], "chunk_id string, content string")
    got = {r.chunk_id: r.embedding for r in chunking.embed(rows, lambda texts: [[len(t), 1] for t in texts], batch=3).collect()}
    assert got == {f"c{k}": [float(k), 1.0] for k in range(7)}


def test_citation_contexts(spark, placed):
    chunks = spark.createDataFrame([("d", "c1", "b2", "A", None, 1), ("d", "c2", "lost", None, None, 2)], "doc_id string, chunk_id string, content string, section_id string, section_title string, page_num int")
    boxes = spark.createDataFrame([("d", "c1", (0.0, 380.0, 10.0, 390.0))], "doc_id string, chunk_id string, coordinates struct<x1:double,y1:double,x2:double,y2:double>")
    titles = spark.createDataFrame([("d", None)], "doc_id string, title string")
    cited = citations.build(chunks, titles, placed[1], boxes)
    rows = {r.chunk_id: r for r in citations.with_text(cited).collect()}
    assert rows["c1"].citation == 'Unknown Document, p. 1, first - "b2"' and rows["c2"].section_title == "first"
    pages = spark.createDataFrame([("d", 1, 100.0, 500.0), ("d", 2, 100.0, 500.0)], "doc_id string, page_num int, width double, height double")
    found = {r.chunk_id: r.context for r in citations.contexts(cited, placed[0], pages).collect()}
    assert (found["c1"].before, found["c1"].after) == ("", "\nb3") and found["c2"].full_context == "b4"  # without a box: the page
    assert citations.of_section(cited, "d", "A").count() == 2 and citations.of_page(cited, "d", 2).count() == 1


def shuffled_bytes(spark):
    """Bytes written to shuffles so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    return sum(s.shuffleWriteBytes() for s in (lambda x: [x.apply(i) for i in range(x.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))


def test_citation_contexts_in_strips(spark):
    """Against all pairs, with boxes within a strip, over several, unknown and on pages that aren't given; and the text around a citation isn't shuffled for each."""
    rng = random.Random(5)
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    cited = []
    for k in range(120):
        y = rng.uniform(0, 3400)
        cited.append(("d", k, rng.choice([1, 2, 3]), rng.choice(["b7", "lost", "b11"]), None if k % 10 == 0 else (100.0, y, 200.0, y + rng.choice([10.0, 400.0, 2500.0]))))
    blocks = [("d", page, n, kind, f"b{n}", (float(n % 7 * 60), n * 12.0, n * 60.0, n * 12.0 + rng.choice([9.0, 1200.0]))) for page in (1, 2) for n in range(280) for kind in ["image" if n % 13 == 0 else "text"]]
    blocks = [(d, p, n, kind, t, (x0, y0, x0 + 50, y1)) for d, p, n, kind, t, (x0, y0, _, y1) in blocks]
    left = spark.createDataFrame(cited + [(None, 500, 1, "b7", None)], f"document_id string, chunk_id int, page_number int, text_snippet string, coordinates {box}")
    right = spark.createDataFrame(blocks, "doc_id string, page_num int, block_no int, block_type string, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>")
    pages = spark.createDataFrame([("d", 1, 450.0, 3360.0), ("d", 2, 300.0, 900.0)], "doc_id string, page_num int, width double, height double")
    sizes = {1: (450.0, 3360.0), 2: (300.0, 900.0)}
    want = {500: ""}
    for d, k, page, _, c in cited:
        width, height = sizes.get(page, (-1e9, -1e9))
        x1, y1, x2, y2 = c or (0.0, 0.0, 1e9, 1e9)
        x1, y1, x2, y2 = max(0.0, x1 - 50), max(0.0, y1 - 50), min(width, x2 + 50), min(height, y2 + 50)
        want[k] = "\n".join(t for _, p, n, kind, t, (a, b, e, f) in blocks if page in sizes and p == page and kind == "text" and f >= y1 and b <= y2 and e >= x1 and a <= x2)
    out = citations.contexts(left, right, pages, 100_000)
    assert out.columns == [*left.columns, "context"]
    got = {r.chunk_id: r for r in out.collect()}
    assert len(got) == 121 and {k: r.context.full_context for k, r in got.items()} == want
    assert all(r.context.before == ("" if r.text_snippet not in want[k] else want[k][: want[k].index(r.text_snippet)]) for k, r in got.items())
    long = spark.range(4000).select(F.lit("d").alias("doc_id"), F.floor(F.col("id") / 20).cast("int").alias("page_num"), F.col("id").cast("int").alias("block_no"), F.lit("text").alias("block_type"), F.concat(*(F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 256) for i in range(8))).alias("text"), (F.col("id") % 20 * 10.0).alias("y"))
    of_lines = long.select("doc_id", "page_num", "block_no", "block_type", "text", F.struct(F.lit(0.0).alias("x0"), F.col("y").alias("y0"), F.lit(500.0).alias("x1"), (F.col("y") + 10).alias("y1")).alias("bbox"))
    asked = long.select(F.col("doc_id").alias("document_id"), F.col("block_no").alias("chunk_id"), F.col("page_num").alias("page_number"), F.substring("text", 1, 20).alias("text_snippet"), F.struct(F.lit(0.0).alias("x1"), F.col("y").alias("y1"), F.lit(500.0).alias("x2"), (F.col("y") + 10).alias("y2")).alias("coordinates"))
    before = shuffled_bytes(spark)
    found = citations.contexts(asked, of_lines, long.select("doc_id", "page_num").distinct().withColumns({"width": F.lit(500.0), "height": F.lit(200.0)}), 100_000)
    assert found.agg(F.sum(F.length("context.full_context"))).first()[0] > 4000 * 5000
    assert shuffled_bytes(spark) - before < 5 * 4000 * 512


def test_boxes_meet_in_bands(spark):
    """Against all pairs, with boxes of any height, upside down, off the page and far below; and few candidates on a page of many blocks."""
    rng = random.Random(3)
    height = lambda: rng.choice([rng.uniform(-60, 900), float(rng.randrange(0, 900, 50)), 1e9])
    boxes = [(k, *(sorted((a, b)) if k % 9 else (b, a))) for k in range(80) for a, b in [(height(), height() if k % 3 else 40.0)]]
    texts = [(k, *(sorted((a, b)) if k % 7 else (b, a))) for k in range(120) for a, b in [(height(), height())]] + [(500, None, 3.0)]
    left = spark.createDataFrame([("d", 1, *b) for b in boxes], "document_id string, page_number int, k int, low double, high double")
    right = spark.createDataFrame([("d", 1, *t) for t in texts], "document_id string, page_number int, n int, y0 double, y1 double")
    got = sorted((r.k, r.n) for r in citations.touching(left, right).collect())
    assert got == sorted((k, n) for k, low, high in boxes for n, y0, y1 in texts if y0 is not None and y1 >= low and y0 <= high)
    many = spark.range(10_000).select(F.lit("d").alias("document_id"), F.lit(1).alias("page_number"), F.col("id").alias("n"), (F.col("id") * 10.0).alias("y0"), (F.col("id") * 10.0 + 9).alias("y1"))
    asked = many.select("document_id", "page_number", F.col("n").alias("k"), (F.col("y0") - 50).alias("low"), (F.col("y1") + 50).alias("high"))
    assert citations.touching(asked, many).count() < 12 * 10_000
    bands = asked.withColumn("band", F.explode(citations.bands(F.col("low"), F.col("high"))[1])).groupBy("band").count()
    of_texts = many.withColumn("band", F.explode(citations.bands(F.col("y0"), F.col("y1"))[1])).groupBy("band").agg(F.count("*").alias("m"))
    assert bands.join(of_texts, "band").agg(F.sum(F.col("count") * F.col("m"))).first()[0] < 40 * 10_000  # all candidates of a page of 10,000 blocks


def test_layout_files(spark, tmp_path):
    """What is written comes back; lines that aren't pages are set apart."""
    box = (0.0, 0.0, 5.0, 5.0)
    rows = [(1, 1, b, line, k, f"t{b}{line}{k}", 9.5, 0, None, box) for b in range(2) for line in range(2) for k in range(3)] + [(2, 3, 0, 0, 0, "é\n\"x\"", None, 1, "f", None)]
    schema = "doc_id long, page_num int, block_no int, line_no int, span_no int, text string, size double, flags int, font string, bbox struct<x0: double, y0: double, x1: double, y1: double>"
    data = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "pages")
    layouts.write(data.repartition(3), path)
    assert sorted(map(str, layouts.spans(spark, path).collect())) == sorted(map(str, data.collect()))
    (tmp_path / "pages" / "broken.json").write_text('{"doc_id": 5, "page_num": 1, "blocks": [\n{"page_num": 4}\nnot json\n{"doc_id": 6, "page_num": 2, "width": 10.0, "height": 20.0, "blocks": [{"type": "image", "lines": null}]}\n')
    assert layouts.spans(spark, path).count() == len(rows)
    bad = layouts.bad_pages(spark, path).collect()
    assert len(bad) == 3 and all(r.file.endswith("broken.json") for r in bad) and any("not json" == r.line for r in bad)
    assert layouts.page_sizes(spark, path).where("width = 10").first().doc_id == 6
    plan = layouts.page_sizes(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "blocks" not in plan[plan.index("ReadSchema") :]


def test_many_terms_are_found_as_few_are(spark, monkeypatch):
    """The automaton's results are the columns', for overlapping, nested, repeated and odd terms; nulls stay null."""
    rng = random.Random(1)
    terms = ["aa", "a", "ab", "ba", "aba", "é", "x y", "aa", "zzz", "ß"]
    texts = ["".join(rng.choice("aab é xyß") for _ in range(rng.randrange(40))) for _ in range(200)] + ["", None, "aaaaa", "ababab"]
    data = spark.createDataFrame([(t,) for t in texts], "t string")
    results = []
    for most in (64, 0):
        monkeypatch.setattr(tx, "MANY", most)
        results.append([tuple(r) for r in data.select("t", tx.occurrences(F.col("t"), terms), tx.terms_in(F.col("t"), terms), tx.contains_any(F.col("t"), terms)).collect()])
    few, many = results
    assert few == many
    words = [f"w{k}q" for k in range(3000)]
    monkeypatch.setattr(tx, "MANY", 64)
    assert spark.createDataFrame([("w7q w7q w2999q",)], "t string").select(tx.occurrences(F.col("t"), words)).first()[0] == 3


def test_kept_figures(spark, tmp_path):
    """After adds, a repeated add, deletes and compaction: those of a scan."""
    rows = [("pdf-qa-shared", 10, 1), ("pdf-qa-shared", 20, None), ("pdf-qa-personal-a", None, 3), ("pdf-qa-personal-b", 5, 4)]
    data = spark.createDataFrame(rows, "index_name string, file_size long, chunk_count long")
    keys, sums = summaries.CATALOG_KEYS, summaries.CATALOG_SUMS
    path = str(tmp_path / "figures")
    for batch, part in (("1", data), ("2", data), ("2", data)):
        summaries.record(part, path, batch, keys, sums)
    summaries.record(data.where("index_name like '%-b'"), path, "3", keys, sums, gone=True)
    summaries.record(data.where("index_name like '%-b'"), path, "4", keys, sums, gone=True)
    left = data.union(data).where("index_name not like '%-b'")
    want = [tuple(r) for r in catalog.statistics(left).collect()]
    figures = lambda: [tuple(r) for r in summaries.catalog_stats(summaries.merged(spark, path, keys, sums), catalog.SHARED_INDEX, catalog.PERSONAL_PREFIX).collect()]
    assert figures() == want
    summaries.compact(spark, path, keys, sums, "all")
    assert figures() == want and len(summaries._batches(spark, path)) == 1


def test_blocks_of_pages_without_a_shuffle(spark, tmp_path):
    """Pages that lie in one row give the blocks of their spans; files are compressed."""
    box = lambda x, y: (x, y, x + 1.0, y + 2.0)
    span = lambda t, x, y: (t, 9.0, 0, "serif", box(x, y))
    pages = [(1, 1, 5.0, 8.0, [("text", [([span("b ", 2.0, 3.0), span(None, 9.0, 9.0), span("a", 1.0, 4.0)],), ([],), (None,), ([span(" c", 0.5, 7.0)],)]), ("image", [([span("no", 0.0, 0.0)],)]), ("text", []), ("text", None), ("text", [([span(" ", 0.0, 0.0)],)])]), (1, 2, 5.0, 8.0, [("text", [([span("d", 0.0, 0.0)],)])]), (2, 1, 5.0, 8.0, None)]
    layouts.write_pages(spark.createDataFrame(pages, layouts.PAGE), str(tmp_path / "pages"))
    assert list((tmp_path / "pages").glob("*.json.gz")) and not list((tmp_path / "pages").glob("*.json"))
    got = layout.blocks_of_pages(layouts.pages(spark, str(tmp_path / "pages")).where("is_page"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = layout.blocks_from_spans(layouts.spans(spark, str(tmp_path / "pages")))
    rows = lambda df: sorted((r.doc_id, r.page_num, r.block_no, r.text, tuple(r.bbox), r.block_type) for r in df.collect())
    assert rows(got) == rows(want) == [(1, 1, 0, "b a\n c", (0.5, 3.0, 10.0, 11.0), "text"), (1, 2, 0, "d", (0.0, 0.0, 1.0, 2.0), "text")]


def test_long_words_are_found_once(spark):
    """Neighbours' words, for whichever of the tests name them."""
    assert str(chunking.related(F.col("a"), F.col("b"))).count("split(") <= 2


def test_texts_without_marks_are_passed_over(monkeypatch):
    signs = random.Random(2)
    parts = ["$5", "$$a$$", "\\(x\\)", "\\[y\\]", "TABLE 3", "f\u0131gure 1", "F\u0130GURE 2", "table", "Figure", "plain", ". ", "\n\n", "$ab$"]
    texts = ["".join(signs.choices(parts, k=signs.randint(0, 4))) for _ in range(500)]
    quick = [chunking.mask_special(t) for t in texts]
    monkeypatch.setattr(chunking, "_MAYBE", re.compile(""))
    assert quick == [chunking.mask_special(t) for t in texts]


def test_results_go_on_in_small_tables(monkeypatch):
    monkeypatch.setattr(chunking, "FRAME", 1000)
    asked = []
    rows = ((k, "x" * 300) for k in range(50) if asked.append(k) is None)
    frames = chunking.in_frames(rows, ["k", "t"], 1)
    assert len(next(frames)) == 3 and len(asked) == 3  # no more is made than is handed on
    assert [k for f in frames for k in f.k] == list(range(3, 50)) and not list(chunking.in_frames(iter(()), ["k", "t"], 1))


def test_gathered_rows_are_flat(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "c"), (0, 9, "a"), (1, 1, "b"), (2, 0, None)], "p int, q int, t string")
    got = rows.repartition(3).groupBy().agg(tx.gathered([F.col("p"), F.col("q")], F.col("t")).alias("all"))
    assert got.first().all == "a\nb\nc\nb"
    assert "collect_list(struct(k0, p" in got._jdf.queryExecution().optimizedPlan().toString()
