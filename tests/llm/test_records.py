import hashlib
import struct
import zlib
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lectern.llm import ann, quality, queries, storage, urlfilter, warc

from .cases import DOCS, collected, documents, prose

PAGES = [
    (1, "http://a.example.com/en/1", "<p>" + "same " * 40),
    (2, "http://b.example.com/", "<p>" + "same " * 40),
    (3, None, None),
    (4, "no scheme", ""),
    (5, "ftp://X.Example.COM:80/EN/?q#f", "short"),
    (6, "http://net", "short"),
    (7, "http://es.net/es/a", "é" * 60),
    (8, "http://es.net/es/a", "é" * 60),
    (8, "http://es.net/es/a", "é" * 60),
    (9, "http://www.example.com/en/x?y=/en/", "x" * 300_000),
    (None, "http://m.www.example.com/en/\n z", "<p>" + "same " * 40),
    (10, "http://example.com?x=/en/", "tail"),
    (11, "http://notexample.com/en/", "tail"),
    (12, "://net/fr/", "\r\n\r\n"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, digest string, id int, key string")


def expected_records():
    first = {}
    for i, _, h in PAGES:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        to = first.get(b)
        to = None if to == i else to
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    return out


@pytest.mark.parametrize("limit", [64 << 20, 200])
def test_warc_round_trip(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", limit)
    monkeypatch.setattr(warc, "SAMPLE_BYTES", 1000)
    manifest = warc.write(pages(spark).repartition(2), str(tmp_path / "w"))
    rows = warc.read(manifest, with_payload=True)
    assert collected(rows.drop("url", "payload")) == collected(spark.createDataFrame(expected_records(), "a long, b long, c string, d string, e long"))
    html = {}
    for i, _, h in PAGES:
        html.setdefault(i, (h or "").encode())
    assert all(bytes(r.payload) == html[r.page_id] for r in rows.where("record_type = 'response'").collect())
    assert sum(r.records for r in manifest.collect()) == len(PAGES)


def test_archives_begin_with_their_dictionary(spark, tmp_path):
    rows = [(k, f"http://a/{k}", "<html>" + prose(k, 60)) for k in range(300)]
    path = warc.write(pages(spark, rows).coalesce(1), str(tmp_path / "w")).first().archive
    with open(path, "rb") as f:
        magic, size = struct.unpack("<II", f.read(8))
        own = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(f.read(size), max_output_size=1 << 20))
        rest = f.read()
    assert magic == 0x184D2A5D and own.dict_id()
    one = zstandard.ZstdDecompressor(dict_data=own).decompressobj()
    assert one.decompress(rest).startswith(b"WARC/1.1\r\n") and one.unused_data  # a record is a frame


def test_damaged_records_are_refused():
    data = warc.record(1, "http://a/", b"payload", hashlib.sha256(b"other").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.parse(data)


def test_no_pages(spark, tmp_path):
    assert warc.read(warc.write(pages(spark, []), str(tmp_path / "w"))).collect() == []
    assert urlfilter.judge(pages(spark, [])).collect() == []


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path] + [len(path)])]
    fitting = [(len(h) + len(p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fitting, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_rules(spark):
    got = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages(spark)).collect()}
    assert got == {(i, u): plain_verdict(u, urlfilter.RULES) for i, u, _ in PAGES}
    assert {r.verdict for r in urlfilter.judge(pages(spark), []).collect()} == {"allow"}


def test_many_rules_make_several_levels(spark):
    rules = [(f"h{k}.com", "/", "block" if k % 3 else "allow") for k in range(300)] + [("com", "/x", "block")]
    rows = [(k, f"http://h{k}.com/{'x' if k % 2 else 'y'}{k}", "") for k in range(4000)]
    out = urlfilter.judge(pages(spark, rows), rules)
    assert {r.page_id: (r.rule, r.verdict) for r in out.collect()} == {i: plain_verdict(u, rules)[2:] for i, u, _ in rows}
    universe = spark.createDataFrame([(f"k{k}",) for k in range(5000)], "key string")
    cascade = urlfilter.make_cascade(universe, [f"k{k}" for k in range(0, 5000, 11)], 5000)
    assert len(cascade.levels) > 1
    assert {r.key for r in universe.where(cascade.lists(F.col("key"))).collect()} == {f"k{k}" for k in range(0, 5000, 11)}


def test_url_filter_runs_no_python(spark):
    plan = urlfilter.judge(pages(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Join" not in plan


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("pages", "documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, small).select(want.columns)
    assert collected(got) == sorted(want.fetchall(), key=lambda x: tuple((v is None, str(v)) for v in x))


# --- nearest neighbours --------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 3, "z") for r in rows], "vec_id long, embedding array<float>, rank int, score string")


def test_search_against_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "INDEX_BLOCK", 150)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(0)
    x = (rng.standard_normal((500, 24)) * rng.uniform(0.5, 2, (500, 1))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500, None), (520, [0.0] * 24), (540, [float("nan")] * 24), (None, x[0].tolist()), (560, [1.0])]
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    scores = x.astype(float) @ x.astype(float).T
    hits = total = 0
    for q in range(0, 500, 20):
        own = [r for r in got if r.query_id == q]
        assert [r["rank"] for r in own] == list(range(1, 21)) and q not in {r.vec_id for r in own}
        assert all(abs(r.score - scores[q, r.vec_id]) < 1e-9 for r in own)
        assert sorted(own, key=lambda r: (-r.score, r.vec_id)) == own
        best = [k for k in np.argsort(-scores[q], kind="stable") if k != q][:20]
        hits += len(set(best) & {r.vec_id for r in own})
        total += 20
    assert hits / total >= 0.9 and {r.query_id for r in got} == set(range(0, 500, 20))


def test_repeated_query_ids_have_lists_of_their_own(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 8)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(20, (-x[20]).tolist()), (40, x[40].tolist())]
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).where("query_id in (20, 40)").collect()
    assert len(got) == 80 and all(sum(r["rank"] == k and r.query_id == q for r in got) == 2 for k in range(1, 21) for q in (20, 40))
    for v in (x[20], -x[20]):
        scores = np.array([np.array(r[1], dtype=float) for r in rows]) @ v.astype(float)
        best = sorted((-s, r[0]) for s, r in zip(scores, rows) if r[1] != v.tolist())[:20]
        mine = {(r["rank"], r.vec_id, round(r.score, 9)) for r in got if r.query_id == 20}
        assert len({(k + 1, i, round(-s, 9)) for k, (s, i) in enumerate(best)} & mine) >= 18
    assert {(r.vec_id, round(r.score, 6)) for r in got if r.query_id == 40 and r["rank"] == 1} == {(40, round(float(x[40].astype(float) @ x[40]), 6))}


def test_search_ties_and_few_rows(spark):
    rows = [(20, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (1, [0.0, 1.0])]
    got = ann.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 1.0), (3, 1.0), (1, 0.0)]
    assert ann.search(vectors(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert ann.search(vectors(spark, [(1, None)]), F.col("vec_id") % 20 == 0).collect() == []


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 256, (2000, 4), dtype=np.uint8)
    index = ann.Index(codes)
    for q in codes[:30]:
        for radius in (0, 3, 9):
            away = np.unpackbits(codes ^ q, axis=1).sum(axis=1)
            assert index.near(q, radius).tolist() == np.flatnonzero(away <= radius).tolist()


# --- quality -------------------------------------------------------------------------------------


def quality_case(spark, n=600):
    good = [(k, prose(k, 60) + ".", 1) for k in range(n) if k % 4]
    bad = [(k, " ".join(w.upper() + "!!" for w in prose(k, 60).split()), 0) for k in range(n) if not k % 4]
    rows = good + bad
    docs = documents(spark, [(i, t) for i, t, _ in rows] + [r for r in DOCS if r[0] in (4, 5, 8, None)][:0] + [(10_000, None), (10_001, ""), (None, prose(1, 9)), (10_002, "x" * (1 << 20) + " " + prose(3, 100))])
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(0, 1, 1), (None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels, {i: y for i, _, y in rows}


def test_quality_held_out_accuracy(spark):
    docs, labels, truth = quality_case(spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_quality_does_not_depend_on_partitions(spark):
    docs, labels, _ = quality_case(spark, 200)
    one, many = (quality.word_vectors(docs.repartition(n)) for n in (1, 7))
    assert np.array_equal(one, many)


def test_quality_reads_long_texts_whole(spark, monkeypatch):
    texts = [t for _, t in DOCS] + ["é" * 300 + " " + "ab12?? " * 90]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    batch = table.toArrow().to_batches()[0]
    monkeypatch.setattr(quality, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    whole = [p.as_py() for b in quality._contexts(iter([batch])) for p in b.column("part")]
    data = quality.text_bytes(batch.column(0))
    vectors = np.random.default_rng(1).standard_normal((quality.BUCKETS, quality.SIZE)).astype(np.float32)
    want = quality.features(vectors, *data)
    for piece in (1, 7, 64, 5000):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert [p.as_py() for b in quality._contexts(iter([batch])) for p in b.column("part")] == whole
        assert np.allclose(quality.features(vectors, *data), want, rtol=1e-12, atol=1e-12)


def test_quality_without_labels(spark):
    docs, labels, _ = quality_case(spark, 40)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(documents(spark, []), labels).collect() == []


def test_held_out_labels_are_not_learned(spark):
    docs, labels, _ = quality_case(spark, 200)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert collected(quality.classify(docs, labels)) == collected(quality.classify(docs, flipped))


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages_bear_odd_rows(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame([(i, 1) for i, _ in DOCS if i is not None], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    good, one, cut, pack = (stage for _, stage in corpus_pipeline.STAGES)
    for stage in (good, one, cut):
        assert stage(spark, documents(spark, []), folder).columns == corpus_pipeline.COLUMNS
        assert stage(spark, documents(spark, []), folder).collect() == []
    assert pack(spark, documents(spark, []), folder).collect() == []
    ids = lambda rows: sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    docs = documents(spark)
    everyone = ids(docs.collect())
    assert ids(good(spark, docs, folder).collect()) == everyone  # labels of one kind only: all have its share, 1
    # 2 and 3 go with 1, texts without words with 4, 13 with 12, and of rows that share an id one stays
    assert ids(one(spark, docs, folder).collect()) == sorted((i is None, i or 0) for i in (1, 4, 7, 8, 9, 10, None, 11, 12))
    kept = cut(spark, docs, folder)
    assert ids(kept.collect()) == everyone
    texts = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert texts[1] == texts[2] == texts[4] == ("", 0)  # each copy goes, and what is empty stays a document
    assert texts[7] == ("One", 3)
    assert {r.doc_id for r in pack(spark, docs, folder).collect()} == {i for i, _ in DOCS}


def test_pipeline_drops_what_the_classifier_rejects(spark, tmp_path):
    import corpus_pipeline

    docs, labels, truth = quality_case(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    whole = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    score = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, whole, str(tmp_path)).collect()}
    assert kept == {i for i, s in score.items() if s >= 0.5} and 0 < len(kept) < len(score)


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = storage.table(spark, small, "documents", *corpus_pipeline.COLUMNS)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, storage.keep(stage(spark, docs, small), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        assert docs.count() == docs.join(before, "doc_id", "left_semi").count() <= n
    assert docs.count() < n
    pieces = corpus_pipeline.run(spark, small)
    assert pieces.select("doc_id").distinct().count() == docs.count()
