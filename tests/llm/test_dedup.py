import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import buckets, components, embeddings, simhash, suffix

from .cases import DOCS, collected, documents, prose


def groups(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups(300, links)
    assert got == {k: want[k] for k in range(300) if want[k] != k}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<float>, label int, node int, key string, weight double")


def cosine_case(seed=0, n=400, size=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, size))
    rows = []
    for k in range(n):
        v = (base[k % 12] + rng.standard_normal(size) * rng.choice([0.05, 0.14, 0.4])).astype(np.float32)
        rows.append((k, v.tolist(), int(k % 3)))
    rows += [(n, rows[5][1], rows[5][2]), (n + 1, rows[5][1], rows[5][2]), (n + 2, rows[5][1], None), (n + 3, None, 1), (n + 4, [0.0] * size, 1), (n + 5, [float("nan")] * size, 1), (n + 6, [None, 1.0], 1), (n + 7, [1.0, 0.0], 1), (n + 8, [2.0, 0.0], 1), (n + 9, [], 2), (n + 10, [float("inf")] * size, 0)]
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_embeddings_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(buckets.links, "__defaults__", (block, *buckets.links.__defaults__[1:]))
    rows = cosine_case()
    fine = [k for k, (_, v, label) in enumerate(rows) if v and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    for a in fine:
        for b in fine:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], dtype=float), np.array(rows[b][1], dtype=float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    links.append((a, b))
    assert len(links) > 100
    count = Counter(k for pair in links for k in pair)
    root = groups(len(rows), links)
    want = [(k, count[k], root[k], root[k] == k) for k in range(len(rows))]
    assert collected(embeddings.near_duplicates(vectors(spark, rows), miss=1e-7)) == collected(spark.createDataFrame(want, "a long, b long, c long, d boolean"))


def test_embeddings_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [1.0, 0.001], 0), (None, [1.0, 0.0], 0)]
    got = collected(embeddings.near_duplicates(vectors(spark, rows)))
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 0, None, False)]
    assert embeddings.near_duplicates(vectors(spark, [])).collect() == []


def test_embeddings_with_repeated_ids_and_labels_of_text(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.01], "a"), (2, [1.0, 0.02], "a"), (3, [1.0, 0.0], "b"), (1, None, "a"), (4, [1.0, 0.01], "a"), (1, [0.0, 1.0], "a"), (0, [0.01, 1.0], "a")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = collected(embeddings.near_duplicates(table))
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (4, 3, 1, False), (3, 0, 3, True), (1, 0, 1, True), (1, 1, 0, False), (0, 1, 0, True)], key=lambda r: tuple((v is None, str(v)) for v in r))
    close = spark.createDataFrame([(1, [1.0, 0.0], 1.2), (2, [1.0, 0.0], 1.7)], "vec_id long, embedding array<double>, label double")
    assert [r.n_links for r in embeddings.near_duplicates(close).collect()] == [0, 0]


def test_embedding_pairs_at_the_threshold_are_found_by_default(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(1500):
        v, w = rng.standard_normal((2, 24))
        v /= np.linalg.norm(v)
        w -= (w @ v) * v
        w /= np.linalg.norm(w)
        c = 0.98 + 1e-9
        rows += [(2 * k, v.tolist(), 0), (2 * k + 1, (c * v + np.sqrt(1 - c * c) * w).tolist(), 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    found = embeddings.near_duplicates(table).where("vec_id % 2 = 1 AND component_id < vec_id").count()
    assert found >= 0.999 * 1500


def test_more_rows_get_more_bits_and_tables():
    a, b = embeddings.plan(1000, 0.98, 1e-4), embeddings.plan(10**9, 0.98, 1e-4)
    assert a[0] < b[0] and a[1] < b[1]


def plain_fingerprint(text, size=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)) if shingles else 0


@pytest.mark.parametrize("block", [512, 5])
def test_simhash_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(buckets.links, "__defaults__", (block, *buckets.links.__defaults__[1:]))
    rng = random.Random(2)
    rows = [r for r in DOCS if r[0] not in (8, None)]
    rows += [(1, prose(77, 90)), (7, prose(78, 90)), (0, prose(78, 89) + " end"), (7, prose(1, 120))]  # ids that repeat with other texts
    for k in range(20, 140):
        words = prose(k % 9, 150).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "other" + str(rng.randrange(99))
        rows.append((k, " ".join(words)))
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 2]
    root = groups(len(rows), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], i), i)
    want = [(i, f"{prints[k]:016x}", least[root[k]]) for k, (i, _) in enumerate(rows)]
    assert collected(simhash.near_duplicates(documents(spark, rows))) == collected(spark.createDataFrame(want, "a long, b string, c long"))


@pytest.mark.parametrize("distance, cells", [(2, 2), (2, 5), (5, 3), (0, 2)])
def test_near_fingerprints_share_a_key(spark, distance, cells):
    rng = random.Random(distance)
    rows = []
    for k in range(400):
        a = b = rng.getrandbits(64)
        for bit in rng.sample(range(64), rng.randrange(distance + 1)):
            b ^= 1 << bit
        rows += [(2 * k, a - (1 << 64) * (a >> 63)), (2 * k + 1, b - (1 << 64) * (b >> 63))]
    table = simhash.pivot_table(spark.createDataFrame(rows, "id long, fp long"), distance, cells)
    x, y = (table.where(f"id % 2 = {r}").selectExpr("id div 2 AS pair", f"keys AS k{r}") for r in (0, 1))
    assert x.join(y, "pair").where(F.arrays_overlap("k0", "k1")).count() == 400


def test_simhash_odd_rows(spark):
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, [(1, None), (2, ""), (3, " \n"), (None, prose(6, 40)), (4, "one TWO"), (5, "One two")])).collect()}
    assert got[1].fingerprint == "0" * 16 and got[2].component_id == got[3].component_id == 1
    assert got[None].component_id is None and got[5].component_id == 4
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def test_similar_groups(spark):
    rng = random.Random(5)
    rows = []
    for k in range(90):
        words = prose(k // 3, 160).split()
        for _ in range((k % 3) * 2):
            words[rng.randrange(len(words))] = "other" + str(rng.randrange(99))
        rows.append((k, " ".join(words)))
    rows += [(200, ""), (201, None), (202, "word")]
    sets = [{" ".join(w[a : a + 5]) for a in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0]
    root = groups(len(rows), links)
    want = {rows[k][0]: rows[root[k]][0] for k in range(len(rows)) if root[k] != k}
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, rows), miss=1e-6).collect()}
    assert got == want
    kept = simhash.without_near_duplicates(documents(spark, rows + [(0, rows[0][1]), (None, "alone")]))
    assert kept.columns == documents(spark, []).columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i, _ in rows if i not in want) and ids.count(None) == 1


def test_repeated_ids_lose_no_text(spark):
    """Ids that repeat with different texts: each text has its own group, and what stays doesn't depend on the order of rows."""
    a, b = prose(11, 80), prose(12, 80)
    rows = [(1, a), (1, b), (2, " ".join(a.split()[:-2])), (3, " ".join(b.split()[:-2])), (9, prose(13, 50)), (9, prose(13, 50)), (4, a), (9, prose(13, 50) + " more")]
    for parts in (1, 3):
        docs = documents(spark, rows).repartition(parts)
        kept = sorted((r.doc_id, r.text) for r in simhash.without_near_duplicates(docs).select("doc_id", "text").collect())
        nines = [t for i, t in kept if i == 9]
        assert [x for x in kept if x[0] != 9] == sorted([(1, a), (1, b)]) and len(nines) == 1
        assert nines[0] == min((t for i, t in rows if i == 9), key=lambda t: hashlib.md5(t.encode()).hexdigest())


def at_threshold(seed):
    """Two texts with a similarity of exactly 0.8: 4 of 5 shingles, or 200 shared and 25 on either side."""
    words = [f"w{seed}x{k}" for k in range(229)]
    if seed % 2:
        return " ".join(words[:8]), " ".join(words[:9])
    return " ".join(words), " ".join([f"v{seed}x{k}" for k in range(25)] + words[25:])


def test_similar_groups_lose_no_pair_at_the_threshold(spark):
    pairs = [at_threshold(k) for k in range(600)]
    sets = lambda t: {" ".join(w[a : a + 5]) for w in [t.split()] for a in range(len(w) - 4)}
    assert all(len(sets(a) & sets(b)) == 0.8 * len(sets(a) | sets(b)) for a, b in pairs)
    rows = [(2 * k + side, text) for k, pair in enumerate(pairs) for side, text in enumerate(pair)]
    rows += [(5000 + k, f"a {k} b c d") for k in range(20)]  # of one shingle each, all different
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(spark, rows)).collect()}
    assert got == {2 * k + 1: 2 * k for k in range(600)}


def plain_removal(rows, window):
    counts = Counter(b[a : a + window] for _, b in rows for a in range(len(b) - window + 1))
    out = []
    for i, b in rows:
        gone = np.zeros(len(b) + 1, dtype=np.int8)
        for a in range(len(b) - window + 1):
            if counts[b[a : a + window]] > 1:
                gone[a : a + window] = 1
        gone[-1] = 0
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def removal_rows():
    rows = [r for r in DOCS if r[0] != 8]
    rows += [(50, "é" * 150), (51, "x" + "é" * 160), (52, "ab" * 400), (53, prose(11, 30) + SHORT + prose(12, 30)), (54, prose(13, 30) + SHORT + prose(14, 30)), (55, SHORT)]
    return rows


SHORT = prose(21, 40)[:199] + "é"


def test_suffix_arrays_against_all_windows(spark):
    rows = removal_rows()
    want = plain_removal([(i, (t or "").encode()) for i, t in rows], 200)
    got = collected(suffix.remove_repeats(documents(spark, rows).repartition(5)))
    assert got == collected(spark.createDataFrame(want, "a long, b long, c long, d long, e string"))
    assert suffix.remove_repeats(documents(spark, [])).collect() == []


def test_suffix_arrays_with_small_units(spark, monkeypatch):
    monkeypatch.setattr(suffix, "UNIT", 2)
    monkeypatch.setattr(suffix, "CHUNK", 500)
    text = prose(31, 80)
    rows = [(k, prose(40 + k, 20 + k) + " " + text[(k % 5) * 7 :] + prose(70 + k, 25)) for k in range(30)]
    want = plain_removal([(i, t.encode()) for i, t in rows], 200)
    assert collected(suffix.remove_repeats(documents(spark, rows).repartition(3))) == collected(spark.createDataFrame(want, "a long, b long, c long, d long, e string"))


def test_kept_text(spark):
    rows = [(1, prose(1, 100)), (2, prose(1, 100)), (3, prose(2, 100)), (4, None)]
    got = {r.doc_id: r for r in suffix.remove_repeats(documents(spark, rows), with_text=True, carry=("lang",)).collect()}
    assert got[1].kept_text == "" and got[3].kept_text == rows[2][1] and got[4].kept_text == "" and got[4].lang == "en"


def test_deep_shallow_sorts(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(suffix, "SHALLOW", 8)
    for n in (0, 1, 2, 50, 300):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(n)]
        assert [strings[k] for k in suffix.deep_shallow(strings)] == sorted(strings)
