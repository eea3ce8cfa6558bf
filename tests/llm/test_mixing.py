"""Mixes of sources against plain sums, permutations and texts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import mixing
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """By resharing what is above, over and over."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        height = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / height
        left = 0.0
        for s in [*open_]:
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def rows_of(n, seed=1):
    rng = random.Random(seed)
    sources = ["a"] * 30 + ["b", "b", "é", "Z", "z", "", None, "😀", "￿"]
    return [(i, rng.choice([None, "", " \n"]) if rng.random() < 0.05 else " ".join(f"w{i}x{k}" for k in range(rng.choice([1, 3, 40, 200]))), rng.choice(sources)) for i in range(n)]


def table(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "k", 1, 2.0, 3) for r in rows], "doc_id long, text string, source string, name string, place int, target double, at long").repartition(parts)


def checked(rows, got):
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    by_source = defaultdict(int)
    for (_, _, s), n in zip(rows, sizes):
        by_source[s] += n
    want = plain_targets(by_source)
    source = {i: s for i, _, s in rows}
    assert sorted((r.doc_id, r.size) for r in got) == sorted((r[0], n) for r, n in zip(rows, sizes))
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == by_source[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, n in want.items():
        assert abs(taken[s] - n) <= 0.5001, (s, taken[s], n)


@pytest.mark.parametrize("block, shard", [(7, 16), (mixing.BLOCK, mixing.SHARD)])
def test_targets_are_met(spark, block, shard):
    rows = rows_of(400)
    checked(rows, mixing.Mix(table(spark, rows), block=block, shard=shard, with_text=False).taken().collect())


def test_real_documents_and_reruns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    first = mixing.Mix(docs, with_text=False).taken().collect()
    checked(rows, first)
    again = mixing.Mix(docs.repartition(7), with_text=False).taken().collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_blocks_hold_the_words(spark, tmp_path):
    """Texts of the blocks add up to what is taken, in the documents' own order; sources mix within a shard."""
    rows = rows_of(120, 2)
    mix = mixing.Mix(table(spark, rows), block=16, shard=32)
    mix.write(str(tmp_path / "mix"))
    blocks = spark.read.parquet(str(tmp_path / "mix")).collect()
    seen = Counter(w for b in blocks for w in b.text.split(" "))
    assert all(b.n_words == len(b.text.split(" ")) <= 16 for b in blocks)
    taken = {r.doc_id: r.taken for r in mix.taken().collect()}
    assert Counter({i: n for i, n in taken.items() if n}) == Counter(int(w[1:].split("x")[0]) for w in seen.elements())
    assert max(seen.values()) <= 2
    own = {i: (t or "").split() for i, t, _ in rows}
    for b in blocks:
        for w, v in zip(b.text.split(" "), b.text.split(" ")[1:]):
            i, k = map(int, w[1:].split("x"))
            assert v.split("x")[0] != f"w{i}" or own[i].index(v) == k + 1
    shards = defaultdict(list)
    for b in blocks:
        shards[b.shard].append(b)
    assert all(sorted(b.slot for b in bs) == list(range(len(bs))) for bs in shards.values())
    assert {len(bs) for s, bs in shards.items() if s != max(shards)} == {32}
    assert len({b.source for b in shards[0]}) > 1


def test_draws_are_multinomial(spark):
    """Shares of a shard's slots are the targets', with the variance of draws."""
    rows = [(i, "w " * 500, "ab"[i % 2]) for i in range(200)]
    mix = mixing.Mix(table(spark, rows), block=10, shard=100, with_text=False)
    counts = np.array([r.n for r in mix.slots.where("place = 1").groupBy("shard").count().withColumnRenamed("count", "n").collect()])
    p = 100_000 / 150_000  # the first stops at twice its size
    assert abs(counts.mean() - 100 * p) < 1.5 and 0.5 < counts.var() / (100 * p * (1 - p)) < 1.6


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        for key in range(3):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))) == list(range(n))
    assert list(mixing.permuted(np.arange(100), np.full(100, 100), np.full(100, 1))) != list(mixing.permuted(np.arange(100), np.full(100, 100), np.full(100, 2)))


def test_odd_rows(spark):
    docs = cases.documents(spark)
    got = mixing.Mix(docs, with_text=False).taken().collect()
    assert len(got) == len(cases.DOCS) and abs(sum(r.taken for r in got) - got[0].target) <= 0.5
    assert mixing.Mix(docs.where("false"), with_text=False).taken().collect() == []
    none = mixing.Mix(table(spark, [(1, None, "a"), (2, "", None)]), with_text=False).taken().collect()
    assert sorted(tuple(r)[1:] for r in none) == [(0, 0, 0.0, 0)] * 2


def test_many_sources(spark):
    """More sources than a draw is over at once."""
    rows = [(i, "w " * (i % 9 + 1), f"s{i:05}") for i in range(2500)]
    checked(rows, mixing.Mix(table(spark, rows), block=4, shard=256, with_text=False).taken().collect())
