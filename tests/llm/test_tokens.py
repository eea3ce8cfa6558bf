import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import bpe, packing, storage, tokenbin

from .cases import DOCS, documents


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


ODD = ["", "ΑΣ ΟΔΟΣ İstanbul ß ǅ", "a\x1cb \x85 c d", "<|endoftext|> hi <|EndOfText|><|startoftext|>x", "it's we'll 'S don't  123 ½²", "é ﬁ é", "x" * 700 + "y", "ab" * 200, "héllo😀 👍🏽", "'''s", "a_b __ c", " ", "\n", "'s't 're'llo .'s ''ve x'd'", "1'2 'r 'rex '", "日本 語 " * 30, "a\u2028b\u3000c\x1d d"]


@pytest.mark.parametrize("text", ODD)
def test_encode_and_decode_as_the_library(library, text):
    ours = bpe.tokenizer(None)
    ids = ours.encode(text).tolist()
    assert ids == ids_of(library, text)
    assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_short_and_long_merges_agree():
    ours = bpe.tokenizer(None)
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40, 90):
        word = bytes(rng.choice(list(b"aeinrst"), n).tolist())
        symbols = [*ours.inner[list(word[:-1])].tolist(), int(ours.final[word[-1]])]
        raw = np.frombuffer(word, dtype=np.uint8)
        short, counts = ours.merge_short(raw, np.array([0]), np.array([n]))
        assert short.tolist() == ours.merge_long(symbols)
        assert counts.tolist() == [len(short)]


def test_cache_starts_afresh(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    ours = bpe.WordBPE(bpe.default_path())
    texts = [t for _, t in DOCS if t and len(t) < 5000]
    for text, packed in zip(texts, ours.packed(texts)):
        assert np.frombuffer(packed, dtype="<u2").tolist() == ids_of(library, text)


def test_long_texts_are_cut_at_white_space_alone(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 64)
    ours = bpe.WordBPE(bpe.default_path())
    texts = [t for _, t in DOCS if t and len(t) < 5000] + ODD + ["x" * 1000 + " it's é " + "日" * 600]
    for text, packed in zip(texts, ours.packed(texts)):
        assert np.frombuffer(packed, dtype="<u2").tolist() == ids_of(library, text)


def test_words_whose_hashes_are_equal(library):
    ours = bpe.WordBPE(bpe.default_path())
    ours.packed(["one two"])
    ours.words.bytes[:3] = list(b"own")  # as if another word had the hash of "one"
    assert ours.encode("one two").tolist() == ids_of(library, "one two")


def test_round_trip(spark, library):
    rows = bpe.round_trip(documents(spark)).collect()
    want = sorted((i is None, i or 0, len(ids := ids_of(library, t)), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for i, t in DOCS)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want


def test_encode_then_decode(spark, library):
    texts = {r.doc_id: r.text for r in bpe.decode(bpe.encode(documents(spark, DOCS[:10]))).collect()}
    assert texts == {i: library.decode(ids_of(library, t), skip_special_tokens=False) for i, t in DOCS[:10]}


def whole(library, rows, pieces, width):
    """Checks that pieces hold each id once and windows are gapless; returns windows' fills."""
    expected = defaultdict(list)
    for i, t in rows:
        expected[i].append([*ids_of(library, t), packing.END_ID])
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == set(expected)
    for key, own in by_doc.items():
        total = expected[key]
        assert sum(p.length for p in own) == sum(map(len, total))
        full = total[0]
        assert all(p.doc_tokens == len(full) for p in own)
        for p in own:
            assert zlib.crc32(np.array(full[p.start : p.start + p.length], dtype="<u4").tobytes()) == p.ids_crc32
        covered = sorted((p.start, p.length) for p in own)
        assert covered[0][0] == 0
    fills = []
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= width
        fills.append(at)
    return fills


@pytest.mark.parametrize("partitions", [1, 3])
def test_packing(spark, library, partitions):
    pieces = packing.pack(documents(spark).repartition(partitions)).collect()
    fills = whole(library, DOCS, pieces, packing.CAPACITY)
    assert all(f & (f - 1) == 0 for f in fills)  # nothing is padded


@pytest.mark.parametrize("lengths", ["any", "three quarters", "tiny", "one length"])
def test_open_windows_stay_few(lengths):
    """Whatever the lengths: levels that nothing else fills are filled by cut pieces."""
    got = []
    size = 64
    packer = packing.SumOfSquares(size, lambda tag, start, ids, window, offset: got.append((tag, start, len(ids), window, offset)))
    rng = np.random.default_rng(0)
    sizes = {"any": rng.integers(1, 200, 5000), "three quarters": rng.integers(44, 56, 5000), "tiny": rng.integers(1, 3, 5000), "one length": np.full(5000, 37)}[lengths]
    for k, n in enumerate(sizes):
        packer.add(k, np.arange(n))
        assert packer.level.max() <= 8 * packing.CUT and packer.n_open == packer.level.sum()
    placed, cut = packer.placed, packer.cut
    packer.settle()
    fill, parts = defaultdict(int), defaultdict(list)
    for tag, start, n, window, offset in got:
        assert offset == fill[window]
        fill[window] += n
        parts[tag].append((start, n))
    assert all(f <= size and f & (f - 1) == 0 for f in fill.values()) and placed + cut + packer.settled <= len(fill)
    for k, n in enumerate(sizes):
        at = 0
        for start, length in sorted(parts[k]):
            assert start == at
            at += length
        assert at == n


def test_sum_of_squares_picks_the_least_growth():
    size = 12
    packer = packing.SumOfSquares(size, lambda *a: None, price=1e9)  # no cuts
    rng = np.random.default_rng(6)
    for n in rng.integers(1, size, 400).tolist():
        before = packer.level.copy()
        after = []
        for h in [0, *np.flatnonzero(before[:size])]:
            if h + n <= size:
                level = before.copy()
                level[h] -= h > 0
                level[h + n] += h + n < size
                after.append(int((level[:size] ** 2).sum()))
        packer.add(n, np.arange(n))
        assert int((packer.level[:size] ** 2).sum()) == min(after)


def test_token_matrices(spark, library, tmp_path, monkeypatch):
    manifest = tokenbin.write(documents(spark).repartition(2), str(tmp_path / "tokens"))
    rows = tokenbin.read(manifest, with_ids=True).collect()
    whole(library, DOCS, rows, tokenbin.WIDTH)
    texts = defaultdict(list)
    for i, t in DOCS:
        texts[i] = [*ids_of(library, t), 1]
    for r in rows:
        assert list(r.ids) == texts[r.doc_id][r.start : r.start + r.length]


def test_best_fit_decreasing():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 400)
    rows, n = tokenbin.best_fit_decreasing(lengths, 100)
    fill = np.bincount(rows, weights=lengths, minlength=n)
    assert fill.max() <= 100
    room, placed = [], np.zeros(400, dtype=int)  # plain best fit
    for k in np.argsort(-lengths, kind="stable"):
        fitting = [(r, i) for i, r in enumerate(room) if r >= lengths[k]]
        if fitting:
            r, i = min(fitting)
            room[i] -= lengths[k]
        else:
            room.append(100 - lengths[k])
    assert n == len(room)


@pytest.mark.parametrize("run", [bpe.round_trip, packing.pack, bpe.encode, lambda d: tokenbin.read(tokenbin.write(d, storage.fresh_dir(d.sparkSession, "none")))])
def test_empty_tables(spark, run):
    assert run(documents(spark, [])).collect() == []
