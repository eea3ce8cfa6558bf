"""Token alignment against a plain walk over whole texts, encoded whole."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import alignment, bpe
from tests.llm import cases


@pytest.fixture(scope="module")
def both():
    return alignment.tokens(None, None)


def plain(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    back = {c: i for i, c in enumerate(bpe.byte_characters())}
    found, links = [], Counter()
    for doc, text in rows:
        encoded = a.encode(" " + (text or ""), add_special_tokens=False)
        of_a = [(i, bytes(back[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens)]
        of_b = [(i, bytes([i - 3]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text or "")]
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(x for _, x in side) != whole for side in (of_a, of_b)):
            found.append((doc, 0, 0, [], ""))
            continue
        ends = []
        for side in (of_a, of_b):
            at, places = 0, {}
            for k, (_, raw) in enumerate(side):
                at += len(raw)
                places[at] = k
            ends.append(places)
        pairs, groups, i, j = [], [], 0, 0
        for place in sorted(ends[0].keys() & ends[1].keys()):
            k, m = ends[0][place] + 1, ends[1][place] + 1
            groups.append(",".join(str(x) for x, _ in of_a[i:k]) + "|" + ",".join(str(x) for x, _ in of_b[j:m]))
            pairs.append((of_a[k - 1][0], of_b[m - 1][0]))
            i, j = k, m
        links.update(pairs)
        found.append((doc, len(of_a), len(of_b), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    return sorted(((d, x, y, len(p), len(p), sum(links[q] == best[q[1]] for q in p), sum(links[q] for q in p), sha) for d, x, y, p, sha in found), key=str)


ODD = [" ", "  ", "a ", " a", "a  b", "a\n b", "a\n\n  b", "\n", "\t x", "x\r\ny;\r\n z", "a\x1c b\x85c d  e", "▁ mark", "<s> </s> <unk> <0x41>", "<|endoftext|> x", "ﬁ é é", "\x00 \x00a", "🙂🙂 ☃ 漢字", "﻿hi", "don't we'll 12345 ½ _x_", "A A a A"]


def test_against_whole_texts(spark):
    rows = cases.DOCS + [(100 + i, t) for i, t in enumerate(ODD)] + [(200, "z" * 100_000), (201, "Ab1 " * 9 + "▁")]
    got = sorted((tuple(r) for r in alignment.align(cases.documents(spark, rows).repartition(4)).collect()), key=str)
    assert got == plain(rows)


def test_words_begin_anew(spark, small, monkeypatch):
    """Real documents, and no words remembered beyond a block."""
    monkeypatch.setattr(alignment, "REMEMBERED", 10)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = sorted((tuple(r) for r in alignment.align(docs).collect()), key=str)
    assert got == plain([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_identity(both):
    """Ids of the same bytes; a piece goes before a byte. Without the property that words rest on, texts are taken whole."""
    assert both.cuts and both.split("a b\n c") == [" a", " b", "\n c"]
    assert all(both.bytes_b[b] == both.bytes_a[a] for a, b in enumerate(both.identity) if b >= 0)
    assert both.identity[both.a.encode_ordinary("A")[0]] == both.b.piece_to_id("A")
    whole = alignment.Tokens()
    whole.cuts = False
    assert whole.split("a b") == [" a b"]


def test_links_and_empty(spark):
    rows = alignment.align(cases.documents(spark, [(1, "hello hello"), (2, None)]), with_links=True).collect()
    assert {r.doc_id: sum(r.times) for r in rows} == {1: rows[0].n_links if rows[0].doc_id == 1 else rows[1].n_links, 2: 0}
    assert alignment.align(cases.documents(spark, []).limit(0)).collect() == []
