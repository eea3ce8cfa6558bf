"""Alignment of two tokenizers' tokens, and how often their tokens end together in a corpus.

``A`` is a byte-level BPE (a file of the tokenizers library, whose special tokens are plain text here), ``B`` one with pieces and byte fallback (a file of sentencepiece),
which puts a space before a text; so ``A`` gets a space and the text. Places where tokens of both end cut
a text into groups, and the last tokens of a group are linked.

A group of one token each covers the same bytes on both sides. So an array from each ``A`` id to the ``B`` id of the same bytes, made once,
says what its link is, and such links are counted in a vector as long as ``A``'s vocabulary. Only the links of other groups are counted
as pairs, summed in a task before they are shuffled. Of a linked pair one token's bytes end the other's, so how
many pairs there can be follows from the two vocabularies (``Tokens.most_pairs``) and not from the corpus: all counts are held in
arrays of at most that length and sent to the tasks.

Neither tokenizer has a token that goes on from a visible sign to white space, so both cut before white space that follows a visible sign,
and groups never go across. Words (such runs) are therefore aligned once and remembered; a document is a list of words. A vocabulary without that property is found out and texts are taken whole.

Defined cases: texts that are null, empty, or not the same bytes again when a tokenizer's tokens are joined have no tokens (zeros, and ``''`` for
the digest); equal rows count each time; a null id is carried along; texts of any length are aligned whole; an empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, storage

#: Words that a Python worker remembers, and links in them; beyond either the half of the words seen most often stay, or none if that isn't enough.
REMEMBERED, LINKS = 400_000, 4_000_000
#: Before white space that both tokenizers take for it, behind a sign that neither does.
EDGE = re.compile(r"(?<=\S)(?=[ \t\n])")
MARK = "▁"


def byte_level(spec: dict) -> dict[bytes, int]:
    """Ids by bytes, of a byte-level BPE without its special tokens."""
    back = {c: b for b, c in enumerate(bpe.byte_characters())}
    model, special = spec["model"], {t["content"] for t in spec["added_tokens"]}
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if ids != sorted(ids):
        raise ValueError("ids must be in the order of merges")
    return {bytes(back[c] for c in text): i for text, i in model["vocab"].items() if text not in special}


class Tokens:
    """Both vocabularies: bytes of each id, and the identity map."""

    def __init__(self, path_a: str | None = None, path_b: str | None = None):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(path_a or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            vocabulary = byte_level(json.load(f))
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b or public_tokenizers.path("piece_bpe_32k.model"))
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for raw, i in vocabulary.items():
            self.bytes_a[i] = raw
        # with ids in the order of merges they are ranks, which the faster library takes
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        plain = [not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)) for i in range(len(pieces))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        by_bytes = {}
        for i, raw in enumerate(self.bytes_b):
            if plain[i] or self.b.is_byte(i):
                by_bytes[raw] = i if plain[i] else by_bytes.get(raw, i)  # pieces come after bytes
        #: ``identity[a]``: the id of ``B`` with the same bytes, -1 if there is none.
        self.identity = np.array([by_bytes.get(raw, -1) for raw in self.bytes_a], dtype=np.int64)
        #: Whether no token goes across an edge, and none begins with a space and other white space that a word may begin with.
        every = [raw.decode(errors="replace") for raw in self.bytes_a] + [p.replace(MARK, " ") for i, p in enumerate(pieces) if plain[i]]
        self.cuts = not any(EDGE.search(x) or x[:2] in (" \t", " \n") for x in every)
        self.width = len(pieces)
        #: Ids as text, and a token with its identical one as a group.
        self.text_a, self.text_b = ([*map(str, range(len(side)))] for side in (self.bytes_a, self.bytes_b))
        self.single = [f"{a}|{b}" for a, b in enumerate(self.identity.tolist())]

    def most_pairs(self) -> int:
        """How many pairs of ids there are of which one's bytes end the other's."""
        a, b = Counter(self.bytes_a), Counter(self.bytes_b)
        ends = lambda side, other: sum(other[raw[k:]] for raw in side for k in range(len(raw)))
        return ends(self.bytes_a, b) + ends(self.bytes_b, a)

    def split(self, text: str) -> list[str]:
        """A space and the text, cut where both tokenizers cut."""
        return EDGE.split(" " + text) if self.cuts else [" " + text]

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of words on both sides. What ``B`` puts before a word is a space that the word has already, or else a token of its own."""
        a = [*map(self.a.encode_ordinary, words)]
        spaced = [w[0] == " " for w in words]
        b = self.b.encode([w[1:] if s else w for w, s in zip(words, spaced)], num_threads=1)
        # before nothing it puts no space
        return a, [[self.b.piece_to_id(MARK)] if w == " " else ids if s else ids[1:] for w, ids, s in zip(words, b, spaced)]


@functools.lru_cache(maxsize=2)
def tokens(path_a: str | None, path_b: str | None) -> Tokens:
    """One for each Python worker and pair of files."""
    return Tokens(path_a, path_b)


class Words:
    """Words aligned so far: of each, how many tokens on either side, its groups as text, and its links as ``a * width + b``."""

    def __init__(self, both: Tokens):
        self.both = both
        self.clear()

    def forget(self) -> None:
        """Half as many words as may be remembered stay, those seen most often."""
        words = [*self.number]
        kept = np.sort(np.argsort(-self.seen, kind="stable")[: REMEMBERED // 2])
        sizes = np.diff(self.cuts)[kept]
        if sizes.sum() > LINKS // 2:
            return self.clear()
        places = bpe.spread(self.cuts[kept], sizes)
        self.number = {words[i]: n for n, i in enumerate(kept.tolist())}
        self.groups = [self.groups[i] for i in kept.tolist()]
        self.n_a, self.n_b, self.seen = self.n_a[kept], self.n_b[kept], self.seen[kept] // 2
        self.cuts, self.links, self.regular = np.concatenate([[0], np.cumsum(sizes)]), self.links[places], self.regular[places]

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.n_a = self.n_b = self.seen = np.zeros(0, dtype=np.int64)
        self.cuts, self.links = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.regular = np.zeros(0, dtype=bool)

    def add(self, words: list[str]) -> None:
        both = self.both
        a, b = both.encode(words)
        raws = [w.encode() for w in words]
        for ids, side in ((a, both.bytes_a), (b, both.bytes_b)):
            own = [b"".join(map(side.__getitem__, x)) for x in ids]
            if own != raws:
                for i, (x, raw) in enumerate(zip(own, raws)):
                    if x != raw:
                        a[i] = b[i] = []  # no word has no tokens otherwise
        count = lambda side: np.array([len(x) for x in side], dtype=np.int64)
        n_a, n_b = count(a), count(b)
        flat_a, flat_b = (np.fromiter((i for x in side for i in x), dtype=np.int64) for side in (a, b))
        ends_a, ends_b = np.cumsum(both.size_a[flat_a]), np.cumsum(both.size_b[flat_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last_a, last_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        link_a, link_b = flat_a[last_a], flat_b[last_b]
        single = (np.diff(last_a, prepend=-1) == 1) & (np.diff(last_b, prepend=-1) == 1)
        cuts = np.searchsorted(last_a, np.cumsum(n_a))  # groups up to each word's end
        regular = single & (both.identity[link_a] == link_b)
        rows = [*map(both.single.__getitem__, link_a.tolist())]
        ids_a, ids_b = ([*map(t.__getitem__, x.tolist())] for t, x in ((both.text_a, flat_a), (both.text_b, flat_b)))
        first_a, first_b = np.append(0, last_a[:-1] + 1), np.append(0, last_b[:-1] + 1)
        other = np.flatnonzero(~regular)
        for g, i, j, k, m in zip(other.tolist(), first_a[other].tolist(), (last_a[other] + 1).tolist(), first_b[other].tolist(), (last_b[other] + 1).tolist()):
            rows[g] = f"{ids_a[i] if j - i == 1 else ','.join(ids_a[i:j])}|{ids_b[k] if m - k == 1 else ','.join(ids_b[k:m])}"
        begin = len(self.number)
        self.number.update(zip(words, range(begin, begin + len(words))))
        self.groups += [";".join(rows[i:j]).encode() for i, j in zip([0, *cuts.tolist()], cuts.tolist())]
        self.n_a, self.n_b = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), dtype=np.int64)])
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + cuts])
        self.links = np.concatenate([self.links, link_a * both.width + link_b])
        self.regular = np.concatenate([self.regular, regular])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


DOC, VECTOR, PAIRS = range(3)
COLUMNS = "n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>, counts array<long>"


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64), pa.int64()))


def _aligned(batches: Iterator[pa.RecordBatch], path_a: str | None, path_b: str | None) -> Iterator[pa.RecordBatch]:
    """A row for each document with its distinct links and how often it has each; behind them, for the task, the vector of regular links' counts
    (ids of ``A`` that have any) and the counts of the other pairs."""
    both = tokens(path_a, path_b)
    known = Words(both)
    vector = np.zeros(len(both.bytes_a), dtype=np.int64)
    keys = counts = np.zeros(0, dtype=np.int64)
    kind = None

    def batch_of(what, ids, n_a, n_b, n_groups, digests, links, times):
        arrays = [pa.array([what] * len(n_a), pa.int32()), ids, *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)), pa.array(digests, pa.string()), _lists(links), _lists(times)]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "counts"])

    for batch in batches:
        kind = batch.column(0).type
        for at, texts in bpe.in_blocks(batch):
            split = [both.split(t) if t else [] for t in texts]
            coded = pa.array([w for words in split for w in words], pa.string()).dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if new := [w for w in distinct if w not in known.number]:
                known.add(new)
            numbers = np.array([*map(known.number.__getitem__, distinct)], dtype=np.int64)[coded.indices.to_numpy()]
            n_a, n_b, n_groups, digests, links, times = [], [], [], [], [], []
            seen = np.zeros(len(known.number), dtype=np.int64)
            for end, words in zip(np.cumsum([len(words) for words in split]).tolist(), split):
                own = numbers[end - len(words) : end]
                each = known.n_a[own]
                if not len(own) or not each.all():  # a word that isn't the same bytes again: no tokens at all
                    own = own[:0]
                a, b = int(known.n_a[own].sum()), int(known.n_b[own].sum())
                seen += np.bincount(own, minlength=len(seen))
                sizes = known.cuts[own + 1] - known.cuts[own]
                mine = np.sort(known.links[bpe.spread(known.cuts[own], sizes)])
                first = np.flatnonzero(np.diff(mine, prepend=-1))
                n_a.append(a)
                n_b.append(b)
                n_groups.append(len(mine))
                digests.append(hashlib.sha256(b";".join(map(known.groups.__getitem__, own.tolist()))).hexdigest() if len(own) else "")
                links.append(mine[first])
                times.append(np.diff(first, append=len(mine)))
            known.seen += seen
            weights = np.repeat(seen, np.diff(known.cuts))
            some = known.regular & (weights > 0)
            np.add.at(vector, known.links[some] // both.width, weights[some])
            other = ~known.regular & (weights > 0)
            keys, counts = _summed(np.concatenate([keys, known.links[other]]), np.concatenate([counts, weights[other]]))
            yield batch_of(DOC, batch.column(0).slice(at, len(texts)), n_a, n_b, n_groups, digests, links, times)
            if len(known.number) > REMEMBERED or len(known.links) > LINKS:
                known.forget()
    if kind is not None:
        some = np.flatnonzero(vector)
        yield batch_of(VECTOR, pa.nulls(1, kind), [0], [0], [0], [""], [some], [vector[some]])
        yield batch_of(PAIRS, pa.nulls(1, kind), [0], [0], [0], [""], [keys], [counts])


def _counted(aligned: DataFrame, what: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids or pairs with their counts over all tasks, by rising key; as many as the vocabularies allow at most."""
    each = aligned.where(F.col("kind") == what).select(F.explode(F.arrays_zip("links", "counts")).alias("x")).select("x.links", "x.counts")
    table = each.groupBy("links").agg(F.sum("counts").alias("n")).toArrow()
    keys, counts = (table.column(c).to_numpy().astype(np.int64) for c in ("links", "n"))
    order = np.argsort(keys)
    return keys[order], counts[order]


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, with_links: bool = False) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row: tokens on both sides, groups, links, links whose
    pair is as frequent in the corpus as any with its ``B`` id, and the sum of the links' corpus-wide counts; with the distinct links (``a * |B| + b``) and their ``times`` if asked for.
    Texts are encoded once; what they have is stored, and looked up in the counts afterwards."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(id_col, text_col).mapInArrow(lambda batches: _aligned(batches, path_a, path_b), f"kind int, id {kind}, {COLUMNS}")
    aligned = storage.keep(rows, "aligned")
    both = tokens(path_a, path_b)
    ids, n = _counted(aligned, VECTOR)
    pairs, m = _counted(aligned, PAIRS)
    if len(ids) + len(pairs) > both.most_pairs():
        raise ValueError("linked pairs whose bytes don't end each other")
    keys, totals = _summed(np.concatenate([ids * both.width + both.identity[ids], pairs]), np.concatenate([n, m]))
    best = np.zeros(both.width, dtype=np.int64)
    np.maximum.at(best, keys % both.width, totals)
    is_best = totals == best[keys % both.width]
    sent = docs.sparkSession.sparkContext.broadcast((keys, totals, is_best))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, totals, is_best = sent.value
        for batch in batches:
            links, times = batch.column("links"), batch.column("counts")
            place = np.searchsorted(keys, links.flatten().to_numpy())
            times_flat, sizes = times.flatten().to_numpy(), links.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            sums = []
            for values in (times_flat * is_best[place], times_flat * totals[place]):
                upto = np.concatenate([[0], np.cumsum(values)])
                sums.append(pa.array(upto[ends] - upto[ends - sizes], pa.int64()))
            column = {c: batch.column(c) for c in batch.schema.names}
            yield pa.RecordBatch.from_pydict({"id": column["id"], "n_a": column["n_a"], "n_b": column["n_b"], "n_groups": column["n_groups"], "n_links": column["n_groups"], "n_best": sums[0], "count_sum": sums[1], "groups_sha256": column["groups_sha256"]} | ({"links": links, "times": times} if with_links else {}))

    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", links array<long>, times array<long>" * with_links
    return aligned.where(F.col("kind") == DOC).drop("kind").mapInArrow(look_up, schema).withColumnRenamed("id", id_col)
