"""BPE encoding and decoding with a contiguous rank array.

A word is held as its parts and, beside them in one array, the rank of each neighbouring pair. The
smallest rank is found by scanning the array, one boundary is deleted, and the ranks on either side
are looked up again. Words of like length stand side by side, a word to a column, so that one step
of numpy does that step for thousands of words. Scanning is quadratic in a word's length, so words
of over ``SHORT`` bytes (rare, but a text without spaces may be one word) take a heap with linked
neighbours instead; both merge in the same order (lowest rank, then leftmost). Texts are cut into words
by array operations too, and words met before are found by a hash of their bytes.

The vocabulary file names everything else: NFC, runs of white space to one space, lower case, a
pattern that cuts words, bytes as printable characters, and a mark at the end of each word.

Defined cases: a null text is encoded as an empty one (no ids, decoded to ``""``); texts of any
length are encoded whole; equal rows give equal results; other columns are left alone.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import hashing

SHORT = 96
#: Words whose ids a Python worker remembers; the half seen most often stays when there are more.
REMEMBERED = 400_000
#: Bytes that are cut into words at once.
PIECE = 1 << 20
#: Ids that are turned into one column of strings at once (if they aren't one text's).
AT_ONCE = 20_000_000
NONE = 1 << 62
SPACE, LETTER, NUMBER, OTHER = range(4)

#: Letters after an apostrophe that belong to it.
SINGLE = [ord(c) for c in "stmd"]
DOUBLE = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
GAP = regex.compile(r"\p{White_Space}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next free one from 256."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Table:
    """Whole numbers to whole numbers, for whole arrays of them: open addressing with linear probes. Keys are at least 0."""

    def __init__(self, most: int):
        self.bits = max(8, int(most).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int64)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        at, left = self.place(keys), np.arange(len(keys))
        while len(left):
            slot = at[left]
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]  # of several for one slot the last stays
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Words:
    """Words met before, by a hash of their bytes, with bytes and ids; the bytes are compared, so equal hashes do no harm."""

    def __init__(self):
        self.table = Table(REMEMBERED)
        self.bytes, self.ids = np.zeros(1 << 20, dtype=np.uint8), np.zeros(1 << 20, dtype="<u2")
        self.hashes, self.seen = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.byte_cuts, self.id_cuts = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    @staticmethod
    def _grown(store: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
        if used + len(more) > len(store):
            store = np.concatenate([store[:used], np.zeros(used + 2 * len(more), dtype=store.dtype)])
        store[used : used + len(more)] = more
        return store

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words with these hashes, ``NONE`` where there is none."""
        return self.table(hashes)

    def add(self, hashes: np.ndarray, raw: np.ndarray, lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> bool:
        """Whether words that were there have new numbers now, or none."""
        if full := len(self.hashes) + len(hashes) > REMEMBERED:
            self._forget()
        if len(hashes) > REMEMBERED // 2:  # then these are as many as may be held
            some = REMEMBERED // 2
            hashes, lengths, counts = hashes[:some], lengths[:some], counts[:some]
            raw, ids = raw[: int(lengths.sum())], ids[: int(counts.sum())]
        n = len(self.hashes)
        self.table.add(hashes, np.arange(n, n + len(hashes)))
        self.bytes = self._grown(self.bytes, int(self.byte_cuts[-1]), raw)
        self.ids = self._grown(self.ids, int(self.id_cuts[-1]), ids)
        self.hashes, self.seen = np.concatenate([self.hashes, hashes]), np.concatenate([self.seen, np.zeros(len(hashes), dtype=np.int64)])
        self.byte_cuts = np.concatenate([self.byte_cuts, self.byte_cuts[-1] + np.cumsum(lengths)])
        self.id_cuts = np.concatenate([self.id_cuts, self.id_cuts[-1] + np.cumsum(counts)])
        return full

    def _forget(self) -> None:
        """Keeps the words seen most often, half as many as may be held."""
        kept = np.sort(np.argsort(-self.seen, kind="stable")[: REMEMBERED // 2])
        lengths, counts = np.diff(self.byte_cuts)[kept], np.diff(self.id_cuts)[kept]
        self.bytes, self.ids = self.bytes[spread(self.byte_cuts[kept], lengths)], self.ids[spread(self.id_cuts[kept], counts)]
        self.hashes, self.seen = self.hashes[kept], self.seen[kept] // 2
        self.byte_cuts, self.id_cuts = (np.concatenate([[0], np.cumsum(x)]) for x in (lengths, counts))
        self.table = Table(REMEMBERED)
        self.table.add(self.hashes, np.arange(len(kept)))


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Of every code point: white space, letter, number or other sign."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, every):
            out[found.start() : found.end()] = kind
    return out


class WordBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"] or ""
        if len(vocab) + len(spec["added_tokens"]) > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        self.inner = np.array([vocab[c] for c in byte_characters()], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in byte_characters()], dtype=np.int64)
        #: (left id, right id) -> rank and merged id in one number, so that the smallest is the first to merge.
        self.pairs = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[left] << 16 | vocab[right], rank << 16 | vocab[left + right])
        self.table = Table(2 * len(self.pairs))
        self.table.add(np.array([*self.pairs], dtype=np.int64), np.array([*self.pairs.values()], dtype=np.int64))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]
        self.as_strings = pa.array(self.strings, pa.string())
        self.as_decimals = pa.array(map(str, range(len(self.strings))), pa.string())
        self.words = Words()

    def merge_short(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words given by their place in ``raw`` bytes: all their ids in order, and how many each has."""
        n, width = len(lengths), int(lengths.max())
        column = np.repeat(np.arange(n), lengths)
        row = np.arange(len(column)) - (np.cumsum(lengths) - lengths)[column]
        raw = raw[starts[column] + row]
        ids = np.full((width + 1, n), -1, dtype=np.int64)
        ids[row, column] = np.where(row == lengths[column] - 1, self.final[raw], self.inner[raw])
        # ranks[i, w]: of the pair whose left part starts at i, with i in the low bits so that a minimum names its place
        ranks = np.full((width, n), NONE, dtype=np.int64)
        pair = (ids[:-1] >= 0) & (ids[1:] >= 0)
        ranks[pair] = self.table(ids[:-1][pair] << 16 | ids[1:][pair])
        place = np.arange(width, dtype=np.int64)[:, None]
        ranks = np.where(ranks == NONE, NONE, ranks << 8 | place)
        after = np.repeat(np.arange(1, width + 2, dtype=np.int64)[:, None], n, axis=1)
        before = np.repeat(np.arange(-1, width, dtype=np.int64)[:, None], n, axis=1)
        live = np.arange(n)  # words that may still merge; the arrays are narrowed to them now and then
        all_ids = ids
        while True:
            least = ranks.min(axis=0)
            w = np.flatnonzero(least != NONE)
            if not len(w):
                break
            if len(w) < len(live) // 2:
                all_ids[:, live] = ids
                live, ids, ranks, after, before, least = live[w], ids[:, w], ranks[:, w], after[:, w], before[:, w], least[w]
                w = np.arange(len(live))
            least = least[w]
            i = least & 0xFF
            j = after[i, w]
            ids[i, w] = least >> 8 & 0xFFFF
            ids[j, w] = -1
            ranks[np.minimum(j, width - 1), w] = np.where(j < width, NONE, ranks[width - 1, w])
            k = after[j, w]
            after[i, w] = k
            inside = k <= width
            before[k[inside], w[inside]] = i[inside]
            self._refresh(ids, ranks, i, k, w, width)
            h = before[i, w]
            some = h >= 0
            self._refresh(ids, ranks, h[some], i[some], w[some], width)
        all_ids[:, live] = ids
        by_word = all_ids.T
        kept = by_word >= 0
        return by_word[kept].astype("<u2"), kept.sum(axis=1)

    def _refresh(self, ids, ranks, left, right, w, width) -> None:
        b = np.where(right <= width, ids[np.minimum(right, width), w], -1)
        found = np.full(len(w), NONE, dtype=np.int64)
        some = np.flatnonzero(b >= 0)
        found[some] = self.table(ids[left[some], w[some]] << 16 | b[some])
        ranks[left, w] = np.where(found == NONE, NONE, found << 8 | left)

    def merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.pairs.get
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << 16 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank & 0xFFFF, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := get(ids[a] << 16 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]

    def merge(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given by their place in ``raw`` bytes, in order, and how many each has."""
        counts = np.zeros(len(starts), dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = np.where(lengths > SHORT, 0, (lengths + 3) // 4)
        for c in np.unique(sizes):
            every = np.flatnonzero(sizes == c)
            for at in range(0, len(every), 1 << 16) if c else ():
                own = every[at : at + (1 << 16)]
                ids, counts[own] = self.merge_short(raw, starts[own], lengths[own])
                parts.append((own, ids))
            for w in every.tolist() if not c else ():
                symbols = raw[starts[w] : starts[w] + lengths[w]]
                ids = self.merge_long([*self.inner[symbols[:-1]].tolist(), int(self.final[symbols[-1]])])
                counts[w] = len(ids)
                parts.append((np.array([w]), np.array(ids, dtype="<u2")))
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, dtype="<u2")
        for own, ids in parts:
            flat[spread(ends[own] - counts[own], counts[own])] = ids
        return flat, counts

    @staticmethod
    def prepared(text: str) -> str:
        """In composed form and lower case."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # a capital sigma has its own lower case at a word's end in Python only
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    @staticmethod
    def cut(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text's bytes, and where its words start and end there."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        codes = raw if len(raw) == len(text) else np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        kind = classes()[codes]
        first = np.ones(len(kind) + 1, dtype=bool)  # whether a word, or white space, begins
        first[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        # an apostrophe that stands alone takes some letters with it, and a new word begins after them
        quotes = np.flatnonzero((codes[:-1] == 39) & first[:-2] & (kind[1:] == LETTER)) if len(codes) > 1 else np.zeros(0, dtype=np.int64)
        if len(quotes):
            one = codes[quotes + 1]
            two = codes[np.minimum(quotes + 2, len(codes) - 1)] * (quotes + 2 < len(codes))
            taken = np.where(np.isin(one, SINGLE), 1, 0)
            for a, b in DOUBLE:
                taken[(one == a) & (two == b)] = 2
            quotes, taken = quotes[taken > 0], taken[taken > 0]
            first[quotes + 1] = False
            first[quotes + taken + 1] = True
        edges = np.flatnonzero(first)
        starts, ends = edges[:-1], edges[1:]
        real = kind[starts] != SPACE
        starts, ends = starts[real], ends[real]
        if codes is not raw:
            # bytes that go on with a character begin with the bits 10
            at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            starts, ends = at[starts], at[ends]
        return raw, starts, ends

    def _piece(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a text that doesn't begin or end within a word: all ids, how many each word has, and where words start (in bytes)."""
        raw, starts, ends = self.cut(text)
        lengths = ends - starts
        if not len(starts):
            return np.zeros(0, dtype="<u2"), lengths, starts
        hashes = (hashing.run_hashes(raw, starts, ends) >> np.uint64(1)).astype(np.int64)
        known = self.words
        number = known.find(hashes)
        new = np.flatnonzero(number == NONE)
        if len(new):
            _, place = np.unique(hashes[new], return_index=True)
            own = new[place]
            ids, counts = self.merge(raw, starts[own], lengths[own])
            again = known.add(hashes[own], raw[spread(starts[own], lengths[own])], lengths[own], ids, counts)
            if again:
                number = known.find(hashes)
            else:
                number[new] = known.find(hashes[new])
        have = number != NONE
        held = np.where(have, number, 0)
        have &= np.diff(known.byte_cuts)[held] == lengths
        some = np.flatnonzero(have)
        differ = known.bytes[spread(known.byte_cuts[held[some]], lengths[some])] != raw[spread(starts[some], lengths[some])]
        if differ.any():
            have[some[np.repeat(np.arange(len(some)), lengths[some])[differ]]] = False
        known.seen += np.bincount(held[have], minlength=len(known.seen))
        counts = np.diff(known.id_cuts)[held]
        if have.all():
            return known.ids[spread(known.id_cuts[held], counts)], counts, starts
        # words that share a hash with another, or are too many to be remembered
        rest = np.flatnonzero(~have)
        ids, counts[rest] = self.merge(raw, starts[rest], lengths[rest])
        flat, ends = np.zeros(int(counts.sum()), dtype="<u2"), np.cumsum(counts)
        some = np.flatnonzero(have)
        flat[spread((ends - counts)[some], counts[some])] = known.ids[spread(known.id_cuts[held[some]], counts[some])]
        flat[spread((ends - counts)[rest], counts[rest])] = ids
        return flat, counts, starts

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, two bytes each. Texts are joined to pieces of at most about ``PIECE`` bytes, and longer ones cut at white space."""
        out: list[list[bytes]] = [[] for _ in texts]

        def flush(parts: list[tuple[int, str]]) -> None:
            ids, counts, starts = self._piece("\n".join(p for _, p in parts))
            sizes = np.cumsum([len(p) if p.isascii() else len(p.encode()) for _, p in parts]) + np.arange(len(parts))
            cuts = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, sizes)].tolist()
            data = ids.tobytes()
            for (i, _), a, b in zip(parts, [0, *cuts], cuts):
                out[i].append(data[2 * a : 2 * b])

        held, size = [], 0
        for i, text in enumerate(texts):
            at, width = 0, 1 if text.isascii() else 4  # bytes of a character, at most
            while at < len(text):
                end = len(text)
                if (end - at) * width > PIECE and (gap := GAP.search(text, at + (PIECE - size) // width)):
                    end = gap.start() + 1
                held.append((i, text[at:end]))
                size, at = size + (end - at) * width, end
                if size >= PIECE:
                    flush(held)
                    held, size = [], 0
        if held:
            flush(held)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """All ids of each text, two bytes each."""
        plain: list[str] = []
        parts: list[list[int | bytes]] = []  # of each text: numbers of plain texts, and special tokens between them
        for text in texts:
            cut = [text or ""] if self.special_cut is None or not text or "<|" not in text else [x for x in self.special_cut.split(text) if x]
            own: list[int | bytes] = []
            for x in cut:
                if x in self.special:
                    own.append(self.special[x].to_bytes(2, "little"))
                else:
                    own.append(len(plain))
                    plain.append(self.prepared(x))
            parts.append(own)
        found = self._whole(plain)
        return [found[x[0]] if len(x) == 1 and isinstance(x[0], int) else b"".join(found[y] if isinstance(y, int) else y for y in x) for x in parts]

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.packed([text])[0], dtype="<u2")

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


def in_blocks(batch: pa.RecordBatch, column: int = 1, most: int = 2_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """``(first row, texts)`` of slices of a batch, each of about ``most`` characters."""
    at, held, texts = 0, 0, []
    for i, text in enumerate(batch.column(column)):
        texts.append(text.as_py())
        held += len(texts[-1] or "")
        if held >= most:
            yield at, texts
            at, held, texts = i + 1, 0, []
    if texts:
        yield at, texts


def joined(strings: pa.Array, ids: pa.Array, sizes: list[int]) -> Iterator[str]:
    """Runs of ids, of the sizes given, as texts: the strings they stand for, with single spaces between."""
    ends = np.cumsum(sizes, dtype=np.int64)
    first = at = 0
    while first < len(sizes):  # a column of strings has room for 2 GiB
        last = max(first + 1, int(np.searchsorted(ends, at + AT_ONCE, side="right")))
        own, n = sizes[first:last], int(ends[last - 1]) - at
        offsets = pa.array(np.concatenate([[0], np.cumsum(own)]), pa.int32())
        for text in pc.binary_join(pa.ListArray.from_arrays(offsets, strings.take(ids.slice(at, n))), " "):
            yield text.as_py()
        first, at = last, at + n


@functools.lru_cache(maxsize=2)
def tokenizer(path: str | None) -> WordBPE:
    """One for each Python worker and file."""
    return WordBPE(path or default_path())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id, ids array<int>)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for at, texts in in_blocks(batch):
                packed = bpe.packed(texts)
                offsets = np.cumsum([0, *(len(x) // 2 for x in packed)]).astype(np.int32)
                flat = np.frombuffer(b"".join(packed), dtype="<u2").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(offsets, flat)], names=["id", "ids"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``(id, text)``: what the ids stand for, word-end marks and all, special tokens kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows = part.column(1).fill_null([])
                texts = joined(bpe.as_strings, rows.flatten(), rows.value_lengths().to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = encoded.select(id_col).schema[0].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode each text in one task, so that neither ids nor text travel back:
    ``(id, n_tokens long, ids_sha256, decoded_sha256)``. The digest of the ids is that of their
    decimals with single spaces between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        sha = hashlib.sha256
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for _, texts in in_blocks(batch):
                packed = bpe.packed(texts)
                sizes = [len(x) // 2 for x in packed]
                ids = pa.array(np.frombuffer(b"".join(packed), dtype="<u2"))
                counts += sizes
                for strings, digests in ((bpe.as_decimals, of_ids), (bpe.as_strings, of_text)):
                    digests += [sha(x.encode()).hexdigest() for x in joined(strings, ids, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["id", "n", "a", "b"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n long, a string, b string")
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
