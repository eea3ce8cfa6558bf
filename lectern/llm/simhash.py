"""Near-duplicate documents by SimHash, compared with pivot distance tables.

Documents with equal fingerprints are one node. For every distinct
fingerprint its Hamming distances to ``PIVOTS`` fixed reference fingerprints are computed once and
travel with it. By the triangle inequality two fingerprints within ``d`` differ by at most ``d`` in each of
these coordinates. That brings pairs together without comparing all with all: coordinates are dealt into cells, and a
fingerprint stands in its own cell and, where it is within ``d`` of it, in the next one. Besides, of ``d + 1`` pieces of the bits at least one is
the same in both. So they meet in the bucket of that piece and of the cells of some pivots (more of them for more fingerprints). In a bucket a pair is discarded when its greatest coordinate difference exceeds ``d``; only
survivors are compared bit by bit. Large buckets are compared block by block (see ``buckets``); nothing is capped.

``similar_groups`` groups by the Jaccard similarity of word shingles instead, and loses no pair. Most pairs are found by
fingerprints of ``WIDE`` bits: nodes meet where all of some sampled bits agree, in as many samples as ``miss`` asks for, and
are tied when the fingerprints are as near as those of a pair at the threshold mostly are. The sets of shingles
themselves are compared, exactly, within the groups that this leaves. Fingerprints may miss pairs, those of few shingles above
all. So all sets then meet by the shingles of their prefixes (of two sets with a similarity of ``t``, in one order
of all shingles, the first ``n - ceil(t n) + 1`` of each share one), but only where a shingle is in sets that aren't tied yet; what sizes and counts
don't rule out is compared exactly too.

Defined cases: a null text is an empty one and has fingerprint zero, which is linked like any other; texts of
any length are read whole; equal rows share a fingerprint and so a component; rows that share an id but not the text are documents of their own; a row without an id
doesn't name a component but has the one of its fingerprint, if any row with an id shares it or links to it;
other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe, buckets, components, hashing, storage

SEED = 42
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
PIVOTS = 32
#: Width of the cells that pivot distances are dealt into.
CELL = 8
WIDE, WIDE_PIVOTS = 256, 16
#: Standard deviations of a wide fingerprint's distance that a pair at the threshold is given.
MARGIN = 2.0
#: Places that a set's hashes are counted by; documents sampled for common shingles, and how many of these are used.
COUNTS, COARSE = 512, 64
SAMPLE = 20_000
COMMON = 100_000
#: Characters whose shingles are hashed at once.
SIGNS = 500_000


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints."""
    return np.random.default_rng(7919).integers(0, 1 << 64, n, dtype=np.uint64)


def shingle_hashes(text: str | None, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``size`` words (of the whole text, if it has fewer), repeats included."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z alone are lowered, ASCII white space alone cuts
    if not words:
        return np.zeros(0, dtype=np.uint64)
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - 1
    n = max(1, len(words) - size + 1)
    last = ends[size - 1 :] - 1 if len(words) >= size else ends[-1:] - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())), dtype=np.uint64, count=n)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes."""
    if not len(hashes):
        return 0
    return int(np.packbits(2 * hashing.bit_counts(hashes[:, None]) > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(id, fp long)``: the fingerprint's 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, fp long")


def pieces(distance: int) -> list[int]:
    """Masks that share out the 64 bits, one more of them than bits may differ."""
    cuts = [round(64 * k / (distance + 1)) for k in range(distance + 2)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def pivots_in_keys(n: int, distance: int) -> int:
    """How many pivots' cells a key needs, beside a piece, for buckets of some 256 of ``n`` fingerprints; a cell is worth a little over a bit."""
    return min(12, max(2, math.ceil((math.log2(max(n, 1)) - 64 // (distance + 1) - 8) / 1.2)))


def pivot_table(nodes: DataFrame, distance: int, cells: int = 2) -> DataFrame:
    """``nodes``: ``id, fp``. Returns ``id``, ``data`` (fingerprint and its distances to the pivots) and ``keys``: each piece with the cells of the first ``cells`` pivots."""
    masks = np.array(pieces(distance), dtype=np.uint64)
    width = max(CELL, distance + 1)
    stir = np.random.default_rng(7927).integers(0, 1 << 63, cells, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(1).to_numpy().view(np.uint64)
            table = np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.uint8)
            data = np.concatenate([fp.view(np.uint8).reshape(-1, 8), table], axis=1)
            near = table[:, :cells].astype(np.uint64)
            lower, upper = near // np.uint64(width), (near + np.uint64(distance)) // np.uint64(width)
            owners, keys = [], []
            for choice in product((False, True), repeat=cells):  # the cell that a distance is in, and the next where it is that near
                own = np.flatnonzero((upper != lower)[:, np.array(choice, dtype=bool)].all(axis=1))
                cell = (np.where(choice, upper[own], lower[own]) + np.uint64(1)) * stir
                place = hashing.mixed(cell.sum(axis=1, dtype=np.uint64))
                for k, mask in enumerate(masks):
                    owners.append(own)
                    keys.append(hashing.mixed((fp[own] & mask) * np.uint64(hashing.BASE) ^ place ^ np.uint64(k)))
            owner, key = np.concatenate(owners), np.concatenate(keys)
            order = np.argsort(owner, kind="stable")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(fp)))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(key[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in data], pa.binary()), lists], names=["id", "data", "keys"])

    return nodes.mapInArrow(run, "id long, data binary, keys array<long>")


def within(distance: int):
    """Links fingerprints at ``distance`` or fewer differing bits."""

    def compare(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
        linked = np.ones((len(a), len(b)), dtype=bool)
        ta, tb = a[:, 8:].astype(np.int16), b[:, 8:].astype(np.int16)
        for k in range(ta.shape[1]):  # discard by each coordinate's difference
            linked &= np.abs(ta[:, k][:, None] - tb[:, k][None, :]) <= distance
        i, j = np.nonzero(linked)
        fa, fb = (np.ascontiguousarray(x[:, :8]).view("<u8")[:, 0] for x in (a, b))
        linked[i, j] = np.bitwise_count(fa[i] ^ fb[j]) <= distance
        return linked

    return compare


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row. Rows that share an id are rows of their own, each in its own text's component."""
    prints = storage.keep(fingerprints(docs, id_col, text_col, shingle), "prints")
    # a fingerprint is its own number, as ids may repeat; min() passes over null ids, and a fingerprint that only such rows have isn't a node
    nodes = storage.keep(prints.groupBy("fp").agg(F.min("id").alias("first")).where("first is not null"), "nodes")
    table = storage.keep(pivot_table(nodes.select(F.col("fp").alias("id"), "fp"), distance, pivots_in_keys(nodes.count(), distance)), "pivots")
    found = buckets.links(table, within(distance))
    tied = components.connected_components(found.select("id", "root"))
    placed = storage.keep(nodes.join(tied, nodes["fp"] == tied["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "placed")
    storage.discard(table, nodes)
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    out = prints.join(placed.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- by similarity of shingles -------------------------------------------------------------------


def shingles(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Of each text the distinct hashes, in order, of the runs of ``size`` words (of the whole text, if it has fewer)."""
    parts = [(t or "").encode().lower() for t in texts]
    raw = np.frombuffer(b"\n".join(parts), dtype=np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts = edges[::2]
    words = hashing.run_hashes(raw, starts, edges[1::2])
    cuts = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in parts]))  # each text's first word
    counts = np.diff(cuts)
    n = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)  # shingles of each text
    ends = np.cumsum(n)
    first = np.repeat(cuts[:-1] - (ends - n), n) + np.arange(int(n.sum()))
    long = np.repeat(np.minimum(counts, size), n)
    found = words[first]
    for k in range(1, size):
        own = np.flatnonzero(long > k)
        found[own] = hashing.mixed(found[own] * np.uint64(hashing.BASE) + words[first[own] + k])
    out = []
    for a, b in zip((ends - n).tolist(), ends.tolist()):
        own = np.sort(found[a:b])
        out.append(own[np.append(True, own[1:] != own[:-1])] if len(own) else own)
    return out


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """``WIDE`` majority bits of distinct hashes, each stretched to that many bits."""
    ones = np.zeros(WIDE, dtype=np.int64)
    steps = (np.arange(WIDE // 64, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 1 << 14):
        ones += hashing.bit_counts(hashing.mixed(hashing.mixed(hashes[at : at + (1 << 14), None] + steps[None, :])))
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def agreement(similarity: float) -> float:
    """Chance that a bit agrees for two sets of this Jaccard similarity."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def sampled_bits(bits: int, samples: int) -> np.ndarray:
    """Which ``bits`` of a wide fingerprint each sample takes."""
    rng = np.random.default_rng(101)
    return np.stack([rng.choice(WIDE, bits, replace=False) for _ in range(samples)])


def wide_nodes(nodes: DataFrame, bits: int, samples: int) -> DataFrame:
    """``nodes``: ``id, fp``. Returns ``id``, ``data`` (fingerprint and its distances to the pivots) and ``keys``, each with the sample's number in its low bits."""
    chosen = sampled_bits(bits, samples)
    reference = np.random.default_rng(103).integers(0, 2, (WIDE_PIVOTS, WIDE), dtype=np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = buckets.matrix(batch.column(1))
            ones = np.unpackbits(prints, axis=1, bitorder="little")
            away = ones.sum(axis=1, dtype=np.int32)[:, None] + reference.sum(axis=1, dtype=np.int32)[None, :] - 2 * (ones.astype(np.float32) @ reference.T.astype(np.float32)).astype(np.int32)
            data = np.concatenate([prints, away.astype("<u2").view(np.uint8)], axis=1)
            values = np.stack([ones[:, c].astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64)) for c in chosen], axis=1)
            mixed = values << np.uint64(12) | np.arange(samples, dtype=np.uint64)[None, :]
            offsets = np.arange(0, mixed.size + 1, samples, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in data], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(mixed.astype(np.int64).ravel()))], names=["id", "data", "keys"])

    return nodes.mapInArrow(run, "id long, data binary, keys array<long>")


def within_wide(distance: int, bits: int, samples: int):
    """Links fingerprints at ``distance`` or fewer differing bits; a pair that an earlier sample brings together is left to it."""
    masks = np.zeros((samples, WIDE), dtype=np.uint8)
    np.put_along_axis(masks, sampled_bits(bits, samples), 1, axis=1)
    masks = np.packbits(masks, axis=1, bitorder="little").view("<u8")

    def compare(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
        (fa, ta), (fb, tb) = ((np.ascontiguousarray(x[:, : WIDE // 8]).view("<u8"), np.ascontiguousarray(x[:, WIDE // 8 :]).view("<u2").astype(np.int16)) for x in (a, b))
        ones = [np.unpackbits(x[:, : WIDE // 8], axis=1).astype(np.float32) for x in (a, b)]
        # counts up to WIDE are exact in single precision
        linked = ones[0].sum(axis=1)[:, None] + ones[1].sum(axis=1)[None, :] - 2 * (ones[0] @ ones[1].T) <= distance
        for k in range(WIDE_PIVOTS):
            if max(int(ta[:, k].max()) - int(tb[:, k].min()), int(tb[:, k].max()) - int(ta[:, k].min())) > distance:  # else no pair is too far apart
                linked &= np.abs(ta[:, k][:, None] - tb[:, k][None, :]) <= distance
        i, j = np.nonzero(linked)
        linked[i, j] = False
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            differ = fa[x] ^ fb[y]
            for mask in masks[: key & 4095]:
                apart = np.flatnonzero(((differ[:, 0] & mask[0]) | (differ[:, 1] & mask[1]) | (differ[:, 2] & mask[2]) | (differ[:, 3] & mask[3])) != 0)
                x, y, differ = x[apart], y[apart], differ[apart]
            linked[x, y] = True
        return linked

    return compare


def jaccard_at_least(similarity: float):
    """Links sets whose shared part is large enough; exact."""

    def compare(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
        sizes = np.array([len(x) for x in (*a, *b)])
        items = np.concatenate([*a, *b])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        _, number, count = np.unique(items, return_inverse=True, return_counts=True)
        shared = count[number] > 1
        owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
        common = np.zeros((len(a), len(b)), dtype=np.float32)
        order = np.argsort(number, kind="stable")
        owner, number = owner[order], number[order]
        for at in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
            lo, hi = np.searchsorted(number, [at, at + 4096])
            has = np.zeros((len(sizes), 4096), dtype=np.float32)
            has[owner[lo:hi], number[lo:hi] - at] = 1
            common += has[: len(a)] @ has[len(a) :].T
        na, nb = sizes[: len(a), None], sizes[None, len(a) :]
        return common >= similarity * (na + nb - common) - 1e-9

    return compare


def within_counts(similarity: float):
    """Links sets of different components unless their sizes or counts rule the similarity out. Sets that are similar enough differ in at most
    a share of their elements, and counts differ by no more than the sets do, so no such pair is lost."""
    apart = (1 - similarity) / (1 + similarity)

    def compare(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
        (ca, na), (cb, nb) = (np.ascontiguousarray(x[:, :16]).view("<i8").T for x in (a, b))
        linked = (ca[:, None] != cb[None, :]) & (np.minimum(na[:, None], nb[None, :]) >= similarity * np.maximum(na[:, None], nb[None, :]) - 1e-6)
        fine = [x[:, 16:].astype(np.int16) for x in (a, b)]
        coarse = [x.reshape(len(x), COARSE, -1).sum(axis=2, dtype=np.int16) for x in fine]  # differ no more than the places that they sum
        i, j = np.nonzero(linked)
        linked[i, j] = False
        for at in range(0, len(i), 1 << 15):
            x, y = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            for left, right in (coarse, fine):
                most = apart * (na[x] + nb[y]) + 1e-6
                near = np.concatenate([np.abs(left[x[k : k + 4096]] - right[y[k : k + 4096]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), 4096)] or [np.zeros(0)]) <= most
                x, y = x[near], y[near]
            linked[x, y] = True
        return linked

    return compare


def common_shingles(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> np.ndarray:
    """Hashes of shingles that several documents of a sample have, in order. They only say which shingles of a set come last."""
    n = docs.count()
    some = docs.select(id_col, text_col).sample(min(1.0, SAMPLE / max(n, 1)), SEED)
    hashes = shingle_sets(some, id_col, text_col, shingle).select(F.explode("keys").alias("key"))
    found = hashes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(COMMON)
    return np.sort(np.array([r.key for r in found.select("key").collect()], dtype=np.int64).view(np.uint64))


class Common:
    """Which hashes are among some; a table of their high bits answers for most that aren't."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.high = hashes, np.zeros(1 << 20, dtype=bool)
        self.high[hashes >> np.uint64(44)] = True

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        out = self.high[asked >> np.uint64(44)]
        some = np.flatnonzero(out)
        if len(some):
            at = np.minimum(np.searchsorted(self.hashes, asked[some]), len(self.hashes) - 1)
            out[some] = self.hashes[at] == asked[some]
        return out


def prefix(hashes: np.ndarray, similarity: float, common: Common) -> np.ndarray:
    """Of a set's distinct hashes, common ones last, so many that any two similar sets share one of them."""
    last = common(hashes)
    return np.concatenate([hashes[~last], hashes[last]])[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-6) + 1] if len(hashes) else hashes


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(id, keys)``: distinct shingle hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in bpe.in_blocks(batch, most=SIGNS):
                found = [x.view(np.int64) for x in shingles(texts, shingle)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(found, pa.list_(pa.int64()))], names=["id", "keys"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, keys array<long>")


def shingle_bytes(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(id, data)``: distinct shingle hashes in order, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in bpe.in_blocks(batch, most=SIGNS):
                found = [x.tobytes() for x in shingles(texts, shingle)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(found, pa.binary())], names=["id", "data"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, data binary")


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """``(id, key, data, counts, keys)``, ``key`` the text's MD5: of each document's set of shingles the wide fingerprint and a digest, its size and how many hashes fall to each of ``COUNTS`` places
    (255 at most), and its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = Common(common)
        for batch in batches:
            for at, texts in bpe.in_blocks(batch, most=SIGNS):
                data, counts, keys = [], [], []
                for x in shingles(texts, shingle):
                    data.append(wide_fingerprint(x) + xxhash.xxh128_digest(x.tobytes()))
                    held = np.bincount((x % np.uint64(COUNTS)).astype(np.int64), minlength=COUNTS)
                    counts.append(np.array([len(x)], dtype="<i8").tobytes() + np.minimum(held, 255).astype(np.uint8).tobytes())
                    keys.append(prefix(x, similarity, last).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)), pa.array(data, pa.binary()), pa.array(counts, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "key", "data", "counts", "keys"])

    return docs.select(F.col(id_col).cast("long"), text_col, text_key(text_col)).mapInArrow(run, "id long, key string, data binary, counts binary, keys array<long>")


def text_key(text_col: str) -> Column:
    """What tells rows that share an id apart."""
    return F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))


def confirmed(docs: DataFrame, members: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """``members``: ``id, keys``, of ``nodes``: ``id, first``. Links of the sets that are similar enough among those that share a key; exact."""
    named = members.join(nodes.select("id", "first"), "id").select(F.col("id").alias("node"), F.col("first.id").alias("id"), F.col("first.key").alias("key"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("key")).join(named, ["id", "key"])
    sets = shingle_bytes(texts.select("node", "text"), "node", "text", shingle).groupBy("id").agg(F.max("data").alias("data"))  # equal rows have equal sets
    rows = storage.keep(sets.join(members, "id").select("id", "data", "keys"), "sets")
    found = storage.keep(buckets.links(rows, jaccard_at_least(similarity), block=256, load=buckets.arrays).select("id", "root"), "found")
    storage.discard(rows)
    return found


def across(rows: DataFrame, tied: DataFrame) -> DataFrame:
    """``rows``: ``id, counts, keys``. Those of the keys that sets of different components have, with the component before the counts."""
    placed = rows.join(tied, rows["id"] == tied["node"], "left").select("id", "counts", "keys", F.coalesce("component", "id").alias("component"))
    placed = storage.keep(placed, "placed")
    keyed = placed.select("id", "component", F.explode("keys").alias("key"))
    mixed = keyed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("key")
    mixed = storage.keep(mixed, "mixed")
    shared = keyed.join(mixed, "key", "left_semi").groupBy("id").agg(F.collect_set("key").alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = batch.column(1).to_numpy().astype("<i8")
            data = [head.tobytes() + held.as_py() for head, held in zip(heads, batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), batch.column(3)], names=["id", "data", "keys"])

    joined = placed.select("id", "component", "counts").join(shared, "id")
    return joined.mapInArrow(run, "id long, data binary, keys array<long>")


def fates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, miss: float = 0.01) -> DataFrame:
    """``(id, key, component_id, kept)`` of each distinct id and text (by ``text_key``), null ids left out. Kept is of each group the row with the smallest id, and of
    those that share it the one with the smallest key. Texts without words make a group. ``miss`` only says how much of the work the fingerprints take from the prefixes."""
    common = common_shingles(docs, id_col, text_col, shingle)
    prints = storage.keep(sketches(docs, id_col, text_col, shingle, similarity, common).withColumn("row", F.monotonically_increasing_id()), "prints")
    # a node is a distinct set of shingles, numbered by one of its rows, as ids may repeat
    each = prints.where("id is not null").groupBy("data").agg(F.min(F.struct("id", "key", "row")).alias("first"))
    nodes = storage.keep(each.select(F.col("first.row").alias("id"), "data", F.struct("first.id", "first.key").alias("first")), "nodes")
    agree = agreement(similarity)
    n = nodes.count()
    bits = min(40, max(8, math.ceil(math.log2(max(n, 1) / 256)) if n > 256 else 8))
    samples = math.ceil(math.log(miss) / math.log1p(-(agree**bits)))
    distance = math.ceil(WIDE * (1 - agree) + MARGIN * math.sqrt(WIDE * agree * (1 - agree)))
    wide = wide_nodes(nodes.select("id", F.substring("data", 1, WIDE // 8).alias("fp")), bits, samples)
    wide = storage.keep(wide, "wide")
    near = buckets.links(wide, within_wide(distance, bits, samples), with_key=True)
    # sets are compared in the buckets that brought their fingerprints together, at most one for each sample
    members = storage.keep(near.groupBy("id").agg(F.collect_set("key").alias("keys")), "near")
    storage.discard(wide)
    first = confirmed(docs, members, nodes, id_col, text_col, shingle, similarity)
    tied = storage.keep(components.connected_components(first), "tied")
    storage.discard(members, first)
    # pairs that fingerprints missed share a shingle of their prefixes
    rows = prints.select(F.col("row").alias("id"), "counts", "keys").join(nodes.select("id"), "id", "left_semi")
    mixed = storage.keep(across(rows, tied), "across")
    loose = storage.keep(components.connected_components(buckets.links(mixed, within_counts(similarity)).select("id", "root")), "loose")
    storage.discard(mixed)
    members = loose.select(F.col("node").alias("id"), "component").union(loose.select(F.col("component").alias("id"), "component")).distinct()
    more = confirmed(docs, members.select("id", F.array("component").alias("keys")), nodes, id_col, text_col, shingle, similarity)
    tied = components.connected_components(tied.toDF("id", "root").union(more))
    placed = storage.keep(nodes.join(tied, nodes["id"] == tied["node"], "left").select("data", "first", F.coalesce("component", "id").alias("root")), "placed")
    best = placed.groupBy("root").agg(F.min("first").alias("best"))
    named = placed.select("data", "root").join(best, "root").select("data", "best")
    out = prints.where("id is not null").select("id", "key", "data").distinct().join(named, "data")
    return out.select("id", "key", F.col("best.id").alias("component_id"), ((F.col("id") == F.col("best.id")) & (F.col("key") == F.col("best.key"))).alias("kept"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, miss: float = 0.01) -> DataFrame:
    """``(id, component_id)`` of the rows that aren't kept."""
    return fates(docs, id_col, text_col, shingle, similarity, miss).where("NOT kept").select(F.col("id").alias(id_col), "component_id")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of ``fates``. Rows that share an id are documents of their own: with unlike texts all stay, and of those in one group the one with the
    smallest MD5 does; of rows with equal id and text the first by all their columns. Rows without an id all stay."""
    gone = fates(docs, id_col, text_col, shingle, similarity).where("NOT kept").select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    marked = docs.withColumn("_key", text_key(text_col))
    kept = marked.join(gone.withColumnRenamed("_key", "_gone"), (F.col(id_col) == F.col("_id")) & (F.col("_key") == F.col("_gone")), "left_anti")
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if not repeated:
        return kept.select(docs.columns)
    whole = F.struct(*docs.columns)
    once = kept.where(F.col(id_col).isNotNull()).groupBy(id_col, "_key").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return once.unionByName(kept.where(F.col(id_col).isNull()).select(docs.columns))
