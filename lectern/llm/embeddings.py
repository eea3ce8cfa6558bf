"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine
verification and distributed connected components.

Equal vectors of a label are one node with a weight, so a vector that a third of all rows hold is
compared once. Each of the tables hashes a node to the signs of its products with ``bits`` random
hyperplanes; nodes of a label that agree in a table are compared exactly, in double precision. How
many bits follows from the number of rows (buckets stay small as it grows); how many tables from
``miss``, the greatest chance that a pair exactly at the threshold agrees in none. A pair that meets
in several tables is counted in the first. Nothing is capped: large buckets are compared block by
block (see ``buckets``).

Defined cases: a vector that is null, zero, or holds null or non-finite components, or whose label
is null, links with nothing and is its own component; vectors of different lengths don't link; equal
rows link with each other; rows that share an id but not a vector are vectors of their own, each with its own links and
component; a row without an id links with nothing, has a null component and isn't kept; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets, components, storage

SEED = 20240229


def plan(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """``(bits, tables)`` for ``n`` rows."""
    bits = min(60, max(12, math.ceil(math.log2(max(n, 2)))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def usable(vector) -> F.Column:
    """Whether a vector can be compared at all."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def sign_codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One number for each vector and table."""
    planes = np.random.default_rng([SEED, vectors.shape[1], bits, tables]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def nodes(vectors: DataFrame, bits: int, tables: int, kind: str) -> DataFrame:
    """``vectors``: ``id, label, weight, vector``. Returns ``id``, ``data`` (label, weight, codes, the vector) and ``keys``."""

    def run(frames):
        for pdf in frames:
            datas, keys = [None] * len(pdf), [None] * len(pdf)
            by_length: dict[int, list[int]] = {}
            for i, v in enumerate(pdf["vector"]):
                by_length.setdefault(len(v), []).append(i)
            for length, own in by_length.items():
                raw = np.stack([pdf["vector"].iat[i] for i in own]).astype(kind)
                codes = sign_codes(raw.astype(np.float64), bits, tables)
                labels = pdf["label"].to_numpy(dtype=np.int64)[own]
                head = np.stack([labels, pdf["weight"].to_numpy(dtype=np.int64)[own]], axis=1)
                whole = np.concatenate([head.view(np.uint8), codes.view(np.uint8), raw.view(np.uint8)], axis=1)
                place = (np.arange(tables, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
                own_label = labels.astype(np.uint64) * np.uint64(0x165667B19E3779F9) + np.uint64(length)
                mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ place[None, :] ^ own_label[:, None]
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                # the table's number stays readable in the low bits
                mixed = (mixed >> np.uint64(11) << np.uint64(10) | np.arange(tables, dtype=np.uint64)[None, :]).astype(np.int64)
                for k, i in enumerate(own):
                    datas[i], keys[i] = whole[k].tobytes(), mixed[k]
            yield pd.DataFrame({"id": pdf["id"], "data": datas, "keys": keys})

    return vectors.mapInPandas(run, "id long, data binary, keys array<long>")


def comparing(threshold: float, tables: int, kind: str):
    """Links by cosine; pairs that an earlier table brought together are left to it."""
    at = 16 + 8 * tables

    def parts(rows: np.ndarray):
        v = np.ascontiguousarray(rows[:, at:]).view(kind).astype(np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares stay finite
        v /= np.sqrt((v * v).sum(axis=1, keepdims=True))
        return np.ascontiguousarray(rows[:, :8]).view(np.int64)[:, 0], np.ascontiguousarray(rows[:, 16:at]).view(np.int64), v

    def compare(a: np.ndarray, b: np.ndarray, key: int) -> np.ndarray:
        table = key & 1023
        la, ca, va = parts(a)
        lb, cb, vb = (la, ca, va) if a is b else parts(b)
        linked = va @ vb.T >= threshold
        # by chance of the hash, a bucket may hold other labels and codes
        i, j = np.nonzero(linked)
        wrong = (la[i] != lb[j]) | (ca[i, table] != cb[j, table])
        for t in range(table):
            wrong |= ca[i, t] == cb[j, t]
        linked[i[wrong], j[wrong]] = False
        return linked

    return compare


def weight(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows[:, 8:16]).view(np.int64)[:, 0]


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows``: ``id, label, vector``. Equal vectors of a label as one row ``(node, group, first, weight, vector)``, stored, and the seed of the hashes that number
    vectors and labels; it is changed until no two share a number."""
    for seed in range(SEED, SEED + 100):
        node, group = F.xxhash64("label", "vector", F.lit(seed)), F.xxhash64("label", F.lit(seed))
        each = rows.groupBy("label", "vector", node.alias("node"), group.alias("group")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("weight"))
        kept = storage.keep(each, "vectors")
        counts = kept.agg(F.count(F.lit(1)), F.countDistinct("node"), F.countDistinct("group"), F.countDistinct("label")).first()
        if counts[0] == counts[1] and counts[2] == counts[3]:
            return kept, seed
        storage.discard(kept)
    raise RuntimeError("no seed gives distinct numbers")


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, miss: float = 1e-4) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every row. Labels of any type are compared as they are."""
    kind = "<f4" if embeddings.select(vector_col).schema[0].dataType.elementType.simpleString() == "float" else "<f8"
    vector = F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), vector.alias("vector"))
    fine = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    grouped, seed = numbered(rows.where(fine))
    bits, tables = plan(grouped.count(), threshold, miss)
    table = storage.keep(nodes(grouped.select(F.col("node").alias("id"), F.col("group").alias("label"), "weight", "vector"), bits, tables, kind), "nodes")
    found = storage.keep(buckets.links(table, comparing(threshold, tables, kind), weigh=weight), "found")
    storage.discard(table)
    tied = storage.keep(components.connected_components(found.select("id", "root")).withColumnRenamed("component", "root"), "tied")
    # components are of nodes; each is named by the smallest id in it
    placed = storage.keep(grouped.select("node", "first", "weight").join(tied, "node", "left").select("node", "first", "weight", F.coalesce("root", "node").alias("root")), "placed")
    named = storage.keep(placed.groupBy("root").agg(F.min("first").alias("component_id")), "named")
    counts = storage.keep(found.groupBy(F.col("id").alias("node")).agg(F.sum("n").alias("n")), "counts")
    each = placed.join(named, "root").join(counts, "node", "left").select("node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    own = rows.select("id", F.when(fine, F.xxhash64("label", "vector", F.lit(seed))).alias("node"))
    out = own.join(storage.keep(each, "each"), "node", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
