"""Connected components of a table of links, by alternating large-star and small-star steps.

Both steps point the neighbours of a node to the smallest among them; each is a grouped minimum (so
a node with a great many links is summed before the shuffle), stored, and joined back to the links (where Spark
can then split the tasks of such a node). The number of rounds grows with the logarithm of the longest chain. Every
round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

MOST_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: two long columns, any direction, repeats and loops allowed. Returns ``(node,
    component)`` of the nodes that aren't the smallest of their component."""
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, before = storage.keep(edges, "links"), None
    for _ in range(MOST_ROUNDS):
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = storage.keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = storage.keep(large, "links")
        storage.discard(edges, least)
        least = storage.keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = storage.keep(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        storage.discard(large, least)
    raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
