"""URL rules judged with Bloom filter cascades, in DataFrame expressions alone.

A rule is a host and a path; it fits that host and its subdomains where the url's path starts with
the rule's. A url's keys are its host's ends at label boundaries, each with each beginning of its
path that is as long as some rule's path: a rule fits exactly if it is one of the keys. The keys of
all urls are the universe.

A cascade answers "is this key listed?" without error for every key of the universe. Level 0 is a
Bloom filter of the listed keys; level 1 one of those keys of the universe that level 0 takes for
listed though they aren't; level 2 one of the listed keys that level 1 takes for those, and so on
until a level is mistaken about none. A key belongs where the first level that doesn't hold it
says. The levels' bits (a few for each listed key, whatever the corpus's size) are constants of the
expression, so judging a url takes no join and no shuffle.

Defined cases: a null url or one without ``://`` has empty host and path and no rule; a url without a
fitting rule is in no list, and ``allow`` is what the cascades say of it; of two rules of equal
length the one with the longer host wins, a key in both lists is blocked; equal rows are judged
alike; other columns are left alone; no rules or no rows are fine.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

#: (host, path, action)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def keys(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """All keys under which a rule for this url might be listed, the longest first."""
    labels = F.split(host, r"\.")
    most = max((h.count(".") + 1 for h, _, _ in rules), default=0)
    sizes = sorted({len(p) for _, p, _ in rules})
    ends = [F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in range(1, most + 1)]
    found = [F.when(F.length(path) >= size, F.struct((F.length(end) + size).alias("size"), F.length(end).alias("host_size"), F.concat(end, path.substr(1, size)).alias("key"))) for end in ends for size in sizes]
    if not found:
        return F.expr("array_remove(array(''), '')")
    listed = F.sort_array(F.filter(F.array(*found), lambda x: x["key"].isNotNull()), asc=False)
    return F.transform(listed, lambda x: x["key"])


@dataclass
class Level:
    """``bits`` of a Bloom filter in 64-bit words, with ``hashes`` places for each key."""

    number: int
    size: int
    hashes: int
    words: list[int]

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number), F.lit(i)), F.lit(self.size)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to a constant
        found = F.lit(True)
        for place in self.places(key):
            bit = F.getbit(F.element_at(words, (F.floor(place / 64) + 1).cast("int")), (place % 64).cast("int"))
            found = found & (bit == 1)
        return found


def make_level(listed: DataFrame, number: int, n: int, wrong: float) -> Level:
    """A Bloom filter of ``n`` keys that takes a share ``wrong`` of others for its own."""
    hashes = max(1, math.ceil(math.log2(1 / wrong)))
    level = Level(number, 64 * max(1, math.ceil(1.45 * n * hashes / 64)), hashes, [])
    places = listed.select(F.explode(F.array(*level.places(F.col("key")))).alias("place"))
    one = F.expr("shiftleft(1L, cast(place % 64 as int))")
    rows = places.groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(one).alias("bits")).collect()  # at most size / 64 rows
    level.words = [0] * (level.size // 64)
    for row in rows:
        level.words[row["word"]] = row["bits"]
    return level


@dataclass
class Cascade:
    levels: list[Level]

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.holds(key), answer).otherwise(F.lit(level.number % 2 == 1))
        return answer


def make_cascade(universe: DataFrame, listed: list[str], n_universe: int) -> Cascade:
    """``universe``: a column ``key``, repeats allowed; all keys that will ever be asked for."""
    if not listed:
        return Cascade([])
    spark = universe.sparkSession
    inside = spark.range(1).select(F.explode(F.array(*map(F.lit, sorted(set(listed))))).alias("key"))
    n_in = len(set(listed))
    wrong = min(0.5, math.sqrt(0.5) * n_in / max(n_universe, 1))
    levels = [make_level(inside, 0, n_in, wrong)]
    others = universe.where(levels[0].holds(F.col("key")) & ~F.col("key").isin(sorted(set(listed)))).distinct()
    sides = [inside, storage.keep(others, "cascade")]
    while n := sides[1].count():
        level = make_level(sides[1], len(levels), n, 0.5)
        levels.append(level)
        sides = [sides[1], storage.keep(sides[0].where(level.holds(F.col("key"))), "cascade")]
    return Cascade(levels)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, url_col: str = "url") -> DataFrame:
    """The rows of ``pages`` with ``host``, ``path``, ``rule`` (host and path of the one that wins, else null) and ``verdict`` (replacing columns of these names)."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(F.col(url_col))
    universe = pages.select(F.explode(keys(host, path, rules)).alias("key"))
    n = universe.agg(F.approx_count_distinct("key")).first()[0]  # sizes the filters only
    by = {action: make_cascade(universe, [h + p for h, p, a in rules if a == action], n) for action in ("allow", "block")}
    listed = F.filter(keys(F.col("host"), F.col("path"), rules), lambda k: by["allow"].lists(k) | by["block"].lists(k))
    out = pages.withColumns({"host": host, "path": path}) if url_col not in ("host", "path") else pages.withColumn("_url", F.col(url_col)).withColumns(dict(zip(("host", "path"), host_and_path(F.col("_url"))))).drop("_url")
    out = out.withColumn("rule", F.get(listed, F.lit(0)))
    return out.withColumn("verdict", F.when(by["block"].lists(F.col("rule")) & F.col("rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
