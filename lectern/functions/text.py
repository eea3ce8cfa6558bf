"""Column expressions over text. All stay inside the JVM, but for those over more than ``MANY`` terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


from . import terms as many_terms

#: Terms up to which a text is gone through once for each.
MANY = 64


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, for which the value is found once however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def tokens(text: Column) -> Column:
    """Lower-case words of three or more letters a-z that stand between characters that are no letters, digits or underscores."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda x: x.rlike("^[a-z]{3,}$"))


def long_words(text: Column) -> Column:
    """Distinct lower-case words of four or more letters a-z."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda x: x.rlike("^[a-z]{4,}$")))


def word_count(text: Column) -> Column:
    """Number of runs of characters between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != ""))


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def last_place(text: Column, sign: str) -> Column:
    """Place of the last ``sign``, from 0; -1 if there is none."""
    at = F.instr(F.reverse(text), sign)
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(text) - at)


def shortened(text: Column, most: int, share: float) -> Column:
    """Text of at most ``most`` characters as it is; else cut after the last sentence that ends beyond ``share`` of them, else
    before the last space, else hard, the last two with dots."""
    begin = F.substring(text, 1, 4 * most)  # enough, unless most of it is white space

    def cut_at(cut: Column, sentence: Column, space: Column) -> Column:
        return F.when(sentence > most * share, cut.substr(F.lit(1), sentence + 1)).when(space > 0, F.concat(cut.substr(F.lit(1), space), F.lit("..."))).otherwise(F.concat(cut, F.lit("...")))

    def placed(cut: Column) -> Column:
        places = F.struct(F.greatest(*(last_place(cut, s) for s in ".!?")).alias("sentence"), last_place(cut, " ").alias("space"))
        return bound(places, lambda p: cut_at(cut, p["sentence"], p["space"]))

    def whole(clean: Column) -> Column:
        return F.when(F.length(clean) <= most, clean).otherwise(bound(F.substring(clean, 1, most), placed))

    of_begin = bound(squeezed(begin), lambda c: F.when(F.length(c) > most, whole(c)))
    return F.coalesce(F.when(F.length(text) > 4 * most, of_begin), bound(squeezed(text), whole))


def snippet(text: Column) -> Column:
    return shortened(text, 200, 0.6)


def quote(text: Column) -> Column:
    return shortened(text, 300, 0.7)


def occurrences(text: Column, terms: list[str]) -> Column:
    """How often the terms occur in the text, as substrings that don't overlap (each term by itself)."""
    if len(terms) > MANY:
        return many_terms.occurrences(text, terms)
    each = [((F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)).cast("int") for t in terms]
    return sum(each[1:], each[0]) if each else F.lit(0)


def contains_any(text: Column, terms: list[str]) -> Column:
    if len(terms) > MANY:
        return many_terms.contains_any(text, terms)
    return bound(text, lambda once: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(once, t))) if terms else F.lit(False)


def terms_in(text: Column, terms: list[str]) -> Column:
    """The terms that occur, in the order of the list."""
    if len(terms) > MANY:
        return many_terms.terms_in(text, terms)
    return bound(text, lambda once: F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(once, t)))


def chunk_id(content: Column) -> Column:
    """An id that depends on the content alone."""
    return F.concat(F.lit("chunk_"), F.substring(F.md5(content.cast("binary")), 1, 12))


def joined(rows: Column, sep: str = "\n") -> Column:
    """A gathered array of ``struct(places.., value)`` as one text in the order of the places."""
    return F.array_join(F.transform(F.array_sort(rows), lambda x: x["value"]), sep)


def gathered(order: list[Column] | Column, value: Column, sep: str = "\n") -> Column:
    """Aggregate: the values of a group joined in a stated order."""
    keys = order if isinstance(order, list) else [order]
    # one flat struct, as a nested one takes half as much again of every row that is shuffled
    return joined(F.collect_list(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), value.alias("value"))), sep)
