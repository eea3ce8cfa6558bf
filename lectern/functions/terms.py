"""Many terms looked for in one pass over a text: an automaton of all of them (Aho-Corasick), in Arrow batches.

Column expressions go through a text once for each term, which is the faster way for a few. Beyond ``functions.text.MANY`` terms
the functions there come here; results are the same.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _automaton(terms: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for n, term in enumerate(terms):
        out.add_word(term, (n, len(term)))
    out.make_automaton()
    return out


def counts_in(text: str, automaton, n: int) -> dict[int, int]:
    """How often each of the automaton's terms occurs, by its number; a term's occurrences don't overlap, and those of different terms may."""
    found: dict[int, int] = {}
    free = [0] * n  # where the next occurrence may begin
    for end, (i, length) in automaton.iter(text):
        if end + 1 - length >= free[i]:
            found[i] = found.get(i, 0) + 1
            free[i] = end + 1
    return found


def _each(terms: list[str], kind: str, result, missing=None):
    """A function over batches of texts; ``result`` gets the counts of a text's terms, and null texts give ``missing``. The automaton is made once for each batch of a task."""

    def run(texts: pd.Series) -> pd.Series:
        automaton = _automaton(terms)
        return pd.Series([missing if t is None else result(counts_in(t, automaton, len(terms))) for t in texts], dtype=object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def occurrences(text: Column, terms: list[str]) -> Column:
    """As ``functions.text.occurrences``; a term that is listed twice counts twice."""
    times = Counter(terms)
    names = [*times]
    weight = [times[t] for t in names]
    return _each(names, "int", lambda found: sum(n * weight[i] for i, n in found.items()))(text)


def contains_any(text: Column, terms: list[str]) -> Column:
    return _each([*dict.fromkeys(terms)], "boolean", bool)(text)


def terms_in(text: Column, terms: list[str]) -> Column:
    names = [*dict.fromkeys(terms)]
    place = {t: i for i, t in enumerate(names)}
    listed = [place[t] for t in terms]
    return _each(names, "array<string>", lambda found: [names[i] for i in listed if i in found], [])(text)
