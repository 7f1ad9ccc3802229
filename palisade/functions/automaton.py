"""The first needle of a list, in its order, that a text contains: one pass over the text, whatever the list's length.

An Aho-Corasick automaton holds the needles of several lists; each needle carries its least place in
each of them.  It is built once in each worker and runs over Arrow batches.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.text import LOWER, UPPER, ascii_lower_text

_FOLD = str.maketrans(UPPER, LOWER)


class Automaton:
    """Needles of named lists, any case of ASCII letters."""

    def __init__(self, lists: dict[str, list[str]]):
        import ahocorasick

        self.names = list(lists)
        #: Of the empty needle, which every text contains.
        self.always: list[int | None] = [None] * len(lists)
        places: dict[str, list[int | None]] = {}
        for k, needles in enumerate(lists.values()):
            for i, needle in enumerate(needles, 1):
                low = ascii_lower_text(needle)
                mine = self.always if low == "" else places.setdefault(low, [None] * len(lists))
                mine[k] = i if mine[k] is None else mine[k]
        self.machine = ahocorasick.Automaton()
        for low, at in places.items():
            self.machine.add_word(low, [(k, i) for k, i in enumerate(at) if i is not None])
        if places:
            self.machine.make_automaton()

    def first(self, text: str | None) -> list[int | None]:
        """For each list, the place (from 1) of its first needle that the text contains; null for none, and for a null text."""
        if text is None:
            return [None] * len(self.names)
        out = list(self.always)
        if len(self.machine):
            for _, found in self.machine.iter(text.lower() if text.isascii() else text.translate(_FOLD)):
                for k, i in found:
                    if out[k] is None or i < out[k]:
                        out[k] = i
        return out


@functools.lru_cache(maxsize=4)
def _built(name: str) -> list:
    """A place for a worker's automaton of this name."""
    return []


def first_needles(hay: Column, lists: dict[str, list[str]]) -> Column:
    """A struct of the lists' first places (int)."""
    name = hashlib.md5(repr(lists).encode()).hexdigest()
    return _udf(name, lists)(hay)


def _udf(name: str, lists: dict[str, list[str]]) -> Callable[[Column], Column]:
    kinds = ", ".join(f"{k} int" for k in lists)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = _built(name)
        if not held:
            held.append(Automaton(lists))
        for texts in batches:
            found = [held[0].first(t) for t in texts]
            yield pd.DataFrame({k: pd.array([f[i] for f in found], "Int32") for i, k in enumerate(lists)})

    return F.pandas_udf(run, kinds, F.PandasUDFType.SCALAR_ITER)
