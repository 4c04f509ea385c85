"""A literal prefilter of pattern catalogues: one pass over a text tells which patterns can match it at all.

Most patterns contain strings that every match must contain. An automaton over those strings finds, in one pass, the patterns that are possible; only these are run.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache, reduce
from re import _constants as C
from re import _parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def fold(text: str) -> str:
    """Text in which letters that patterns without regard to case treat alike are the same."""
    return text.casefold().replace("ı", "i")


def _sets(sequence) -> list[frozenset[str]]:
    """Sets of strings, of each of which every match of a parsed sequence contains one."""
    found, run = [], ""
    for kind, value in sequence:
        if kind is C.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset([fold(run)]))
            run = ""
        if kind is C.SUBPATTERN:
            found += _sets(value[3])
        elif kind is C.BRANCH:
            best = [_best(_sets(branch)) for branch in value[1]]
            if all(best):
                found.append(frozenset().union(*best))
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            found += _sets(value[2])
        elif kind is C.IN and all(k is C.LITERAL for k, _ in value):
            found.append(frozenset(fold(chr(v)) for _, v in value))
    if run:
        found.append(frozenset([fold(run)]))
    return found


def _best(sets: list[frozenset[str]]) -> frozenset[str]:
    """The set whose shortest string is longest, as it is found least often."""
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=frozenset())


@lru_cache(maxsize=4096)
def required(pattern: str) -> frozenset[str]:
    """Strings one of which is in every text that the pattern matches, both folded; empty if there are none that say anything."""
    best = _best(_sets(_parser.parse(pattern)))
    return best if best and min(map(len, best)) > 1 else frozenset()


def possible(pattern: str, folded: str) -> bool:
    """Whether a pattern can match a text at all, of which the folded form is given."""
    strings = required(pattern)
    return not strings or any(s in folded for s in strings)


class Literals:
    """The patterns of a catalogue that a text may match, by one pass over it."""

    def __init__(self, patterns: Iterable[str]):
        self.patterns = list(dict.fromkeys(patterns))
        self.always, by_string = [], {}
        for i, p in enumerate(self.patterns):
            for s in required(p):
                by_string.setdefault(s, []).append(i)
            if not required(p):
                self.always.append(i)
        self.by_string = by_string
        self.automaton = _automaton(by_string)

    def possible(self, text: str | None) -> list[int] | None:
        """The numbers of patterns that can match, in order."""
        if text is None:
            return None
        low, found = fold(text), set(self.always)
        if self.automaton is None:
            strings = (s for s in self.by_string if s in low)
        else:
            strings = {s for _, s in self.automaton.iter(low)}
        for s in strings:
            found.update(self.by_string[s])
        return sorted(found)


def _automaton(strings):
    """An automaton over strings; None where its library is not installed, when each string is looked for by itself."""
    try:
        import ahocorasick
    except ImportError:
        return None
    automaton = ahocorasick.Automaton()
    for s in strings:
        automaton.add_word(s, s)
    if strings:
        automaton.make_automaton()
        return automaton
    return None


class Catalogue:
    """Patterns whose possible ones a column holds for each row, so that columns of matches run only these."""

    def __init__(self, patterns: Iterable[str]):
        self.patterns = list(dict.fromkeys(patterns))
        self.number = {p: i for i, p in enumerate(self.patterns)}

    def possible(self, text: Column) -> Column:
        """The numbers of the patterns that can match; null for null."""
        patterns = self.patterns

        @pandas_udf(T.ArrayType(T.IntegerType()))
        def find(texts: pd.Series) -> pd.Series:
            literals = Literals(patterns)
            return texts.map(literals.possible)

        return find(text)

    def matches(self, text: Column, possible: Column, patterns: list[str]) -> Column:
        """Whether one of the patterns is found; those that cannot be are not run."""
        each = [F.array_contains(possible, F.lit(self.number[p])) & text.rlike(p) for p in patterns]
        return reduce(lambda a, b: a | b, each, F.lit(False))
