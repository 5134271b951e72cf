"""Rule tables of any usual size over texts in one pass: an Aho-Corasick automaton in place of one expression a rule.

A table is a list of (pattern, value) in its order of use, some 100,000 rules at most (``readers.rules`` refuses more); it goes to
the executors with the function. A worker builds the automaton once and keeps it. Patterns and texts are compared in
lower case, as by ``contains``; an empty pattern is in every text; a null text is empty. A pattern given twice keeps its first place.

For a handful of rules ``matching.first_rule`` and ``only_value`` stay inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmark.operators.care import ACCENTED, PLAIN, without_accents

AMBIGUOUS = "ambiguous"
_PLAIN = str.maketrans(ACCENTED, PLAIN)


class Patterns:
    """The patterns of a table by number; the automaton is built where it is used, not sent."""

    def __init__(self, patterns: tuple[str, ...]):
        self.patterns = patterns
        self.numbers: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            self.numbers.setdefault(p, []).append(i)
        self._always = self.numbers.pop("", [])
        self._machine = ahocorasick.Automaton()
        for p, numbers in self.numbers.items():
            self._machine.add_word(p, numbers)
        if self.numbers:
            self._machine.make_automaton()

    def places(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """Where an occurrence of a pattern ends, its last character, and the numbers of the pattern."""
        return self._machine.iter(text) if self.numbers else iter(())

    def numbers_of(self, first: int) -> list[int]:
        """All numbers of the pattern that is first given under this one."""
        return self.numbers[self.patterns[first]]

    def found(self, text: str) -> list[int]:
        """The numbers of the patterns that are in the text, ascending."""
        hits = set(self._always)
        if self.numbers:
            for _, numbers in self._machine.iter(text):
                hits.update(numbers)
        return sorted(hits)


@lru_cache(maxsize=8)
def _built(patterns: tuple[str, ...]) -> Patterns:
    return Patterns(patterns)


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _table(rules: list[tuple[str, str]]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    return tuple(p.lower() for p, _ in rules), tuple(v for _, v in rules)


def first(text: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(value, pattern) of the first rule whose pattern the text contains; nulls where none does."""
    patterns, values = _table(rules)

    @F.pandas_udf("value string, pattern string")
    def run(texts: pd.Series) -> pd.DataFrame:
        machine = _built(patterns)
        hits = [machine.found(t) for t in texts]
        return pd.DataFrame({"value": [values[h[0]] if h else None for h in hits], "pattern": [patterns[h[0]] if h else None for h in hits]})

    return run(_lower(text))


def agreeing(text: Column, rules: list[tuple[str, str]], authoritative: frozenset[str] = frozenset()) -> Column:
    """struct(value, pattern): what all matching rules agree on, with the first of their patterns.

    The first rule whose pattern is among the authoritative decides alone. Where the rules differ the value is null and the
    pattern ``ambiguous``; where none matches both are null.
    """
    patterns, values = _table(rules)
    sure = frozenset(p.lower() for p in authoritative)

    @F.pandas_udf("value string, pattern string")
    def run(texts: pd.Series) -> pd.DataFrame:
        machine = _built(patterns)
        out: list[tuple[str | None, str | None]] = []
        for t in texts:
            hits = machine.found(t)
            decides = next((h for h in hits if patterns[h] in sure), None)
            if decides is None and hits:
                decides = hits[0] if len({values[h] for h in hits}) == 1 else -1
            out.append((None, None) if decides is None else (None, AMBIGUOUS) if decides < 0 else (values[decides], patterns[decides]))
        return pd.DataFrame(out, columns=["value", "pattern"])

    return run(_lower(text))


def every(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The different values of all matching rules, in the table's order."""
    patterns, values = _table(rules)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        machine = _built(patterns)
        return pd.Series([list(dict.fromkeys(values[h] for h in machine.found(t))) for t in texts], dtype=object)

    return run(_lower(text))


def _joined(text: str) -> str:
    return re.sub(r"[\s-]+", " ", text)


@lru_cache(maxsize=1 << 16)
def _as_words(term: str) -> re.Pattern:
    return re.compile(r"(?<!\w)" + r"[\s-]+".join(re.escape(w) for w in term.split()) + r"(?!\w)")


def _within(c: str) -> bool:
    return c.isalnum() or c == "_"


class Words:
    """Terms that are looked for as whole words, by number; built once in a worker."""

    def __init__(self, plain: tuple[str, ...]):
        joined = tuple(map(_joined, plain))
        self.machine, self.sizes, self.plain = Patterns(joined), tuple(map(len, joined)), plain

    def found(self, text: str) -> list[int]:
        """The numbers of the terms that stand in the text, ascending.

        Where the automaton found a term the characters on both sides decide, so a text costs its length and its hits. A hyphen
        inside a term stands for itself, which the joined text does not tell: such a term is then looked for by its pattern.
        """
        joined = _joined(text)
        bounded, anywhere = set(), set()  # numbers of hits
        for end, numbers in self.machine.places(joined):
            one = numbers[0]
            anywhere.add(one)
            if one not in bounded:
                start = end + 1 - self.sizes[one]
                if not (start and _within(joined[start - 1])) and not (end + 1 < len(joined) and _within(joined[end + 1])):
                    bounded.add(one)
        return sorted(i for one in anywhere for i in self.machine.numbers_of(one) if (_as_words(self.plain[i]).search(text) if "-" in self.plain[i] else one in bounded))


@lru_cache(maxsize=8)
def _words(plain: tuple[str, ...]) -> Words:
    return Words(plain)


def terms(text: Column, wanted: list[str]) -> Column:
    """Those of the terms, in their order, that stand in the text as whole words, with hyphens or white space between them.

    Case and accents do not count. The automaton finds them in a text whose gaps are all one space.
    """
    plain = tuple(" ".join(w.translate(_PLAIN).lower().split()) for w in wanted)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        words = _words(plain)
        return pd.Series([[wanted[i] for i in words.found(t)] for t in texts], dtype=object)

    # so that a filter on the terms does not look for them once more
    return run.asNondeterministic()(F.lower(without_accents(text)))
