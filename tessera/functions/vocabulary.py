"""A vocabulary as an automaton, and what it says of the terms of a question.

All words of the vocabulary are found in one pass over a text (a trie with
failure links); a term is broken into words by dynamic programming over these
matches.  Built once on the driver, broadcast, used in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator, Mapping
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that fit on the driver and in each worker.
MAX_WORDS = 200_000


class Vocabulary:
    def __init__(self, words: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.lengths = [0], [()]
        for word in sorted({w for w in words if w}):
            at = 0
            for c in word:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({}), self.fail.append(0), self.lengths.append(())
                at = self.next[at][c]
            self.lengths[at] = (len(word),)
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            # words that end here: the node's own and those of its longest suffix in the trie
            self.lengths[at] += self.lengths[self.fail[at]]
            for c, child in self.next[at].items():
                back = self.fail[at]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(c, 0)
                queue.append(child)

    def matches(self, text: str) -> Iterator[tuple[int, int]]:
        """(start, end) of every word of the vocabulary in ``text``, by end, longer ones first."""
        at = 0
        for end, c in enumerate(text, 1):
            while at and c not in self.next[at]:
                at = self.fail[at]
            at = self.next[at].get(c, 0)
            for n in self.lengths[at]:
                yield end - n, end

    def breaks(self, term: str, haystack: str = "") -> bool:
        """Can ``term`` be cut into words of the vocabulary and pieces, of two characters or more, that are terms of ``haystack``?"""
        spans: dict[int, list[int]] = {}
        for start, end in self.matches(term):
            spans.setdefault(end, []).append(start)
        if len(term) == 1:
            return bool(spans) or term in haystack
        reached = [True] + [False] * len(term)
        for end in range(1, len(term) + 1):
            reached[end] = any(reached[s] for s in spans.get(end, ())) or (bool(haystack) and any(reached[s] and has_term(haystack, term[s:end]) for s in range(end - 1)))
        return reached[-1]


_ASCII = re.compile(r"[a-z0-9][a-z0-9/+._-]*")


def has_term(haystack: str, term: str) -> bool:
    """ASCII terms are whole words, others substrings."""
    if not _ASCII.fullmatch(term):
        return term in haystack
    at = haystack.find(term)
    while at >= 0:
        end = at + len(term)
        if not any(c.isascii() and c.isalnum() for c in haystack[max(at - 1, 0) : at] + haystack[end : end + 1]):
            return True
        at = haystack.find(term, at + 1)
    return False


class TermRules(NamedTuple):
    """What of a question is no topic of it."""

    #: a question without a match has no terms (None: any may)
    needs: str | None = None
    #: figures, question words and the like
    stop: str | None = None
    #: names of what every question is about
    scope: tuple[str, ...] = ()
    #: runs of characters that may be terms, and what is taken off their ends
    run: str = r"[^\W_]+(?:[/+._-][^\W_]+)*"
    edges: str = "・/+._-"
    #: a single ideograph is a term between these only (or at an end)
    ideograph: str = "[一-龥]"
    before: str = "はがをにでのともへや、。,.!?！？ "
    after: str = "はがをにでのともへや"
    least: int = 2


def content_terms(text: str | None, vocabulary: Vocabulary, rules: TermRules = TermRules()) -> list[str]:
    """The distinctive terms of a question, each once, in order: what is left when stop words, scope names, figures and all that the vocabulary can spell are gone."""
    low = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text or "")).strip().lower()
    if rules.needs and not re.search(rules.needs, low):
        return []
    if rules.stop:
        low = re.sub(rules.stop, " ", low)
    for name in rules.scope:
        low = low.replace(name.lower(), " ")
    found: dict[str, None] = {}
    for m in re.finditer(rules.run, low):
        term = m.group().strip(rules.edges)
        if len(term) == 1 and re.fullmatch(rules.ideograph, term):
            beside = low[m.start() - 1 : m.start()] if m.start() else "", low[m.end() : m.end() + 1]
            if (beside[0] and beside[0] not in rules.before) or (beside[1] and beside[1] not in rules.after):
                continue
        elif len(term) < rules.least:
            continue
        if not term.isdigit() and not vocabulary.breaks(term):
            found[term] = None
    return list(found)


def covered(term: str, haystack: str, vocabulary: Vocabulary, synonyms: Mapping[str, Iterable[str]] = {}) -> bool:
    """Is a term in a text: spelled by the vocabulary and pieces of the text, or by a synonym that the text has?"""
    return vocabulary.breaks(term, haystack) or any(has_term(haystack, s) for s in synonyms.get(term, ()))


def credit(term: str, haystack: str, vocabulary: Vocabulary, synonyms: Mapping[str, Iterable[str]] = {}) -> float:
    """1 if covered; else half the share of the longest piece (two characters or more, no vocabulary word) that the text has."""
    if not term or covered(term, haystack, vocabulary, synonyms):
        return 1.0
    known = {term[s:e] for s, e in vocabulary.matches(term)}
    for size in range(len(term) - 1, 1, -1):
        if any((p := term[at : at + size]) not in known and has_term(haystack, p) for at in range(len(term) - size + 1)):
            return 0.5 * size / len(term)
    return 0.0


def unmatched_qualifier(question: str | None, evidence: str, kind: str, separators: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), qualifier: str = "[一-龥ぁ-んァ-ン]{2,12}") -> str:
    """The first qualifier before ``kind`` in a question that no evidence has; '' if all are there.

    Of a qualifier what follows its last separator counts, without a leading scope name.
    """
    compact = re.sub(r"\s+", "", unicodedata.normalize("NFKC", question or ""))
    for found in re.findall(rf"({qualifier})(?={kind})", compact):
        for separator in separators:
            found = found.rsplit(separator, 1)[-1]
        for prefix in prefixes:
            found = found.removeprefix(prefix)
        if found and found not in evidence:
            return found
    return ""


def collected(words: DataFrame, most: int = MAX_WORDS) -> Vocabulary:
    """The vocabulary of a table of one column; more than ``most`` words are an error."""
    rows = [r[0] for r in words.distinct().limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} words")
    return Vocabulary(rows)


def content_terms_of(c: Column, df: DataFrame, vocabulary: Vocabulary, rules: TermRules = TermRules()) -> Column:
    """``content_terms`` of a column of ``df``, in Arrow batches with the automaton broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: content_terms(t, shared.value, rules))

    return run(c)


def coverage_of(terms: Column, text: Column, df: DataFrame, vocabulary: Vocabulary, synonyms: Mapping[str, Iterable[str]] = {}) -> Column:
    """The mean credit of an array of terms in a text; 1 without terms."""
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, dict(synonyms)))

    @F.pandas_udf("double")
    def run(terms: pd.Series, texts: pd.Series) -> pd.Series:
        words, same = shared.value
        mean = lambda ts, low: sum(credit(t, low, words, same) for t in ts) / len(ts) if ts else 1.0
        return pd.Series([mean(list(ts) if ts is not None else [], (t or "").lower()) for ts, t in zip(terms, texts)], dtype="float64")

    return run(terms, text)
