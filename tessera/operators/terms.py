"""Relevance of texts to the terms of a query: word break over a vocabulary, synonyms, partial credit."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.vocabulary import Vocabulary, credit, has_term


def relevance(terms: Column, title: Column, body: Column, vocabulary: Vocabulary, synonyms: Mapping[str, Iterable[str]] = {}, head: int = 160) -> Column:
    """150 * mean credit of the terms in the body, half as much again for a term of the title, a quarter for one of the body's beginning.

    For candidates, not for whole corpora: it runs in Python, in Arrow batches.
    """

    @F.pandas_udf("double")
    def run(terms: pd.Series, title: pd.Series, body: pd.Series) -> pd.Series:
        def one(ts, t, b):
            ts, t, b = list(ts) if ts is not None else [], (t or "").lower(), (b or "").lower()
            if not ts:
                return 0.0
            score = sum(credit(x, b, vocabulary, synonyms) + 0.5 * has_term(t, x) + 0.25 * has_term(b[:head], x) for x in ts)
            return round(150 * score / len(ts), 6)

        return pd.Series([one(*r) for r in zip(terms, title, body)])

    return run(terms, title, body)
