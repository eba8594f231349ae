"""Ratcliff-Obershelp similarity: the one measure Spark has no expression for."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=1 << 16)
def ratio(a: str, b: str) -> float:
    """``2*M/T`` over the matching blocks of ``a`` and ``b``; the argument order matters."""
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Row-wise ratio; null when either side is null."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@lru_cache(maxsize=1 << 10)
def _groups(signature: str) -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(g.split(" ")) if g else () for g in signature.split("|"))


@lru_cache(maxsize=1 << 13)
def _best_per_group(token: str, signature: str) -> np.ndarray:
    return np.array([max((ratio(token, t) for t in group), default=0.0) for group in _groups(signature)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def best_ratio_per_group(tokens: pd.Series, groups: pd.Series) -> pd.Series:
    """Best ratio of any token against each group.

    Both inputs are plain strings so Arrow moves them cheaply: ``tokens`` space-separated, ``groups`` as
    ``"a b|c|d e"``. A token meets the same groups on many rows, hence the caches.
    """
    seen: dict[tuple[str, str], np.ndarray] = {}  # rows of a batch often ask the same
    for pair in zip(tokens, groups):
        if pair not in seen:
            rows = [_best_per_group(w, pair[1]) for w in pair[0].split(" ") if w]
            seen[pair] = np.maximum.reduce(rows) if rows else np.zeros(len(_groups(pair[1])))
    return pd.Series([seen[pair] for pair in zip(tokens, groups)])


@lru_cache(maxsize=1 << 14)
def _two_best(token: str, names: tuple[str, ...]) -> tuple[int, float, float]:
    ratios = [ratio(token, name.lower()) for name in names]
    best = int(np.argmax(ratios))  # the first of equals
    second = max(ratios[:best] + ratios[best + 1 :], default=0.0)
    return best, ratios[best], second


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def two_best_matches(tokens: pd.Series, names: pd.Series) -> pd.Series:
    """Three numbers per lower-case token: the position of its best name, the best and the second-best ratio.

    Both are arrays of strings; no names give no numbers, equal ratios keep the name order.
    """
    out = []
    for words, candidates in zip(tokens, names):
        known = tuple(candidates) if candidates is not None else ()
        out.append([number for word in (words if known else ()) for number in _two_best(word, known)])
    return pd.Series(out)


# Declared non-deterministic so that the optimizer keeps one call per row instead of copying it into every
# expression that uses its result.
similarity_ratio = similarity_ratio.asNondeterministic()
best_ratio_per_group = best_ratio_per_group.asNondeterministic()
two_best_matches = two_best_matches.asNondeterministic()


def ratio_bound(a: Column, b: Column) -> Column:
    """No ratio of ``a`` and ``b`` is higher: matching blocks hold only letters that both sides have."""
    common = F.least(*(F.length(x) - F.length(F.call_function("translate", x, y, F.lit(""))) for x, y in ((a, b), (b, a))))
    return 2.0 * common / F.greatest(F.length(a) + F.length(b), F.lit(1))
