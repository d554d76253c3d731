"""String similarity for entity resolution: indel ratio, token ratios and their weighted combination, 0 to 100.

The kernel runs in Python over distinct pairs of an Arrow batch; longest common subsequences are found bit-parallel.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def process(text: str | None) -> str:
    """Lower-cased text with everything but letters and digits blanked, trimmed."""
    return re.sub(r"[^\w]|_", " ", text or "").lower().strip()


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """200 times the common subsequence over both lengths; 100 for two empty texts."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """The best ratio of the shorter text with a window of the longer; ``floor`` where none is above it.

    The characters that a window shares with the shorter text, whatever their order, bound its ratio: windows that can't beat the best so far aren't compared.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best = len(a), floor
    where: dict[str, int] = {}
    spare: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
        spare[c] = spare.get(c, 0) + 1
    masks = [where.get(c, 0) for c in b]
    full = (1 << n) - 1
    shared = 0
    for end in range(1, len(b) + n):
        start, stop = max(0, end - n), min(end, len(b))
        if end <= len(b) and masks[end - 1]:
            spare[b[end - 1]] -= 1
            shared += spare[b[end - 1]] >= 0
        if start and masks[start - 1]:
            shared -= spare[b[start - 1]] >= 0
            spare[b[start - 1]] += 1
        if 200.0 * shared / (n + stop - start) > best and (masks[stop - 1] or masks[start]):
            s = full
            for m in masks[start:stop]:
                u = s & m
                s = (s + u) | (s - u)
            best = max(best, 200.0 * (n - (s & full).bit_count()) / (n + stop - start))
            if best == 100.0:
                break
    return best


def token_sort_ratio(a: str, b: str) -> float:
    """Ratio of the texts with their words sorted."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with each side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = " ".join(filter(None, (both, left))), " ".join(filter(None, (both, right)))
    scores = [ratio(one, two)]
    if both:
        scores += [ratio(both, one), ratio(both, two)]
    return max(scores)


def partial_token_ratio(a: str, b: str, floor: float = 0.0) -> float:
    """Best partial ratio of sorted words, ``floor`` where it isn't above that; 100 as soon as a word is shared."""
    x, y = a.split(), b.split()
    if set(x) & set(y):
        return 100.0
    best = partial_ratio(" ".join(sorted(x)), " ".join(sorted(y)), floor)
    if len(set(x)) == len(x) and len(set(y)) == len(y):
        return best
    return max(best, partial_ratio(" ".join(sorted(set(x))), " ".join(sorted(set(y))), floor))


def weighted_above(a: str, b: str, floor: float) -> float:
    """:func:`weighted_ratio` of two texts where it is above ``floor``, which is returned else; windows that can't be are left out."""
    if not a or not b:
        return max(0.0, floor)
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    best = max(floor, ratio(a, b))
    if longer / shorter < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if longer / shorter <= 8 else 0.6
    beat = lambda weight: max(0.0, best / weight - 1e-9)
    best = max(best, 0.95 * scale * partial_token_ratio(a, b, beat(0.95 * scale)))
    return max(best, scale * partial_ratio(a, b, beat(scale)))


@lru_cache(maxsize=200_000)
def weighted_ratio(a: str, b: str) -> float:
    """The weighted combination for texts already processed; 0 if either is empty."""
    return weighted_above(a, b, 0.0)


def _paired(kernel, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([kernel(process(x), process(y)) for x, y in zip(a, b)], index=a.index, dtype="float64")


@F.pandas_udf(DoubleType())
def _weighted(a: pd.Series, b: pd.Series) -> pd.Series:
    return _paired(weighted_ratio, a, b)


@F.pandas_udf(DoubleType())
def _token_sort(a: pd.Series, b: pd.Series) -> pd.Series:
    return _paired(token_sort_ratio, a, b)


def weighted_similarity(a: Column, b: Column) -> Column:
    """:func:`weighted_ratio` of two text columns after :func:`process`."""
    return _weighted(a, b)


def token_sort_similarity(a: Column, b: Column) -> Column:
    """:func:`token_sort_ratio` of two text columns after :func:`process`."""
    return _token_sort(a, b)


@F.pandas_udf(StringType())
def _sorted_words(a: pd.Series) -> pd.Series:
    return a.map(lambda x: " ".join(sorted(process(x).split())))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b)], index=a.index, dtype="float64")


def sorted_words(text: Column) -> Column:
    """A text after :func:`process` with its words sorted, so that of many pairs each text is prepared once; null counts as empty."""
    return _sorted_words(text)


def ratio_similarity(a: Column, b: Column) -> Column:
    """:func:`ratio` of two text columns as they are; of :func:`sorted_words` it is :func:`token_sort_similarity`."""
    return _ratio(a, b)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """100 times one minus the edit distance over the longer length; a scorer that stays in the JVM."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 100.0 * (1 - F.levenshtein(a, b) / longest)).otherwise(100.0)


def word_similarity(a: Column, b: Column) -> Column:
    """100 times the shared share of both texts' different words, without regard to case; 0 if neither has words. A scorer that stays in the JVM."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    every = F.size(F.array_union(words(a), words(b)))
    return F.when(every > 0, 100.0 * F.size(F.array_intersect(words(a), words(b))) / every).otherwise(0.0)
