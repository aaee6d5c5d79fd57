"""Prefix edit distance and related text functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_edit_distance(typed: Column, word: Column, tau: int) -> Column:
    """The least Levenshtein distance of ``typed`` to a prefix of ``word``; null beyond ``tau``.

    Only prefixes whose length is within ``tau`` of the typed text's can be that near. At tau 0 it
    is 0 for words that start with the text. Both are taken lower case.
    """
    typed, word = F.lower(typed), F.lower(word)
    if tau == 0:
        return F.when(F.startswith(word, typed), F.lit(0))
    low = F.greatest(F.lit(0), F.length(typed) - tau)
    high = F.least(F.length(word), F.length(typed) + tau)
    near = F.transform(F.sequence(low, high), lambda i: F.levenshtein(typed, F.substring(word, F.lit(1), i), tau))
    found = F.array_min(F.filter(near, lambda d: d >= 0))
    return F.when(F.length(word) >= F.length(typed) - tau, found)


def prefixes(word: Column, with_root: bool = True) -> Column:
    """All prefixes of a word, the empty one first: the path of trie nodes to it."""
    path = F.transform(F.sequence(F.lit(0), F.length(word)), lambda i: F.substring(word, F.lit(1), i))
    return path if with_root else F.slice(path, 2, F.length(word) + 1)


def deletions(text: Column, most: int) -> Column:
    """All strings that ``text`` becomes when up to ``most`` characters are left out."""
    every = front = F.array(text)
    for _ in range(most):
        shorter = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        front = F.array_distinct(F.flatten(F.transform(front, shorter)))
        every = F.array_union(every, front)
    return every


def score(dist: Column, ped: Column, tau: int, alpha: float, d_max: float) -> Column:
    """``dist * alpha / d_max + (1 - alpha) * ped / tau`` in double, in this order of operations."""
    text = F.lit(0.0) if tau == 0 else F.lit(1 - alpha) * ped.cast("double") / F.lit(float(tau))
    return spatial(dist, alpha, d_max) + text


def spatial(dist: Column, alpha: float, d_max: float) -> Column:
    return dist.cast("double") * F.lit(float(alpha)) / F.lit(float(d_max))
