"""Similarities of names, phones, web sites, postal codes and addresses, each in 0 to 1.

Missing (null or empty) sides score 0. The Indel ratio is 2 * LCS / (length a + length b); its longest common
subsequence is bit-parallel, a big-integer step per character, in an Arrow UDF.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import domain, normal_name


def lcs_length(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & where.get(c, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def lcs_lengths(patterns: list[str], texts: list[str], rows: int = 8192) -> np.ndarray:
    """Longest common subsequences of all patterns with all texts: the bit-parallel step for many texts at once.

    Texts go in groups of like length, so that padding at most doubles the work."""
    out = np.zeros((len(patterns), len(texts)), np.int64)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    start = 0
    while start < len(order):
        limit, stop = 2 * max(8, len(texts[order[start]])), start
        while stop < len(order) and stop - start < rows and len(texts[order[stop]]) <= limit:
            stop += 1
        group = order[start:stop]
        start = stop
        sizes = np.array([len(texts[i]) for i in group])
        if not sizes[-1]:
            continue
        letters, coded = np.unique(np.frombuffer("".join(texts[i] for i in group).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        owner = np.repeat(np.arange(len(group)), sizes)
        place = np.arange(len(coded)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns = np.zeros((int(sizes[-1]), len(group)), np.int32)  # 0 is no letter
        columns[place, owner] = coded + 1
        spot = {chr(c): k + 1 for k, c in enumerate(letters.tolist())}
        for at, pattern in enumerate(patterns):
            words = -(-len(pattern) // 64)
            where = [[0] * (len(letters) + 1) for _ in range(words)]
            for i, c in enumerate(pattern):
                if c in spot:
                    where[i >> 6][spot[c]] |= 1 << (i & 63)
            where = np.array(where, np.uint64).reshape(words, len(letters) + 1)
            state = np.full((words, len(group)), np.iinfo(np.uint64).max, np.uint64)
            for column in columns:
                carry = None
                for w in range(words):
                    hit = state[w] & where[w].take(column)
                    total = state[w] + hit
                    if words > 1:
                        over = total < hit
                        if carry is not None:
                            total += carry
                            over |= (total == 0) & (carry == 1)
                        carry = over.astype(np.uint64)
                    state[w] = total | (state[w] ^ hit)
            out[at, group] = 64 * words - np.bitwise_count(state).sum(axis=0, dtype=np.int64)
    return out


def indel_ratios(patterns: list[str], texts: list[str]) -> np.ndarray:
    """The Indel ratio of all patterns with all texts."""
    sizes = np.array([len(x) for x in patterns], np.int64)[:, None] + np.array([len(x) for x in texts], np.int64)[None, :]
    return np.where(sizes > 0, 2 * lcs_lengths(patterns, texts) / np.maximum(sizes, 1), 1.0)


def indel(a: str | None, b: str | None) -> float | None:
    """Null for a null side; two empty texts are equal."""
    if a is None or b is None:
        return None
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.split(text, " ")), " ")


def present(*cols: Column) -> Column:
    """All given and not empty."""
    out = F.lit(True)
    for c in cols:
        out = out & F.coalesce(c != "", F.lit(False))
    return out


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))


def phone_similarity(a: Column, b: Column) -> Column:
    """1 if the shorter digit string has 7 digits or more and ends the other."""
    a, b = (F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "") for c in (a, b))
    n = F.least(F.length(a), F.length(b))
    return F.when((n >= 7) & (F.right(a, n) == F.right(b, n)), 1.0).otherwise(0.0)


def website_similarity(a: Column, b: Column) -> Column:
    a, b = domain(a), domain(b)
    return F.when(present(a, b), indel_ratio(a, b)).otherwise(0.0)


def zip_similarity(a: Column, b: Column) -> Column:
    """Equal but for case, spaces and dashes: 1; the same first five characters: 0.8."""
    a, b = (F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s\-]", "") for c in (a, b))
    near = (F.length(a) >= 5) & (F.length(b) >= 5) & (F.left(a, F.lit(5)) == F.left(b, F.lit(5)))
    return F.when(~present(a, b), 0.0).when(F.lower(a) == F.lower(b), 1.0).when(near, 0.8).otherwise(0.0)


def joined_address(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def address_similarity(a: Column, b: Column) -> Column:
    return F.when(present(a, b), token_sort_ratio(normal_name(a), normal_name(b))).otherwise(0.0)


def identifier_similarity(*pairs: tuple[Column, Column]) -> Column:
    """1 if any pair of identifiers is given and equal once normalised."""
    out = F.lit(False)
    for a, b in pairs:
        out = out | (present(a, b) & (normal_name(a) == normal_name(b)))
    return F.when(out, 1.0).otherwise(0.0)
