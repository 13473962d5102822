"""String similarity: exact scores and the bounds that blocking relies on."""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_sort_text(text: Column) -> Column:
    """Blank-separated tokens in code-point order, joined by one blank."""
    return F.array_join(F.array_sort(F.filter(F.split(text, "\\s+"), lambda t: t != "")), " ")


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by the bit-parallel recurrence."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    open_bits = full
    for ch in b:
        hit = open_bits & where.get(ch, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(a) - open_bits.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Normalised similarity under insertions and deletions, 0 to 100."""
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * lcs_length(a, b) / total


def jaro(a: str, b: str) -> float:
    """Share of characters matched within half the longer length, less swaps.

    Free positions of ``b`` are bits of a number, so a character takes its first
    free match with one mask.
    """
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    where: dict[str, int] = {}
    for j, ch in enumerate(b):
        where[ch] = where.get(ch, 0) | (1 << j)
    taken, left = 0, []
    for i, ch in enumerate(a):
        low = max(0, i - reach)
        window = ((1 << (i + reach + 1)) - 1) >> low << low
        open_bits = where.get(ch, 0) & window & ~taken
        if open_bits:
            taken |= open_bits & -open_bits
            left.append(ch)
    if not left:
        return 0.0
    m = len(left)
    right = [ch for j, ch in enumerate(b) if taken >> j & 1]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with a bonus of 0.1 per shared leading character (at most
    four), given only when the Jaro part exceeds 0.7."""
    score = jaro(a, b)
    if score > 0.7:
        score += 0.1 * shared_prefix(a, b) * (1 - score)
    return score


def shared_prefix(a: str, b: str, most: int = 4) -> int:
    n = 0
    while n < most and n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def bag(text: str) -> list[str]:
    """The characters as a set of numbered tokens, so repeats stay distinct."""
    seen: Counter[str] = Counter()
    tokens = []
    for ch in text:
        tokens.append(f"{ch}{seen[ch]}")
        seen[ch] += 1
    return tokens


class Way(NamedTuple):
    """One way for a text to match: pairs matched this way share ``extra`` and at
    least ``least`` characters of this text, and are keyed by so many of them."""

    number: int
    extra: str
    least: int
    sizes: frozenset[int]


# Longer texts are keyed by single tokens, since their pairs would be too many.
LONG_TEXT = 64


def _key_sizes(length: int, least: int, size: int, shortest: float) -> frozenset[int]:
    """Key sizes of a text such that any two matching texts have one in common.

    ``shortest`` bounds the length of a partner, as a share of the longer text.
    """
    if length > LONG_TEXT:
        return frozenset({min(size, 1)})
    sizes = {size, min(size, least)}
    if length > LONG_TEXT * shortest - 1:
        sizes.add(min(size, 1))
    return frozenset(sizes)


class TokenSortMeasure:
    """Indel ratio of blank-sorted tokens, on a 0 to 100 scale.

    A pair can only reach the threshold if the character bags share at least
    ``t * (la + lb) / 2`` tokens, since a common subsequence is a common bag.
    """

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.share = threshold / 100.0

    def score(self, a: str, b: str) -> float:
        return indel_ratio(a, b)

    def ways(self, text: str) -> list[Way]:
        shortest = self.share / (2 - self.share)
        least = _ceil(len(text) * shortest)
        return [Way(0, "", least, _key_sizes(len(text), least, 2, shortest))]

    def needed(self, way: int, la, lb):
        """Least bag overlap of a pair with these lengths."""
        return self.share * (la + lb) / 2.0

    def elsewhere(self, way: int, left: list[str], right: list[str]):
        """Pairs that another way finds (none)."""
        return None


class JaroWinklerMeasure:
    """Jaro-Winkler on a 0 to 100 scale, truncated to an integer.

    With ``p`` shared leading characters the Jaro part must reach
    ``(T - 0.1 p) / (1 - 0.1 p)`` (and more than 0.7 for the bonus to count),
    and a Jaro of ``J`` needs ``m/la + m/lb >= 3 J - 1`` matching characters.
    Each number of shared leading characters is one way to match. From three on the
    bound is that of four; a common prefix alone would put all texts of a column under one key.
    """

    TOKENS = {0: 2, 1: 1, 2: 1, 3: 2}

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.share = threshold / 100.0

    def score(self, a: str, b: str) -> float:
        return float(math.floor(jaro_winkler(a, b) * 100))

    def _least_jaro(self, prefix: int) -> float:
        return max((self.share - 0.1 * prefix) / (1 - 0.1 * prefix), min(self.share, 0.7))

    def ways(self, text: str) -> list[Way]:
        found = []
        for prefix, tokens in self.TOKENS.items():
            if prefix <= len(text):
                shortest = 3 * self._least_jaro(4 if prefix == 3 else prefix) - 2
                least = _ceil(len(text) * shortest)
                found.append(Way(prefix, text[:prefix], least, _key_sizes(len(text), least, tokens, shortest)))
        return found

    def needed(self, way: int, la, lb):
        prefix = 4 if way == 3 else way
        return (3 * self._least_jaro(prefix) - 1) * la * lb / (la + lb)

    def elsewhere(self, way: int, left: list[str], right: list[str]):
        """Pairs that share a further leading character belong to the next way."""
        import numpy as np

        if way == 3:
            return None
        at = lambda texts, none: np.array([ord(t[way]) if len(t) > way else none for t in texts])
        return at(left, -1)[:, None] == at(right, -2)[None, :]


MEASURES = {"token_sort": TokenSortMeasure, "jaro_winkler": JaroWinklerMeasure}


def _ceil(x: float) -> int:
    """Ceiling that forgives rounding, so a bound is never a token too high."""
    return max(1, math.ceil(x - 1e-9))
