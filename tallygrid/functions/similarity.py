"""String similarities and the layered match score.

Similarity is by longest common subsequence: 100 * 2 * lcs / (sum of lengths). The longest common subsequence is computed
on the bits of whole integers, a row a step. Scores run as Arrow-batched functions on candidate pairs only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

from tallygrid.functions import fixed

_STOP = frozenset(fixed.STOP_WORDS)
_TAGS = [re.compile(p) for p in fixed.MATCH_TAGS]


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if not a or not b:
        return 0
    masks = _places(a)
    return _common(len(a), [masks[c] for c in b if c in masks])


def _places(a: str) -> dict[str, int]:
    """Where each character stands in ``a``, as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _common(m: int, places: list[int]) -> int:
    """Length of the longest common subsequence of a text of ``m`` characters and one whose characters stand at ``places`` of it."""
    full = (1 << m) - 1
    v = full
    for x in places:
        u = v & x
        v = (v + u | v - u) & full
    return m - v.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100; two empty strings are equal."""
    n = len(a) + len(b)
    return 100.0 if n == 0 else 200.0 * lcs(a, b) / n


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer, windows cut off at the ends included.

    The characters that a window has in common bound its subsequence. Windows are compared from the greatest bound on, until no bound is above the best.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    m, n, best = len(a), len(b), 0.0
    masks = _places(a)
    places = [masks.get(c, 0) for c in b]
    left, shared, windows = {c: x.bit_count() for c, x in masks.items()}, 0, []
    for end in range(1, n + m):
        if end <= n and places[end - 1]:
            c = b[end - 1]
            left[c] -= 1
            shared += left[c] >= 0
        start = end - m
        if start > 0 and places[start - 1]:
            c = b[start - 1]
            left[c] += 1
            shared -= left[c] > 0
        if shared:
            start, stop = max(0, start), min(end, n)
            windows.append((200.0 * shared / (m + stop - start), start, stop))
    windows.sort(reverse=True)
    for bound, start, stop in windows:
        if bound <= best:
            break
        best = max(best, 200.0 * _common(m, [x for x in places[start:stop] if x]) / (m + stop - start))
    return best


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common words alone and with either rest; words sorted, each once."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not left or not right):
        return 100.0
    one, two = f"{common} {left}".strip(), f"{common} {right}".strip()
    best = ratio(one, two)
    return max(best, ratio(common, one), ratio(common, two)) if common else best


def spelled(text: str) -> str:
    out = text.lower()
    for a, b in fixed.SPELLINGS:
        out = out.replace(a, b)
    return out


def significant(text: str) -> set[str]:
    return set(re.findall(r"\b[a-z]{4,}\b", text.lower())) - _STOP


def tags_of(text: str) -> set[str]:
    upper = text.upper()
    return {m for p in _TAGS for m in p.findall(upper)}


def type_of(text: str) -> str:
    lower = text.lower()
    return next((name for name, words in fixed.ITEM_TYPES if any(w in lower for w in words)), "other")


def match_score(expected: str, predicted: str, exact_shortcut: bool = False) -> float:
    """How well a prediction fits an expected item, 0 to 100, in layers: shared words, tags, critical words, fuzzy.

    Two texts with fewer than two shared significant words score at most 30, even equal ones; ``exact_shortcut`` gives equal ones 100.
    """
    a, b = spelled(expected), spelled(predicted)
    if exact_shortcut and a == b:
        return 100.0
    x, y = significant(a), significant(b)
    if x and y and len(x & y) < 2:
        return int(partial_ratio(a, b) * 0.3)
    s, t = tags_of(expected), tags_of(predicted)
    if s and t:
        near = partial_ratio(a, b)
        if not s & t:
            return min(near, 30)
        kind, other = type_of(expected), type_of(predicted)
        if "other" not in (kind, other) and kind != other:
            return min(near, 35)
        if kind in fixed.TYPE_WORDS and not any(w in b for w in fixed.TYPE_WORDS[kind]):
            return min(near, 40)
        return max(near, 85)
    low, high = expected.lower(), predicted.lower()
    if any(k in low and not any(w in high for w in ws) for k, ws in fixed.CRITICAL_WORDS):
        return int(partial_ratio(a, b) * 0.4)
    if len(expected) < 20:
        return token_set_ratio(a, b)
    if len(expected) < 40:
        words, part = token_set_ratio(a, b), partial_ratio(a, b)
        return int((words + part) / 2) if part > words + 20 else words
    part = partial_ratio(a, b)
    return int(part * 0.7) if len(predicted) > 3 * len(expected) else part


#: Scores that a task remembers, so that a pair which comes again is not compared again.
REMEMBERED = 65_536


def _batched(f):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = lru_cache(REMEMBERED)(f)
        for a, b in batches:
            yield pd.Series([None if x is None or y is None else float(score(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")


def match_score_of(expected, predicted):
    """Column of match scores."""
    return _batched(match_score)(expected, predicted)


def ratio_of(a, b):
    return _batched(ratio)(a, b)
