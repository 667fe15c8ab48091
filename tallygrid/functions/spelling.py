"""Correction of recognised words by a dictionary that the caller gives.

The dictionary is held as an index of deletions, so a word's neighbours within two edits are a few look-ups, not a scan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import functions as F

#: Known confusions.
CONFUSIONS = {"vaccancy": "vacancy"}
MOST_WORDS = 200_000


def _cut(word: str, most: int) -> Iterator[str]:
    """A word with up to ``most`` letters left out."""
    for n in range(min(most, len(word) - 1) + 1):
        for gone in combinations(range(len(word)), n):
            yield "".join(c for i, c in enumerate(word) if i not in gone)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Speller:
    """Corrects words of three letters or more; the nearest word within ``edits``, the first in the dictionary of equals."""

    def __init__(self, words: Iterable[str], edits: int = 1):
        self.rank = {w.lower(): k for k, w in reversed(list(enumerate(words)))}
        if len(self.rank) > MOST_WORDS:
            raise ValueError(f"more than {MOST_WORDS} words")
        self.edits, self.index = edits, {}
        for w in self.rank:
            for c in _cut(w, edits):
                self.index.setdefault(c, []).append(w)

    def word(self, word: str) -> str:
        low = word.lower()
        if len(word) < 3 or low in self.rank:
            return word
        if low in CONFUSIONS:
            return CONFUSIONS[low]
        near = {w for c in _cut(low, self.edits) for w in self.index.get(c, ())}
        ranked = sorted((distance(low, w), self.rank[w], w) for w in near)
        if not ranked or ranked[0][0] > self.edits:
            return word
        best = ranked[0][2]
        return best.upper() if word.isupper() else best.capitalize() if word[0].isupper() else best

    def line(self, line: str) -> str:
        out = []
        for w in line.split():
            bare = re.sub(r"[^\w]", "", w)
            if not bare:
                out.append(w)
                continue
            new = self.word(bare)
            out.append(("(" if w[0] == "(" else "") + new + (w[-1] if w[-1] in "),." else ""))
        return " ".join(out)

    def text(self, text: str) -> str:
        return "\n".join(map(self.line, text.split("\n")))

    def unknown(self, text: str) -> list[tuple[str, str]]:
        """Words that would be corrected, with their corrections."""
        return [(w, c) for w in re.findall(r"\b[a-zA-Z]{3,}\b", text) if (c := self.word(w)) != w]


def corrected(col, words: Iterable[str], edits: int = 1):
    """A column of corrected texts; null stays null."""
    speller: Callable[[str], str] = Speller(words, edits).text

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(speller, na_action="ignore")

    return run(col)
