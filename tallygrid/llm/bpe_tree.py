"""Byte-level BPE by monoid tree reduction.

Text is split into matches of the tokenizer's pattern, and each match into tokens by lowest-rank-first merges. Both
levels are built as trees: a long input is halved until the halves are small, the halves are encoded on their own, and
two neighbours are joined by encoding a window around their border anew.

*Tokens.* A sequence of tokens is the encoding of its bytes if and only if each two neighbours, encoded together, stay
these two tokens: the first merge across a border in the whole would also be the first across it in the pair, since
until then both runs make the same merges on the two sides, in the same order. So a window may grow by doubling until
the pairs at its two edges are stable, and then nothing outside can change.

*Matches.* The pattern looks at most one character past a match, or three past its start, and never back. A match of the
left half that keeps that distance from the border is final; matching goes on from the first that does not, and stops
where it meets a border between matches of the right half, from which on all matches are the same.

Decoding joins the bytes of the tokens up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Characters of a text, and bytes of a match, that are encoded without halving.
LEAF_CHARS, LEAF_BYTES = 1 << 11, 16
#: Ids that are decoded without halving.
LEAF_IDS = 256
#: Entries of a worker's caches of matches and of pairs; a full cache is emptied.
CACHE = 250_000
#: Characters that the pattern may look at beyond the start of a match.
LOOK = 3

RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES, leaf_ids: int = LEAF_IDS):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.token[r] = b
        self.find = regex.compile(pattern)
        self.leaf_chars, self.leaf_bytes, self.leaf_ids = max(leaf_chars, 2 * LOOK), max(leaf_bytes, 2), max(leaf_ids, 1)
        self.packed: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # tokens of one match

    def merge(self, data: bytes) -> list[int]:
        """Merges of the lowest rank first, the leftmost of equals, by a heap over a linked list."""
        ranks, n = self.ranks, len(data)
        if n < 2:
            return [ranks[data]] if n else []
        part: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            a, b = part[i], part[j]
            if a is None or b is None or after[i] != j or len(a) + len(b) != size:
                continue
            part[i], part[j] = a + b, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, k, size + len(part[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, i, size + len(part[h])))
        return [ranks[p] for p in part if p is not None]

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens stay apart when they are encoded together."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            mid = self.merge(b"".join(self.token[t] for t in left[a:] + right[:b]))
            if (a == 0 or self.stable(left[a - 1], mid[0])) and (b == len(right) or self.stable(mid[-1], right[b])):
                return left[:a] + mid + right[b:]
            k *= 2

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merge(data)
        m = len(data) // 2
        return self.join(self.tree(data[:m]), self.tree(data[m:]))

    def match_ids(self, match: str) -> list[int]:
        data = match.encode()
        whole = self.ranks.get(data)
        return self.tree(data) if whole is None else [whole]

    # matches of a text

    def matches(self, text: str) -> list[str]:
        if len(text) <= self.leaf_chars:
            return self.find.findall(text)
        m = len(text) // 2
        return self.join_matches(text, m, self.matches(text[:m]), self.matches(text[m:]))

    def join_matches(self, text: str, m: int, left: list[str], right: list[str]) -> list[str]:
        at = m
        while left and (at + 1 > m or at - len(left[-1]) + LOOK > m):
            at -= len(left.pop())
        while left:  # the last that stays must keep its distance too
            start = at - len(left[-1])
            if at + 1 <= m and start + LOOK <= m:
                break
            at -= len(left.pop())
        ends, p = {m: 0}, m
        for k, x in enumerate(right, 1):
            p += len(x)
            ends[p] = k
        for found in self.find.finditer(text, at):
            left.append(found.group())
            if (k := ends.get(found.end())) is not None:
                return left + right[k:]
        return left

    # whole texts

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        packed, out = self.packed, []
        for x in self.matches(text):
            y = packed.get(x)
            if y is None:
                if len(packed) >= CACHE:
                    packed.clear()
                ids = self.match_ids(x)
                y = struct.pack(f"<{len(ids)}I", *ids)
                if len(x) <= 64:
                    packed[x] = y
            out.append(y)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ``ids``, concatenated up a tree: halves are decoded on their own until they are small, and then joined."""
        if len(ids) <= self.leaf_ids:
            token = self.token
            return b"".join([token[i] for i in ids])
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


_loaded: dict[tuple, TreeBPE] = {}


def coder(path: str, pattern: str) -> TreeBPE:
    """One coder a worker process and vocabulary."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = TreeBPE(load_ranks(path), pattern)
    return _loaded[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each whole text: ``id_col``, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ``ids``.

    ``path`` is a rank file that every executor has, ``pattern`` the split before the merges. A null or empty text has
    no tokens. Repeated rows give repeated results; other columns are left aside; an empty table gives none. A very long text is
    halved in its row, which must fit in memory. Rows are independent: no shuffle.
    """
    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, {RESULT}" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for batch in batches:
            n, ids, back, kept = [], [], [], []
            for text in batch.column(1):
                packed = c.encode_packed(text.as_py() or "")
                seq = np.frombuffer(packed, "<u4").tolist()
                n.append(len(seq))
                ids.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(c.decode(seq)).hexdigest())
                if with_ids:
                    kept.append(seq)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
