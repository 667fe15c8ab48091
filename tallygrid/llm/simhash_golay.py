"""Near-duplicate groups by SimHash fingerprints and Golay-code fuzzy keys.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, each a word of the perfect (23, 12) Golay code with
its spare bits zero. A word x decodes to the one codeword c(x) within distance 3. If x and y differ in at most one bit, c(x)
is within distance 4 of y; only words at distance 3 from their own codeword have others at distance 4, and they have five.
So a word has one key where it is indexed, c(x), and one or six where it is looked up.

Fingerprints that differ in at most 3 bits share a key, by counting the errors of their segments (pigeonhole):

* two segments have one error at most, and unless all three have just one, one of these two has none. A key of the exact
  bits of segment i and a codeword of segment j, for the six ordered pairs (i, j), finds all such pairs;
* with one error in each segment, the parity of each segment's weight flips and one half of the last segment is
  untouched. A key of that half, the codewords of the first two segments and the three parities finds these.

A fingerprint is thus indexed under 8 keys and looked up under at most 6 * 6 + 2 * 36, all of 34 bits or more, so chance
meetings stay rare. Candidates are verified by counting bits. Copies share a fingerprint and are one row before any pair is
made; a fingerprint has at most 43,744 others within 3 bits, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.common import checkpoint, components, pick_rows, row_name

#: The generator polynomial of the Golay code, the widths of the segments, and the shingles' hash seed.
GOLAY, WIDTHS, SEED = 0b101011100011, (22, 21, 21), 42
#: Words of a shingle, and bits that linked fingerprints may differ in.
SHINGLE, BITS = 3, 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash over the XXH64 values of word shingles; ties at half of them give a zero bit, no words give zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype=">u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Every row of ``docs`` with its text replaced by ``fp``, the fingerprint as a signed long.

    Null and empty texts have the fingerprint zero; repeated rows each have one; a very long text is read whole, in its row; an empty table gives none.
    """
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(len(rest))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(fps)], [*rest, "fp"])

    kinds = dict(docs.dtypes)
    return docs.select(*rest, text_col).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "fp long"]))


# the code


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    r = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GOLAY << (bit - 11)), r)
    return r


@cache
def near_patterns() -> np.ndarray:
    """By syndrome: the error to the nearest codeword, then the errors to those at distance 4, or -1."""
    out = np.full((2048, 6), -1, np.int64)
    for weight in (0, 1, 2, 3, 4):
        words = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)], np.uint32)
        for s, w in zip(syndrome(words).tolist(), words.tolist(), strict=True):
            out[s, int((out[s] >= 0).sum())] = w
    return out


def codewords(words: np.ndarray) -> np.ndarray:
    """The 12-bit indices of the codewords near each word: (n, 6), the nearest first, -1 where there are no more."""
    errors = near_patterns()[syndrome(words)]
    return np.where(errors >= 0, (words[:, None].astype(np.int64) ^ errors) >> 11, -1)


def keys(fps: np.ndarray, lookup: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the keys under which fingerprints are indexed, or looked up."""
    fps = fps.view(np.uint64)
    segs, at = [], 0
    for w in WIDTHS:
        segs.append((fps >> np.uint64(at) & np.uint64((1 << w) - 1)).astype(np.int64))
        at += w
    near = [codewords(s) if lookup else codewords(s)[:, :1] for s in segs]
    rows, out = [], []

    def add(tag: int, base: np.ndarray, *codes: np.ndarray) -> None:
        key, ok = base, np.ones(len(base), bool)
        for c in codes:
            key, ok = key << 12 | np.maximum(c, 0), ok & (c >= 0)
        rows.append(np.flatnonzero(ok))
        out.append((key | tag << 58)[ok])

    for tag, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if i != j):
        for m in range(near[j].shape[1]):
            add(tag, segs[i], near[j][:, m])
    parity = sum((np.bitwise_count(s).astype(np.int64) & 1 ^ int(lookup)) << i for i, s in enumerate(segs))
    for half, part in enumerate((segs[2] & 0x3FF, segs[2] >> 10)):
        base = part << 3 | parity
        for m in range(near[0].shape[1]):
            for n in range(near[1].shape[1]):
                add(6 + half, base, near[0][:, m], near[1][:, n])
    return np.concatenate(rows), np.concatenate(out)


def keyed(fps: DataFrame, lookup: bool) -> DataFrame:
    """``(key, fp)`` rows of distinct fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(values), 2000):
                part = values[k : k + 2000]
                rows, out = keys(part, lookup)
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(part[rows])], ["key", "fp"])

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of distinct fingerprints that differ in at most ``bits`` (3 or fewer) bits."""
    if not 0 <= bits <= 3:
        raise ValueError("the keys find all pairs up to 3 bits")
    x = keyed(fps, False).toDF("key", "x")
    y = keyed(fps, True).toDF("key", "y")
    met = x.join(y, (x["key"] == y["key"]) & (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= bits))
    return met.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprinted rows, with all columns of ``docs`` but the text, and ``(fp, label, component_id)``."""
    rows = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    fps = checkpoint(rows.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = components(links(fps.select("fp"), bits)).toDF("fp", "label")
    named = fps.join(found, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return rows, checkpoint(named.join(least, "label").select("fp", "label", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``(id_col, fp, label, component_id)`` for every row of ``docs``.

    ``label`` names the component (its smallest fingerprint as a signed long); ``component_id`` is the smallest id in it,
    null ids aside, or null if it has no other. Null and empty texts have the fingerprint zero, and are linked like any
    other. Repeated rows and repeated ids each keep their row. Very long texts are read whole, in their row; an empty table gives none; other columns are not read.
    """
    rows, of_fp = _grouped(docs.select(id_col, text_col), id_col, text_col, shingle, bits)
    return rows.join(of_fp, "fp").select(id_col, "fp", "label", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest id, null ids last.

    Among rows with the same id, the one whose text has the smallest digest stays, and of rows that differ in other columns only, the
    least by the digest of all their columns. Only ids and digests are gathered by component; texts are moved once, to be matched.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.md5(F.coalesce(text_col, F.lit(""))).alias("digest"), row_name(id_col, text_col).alias("name"))
    rows, of_fp = _grouped(named, "id", "text", shingle, bits)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "name")).alias("s")
    return pick_rows(docs, rows.join(of_fp, "fp").groupBy("label").agg(first).select("s.name"), id_col, text_col)
