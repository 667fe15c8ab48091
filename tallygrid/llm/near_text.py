"""Near-duplicate texts by the similarity of their word shingles, for the pipeline.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. Candidates come first from SimHash: sets have
fingerprints of 64 bits, and Golay keys find all that differ in three bits or fewer. At 0.8 fingerprints differ in ten bits or so, beyond those keys, so the
candidates of MinHash are added: 120 minima in 24 bands of five. A pair at 0.8 shares a band with probability 0.9999, a more similar one with more. Every candidate is verified on its whole sets.

Texts with equal sets are one row before any pair is made. In a bucket of at most ``SMALL`` sets all pairs are candidates. A
larger one is a group of copies, whose members are closest to the text that they were made of; each set is compared with the bucket's most central
set, that which meets most sets in all its buckets together, and with the least. These links leave one large component and outsiders. What links the
outsiders have is found exactly, around each central set. A few of the sets around it give a common stock of shingles, and each set is what it lacks of the stock and what it
has besides, which is little. Two sets share the stock but what either lacks, and in addition what both lack, counted on bits, and what both have besides. That is compared a block of
sets with another at a time, and gives a set one link to a component at most, so a large group makes no square of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm import simhash_golay
from tallygrid.llm.common import checkpoint, components, pick_rows, row_name, saved

#: Words of a shingle, the similarity of linked texts, bands and minima of a band, and sets of a bucket of which all pairs are made.
SHINGLE, SIMILARITY, BANDS, DEPTH, SMALL = 5, 0.8, 24, 5, 32
#: Fixed value: the seed of hashes and of the permutations.
SEED = 42
#: Shingles that are permuted at once, sets that make a stock of shingles, and sets of a block that are compared with those of another at once.
CHUNK, STOCK, BLOCK = 4096, 15, 256

_RANDOM = np.random.default_rng(SEED)
_MASKS = _RANDOM.integers(0, 1 << 63, (BANDS * DEPTH, 1), dtype=np.uint64)
_FACTORS = _RANDOM.integers(0, 1 << 63, (BANDS * DEPTH, 1), dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct XXH64 values of a text's word shingles; a shorter text is one shingle, one without words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64))


def buckets(hashes: np.ndarray) -> list[int]:
    """One bucket of each band, as signed longs; none without shingles."""
    if not len(hashes):
        return []
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), CHUNK):
        mixed = (hashes[None, k : k + CHUNK] ^ _MASKS) * _FACTORS
        np.minimum(least, mixed.min(axis=1), out=least)
    raw = least.tobytes()
    width = 8 * DEPTH
    return np.array([xxhash.xxh64_intdigest(raw[b * width : (b + 1) * width], b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of shingles as a signed long: a bit is set that is in over half of the hashes; zero without any."""
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, digest, name, key, fp, buckets)`` of every row; ``key`` names the set of shingles, ``fp`` is its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(3)]
            keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            cols = [*batch.columns[:3], pa.array(keys), pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array([buckets(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "digest", "name", "key", "fp", "buckets"])

    marked = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(text_col, F.lit(""))).alias("digest"), row_name(id_col, text_col).alias("name"), text_col)
    return marked.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, digest string, name string, key long, fp long, buckets array<long>")


def hashed(docs: DataFrame, of: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(key, hashes)`` of the rows that ``of(key, name)`` names, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["key", "hashes"])

    texts = docs.select(row_name(id_col, text_col).alias("name"), F.col(text_col).alias("text"))
    return texts.join(of, "name").dropDuplicates(["name"]).select("key", "text").mapInArrow(run, "key long, hashes binary")


def near_fingerprints(sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of keys in ``sets(key, fp)`` by their fingerprints: each key with the least of its fingerprint, and the least of fingerprints that differ in three bits or fewer."""
    least = checkpoint(sets.groupBy("fp").agg(F.min("key").alias("least")))
    same = sets.join(least, "fp").select("key", F.col("least").alias("other"))
    of = lambda end: least.select(F.col("fp").alias(end), F.col("least").alias(f"key_{end}"))
    near = simhash_golay.links(least).join(of("a"), "a").join(of("b"), "b").select(F.col("key_a").alias("key"), F.col("key_b").alias("other"))
    return same.unionByName(near).where("key <> other").select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))


def candidates(sets: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``(a, b)``, a < b, of keys in ``sets(key, buckets)``, and ``(key, centre)`` of the sets in large buckets: see the module for which."""
    each = sets.select("key", F.explode("buckets").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).where("n > 1")
    met = checkpoint(each.join(shared, "bucket"))
    large = met.where(F.col("n") > small)
    weight = met.groupBy("key").agg(F.sum("n").alias("weight"))
    central = large.select("key", "bucket").join(weight, "key").groupBy("bucket").agg(F.max(F.struct("weight", "key")).alias("c")).select("bucket", F.col("c.key").alias("central"))
    around = checkpoint(large.join(central, "bucket").select("key", "central", "least").distinct())
    star = around.select("key", F.explode(F.array("central", "least")).alias("other"))
    two = met.where((F.col("n") <= small) & (F.col("n") == 2)).select("key", F.explode(F.array("least", "most")).alias("other"))
    few = met.where((F.col("n") <= small) & (F.col("n") > 2)).groupBy("bucket").agg(F.collect_list("key").alias("keys"))
    every = few.select("keys", F.explode("keys").alias("key")).select("key", F.explode("keys").alias("other"))
    pairs = star.union(two).union(every).where("key <> other").select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()
    return pairs, around.where("key <> central").select("key", F.col("central").alias("centre")).distinct()


def stocks(around: DataFrame, sets: DataFrame) -> DataFrame:
    """``(centre, stock)``: the shingles that half of the centre's set and ``STOCK`` of the sets around it have; any stock gives the same links, a good one fast."""
    ranked = around.withColumn("rank", F.row_number().over(Window.partitionBy("centre").orderBy(F.xxhash64("key"), "key"))).where(F.col("rank") <= STOCK)
    some = ranked.select("key", "centre").unionByName(around.select(F.col("centre").alias("key"), "centre").distinct())
    held = some.join(sets, "key").groupBy("centre").agg(F.collect_list("hashes").alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for every in batch.column(1):
                values, n = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in every.values]), return_counts=True)
                out.append(values[2 * n >= len(every.values)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["centre", "stock"])

    return held.select("centre", "all").mapInArrow(run, "centre long, stock binary")


def apart_from(own: np.ndarray, stock: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """What a set lacks of a stock, as bits in words of 64 and their number, and what it has besides."""
    lacks = ~np.isin(stock, own, assume_unique=True)
    bits = np.packbits(lacks)
    return bits.tobytes() + b"\0" * (-len(bits) % 8), int(lacks.sum()), own[~np.isin(own, stock, assume_unique=True)]


def described(placed: DataFrame, sets: DataFrame, stock: DataFrame) -> DataFrame:
    """``placed(key, centre, label)`` with ``n_stock, n_lacks, lacks, n_more, more`` around its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own, base in zip(batch.column(3), batch.column(4), strict=True):
                base = np.frombuffer(base.as_py(), np.uint64)
                bits, n, more = apart_from(np.frombuffer(own.as_py(), np.uint64), base)
                rows.append((len(base), n, bits, len(more), more.view(np.int64).tolist()))
            kinds = (("n_stock", pa.int64()), ("n_lacks", pa.int64()), ("lacks", pa.binary()), ("n_more", pa.int64()), ("more", pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds))], ["key", "centre", "label", *(n for n, _ in kinds)])

    both = placed.join(sets, "key").join(stock, "centre").select("key", "centre", "label", "hashes", "stock")
    return both.mapInArrow(run, "key long, centre long, label long, n_stock long, n_lacks long, lacks binary, n_more long, more array<long>")


def terms(least: float) -> tuple[int, int]:
    """p and q: two sets are similar if q times what they share is p times the sum of their sizes or more."""
    share = Fraction(least).limit_denominator(10_000)
    share /= 1 + share
    return share.numerator, share.denominator


def met(outside: dict, every: dict, least: float) -> set[tuple[int, int]]:
    """Pairs of labels, of a set of ``outside`` and a similar one of ``every`` of another component. Both are columns of sets around one centre."""
    (p, q), out = terms(least), set()
    bits = [np.frombuffer(b"".join(g["lacks"]), np.uint64).reshape(len(g["lacks"]), -1) for g in (outside, every)]
    far = [(q - p) * g["n_lacks"] + p * g["n_more"] for g in (outside, every)]
    owner = np.repeat(np.arange(len(every["label"])), every["n_more"])
    tokens = np.concatenate([np.asarray(m, np.int64) for m in every["more"]]) if len(owner) else np.zeros(0, np.int64)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    for k, label in enumerate(outside["label"].tolist()):
        shared = np.bitwise_count(bits[0][k] & bits[1]).sum(axis=1, dtype=np.int64)
        own = np.asarray(outside["more"][k], np.int64)
        low, high = np.searchsorted(tokens, own), np.searchsorted(tokens, own, "right")
        for a, b in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True):
            shared[owner[a:b]] += 1
        near = q * shared >= far[0][k] + far[1] - (q - 2 * p) * int(outside["n_stock"][0])
        out |= {(label, other) for other in np.unique(every["label"][near]).tolist() if other != label}
    return out


def outsiders(around: DataFrame, sets: DataFrame, found: DataFrame, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Links ``(a, b)`` beyond the stars: labels of ``found(key, label)`` of which sets around one centre are similar."""
    labelled = around.join(found, "key", "left").select("key", "centre", F.coalesce("label", "key").alias("label"))
    apart = labelled.groupBy("centre").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("centre")
    placed = checkpoint(labelled.join(apart, "centre").select("key", "centre", "label"))
    stock = saved(stocks(placed.select("key", "centre"), sets))
    rows = saved(described(placed, sets, stock))
    near = F.min(F.struct((F.col("n_lacks") + F.col("n_more")).alias("far"), "key", "label"))
    main = rows.groupBy("centre").agg(near.alias("m"), F.count(F.lit(1)).alias("n")).select("centre", F.col("m.label").alias("main"), F.ceil(F.col("n") / block).alias("blocks"))

    columns = ("label", "n_stock", "n_lacks", "lacks", "n_more", "more")
    dealt = rows.join(main, "centre").select("centre", *columns, (F.col("label") != F.col("main")).alias("out"), F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block"))
    packed = lambda d, name: d.groupBy("centre", "block").agg(F.collect_list(F.struct(*columns)).alias(name)).withColumnRenamed("block", f"block_{name}")
    blocks = packed(dealt.where("out"), "outside").join(packed(dealt, "every"), "centre").repartition("centre", "block_outside", "block_every").select("outside", "every")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one, other = ({c: g.field(c).to_pylist() if c in ("lacks", "more") else g.field(c).to_numpy() for c in columns} for g in (batch.column(i)[k].values for i in range(2)))
                pairs = list(met(one, other, least))
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(2)], ["a", "b"])

    return blocks.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The ``pairs(a, b)`` whose ``sets(key, hashes)`` have a similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2), batch.column(3), strict=True)
            ok = [similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= least for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    of = lambda end: sets.select(F.col("key").alias(end), F.col("hashes").alias(f"h_{end}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "h_a", "h_b").mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", small: int = SMALL) -> DataFrame:
    """The rows of ``docs`` with one row of each component of similar texts: that of the smallest id, null ids last.

    Among rows with the same id, the one whose text has the smallest digest stays, once however often it is repeated; of rows that differ
    in other columns only, the least by a digest of these. Null and empty texts have no words and are copies of each other. A very long
    text is one set of shingles in memory. An empty table gives none. Other columns, whatever their names, are as they were. Texts
    move twice: those of candidates to be verified, and all to be matched with the rows that stay.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest", "name")).alias("s")
    of_key = saved(signed(docs, id_col, text_col).groupBy("key").agg(first, F.first("fp").alias("fp"), F.first("buckets").alias("buckets")))
    pairs, around = candidates(of_key.select("key", "buckets"), small)
    pairs = checkpoint(near_fingerprints(of_key.select("key", "fp")).union(pairs).distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = saved(hashed(docs, of_key.select("key", "s.name").join(asked, "key", "left_semi"), id_col, text_col))
    found = components(links(pairs, sets)).toDF("key", "label")
    merged = components(outsiders(around, sets, found)).toDF("label", "top")
    named = of_key.select("key", "s").join(found, "key", "left").withColumn("label", F.coalesce("label", "key")).join(merged, "label", "left")
    stay = named.groupBy(F.coalesce("top", "label").alias("label")).agg(F.min("s").alias("s")).select("s.name")
    return pick_rows(docs, stay, id_col, text_col)
