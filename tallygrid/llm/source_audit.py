"""Divergence of sources by their terms: systolic rotation.

Each group, a source within a language, has a share p of each of the language's kept terms. Two groups diverge by the sum of
(p - q)^2 / (p + q) over all kept terms, and a group is marked by the terms that it has more of than its language.

The groups of a language are dealt to blocks, and its terms to chunks; a cell, one block's counts of one chunk, stays where it is. Compressed vectors of
cells circulate in the rounds of a round-robin tournament, so that each two blocks of a chunk meet once, and a meeting gives the divergence of its pairs in
both directions. A chunk's part of a sum is added to the others' afterwards. Heaps in each cell rank the terms of its groups, and the
best of all cells are ranked again. Vectors hold terms that a group has; the rest have one share, so what they add is known by their number.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import checkpoint, saved

#: Documents of a language that a kept term is in at least, ranks of terms, blocks of a language at most, counts in a chunk about, distinct counts that a task holds.
LEAST, TOP, BLOCKS, CHUNK, HELD = 10, 10, 8, 50_000, 400_000
#: Fixed value: a share of all terms.
ONE = 1_000_000_000

#: Bytes of terms: letters (A-Z become a-z) and all beyond ASCII; others separate.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8; a null text has none."""
    return (text or "").encode().translate(_TERM).split()


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """1 + ONE * (count + 2) // whole, by long division in thousands: exact while ``whole`` is below 9e15."""
    if not whole:
        return np.zeros(len(counts), np.int64)
    digit, rest = np.divmod(counts.astype(np.int64) + 2, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        digit = digit * 1000 + more
    return digit + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(p - q)^2 // (p + q); two shares of nothing do not diverge."""
    return (p - q) ** 2 // np.maximum(p + q, 1)


def counted(docs: DataFrame, lang_col: str, source_col: str, text_col: str, held: int = HELD) -> DataFrame:
    """``(lang, source, term, df, tf)``: documents and occurrences of each term, added up in each task, and a row with an empty term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (df, tf) in groups.items():
                terms = [b"", *tf]
                cols = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *(df[t] for t in tf)], pa.int64()), pa.array([0, *tf.values()], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "df", "tf"])
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                df, tf = groups.setdefault((lang, source), (Counter(), Counter()))
                words, before = terms_of(text.as_py()), len(tf)
                tf.update(words)
                df.update(set(words))
                size += len(tf) - before
                if size > held:
                    yield from out()
                    size = 0
        yield from out()

    named = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (lang_col, source_col)), F.col(f"`{text_col}`"))
    return named.mapInArrow(run, "lang string, source string, term string, df long, tf long")


def _pack(*columns: np.ndarray) -> bytes:
    return zlib.compress(np.stack([c.astype(np.int64) for c in columns]).tobytes(), 1)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.int64).reshape(n, -1)


def celled(rows: DataFrame) -> DataFrame:
    """``(lang, chunk, block, vectors, terms, totals)``: the counts of each cell, compressed, as columns slot, id and tf; ids of -1 have a group's whole.

    ``rows(lang, chunk, block, slot, id, tf, term, total)`` are at most about a chunk's counts and a block's groups a cell.
    """
    packed = rows.groupBy("lang", "chunk", "block").agg(F.sort_array(F.collect_list(F.struct("slot", "id", "tf", "total", "term"))).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, terms, totals = [], [], []
            for cell in batch.column(3):
                r = cell.values
                slot, ids, tf, total = (r.field(k).to_numpy().astype(np.int64) for k in ("slot", "id", "tf", "total"))
                own, first = np.unique(ids, return_index=True)
                first = first[own >= 0]
                vectors.append(_pack(slot, ids, tf))
                terms.append(r.field("term").take(pa.array(first)).to_pylist())
                totals.append(_pack(own[own >= 0], total[first]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(vectors, pa.binary()), pa.array(terms, pa.list_(pa.string())), pa.array(totals, pa.binary())], ["lang", "chunk", "block", "vectors", "terms", "totals"])

    return packed.mapInArrow(run, "lang string, chunk int, block int, vectors binary, terms array<string>, totals binary")


def _groups(raw: bytes) -> dict[int, tuple[np.ndarray, np.ndarray, int, int]]:
    """slot -> ids and shares of its terms, the share of all others, and its whole."""
    slot, ids, tf = _unpack(raw, 3)
    out = {}
    for s in np.unique(slot).tolist():
        own = slot == s
        at, n = ids[own], tf[own]
        whole = int(n[at < 0][0])
        out[s] = (at[at >= 0], shares(n[at >= 0], whole), int(shares(np.zeros(1, np.int64), whole)[0]), whole)
    return out


def meeting(mine: dict, peers: dict, same: bool) -> list[tuple[int, int, int]]:
    """``(slot, slot, part)`` of every pair of a meeting, both ways; the part is what terms of either add beyond what a term of neither does."""
    width = 1 + max([-1, *(int(x[0].max()) for g in (mine, peers) for x in g.values() if len(x[0]))])
    p, has, out = np.zeros(width, np.int64), np.zeros(width, bool), []
    for a, (ids_a, p_a, rest_a, _) in mine.items():
        p[ids_a], has[ids_a] = p_a, True
        for b, (ids_b, p_b, rest_b, _) in peers.items():
            if same and b <= a:
                continue
            other = np.full(width, rest_b, np.int64)
            other[ids_b] = p_b
            alone = ids_b[~has[ids_b]]
            none = int(divergence(np.array([rest_a]), np.array([rest_b]))[0])
            part = int((divergence(p_a, other[ids_a]) - none).sum() + (divergence(np.full(len(alone), rest_a), other[alone]) - none).sum())
            out += [(a, b, part), (b, a, part)]
        has[ids_a] = False
    return out


def opponent(block: Column, n: Column, turn: int) -> Column:
    """The block that meets ``block`` in a turn of the tournament of ``n`` blocks (an even number), by the circle method."""
    around = n - 1
    half = F.pmod(F.lit(turn) * (around + 1) / 2, around).cast("int")
    across = F.pmod(F.lit(turn) - block, around).cast("int")
    return F.when(block == around, half).when(across == block, around).otherwise(across)


def _met(resident: DataFrame, visiting: DataFrame, same: bool) -> DataFrame:
    """``(lang, slot, peer, part)`` of all meetings of cells with what visits them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                mine, peers = _groups(batch.column(1)[k].as_py()), _groups(batch.column(2)[k].as_py())
                found = meeting(mine, peers, same)
                lang = batch.column(0)[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), *(pa.array([x[c] for x in found], pa.int64()) for c in range(3))], ["lang", "slot", "peer", "part"])

    both = resident.select("lang", "chunk", "block", F.col("vectors").alias("own")).join(visiting, ["lang", "chunk", "block"])
    return both.select("lang", "own", "vectors").mapInArrow(run, "lang string, slot long, peer long, part long")


def _marks(cells: DataFrame, top: int) -> DataFrame:
    """``(lang, slot, term, value)``: the best terms of each group in each cell, by a heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, raw, terms, totals, whole in zip(*(batch.column(c) for c in range(5)), strict=True):
                ids, total = _unpack(totals.as_py(), 2)
                q, names = shares(total, whole.as_py() or 0), terms.as_py()
                for slot, (own, p, _, _) in _groups(raw.as_py()).items():
                    at = np.searchsorted(ids, own)
                    above = np.flatnonzero(p > q[at])
                    value = divergence(p[above], q[at[above]])
                    best = heapq.nsmallest(top, zip((-value).tolist(), (names[i].encode() for i in at[above].tolist()), strict=True))
                    found += [(lang.as_py(), slot, t.decode(), -v) for v, t in best]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], ["lang", "slot", "term", "value"])

    return cells.select("lang", "vectors", "terms", "totals", "whole_lang").mapInArrow(run, "lang string, slot long, term string, value long")


def audit(
    docs: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    text_col: str = "text",
    least: int = LEAST,
    top: int = TOP,
    blocks: int = BLOCKS,
    chunk: int = CHUNK,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for every group its divergence from each other source of its language (``pair``), and its marks (``term``).

    Null languages, sources and texts are empty ones. A group without terms has shares like any other; without kept terms all divergences
    of a language are 0. Very long texts are counted in their row, repeated rows each count. Equal values rank by UTF-8. An
    empty table gives none; other columns are not read. Rows grow with the square of a language's sources, as the result has a row for each two.
    """
    if chunk < 1 or blocks < 1:
        raise ValueError("chunk and blocks must be positive")
    by_term = Window.partitionBy("lang", "term")
    counts = counted(docs, lang_col, source_col, text_col).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    over = counts.withColumns({"docs": F.sum("df").over(by_term), "total": F.sum("tf").over(by_term), "first": F.row_number().over(by_term.orderBy("source")) == 1})
    kept = saved(over.where((F.col("docs") >= least) | (F.col("term") == "")).select("lang", "source", "term", "tf", "total", "first"))

    term = F.col("term") != ""
    wholes = kept.groupBy("lang", "source").agg(F.sum("tf").alias("n"), F.count_if(term).alias("entries"), F.count_if(term & F.col("first")).alias("v"))
    of_lang = wholes.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("n").alias("n_lang"), F.sum("entries").alias("entries"), F.count(F.lit(1)).alias("n_groups"))
    sized = of_lang.select(
        "lang",
        "v",
        (F.col("n_lang") + 2 * F.col("v")).alias("whole_lang"),
        F.greatest(F.lit(1), F.ceil(F.col("entries") / chunk)).cast("int").alias("chunks"),
        F.least(F.lit(blocks), "n_groups").cast("int").alias("n_blocks"),
    ).withColumn("places", (F.col("n_blocks") + F.col("n_blocks") % 2).cast("int"))
    slots = wholes.select("lang", "source", "n", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("slot"))
    groups = checkpoint(slots.join(sized, "lang").withColumn("whole", F.col("n") + 2 * F.col("v")).withColumn("block", F.pmod("slot", F.col("n_blocks")).cast("int")))

    names = kept.where(term & F.col("first")).join(sized.select("lang", "chunks"), "lang").select("lang", "term", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int").alias("chunk"))
    ids = names.repartition("lang", "chunk").withColumn("id", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    of_group = groups.select("lang", "source", "slot", "block")
    held = kept.where(term).join(ids, ["lang", "term"]).join(of_group, ["lang", "source"]).select("lang", "chunk", "block", "slot", "id", "tf", "total", "term")
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block", "slot", F.lit(-1).alias("id"), F.col("whole").alias("tf"), F.lit(0).cast("long").alias("total"), F.lit("").alias("term"))
    cells = saved(celled(held.unionByName(heads))).join(sized.select("lang", "places", "whole_lang"), "lang")
    cells = checkpoint(cells.repartition("lang", "chunk", "block"))

    turns = (groups.agg(F.max("places").alias("p")).first()["p"] or 0) - 1
    met = _met(cells, cells.select("lang", "chunk", "block", "vectors"), True)
    for turn in range(turns):
        guests = cells.select("lang", "chunk", "places", F.col("block").alias("from"), "vectors").where(F.col("places") > turn + 1)
        moved = guests.withColumn("block", opponent(F.col("from"), F.col("places"), turn)).where(F.col("block") < F.col("from")).select("lang", "chunk", "block", "vectors")
        met = met.unionByName(_met(cells, moved, False))

    mine, peer = groups.select("lang", "slot", "source", "whole", "v"), groups.select("lang", F.col("slot").alias("peer"), F.col("source").alias("item"), F.col("whole").alias("w"))
    p, q = (F.when(F.col(w) > 0, F.expr(f"{2 * ONE} div {w} + 1")).otherwise(0) for w in ("whole", "w"))
    none = F.when(F.col("v") > 0, F.expr("(p - q) * (p - q) div (p + q)")).otherwise(0)
    summed = met.groupBy("lang", "slot", "peer").agg(F.sum("part").alias("part")).join(mine, ["lang", "slot"]).join(peer, ["lang", "peer"])
    pairs = summed.withColumns({"p": p, "q": q}).select("lang", "source", F.lit("pair").alias("part"), "item", (F.col("part") + F.col("v") * none).cast("long").alias("value"))
    marks = _marks(cells, top).join(mine, ["lang", "slot"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = pairs.unionByName(marks).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
