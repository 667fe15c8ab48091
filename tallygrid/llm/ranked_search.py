"""Ranked lexical search by Fagin's threshold algorithm.

Documents are indexed in segments. A segment holds, for each term of the queries, the list of its documents sorted by impact, and a
forward index, which gives the impacts of any document at random. For a query the lists of its terms are read round-robin, some entries of
each in turn; a document that is met for the first time is scored whole by the forward index. The threshold, the score that a document not met yet
can reach at most, is the sum of the impacts last read. Reading stops once it falls strictly below the kth score: at the same
score, a document that is still unread can go first by its id.

Spark counts terms, documents and lengths over all documents, cuts segments where documents lie, and merges the best of all segments. A task carries its kth
scores from segment to segment, so that later segments stop earlier. No list of a term is ever in one place.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import checkpoint, saved

#: Results of a query; documents of a segment at most; cells of a segment's forward index; entries first read of each list in a turn; characters of queries in a block.
K, SEGMENT, CELLS, FIRST, BLOCK_CHARS = 10, 4096, 1 << 24, 16, 4_000_000
#: Of the score's parts, weight x (ONE x tf) div (1000 x tf + 8 x length share in percent, at least REST).
ONE, REST, LENGTH = 1_000_000_000, 25, 75

#: Bytes of terms: digits, letters (A-Z become a-z) and all beyond ASCII; others separate.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8; a null text has none."""
    return (text or "").encode().translate(_TERM).split()


def weight(n_docs: int, df: int) -> int:
    """The weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def counted(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """``(id, n, terms, tfs)`` of every document with a term: how many terms it has, and which of ``vocabulary`` (by place) how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: k for k, t in enumerate(vocabulary)}.get
        for batch in batches:
            sizes, ends, terms, tfs = [], [0], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                found = Counter(map(place, words))
                found.pop(None, None)
                sizes.append(len(words))
                terms += found.keys()
                tfs += found.values()
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tfs)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "tfs"])
            yield out.filter(pa.array([n > 0 for n in sizes], pa.bool_()))

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, n long, terms array<int>, tfs array<int>")


class Segment:
    """Documents in order of id, with the impact-sorted lists of terms ``low`` to ``high`` and a forward index by document and term.

    An impact is kept without the term's weight, as it is the same along a list; below 1,000,000, as the fixed values have it.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, asked: np.ndarray):
        own = np.searchsorted(asked, term)
        inside = (own < len(asked)) & (asked[np.minimum(own, len(asked) - 1)] == term)
        doc, own, impact = doc[inside], own[inside], impact[inside]
        self.forward = np.zeros((n_docs, len(asked)), np.int32)
        self.forward[doc, own] = impact
        order = np.lexsort((-impact, own))
        self.docs, self.impacts = doc[order], impact[order].astype(np.int64)
        self.starts = np.searchsorted(own[order], np.arange(len(asked) + 1))
        self.seen = np.zeros(n_docs, bool)

    def best(self, terms: np.ndarray, weights: np.ndarray, floor: int, k: int, first: int = FIRST) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents and scores of all that can be among the ``k`` best (more, if scores are equal), where only scores of ``floor`` or more matter; and how many entries were read."""
        starts, ends = self.starts[terms], self.starts[terms + 1]
        live = ends > starts
        terms, weights, starts, ends = terms[live], weights[live], starts[live], ends[live]
        docs, scores, depth, step, read = [np.zeros(0, np.int64)], np.zeros(0, np.int64), 0, first, 0
        kth = max(floor, 1)
        while len(terms):
            spans = [self.docs[a + depth : min(a + depth + step, b)] for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if a + depth < b]
            met = np.concatenate(spans)
            read += len(met)
            new = np.unique(met[~self.seen[met]])
            self.seen[new] = True
            docs.append(new)
            scores = np.concatenate([scores, self.forward[new[:, None], terms].astype(np.int64) @ weights])
            if len(scores) >= k:
                kth = max(kth, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            depth, step = depth + step, step * 2
            more = starts + depth < ends
            if not more.any():
                break
            last = np.where(more, self.impacts[np.minimum(starts + depth - 1, ends - 1)], 0)
            if int(last @ weights) < kth:
                break
        docs = np.concatenate(docs)
        self.seen[docs] = False
        good = scores >= kth
        return docs[good], scores[good], read


def _runs(queries: list[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[list[int]]:
    """Queries in runs that together ask for at most ``most`` distinct terms; one that asks for more is a run alone."""
    run, asked = [], set()
    for q, (terms, _) in enumerate(queries):
        more = asked | set(terms.tolist())
        if run and len(more) > most:
            yield run
            run, more = [], set(terms.tolist())
        run.append(q)
        asked = more
    if run:
        yield run


def _order(ids: list) -> list:
    """Keys by which ids sort, null ones last."""
    return [(x is None, x if x is not None else 0) for x in ids]


def _searched(counts: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int, kind: str, segment: int) -> DataFrame:
    """``(query, id, score)`` of the best ``k`` documents of each task, for queries as (places of terms, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]
        runs = list(_runs(queries, max(1, CELLS // segment)))

        def search(part: pa.Table) -> None:
            ids = part.column("id").to_pylist()
            order = sorted(range(len(ids)), key=_order(ids).__getitem__)
            ids, part = [ids[i] for i in order], part.take(pa.array(order)).combine_chunks()
            lists = [part.column(c).combine_chunks() for c in ("terms", "tfs")]
            term, tf = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            doc = np.repeat(np.arange(len(ids)), np.diff(lists[0].offsets.to_numpy()))
            length = REST + LENGTH * part.column("n").to_numpy().astype(np.int64) * n_docs // n_terms
            impact = ONE * tf // (1000 * tf + 8 * length[doc])
            for some in runs:
                asked = np.unique(np.concatenate([queries[q][0] for q in some]))
                index = Segment(doc, term, impact, len(ids), asked)
                for q in some:
                    terms, weights = queries[q]
                    floor = best[q][-1][0] if len(best[q]) == k else 1
                    at, scores, _ = index.best(np.searchsorted(asked, terms), weights, floor, k)
                    if len(at):
                        rank = np.lexsort((at, -scores))[:k]
                        merged = best[q] + [(int(scores[r]), ids[at[r]]) for r in rank]
                        best[q] = sorted(merged, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]

        held, rows = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, segment):
                part = batch.slice(a, segment)
                if rows + part.num_rows > segment:
                    search(pa.Table.from_batches(held))
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if held:
            search(pa.Table.from_batches(held))
        found = [(q, d, s) for q, x in enumerate(best) for s, d in x]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], ids_type[0]), pa.array([x[2] for x in found], pa.int64())], ["query", "id", "score"])

    ids_type = [pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()]
    return counts.mapInArrow(run, f"query int, id {kind}, score long")


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    query_col: str = "item_id",
    query_text_col: str = "text",
    segment: int = SEGMENT,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``(query_col, rank, id_col, score)``: the ``k`` best documents of every row of ``queries``, those of score above 0; equal scores by ascending id, null ids last.

    Null and empty texts have no terms: as documents they count nowhere, as queries they find nothing. A very long text is counted in its
    row. Repeated documents each have a rank; repeated queries each have their results, under the same ``query_col``. Ids are longs, ints or strings. Distinct texts
    of queries are read by the driver in blocks of about ``block_chars`` characters, however many there are, and each block meets all documents. An
    empty table on either side gives no rows. Other columns are not read.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    if kind not in ("bigint", "int", "string"):
        raise ValueError(f"ids of type {kind}")
    asked = queries.select(F.col(f"`{query_col}`").alias("query"), F.col(f"`{query_text_col}`").alias("text")).where("length(text) > 0").withColumn("digest", F.md5("text"))
    texts = checkpoint(asked.groupBy("digest").agg(F.first("text").alias("text")))
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()["c"]
    blocks = max(1, -(-chars // block_chars))
    found = []
    for b in range(blocks):
        some = texts.where(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == b).collect()
        said = [Counter(terms_of(r["text"])) for r in some]
        vocabulary = sorted(set().union(*said))
        place = {t: i for i, t in enumerate(vocabulary)}
        counts = saved(counted(docs, vocabulary, id_col, text_col))
        whole = counts.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        dfs = dict(counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weights = {t: weight(whole["docs"], dfs.get(i, 0)) for t, i in place.items()}
        numbers = [(np.array([place[t] for t in s], np.int64), np.array([weights[t] * c for t, c in s.items()], np.int64)) for s in said]
        size = min(segment, max(1, CELLS // max([1, *map(len, said)])))
        best = _searched(counts.where(F.size("terms") > 0), numbers, whole["docs"], max(1, whole["terms"]), k, kind, size)
        names = spark.createDataFrame([(i, r["digest"]) for i, r in enumerate(some)], "query int, digest string")
        by_score = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        found.append(ranked.join(F.broadcast(names), "query").select("digest", "rank", "id", "score"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return asked.join(out, "digest").select(F.col("query").alias(query_col), "rank", F.col("id").alias(id_col), "score")
