"""Reply trees as training conversations.

A tree's messages know their parents. Self-joins that double their reach give each message its ancestors 1, 2, 4, ... steps
up with the sum of scores on the way, so a path of n messages takes log2(n) joins. The leaves of a tree are ranked by the
score of their whole path, the chosen ones gather their ancestors by the same jumps, and each chosen path is formatted as one conversation.

The template is ``<s>``, then for each turn one of

    [INST] text [/INST]                for the role user
     text</s>                          for the role assistant, with a space before
    [TURN role] text [/TURN]           for any other role

Control strings inside a text get a backslash after their first character, and those that look like an escaped one get one
more, so texts read back as they were. The loss mask covers the assistants' texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.llm.common import checkpoint

#: The control strings' first characters and rests.
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|TURN |/TURN\])"
_ESCAPE, _UNESCAPE = re.compile(CONTROL), re.compile(CONTROL.replace(r"(\\*)", r"\\(\\*)"))
_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|\[TURN (?P<role>[^\]]*)\] (?P<other>.*?) \[/TURN\]| (?P<assistant>.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and the spans of it (in code points) that carry loss."""
    out, at, spans = ["<s>"], 3, []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            piece = f"[INST] {body} [/INST]"
        elif role == "assistant":
            spans.append((at + 1, at + 1 + len(body)))
            piece = f" {body}</s>"
        else:
            piece = f"[TURN {role.replace('%', '%25').replace(']', '%5D')}] {body} [/TURN]"
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    if not text.startswith("<s>"):
        raise ValueError("not a conversation of this template")
    turns, at = [], 3
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        if m["user"] is not None:
            turns.append(("user", unescape(m["user"])))
        elif m["assistant"] is not None:
            turns.append(("assistant", unescape(m["assistant"])))
        else:
            turns.append((m["role"].replace("%5D", "]").replace("%25", "%"), unescape(m["other"])))
        at = m.end()
    return turns


def jumps(nodes: DataFrame) -> list[DataFrame]:
    """``nodes(tree, node, parent, score)`` -> for k = 0, 1, ...: ``(tree, node, up, far, sum)``.

    ``up`` is the ancestor 2^k steps up, or null beyond the root; ``far`` and ``sum`` are the steps and the scores from the node
    up to, not with, that ancestor. A parent that the tree does not have counts as null. The last has no ``up`` except on cycles.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    step = checkpoint(nodes.join(known, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.lit(1).alias("far"), F.col("score").alias("sum")))
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    out = [step]
    while 2 ** (len(out) - 1) < largest and step.where("up is not null").limit(1).count():
        higher = step.select("tree", F.col("node").alias("up"), F.col("up").alias("top"), F.col("far").alias("far2"), F.col("sum").alias("sum2"))
        # only messages that are not at their root yet take part
        on = step.where("up is not null").join(higher, ["tree", "up"]).select("tree", "node", F.col("top").alias("up"), (F.col("far") + F.col("far2")).alias("far"), (F.col("sum") + F.col("sum2")).alias("sum"))
        step = checkpoint(step.where("up is null").unionByName(on))
        out.append(step)
    return out


def best_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """``nodes(tree, node, parent, score)`` -> ``(tree, leaf, rank, node, depth)``: each tree's ``branches`` best paths.

    A path goes from a root to a leaf; its score is the sum of its messages' scores, a null score counting 0. Equal scores are ranked by leaf. A
    message without a parent in the tree is a root; messages that lead into a cycle are on no path. (tree, node) must be unique and not null.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    up = jumps(nodes)
    leaves = up[-1].where("up is null").join(nodes.select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("sum"), "node"))
    chosen = checkpoint(leaves.withColumn("rank", rank).where(F.col("rank") <= branches).select("tree", F.col("node").alias("leaf"), "rank", "node", F.col("far").alias("depth")))
    for step in up[:-1]:
        above = chosen.join(step.where("up is not null").select("tree", "node", "up", "far"), ["tree", "node"])
        chosen = checkpoint(chosen.unionByName(above.select("tree", "leaf", "rank", F.col("up").alias("node"), (F.col("depth") - F.col("far")).alias("depth"))))
    return chosen


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
        spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in got], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        rest = [c for c in batch.schema.names if c != "turns"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([t for t, _ in got], pa.string()), spans], [*rest, "formatted", "loss_spans"])


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``messages(tree, node, parent, score, role, text)`` -> ``(tree, rank, formatted, loss_spans)``.

    Null texts and roles are empty. See ``best_paths`` for which paths; an empty table gives none. A conversation is one row, so one must fit in memory. Rows with a null
    tree or node belong to no conversation and are left out; ``chain`` gives rows of a null conversation a tree of their own.
    """
    paths = best_paths(messages, branches)
    texts = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(texts, ["tree", "node"]).groupBy("tree", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    return turns.mapInArrow(_render, f"tree {dict(messages.dtypes)['tree']}, rank int, formatted string, loss_spans array<struct<start:int,end:int>>")


def chain(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Plain conversations as trees of one branch: each turn replies to the one before it.

    Turns are ordered by number, nulls first, then by role and text, so repeated turns all stay. A null conversation id is one conversation.
    """
    order = Window.partitionBy(conv_col).orderBy(F.col(turn_col).asc_nulls_first(), role_col, text_col)
    node = F.row_number().over(order)
    return rows.select(F.coalesce(F.col(conv_col).cast("string"), F.lit("")).alias("tree"), node.alias("node"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
            turns = parse(text)
            loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
            rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), *cols], ["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from ``formatted`` and ``loss_spans`` alone.

    A conversation, however long, is parsed as a whole; repeated ones each give a row; an empty table gives none. A null ``formatted`` is no
    conversation, and what is not in the template raises ValueError. Other columns are left aside.
    """
    return formatted.where("formatted IS NOT NULL").select("tree", "formatted", "loss_spans").mapInArrow(_digests, f"tree {dict(formatted.dtypes)['tree']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
