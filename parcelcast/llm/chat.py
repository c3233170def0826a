"""Reply trees as conversations: every chosen root-to-leaf path in a reversible chat template with a loss mask.

A turn is an opening mark, the text, a space and a closing mark; other roles than the three known carry their name.
Marks that occur inside a text (or name) get a backslash before them and the backslashes already there are doubled, so
no text can close its turn and reading back gives each text as it was.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelcast.llm.common import by_batch, written

#: Opening and closing marks by role; fixed, as readers of the format need them.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", " </s>"), "system": ("<<SYS>>", " <</SYS>>")}
OTHER = ("<<ROLE>>", " <</ROLE>>", " <<END>>")
_CONTROL = r"(\\*)(\[/?INST\]|</?s>|<</?SYS>>|<</?ROLE>>|<<END>>)"
_ESCAPED = re.compile(_CONTROL)
_NO_TREE = -(1 << 63)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1$1\\$2")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" * (len(m[1]) // 2) + m[2], text)


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, place, node) of the chosen root-to-leaf paths of ``messages`` (tree, node, parent, score).

    Ancestors at distance 1, 2, 4, ... come from joining the last such table with itself; leaves then take these steps
    from the longest to the shortest, which meets every ancestor once. A branch's score is the mean of its messages'
    scores (null counts as 0); ``branches`` of the best of each tree are kept, all where it is None, ties by leaf. A
    message whose parent isn't there is a root. Raises on replies that form a circle.
    """
    nodes = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("tree", F.col("node").alias("parent"))
    up = [written(nodes.join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("above")), "replies")]
    n = up[0].count()
    while n:
        if len(up) > math.log2(n) + 2 and len(up) > 62:
            raise ValueError("replies form a circle")
        last = up[-1]
        higher = last.select("tree", F.col("node").alias("above"), F.col("above").alias("next"))
        step = written(last.join(higher, ["tree", "above"]).select("tree", "node", F.col("next").alias("above")), "replies")
        n = step.count()
        if n:
            up.append(step)
    parents = up[0].select("tree", F.col("above").alias("node")).distinct()
    found = nodes.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("back"))
    for k in reversed(range(len(up))):
        more = found.join(up[k], ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("back") + (1 << k)).alias("back"))
        found = written(found.union(more), "paths")
    scored = found.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"), F.max("back").alias("depth"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    scored = scored.withColumn("rank", rank)
    if branches is not None:
        scored = scored.where(F.col("rank") <= branches)
    return found.join(scored, ["tree", "leaf"]).select("tree", "leaf", "rank", (F.col("depth") - F.col("back")).alias("place"), "node")


def chain(rows: DataFrame) -> DataFrame:
    """Messages of conversations (conv_id, turn, role, text): each turn answers the one before; rows that share a turn
    follow one another by role and text. Null ids are one conversation, null turns come first."""
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = rows.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(_NO_TREE)).alias("tree"), F.col("turn").cast("long").alias("turn"),
                       F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(conv_id, leaf, rank, formatted, loss_starts, loss_ends): one row for each chosen path of ``messages``
    (tree, node, parent, score, role, text). The loss ranges, in code points of ``formatted``, are what assistants said.
    Null texts and role names count as empty; an empty table gives an empty result; other columns are not read."""
    messages = written(messages.select("tree", "node", "parent", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), "messages")
    body = escape(F.col("text"))
    opening, closing = F.concat(F.lit(OTHER[0]), escape(F.col("role")), F.lit(OTHER[1])), F.lit(OTHER[2])
    for role, (a, b) in MARKS.items():
        opening, closing = F.when(F.col("role") == role, F.lit(a)).otherwise(opening), F.when(F.col("role") == role, F.lit(b)).otherwise(closing)
    said = messages.select("tree", "node", F.struct(opening.alias("a"), body.alias("t"), closing.alias("b"), (F.col("role") == "assistant").alias("loss")).alias("m"))
    turns = paths(messages, branches).join(said, ["tree", "node"]).groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("place", "m"))).alias("turns"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, starts, ends = [], [], []
            for turns in b.column("turns").to_pylist():
                parts, at, begin, stop = [], 0, [], []
                for x in turns:
                    m = x["m"]
                    at += len(m["a"])
                    if m["loss"]:
                        begin.append(at)
                        stop.append(at + len(m["t"]))
                    at += len(m["t"]) + len(m["b"])
                    parts += (m["a"], m["t"], m["b"])
                texts.append("".join(parts))
                starts.append(begin)
                ends.append(stop)
            ids = [None if t == _NO_TREE else t for t in b.column("tree").to_pylist()]
            lists = pa.list_(pa.int64())
            yield pa.record_batch([pa.array(ids, pa.int64()), b.column("leaf"), b.column("rank"), pa.array(texts, pa.string()), pa.array(starts, lists), pa.array(ends, lists)],
                                  names=["conv_id", "leaf", "rank", "formatted", "loss_starts", "loss_ends"])

    return by_batch(turns, write, "conv_id long, leaf long, rank int, formatted string, loss_starts array<bigint>, loss_ends array<bigint>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation, as they were before formatting."""
    out, at = [], 0
    while at < len(formatted):
        role = next((r for r, (a, _) in MARKS.items() if formatted.startswith(a, at)), None)
        if role is None:
            if not formatted.startswith(OTHER[0], at):
                raise ValueError(f"no opening mark at {at}")
            stop = formatted.index(OTHER[1], at)
            role, at, close = unescape(formatted[at + len(OTHER[0]):stop]), stop + len(OTHER[1]), OTHER[2]
        else:
            at, close = at + len(MARKS[role][0]), MARKS[role][1]
        stop = formatted.index(close, at)
        out.append((role, unescape(formatted[at:stop])))
        at = stop + len(close)
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: numbers and hashes of turns and of the text under the loss mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, starts, ends in zip(*(b.column(c).to_pylist() for c in ("formatted", "loss_starts", "loss_ends"))):
                turns = parse(text)
                loss = "".join(unescape(text[i:j]) for i, j in zip(starts, ends))
                rows.append((len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.record_batch([b.column("conv_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                  names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return by_batch(formatted, read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
