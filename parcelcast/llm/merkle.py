"""Merkle manifest of a table: every row a leaf, a tree per source, a tree over the sources' roots.

Leaves get their number within their source by a range partitioned sort and the partitions' counts, without a window
over a whole source. A block of ``RUN ** LEVELS`` consecutive nodes is one window partition: at level k, a node is kept
by its first leaf's row, so its siblings are ``RUN ** k`` rows before or after it. Fixed-offset lag and lead columns,
masked by slot and run length, supply them, and the rows of first children hash the parents. Blocks' roots are the
nodes of the next block level, until one node remains in each group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelcast.llm.common import written

RUN = 3
LEVELS = 7
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_PATH = "cast(array() as array<struct<l: string, r: string>>)"


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, joined as they are."""
    return F.sha2(F.concat(*parts), 256)


def _framed(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(row: dict[str, Column]) -> Column:
    return digest(*[_framed(row[c]) for c in LEAF_COLUMNS])


def numbered(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` with ``i``, the place of a row within its group ``g`` by ``order`` (nulls first), and ``n``, the group's rows.

    Rows are sorted by ranges; a group's rows before a range are the sum of its counts in earlier ones.
    """
    kept = written(nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("_at", F.monotonically_increasing_id()), name)
    kept = kept.withColumn("_part", F.shiftright("_at", 33))
    counts = kept.groupBy("_part", "g").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("g")
    earlier = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(F.col("_part").alias("_p"), F.col("g").alias("_g"), (earlier - F.col("_first")).alias("_base"), F.sum("_n").over(own).alias("n"))
    joined = kept.join(base, (F.col("_part") == F.col("_p")) & F.col("g").eqNullSafe(F.col("_g")))
    return joined.select(*nodes.columns, (F.col("_at") + F.col("_base")).alias("i"), "n")


def _climbed(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (g, i, n, h) with ``block``, the siblings (left, right) at each level as ``path``, and in the first row of
    each block the block's root as ``up``."""
    size = RUN ** levels
    rows = nodes.withColumns({"block": F.expr(f"i div {size}"), "h0": F.col("h")})
    w = Window.partitionBy("g", "block").orderBy("i")
    for k in range(levels):
        step = RUN ** k
        h = F.col(f"h{k}")
        rows = rows.withColumns({f"{side}{d}": f(h, d * step).over(w) for side, f in (("_b", F.lag), ("_f", F.lead)) for d in range(1, RUN)})
        place, count = F.expr(f"i div {step}"), F.expr(f"(n + {step - 1}) div {step}")
        slot, first = F.pmod(place, F.lit(RUN)), F.expr(f"i % {step} = 0")
        length = F.least(F.lit(RUN).cast("long"), count - place + slot)
        left = F.concat(*[F.when(slot >= d, F.col(f"_b{d}")).otherwise("") for d in range(RUN - 1, 0, -1)])
        right = F.concat(*[F.when(slot + d < length, F.col(f"_f{d}")).otherwise("") for d in range(1, RUN)])
        rows = rows.withColumns({"_first": first, "_many": count > 1, "_slot": slot, "_left": left, "_right": right})
        rows = rows.withColumns({
            f"s{k}": F.when(F.col("_first") & F.col("_many"), F.struct(F.col("_left").alias("l"), F.col("_right").alias("r"))),
            f"h{k + 1}": F.when(F.col("_first") & (F.col("_slot") == 0), F.when(F.col("_many"), digest(h, F.col("_right"))).otherwise(h))})
        rows = rows.drop("_first", "_many", "_slot", "_left", "_right", *[f"{s}{d}" for s in ("_b", "_f") for d in range(1, RUN)])
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"s{k}": F.last(f"s{k}", ignorenulls=True).over(so_far) for k in range(levels)})
    path = F.filter(F.array(*[f"s{k}" for k in range(levels)]), lambda s: s.isNotNull())
    return rows.select(*nodes.columns, "block", path.alias("path"), F.col(f"h{levels}").alias("up"))


def tree(nodes: DataFrame, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``nodes`` (g, i, n, h, others) with ``path``, the siblings on the way up, and what ``finish`` adds to the one node
    (with ``path``) that remains of each group."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return finish(nodes)
    levels = 1
    while levels < LEVELS and RUN ** levels < most:
        levels += 1
    size = RUN ** levels
    low = written(_climbed(nodes, levels), "merkle-block")
    heads = low.where(f"i % {size} = 0").select("g", F.col("block").alias("i"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("up").alias("h"))
    top = tree(heads, finish)
    added = [c for c in top.columns if c not in ("g", "i", "n", "h", "path")]
    top = top.select(F.col("g").alias("_g"), F.col("i").alias("_i"), F.col("path").alias("_path"), *added)
    joined = low.join(top, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_i")))
    return joined.select(*nodes.columns, F.concat("path", "_path").alias("path"), *added)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["l"], h, s["r"]))


def siblings_hash(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""))


def manifest(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, held_leaf, path, subroot, root) for every row of ``docs``.

    ``held`` is the text that someone holds instead of the row's own; where it differs, ``held_leaf`` is the leaf that it
    gives, else null. Missing values are hashed as such: a null source is a source of its own, null ids come first. Rows
    with equal ids are ordered by their leaves, so repeated rows have equal results but for their place. An empty table
    has no rows and no root; other columns don't count, whatever their names.
    """
    row = {c: docs[f"`{c}`"] for c in LEAF_COLUMNS}
    changed = F.lit(None).cast("string") if held is None else F.when(~held.eqNullSafe(row["text"]), leaf_hash(row | {"text": held}))
    leaves = docs.select(row["source"].cast("string").alias("g"), row["doc_id"].cast("long").alias("doc_id"), leaf_hash(row).alias("h"), changed.alias("held_leaf"))

    def over_sources(subroots: DataFrame) -> DataFrame:
        subroots = written(subroots, "merkle-subroots")
        one = subroots.select(F.lit(0).alias("g"), F.col("g").alias("source"), "h")
        empty = F.expr(_NO_PATH)
        top = tree(numbered(one, ["source"], "merkle-sources"), lambda last: last.withColumns({"path": empty, "root": F.col("h")}))
        top = top.select(F.col("source").alias("_source"), "path", "root")
        return subroots.join(top, F.col("g").eqNullSafe(F.col("_source"))).drop("_source").withColumn("subroot", F.col("h"))

    found = tree(numbered(leaves, ["doc_id", "h"], "merkle-leaves"), over_sources)
    return found.select("doc_id", F.col("g").alias("source"), F.col("h").alias("leaf"), "held_leaf", "path", "subroot", "root")
