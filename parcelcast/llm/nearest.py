"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every vector is filed in ``TABLES`` tables under the slots of its normal projections. A neighbour at distance d of a
query has projections that differ by normal variates of deviation d, which gives the chance that it lies in a bucket:
the product, over the projections, of the normal mass of its slot. A query visits a table's buckets in falling order of
that chance until their sum reaches the share that all tables need to miss less than ``MISS`` together; so near a slot's
edge it goes to the perturbed bucket early. Candidates of all visited buckets get their exact distances.

The slots' width and d come from a bounded sample: ``SAMPLE`` rows with the smallest hashes, whose exact neighbours
among all rows are found first. Buckets are dealt to shards by their leading slots. Shards and the queries that visit
them are cut into blocks of bounded size, and each block of rows meets each block of queries, so no bucket is capped.
Queries that find too few candidates are compared with all rows, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelcast.llm.common import binaries, by_batch, mix, ship, spans, written

TABLES = 4
MISS = 0.04               # of the neighbours at the sampled distance
SAMPLE = 128
BUCKET = 128              # rows of a bucket to aim at
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
ASKED_IN_TASK = 64
_ERF = np.vectorize(math.erf)


@dataclass
class Tables:
    """Projections of all tables, and how far a neighbour is expected."""
    axes: np.ndarray          # (tables, slots of a bucket, dimension)
    shift: np.ndarray
    width: float
    distance: float
    shards: int

    def slots(self, x: np.ndarray) -> np.ndarray:
        """(tables, rows, slots) numbers of the slots."""
        return np.floor((np.einsum("tkd,nd->tnk", self.axes, x) + self.shift[:, None]) / self.width).astype(np.int64)

    def keys(self, slots: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of a bucket, and its shard, which the leading half of its slots chooses."""
        h = mix(np.asarray(table, np.uint64) + np.uint64(1))
        lead = None
        for k in range(slots.shape[-1]):
            h = mix(h ^ slots[..., k].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
            lead = h if k == slots.shape[-1] // 2 else lead
        return h, (lead % np.uint64(self.shards)).astype(np.int64)

    def visited(self, table: int, x: np.ndarray, share: float) -> np.ndarray:
        """Slots of the buckets that ``x`` visits in a table, likeliest first, until their chances sum to ``share``."""
        at = (self.axes[table] @ x + self.shift[table]) / self.width
        spread = max(self.distance / self.width, 1e-9)
        reach = int(math.ceil(4 * spread)) + 1
        near = np.floor(at).astype(np.int64)[:, None] + np.arange(-reach, reach + 1)
        cdf = lambda z: 0.5 * (1 + _ERF((z - at[:, None]) / (spread * math.sqrt(2))))
        chance = np.log(np.maximum(cdf(near + 1) - cdf(near), 1e-300))
        order = np.argsort(-chance, axis=1, kind="stable")
        near, chance = np.take_along_axis(near, order, 1), np.take_along_axis(chance, order, 1)
        loss, likeliest, budget = chance[:, :1] - chance, chance[:, 0].sum(), 1.0
        while True:               # all buckets within a loss of ``budget`` of the likeliest one
            picked, total = np.zeros((1, 0), np.int64), np.zeros(1)
            for k in range(len(at)):
                few = loss[k] <= budget
                both = (total[:, None] + loss[k][few]).ravel()
                keep = both <= budget
                picked = np.concatenate([np.repeat(picked, few.sum(), axis=0), np.tile(near[k][few], len(total))[:, None]], axis=1)[keep]
                total = both[keep]
            mass = np.exp(likeliest - total)
            if mass.sum() >= share or budget > 60:
                order = np.argsort(total, kind="stable")
                return picked[order][:int(np.searchsorted(np.cumsum(mass[order]), share)) + 1]
            budget *= 1.25


def v_type(rows: DataFrame, vector: str) -> str:
    return next(t for c, t in rows.dtypes if c == vector)


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a vector of the table's most frequent length, not zero, with
    finite components only."""
    v = rows[f"`{vector}`"]
    if v_type(rows, vector) != "array<float>":      # single numbers are kept as they are
        v = v.cast("array<double>")
    good = rows.select(rows["vec_id"].cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)) & F.exists("v", lambda x: x != 0))
    most = good.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return good.where(F.size("v") == (most["w"] if most else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows (id, distance) of one query, ties to the smaller id."""
    other = ids != own
    x, ids = x[other], ids[other]
    score = np.sqrt(((x - q) ** 2).sum(axis=1))
    if len(score) > 4 * k:
        near = score <= np.partition(score, 4 * k)[4 * k] if len(np.unique(ids)) == len(ids) else np.ones(len(ids), bool)
        score, ids = score[near], ids[near]
    order = np.lexsort((ids, score))
    order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]       # a row of each id
    return ids[order], score[order]


def _exact(rows: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of each asked (vec_id, v) within every task's rows."""
    qid = asked.column("vec_id").to_numpy()
    shared = rows.sparkSession.sparkContext.broadcast((qid, _matrix(asked.column("v").combine_chunks()) if len(qid) else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        best = [(np.zeros(0, np.int64), np.zeros((0, q.shape[1])))] * len(own) if q is not None else []
        for b in batches:
            x, ids = _matrix(b.column("v")), b.column("vec_id").to_numpy()
            for i in range(len(best)):
                near, _ = _nearest(x, ids, q[i], own[i], k)
                at = np.flatnonzero(np.isin(ids, near))
                xs, all_ids = np.concatenate([best[i][1], x[at]]), np.concatenate([best[i][0], ids[at]])
                score = np.sqrt(((xs - q[i]) ** 2).sum(axis=1))
                order = np.lexsort((all_ids, score))
                order = order[np.sort(np.unique(all_ids[order], return_index=True)[1])][:k]
                best[i] = all_ids[order], xs[order]
        for i, (near, xs) in enumerate(best):
            if own[i] in near:
                near, xs = near[near != own[i]], xs[near != own[i]]
            yield pa.record_batch([pa.array(np.full(len(near), own[i])), pa.array(near), pa.array(np.sqrt(((xs - q[i]) ** 2).sum(axis=1)))], names=["query_id", "vec_id", "score"])

    return by_batch(rows, run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """A row of each pair (the nearest, where an id has several vectors), the k nearest of each query."""
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def fit(rows: DataFrame, n: int, k: int) -> Tables:
    """Slot width, slots of a bucket and expected distance from ``SAMPLE`` rows of (vec_id, v)."""
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(13)), "vec_id").limit(SAMPLE).toArrow()
    x = _matrix(sample.column("v").combine_chunks())
    found = _ranked(_exact(rows, sample, k), k).groupBy("query_id").agg(F.max("score").alias("d")).collect()      # a row of each sampled query
    distance = float(np.quantile([r.d for r in found], 0.9)) if found else 0.0
    centred = x - x.mean(axis=0)
    scale = float(np.sqrt((centred ** 2).sum(axis=1).mean())) or float(np.abs(x).max())
    slots = max(2, round(math.log2(max(2.0, n / BUCKET))))
    rng = np.random.default_rng(17)
    return Tables(rng.normal(size=(TABLES, slots, x.shape[1])), rng.uniform(0, 2 * scale, (TABLES, slots)), 2 * scale, distance, n * TABLES // SHARD_ROWS + 1)


def _dealt(shard: np.ndarray, columns: list[np.ndarray]) -> tuple[pa.Array, pa.Array, list[pa.Array]]:
    order = np.argsort(shard, kind="stable")
    used, counts = np.unique(shard[order], return_counts=True)
    cut = np.concatenate(([0], np.cumsum(counts)))
    return pa.array(used), pa.array(counts), [binaries(c[order].ravel(), cut * (c[0].size if len(c) else 1)) for c in columns]


def _filed(rows: DataFrame, tables: Tables, kind: type) -> DataFrame:
    """Packed rows of each shard: bucket hashes, ids and vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = _matrix(b.column("v")), b.column("vec_id").to_numpy()
            slots = tables.slots(x)
            for t in range(TABLES):
                key, shard = tables.keys(slots[t], np.full(len(ids), t))
                used, counts, columns = _dealt(shard, [key, ids, x.astype(kind)])
                yield pa.record_batch([used, counts, *columns], names=["shard", "n", "key", "id", "v"])

    return by_batch(rows, run, "shard long, n long, key binary, id binary, v binary")


def _visits(queries: DataFrame, tables: Tables) -> DataFrame:
    """(shard, id, v, keys): the shards that a query goes to, and the buckets it visits there."""
    share = 1 - MISS ** (1 / TABLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, q in enumerate(_matrix(b.column("v"))):
                found = [tables.keys(s, np.full(len(s), t)) for t, s in ((t, tables.visited(t, q, share)) for t in range(TABLES))]
                key, shard = (np.concatenate([f[j] for f in found]) for j in range(2))
                used, _, (keys,) = _dealt(shard, [key])
                own = pa.array([q.tobytes()] * len(used), pa.binary())
                yield pa.record_batch([used, pa.array([b.column("vec_id")[i].as_py()] * len(used), pa.int64()), own, keys], names=["shard", "id", "v", "keys"])

    return by_batch(queries, run, "shard long, id long, v binary, keys binary")


def _blocks(size: int) -> Column:
    return F.ceil(F.col("total") / F.lit(size)).cast("long")


def search(rows: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k nearest rows found by Euclidean distance, nearest first, ties
    to the smaller id. ``is_query`` is a condition on ``vec_id``.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part, nor do
    rows without id. Rows that share an id are one candidate, at the nearest of their vectors, and never each other's
    neighbour; as queries, the smallest of their vectors asks. An empty table, or a single row, gives no rows. Other
    columns don't count, whatever their names.
    """
    spark = rows.sparkSession
    ship(spark)
    known = written(usable(rows, vector), "vectors")
    n = known.count()
    if n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = written(known.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    tables = fit(known, n, k)
    kind = np.float32 if dict(known.dtypes)["v"] == "array<float>" else np.float64
    filed = written(_filed(known, tables, kind), "buckets")
    parts = queries.count() // ASKED_IN_TASK + 1       # naming a query's buckets takes far longer than reading it
    visits = written(_visits(queries.repartition(parts, "vec_id"), tables), "visits")
    row_blocks = filed.groupBy("shard").agg(F.sum("n").alias("total")).select("shard", _blocks(SHARD_ROWS).alias("row_blocks"))
    query_blocks = visits.groupBy("shard").agg(F.count(F.lit(1)).alias("total")).select("shard", _blocks(BLOCK_QUERIES).alias("query_blocks"))
    sizes = written(row_blocks.join(query_blocks, "shard"), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = filed.join(sizes, "shard").withColumns({"a": F.pmod(F.xxhash64("id"), F.col("row_blocks")), "b": every("query_blocks")})
    right = visits.join(sizes, "shard").withColumns({"b": F.pmod(F.xxhash64("id"), F.col("query_blocks")), "a": every("row_blocks")})

    def compare(group: pa.Table, asked: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])
        if not group.num_rows or not asked.num_rows:
            return none
        join = lambda c, t: np.frombuffer(b"".join(x.as_py() for x in group.column(c)), t)
        key, ids = join("key", np.uint64), join("id", np.int64)
        x = join("v", kind).reshape(len(ids), -1).astype(np.float64)
        order = np.argsort(key, kind="stable")
        key, ids, x = key[order], ids[order], x[order]
        out = []
        for own, v, keys in zip(asked.column("id").to_pylist(), asked.column("v"), asked.column("keys")):
            wanted = np.frombuffer(keys.as_py(), np.uint64)
            first = np.searchsorted(key, wanted)
            at = spans(first, np.searchsorted(key, wanted, side="right") - first)
            if len(at):
                near, score = _nearest(x[at], ids[at], np.frombuffer(v.as_py(), np.float64), own, k)
                out.append(pa.table([pa.array(np.full(len(near), own)), pa.array(near), pa.array(score)], names=none.column_names))
        return pa.concat_tables(out) if out else none

    pairs = left.select("shard", "a", "b", "key", "id", "v").groupBy("shard", "a", "b").cogroup(right.select("shard", "a", "b", "id", "v", "keys").groupBy("shard", "a", "b"))
    ranked = written(_ranked(pairs.applyInArrow(compare, "query_id long, vec_id long, score double"), k), "neighbours")
    enough = ranked.where(F.col("rank") == min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    few = written(queries.join(enough, "vec_id", "left_anti"), "short-queries")
    blocks = -(-few.count() // BLOCK_QUERIES)
    for block in range(blocks):        # what the tables can't serve
        asked = few.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block)
        exact = _ranked(_exact(known, asked.toArrow(), k), k)
        ranked = ranked.join(asked.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(exact)
    return ranked
