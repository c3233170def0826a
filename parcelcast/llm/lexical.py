"""Ranked lexical search: hybrid term-at-a-time and document-at-a-time scoring over packed postings.

Tasks index steps of texts: one row per step with its documents in id order and, for the terms of the queries, postings
in document order. Counts over all rows give the terms' weights. Then tasks run every query over their index rows. The
query's short lists are summed term at a time into accumulators; these count as one list whose bound is the largest sum.
With the long lists they go into document-at-a-time skipping: lists whose bounds together stay below the query's k-th
best score so far bring up no document, and are looked up only for documents that can still reach that score. A task
carries its best scores from row to row, so later rows are mostly skipped, and sends k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelcast.llm.common import as_bytes, by_batch, hash_spans, steps, written

STEP = 6 << 20
QUERY_BYTES = 2 << 20        # of queries that are sent to the tasks at once
SHORT = 16                   # lists of at most a 16th of a step's documents are summed term at a time
WINDOW = 512                 # candidates between two looks at the k-th best score
NO_ID = np.iinfo(np.int64).max
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term of a text column, and the row it is in. Terms are runs of ASCII letters and digits and of all
    characters beyond ASCII; only A-Z count as their lower case."""
    data, at = as_bytes(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _WORD[data]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    before[edges], after[edges - 1] = False, False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return hash_spans(_LOWER[data], start, end), np.searchsorted(at, start, side="right") - 1


def _index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Rows of packed postings: documents (id, terms in all) in id order; of each known term the documents and counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in steps(batches, limit=STEP):
            ids = b.column("doc_id").fill_null(NO_ID).to_numpy()
            hashes, row = terms(b.column("text"))
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            n = np.bincount(row, minlength=len(ids))
            term = np.searchsorted(known, hashes)
            hit = np.flatnonzero(known[np.minimum(term, len(known) - 1)] == hashes) if len(known) else np.zeros(0, np.int64)
            cell, tf = np.unique(term[hit] * len(ids) + place[row[hit]], return_counts=True)
            own, df = np.unique(cell // max(1, len(ids)), return_counts=True)
            packed = [ids[order], n[order].astype(np.int32), (cell % max(1, len(ids))).astype(np.int32), tf.astype(np.int32)]
            columns = [pa.array([x.tobytes()], pa.binary()) for x in packed] + [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (own, df)]
            yield pa.record_batch([*columns, pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())],
                                  names=["ids", "n", "at", "tf", "terms", "df", "with_terms", "all_terms"])

    return by_batch(docs, run, "ids binary, n binary, at binary, tf binary, terms array<long>, df array<long>, with_terms long, all_terms long")


class _Best:
    """The k best (score, id) of a query so far; ``least`` is what a document must reach."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        keep = np.lexsort((ids, -scores))[:self.k]
        self.scores, self.ids = scores[keep], ids[keep]
        if len(keep) == self.k:
            self.least = int(self.scores[-1])


def _look_up(docs: np.ndarray, gains: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(docs, wanted), len(docs) - 1)
    return np.where(docs[at] == wanted, gains[at], 0)


def run_query(lists: list[tuple[np.ndarray, np.ndarray, int]], ids: np.ndarray, best: _Best, short: int) -> None:
    """Add to ``best`` what a step's lists (documents in order, gains, bound) give; documents are places in ``ids``."""
    if sum(x[2] for x in lists) < best.least:
        return
    brief = [x for x in lists if len(x[0]) <= short]
    rest = [x for x in lists if len(x[0]) > short]
    if brief:                                      # term at a time
        sums = np.zeros(len(ids), np.int64)
        for docs, gains, _ in brief:
            sums[docs] += gains
        docs = np.flatnonzero(sums)
        if len(docs):
            rest.append((docs, sums[docs], int(sums[docs].max())))
    rest.sort(key=lambda x: x[2])
    bounds = np.cumsum([x[2] for x in rest])
    after = -1
    while True:                                    # document at a time, a window of candidates in order
        first = int(np.searchsorted(bounds, best.least))       # lists before it can't reach the score together
        if first == len(rest):
            return
        parts = [x[0][np.searchsorted(x[0], after, side="right"):] for x in rest[first:]]
        parts = [p[:WINDOW] for p in parts if len(p)]
        if not parts:
            return
        stop = min(int(p[-1]) for p in parts if len(p) == WINDOW) if any(len(p) == WINDOW for p in parts) else len(ids)
        docs = np.unique(np.concatenate([p[:np.searchsorted(p, stop, side="right")] for p in parts]))
        after = stop
        scores = np.zeros(len(docs), np.int64)
        for own_docs, gains, _ in rest[first:]:
            scores += _look_up(own_docs, gains, docs)
        for k in range(first - 1, -1, -1):
            alive = scores + bounds[k] >= best.least
            docs, scores = docs[alive], scores[alive]
            if not len(docs):
                break
            scores += _look_up(*rest[k][:2], docs)
        good = scores >= best.least
        if good.any():
            best.add(scores[good], ids[docs[good]])


def _ranked(index: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast((asked, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, weight = shared.value
        best = [_Best(k) for _ in questions]
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n, at, tf = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("ids", np.int64), ("n", np.int32), ("at", np.int32), ("tf", np.int32)))
                own, df = (np.array(batch.column(c)[i].values, np.int64) for c in ("terms", "df"))
                if not len(own):
                    continue
                m = 100 - 75 + 75 * n.astype(np.int64) * n_docs // n_terms
                count = tf.astype(np.int64)
                gains = np.repeat(weight[own], df) * (1_000_000_000 * count // (1000 * count + 8 * m[at]))
                cut = np.concatenate(([0], np.cumsum(df)))
                most = np.maximum.reduceat(gains, cut[:-1])
                slot = np.full(len(weight), -1, np.int64)
                slot[own] = np.arange(len(own))
                for (wanted, times), found in zip(questions, best):
                    s = slot[wanted]
                    here = s >= 0
                    lists = [(at[cut[j]:cut[j + 1]], gains[cut[j]:cut[j + 1]] * t, int(most[j]) * t) for j, t in zip(s[here].tolist(), times[here].tolist()) if most[j]]
                    if lists:
                        run_query(lists, ids, found, len(ids) // SHORT)
        sizes = [len(b.ids) for b in best]
        if sum(sizes):
            found = np.concatenate([b.ids for b in best])
            yield pa.record_batch([pa.array(np.repeat(np.arange(len(best)), sizes)), pa.array(found, mask=found == NO_ID), pa.array(np.concatenate([b.scores for b in best]))],
                                  names=["query", "doc_id", "score"])

    return by_batch(index, run, "query long, doc_id long, score long")


def _first(rows: DataFrame, k: int, *groups: Column | str) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item by the weighted, length-normed term counts.

    Every row of ``docs`` is a document of its own, also where ids repeat; a null text has no terms, and of equal scores
    a null id comes last (the largest long stands for it and is not an id). Equal rows of ``items`` are one query, and of
    an id with several texts each text is one. Items without terms, or an empty table, give no rows. Queries are sent to
    the tasks in blocks of about ``QUERY_BYTES``, with an index of their own terms each.
    """
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    asked = items.select(items["item_id"].cast("long").alias("item_id"), F.coalesce(items["text"].cast("string"), F.lit("")).alias("text")).distinct()
    asked = written(asked, "queries")
    blocks = (asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // QUERY_BYTES + 1
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).toArrow()
        hashes, row = terms(rows.column("text").combine_chunks()) if rows.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        vocabulary, code = np.unique(hashes, return_inverse=True)
        index = written(_index(texts, vocabulary), "postings")
        n_docs, n_terms = index.agg(F.coalesce(F.sum("with_terms"), F.lit(0)), F.coalesce(F.sum("all_terms"), F.lit(0))).first()
        pairs = index.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).groupBy(F.col("p.terms").alias("term")).agg(F.sum("p.df").alias("df"))
        weights = np.zeros(len(vocabulary), np.int64)
        for r in pairs.collect():                  # a row for each term of the block's queries at most
            weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r.df + 1)))
        cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
        questions = [np.unique(code[cut[i]:cut[i + 1]], return_counts=True) for i in range(rows.num_rows)]
        found = _ranked(index, questions, weights, n_docs, max(1, n_terms), k)
        found = _first(found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))), k, "query", "part")
        names = spark.createDataFrame([(i, x) for i, x in enumerate(rows.column("item_id").to_pylist())], "query long, item_id long")
        ranked = _first(found.select("query", "doc_id", "score"), k, "query").join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out
