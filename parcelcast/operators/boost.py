"""Gradient-boosted regression trees on distributed gradient histograms.

The rows are binned once and written as byte matrices, one record per block of rows. Each task of a barrier stage keeps
its share of them in mapped scratch files until the model is ready, and in memory only which rows are in which node, eight bytes
a row: at a level it sums the gradients of its rows per (node, column, bin), the
tasks tell each other their sums, and each picks the same splits from all of them. A level reads of two children
the one with fewer rows; the other is the difference.

Where the tasks share no folder, hold too many rows, or how many can run at a time is not known, a level is one job over cached
blocks: the sums meet in a tree reduction, and the driver, which sees histograms only, picks the splits.
Scores are carried on there, never refitted: a task adds the trees that its block has not seen yet. It keeps the newest scores
in its worker, and every ``RENEW`` rounds the cached blocks take them up, so a lost block is read from the written table
again and gets all trees once more. The squared error of held-out rows comes with the first job of each round.

A table of one block has nothing to reduce: the loop then runs inside the one task that holds its rows.

An RDD of blocks, not a DataFrame, because thousands of short jobs over one cached table would each be planned anew.
"""

from __future__ import annotations

import base64
import json
import os
import re
import tempfile
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import RDD, BarrierTaskContext, StorageLevel
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from parcelcast.session import scratch_path, ship

BINS = 255                # of a column at most
BLOCK_ROWS = 1 << 16      # of a record, and of a task at least where there are as many
RENEW = 50                # rounds after which cached blocks take up their scores
KEPT_BYTES = 256 << 20    # of scores and nodes that one worker keeps
ROW_BYTES = 16            # of a row in the memory of a task that stays: its number in a node, with room for a copy
SEGMENT = 1 << 18         # rows of a task that are parted at a time
CHUNK = 1 << 15           # rows whose bins are summed at a time
CELLS = 1 << 12           # of columns that are summed together, at most: the product of their bins
STAGE_BYTES = 1 << 29     # of memory for the rows of a task that stays; beyond that the blocks are cached and a level is a job


SCORED, TREES_AT_ONCE = 1 << 15, 1 << 10      # leaves that are looked for at once, and trees
_LEAF = np.uint64(0x03F79D71B4CB0A89)      # whose 6 highest bits, times a power of two, tell which power (de Bruijn)


@dataclass
class Shape:
    """How the trees grow: defaults are those of a plain least-squares booster."""
    rounds: int
    depth: int
    rate: float = 0.05
    l2: float = 0.0
    least: int = 1                 # rows of a leaf
    leaves: int | None = None      # most leaves of a tree; the splits of smallest gain are left out
    row_share: float = 1.0
    column_share: float = 1.0
    seed: int = 42


@dataclass
class Trees:
    """Complete trees in heap order; a node that is not split sends all rows to the left."""
    start: float
    width: int
    feature: np.ndarray            # (trees, inner nodes)
    threshold: np.ndarray          # rows above it go right
    gain: np.ndarray
    value: np.ndarray              # (trees, leaves)
    errors: list[float] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.feature)

    def first(self, n: int) -> Trees:
        return Trees(self.start, self.width, self.feature[:n], self.threshold[:n], self.gain[:n], self.value[:n], self.errors[:n])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Each row's sum of leaves, tree after tree. Of trees with at most 64 leaves a row finds its leaf by bits: a split that
        sends the row to the right takes the leaves on its left away, and the leftmost that stays is the row's."""
        out = np.full(len(x), self.start)
        if self.value.shape[1] > 64:
            return self._walked(x, out)
        for bundles, values, first in self._bits:
            place = []
            for own, _ in bundles:
                at = np.zeros(len(x), np.int64)
                for j, cuts in own:      # a missing value goes to the left
                    at = at * (len(cuts) + 1) + np.where(np.isnan(x[:, j]), 0, np.searchsorted(cuts, x[:, j], side="left"))
                place.append(at)
            rows = max(32, SCORED // len(first))
            every = np.empty((3, min(rows, len(x)), len(first)), np.uint64)
            for low in range(0, len(x), rows):
                part = out[low:low + rows]
                left, seen, leaf = every[:, :len(part)]
                left.fill(2 ** 64 - 1)
                for at, (_, table) in zip(place, bundles):
                    np.bitwise_and(left, table.take(at[low:low + rows], axis=0, out=seen, mode="clip"), out=left)
                np.bitwise_and(left, np.negative(left, out=seen), out=left)          # the lowest bit
                np.right_shift(np.multiply(left, _LEAF, out=left), np.uint64(58), out=left)
                np.add(left.view(np.int64), first, out=seen.view(np.int64))
                leaf = leaf.view(np.float64).reshape(len(first), len(part))
                values.take(seen.view(np.int64).T, out=leaf, mode="clip")
                leaf[0] += part
                np.add.reduce(leaf, axis=0, out=part)      # tree after tree
        return out

    @cached_property
    def _bits(self) -> list[tuple[list, np.ndarray, np.ndarray]]:
        """For runs of trees: by what a row has in a few columns, the leaves that stay in each tree; the trees' values by the
        number that stands for a leaf's bit, and where each tree's begin."""
        splits, leaves, out = np.isfinite(self.threshold), self.value.shape[1], []      # (a node that is not split has none)
        depth = leaves.bit_length() - 1
        gone = [((1 << (leaves >> level + 1)) - 1) << (leaves >> level) * k for level in range(depth) for k in range(1 << level)]
        stays, number = ~np.array(gone, np.uint64), ((_LEAF << np.arange(leaves, dtype=np.uint64)) >> np.uint64(58)).astype(np.int64)
        for low in range(0, len(self), TREES_AT_ONCE):
            feature, threshold, split = (a[low:low + TREES_AT_ONCE] for a in (self.feature, self.threshold, splits))
            tables = []
            for j in np.unique(feature[split]).tolist():
                tree, node = np.nonzero(split & (feature == j))
                cuts = np.unique(threshold[tree, node])
                table = np.full((len(cuts) + 1, len(feature)), 2 ** 64 - 1, np.uint64)
                np.bitwise_and.at(table, (np.searchsorted(cuts, threshold[tree, node]) + 1, tree), stays[node])
                tables.append(([(j, cuts)], np.bitwise_and.accumulate(table)))
            bundles: list[tuple] = []
            for own, table in sorted(tables, key=lambda t: -len(t[1])):
                fits = next((i for i, (_, other) in enumerate(bundles) if len(other) * len(table) <= 256), None)
                if fits is None:
                    bundles.append((own, table))
                else:
                    others, other = bundles[fits]
                    bundles[fits] = others + own, (other[:, None] & table[None]).reshape(-1, len(feature))
            values = np.zeros((len(feature), 64))
            values[:, number] = self.value[low:low + TREES_AT_ONCE]
            out.append((bundles, values.ravel(), 64 * np.arange(len(feature))))
        return out

    def _walked(self, x: np.ndarray, out: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        flat = np.ascontiguousarray(x.T).ravel()
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < len(feature):
                at = 2 * at + 1 + (flat[feature[at] * len(x) + rows] > threshold[at])
            out += value[at - len(feature)]
        return out

    def importances(self) -> np.ndarray:
        """Mean gain of a column's splits, as shares of the sum over all columns."""
        used = self.gain > 0
        total = np.bincount(self.feature[used], self.gain[used], self.width)
        mean = total / np.maximum(np.bincount(self.feature[used], minlength=self.width), 1)
        return mean / mean.sum() if mean.sum() > 0 else mean

    def to_json(self) -> str:
        pack = lambda a: [a.dtype.str, a.shape, base64.b64encode(np.ascontiguousarray(a).tobytes()).decode()]
        return json.dumps({"start": self.start, "width": self.width, "errors": self.errors}
                          | {k: pack(getattr(self, k)) for k in ("feature", "threshold", "gain", "value")})

    @classmethod
    def from_json(cls, text: str) -> Trees:
        read = lambda v: np.frombuffer(base64.b64decode(v[2]), v[0]).reshape(v[1]) if isinstance(v, list) and len(v) == 3 and isinstance(v[0], str) else v
        return cls(**{k: read(v) for k, v in json.loads(text).items()})


class BoostedTrees(Transformer, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage that scores a vector column with fitted trees, a batch at a time; saved as its parameters."""
    trees = Param(Params._dummy(), "trees", "fitted trees as JSON", TypeConverters.toString)

    def __init__(self, trees: Trees | None = None):
        super().__init__()
        if trees is not None:
            self._set(trees=trees.to_json())

    @property
    def fitted(self) -> Trees:
        return Trees.from_json(self.getOrDefault("trees"))

    @property
    def getNumTrees(self) -> int:
        return len(self.fitted)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship(dataset.sparkSession)
        model = self.fitted

        @F.arrow_udf("double")
        def scored(features: pa.Array) -> pa.Array:
            return pa.array(model.predict(features.flatten().to_numpy().reshape(-1, model.width)))

        return dataset.withColumn(self.getPredictionCol(), scored(vector_to_array(self.getFeaturesCol())))


def column_edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Bin edges of every column: midpoints between neighbouring quantiles, all columns in one mergeable sketch pass; the
    sketches of a column meet in a task of its own."""
    at = F.array(*[F.lit(i / BINS) for i in range(BINS + 1)])
    tall = rows.select(F.posexplode(vector_to_array("features")).alias("j", "x"))
    found = dict(tall.groupBy("j").agg(F.percentile_approx("x", at, F.lit(20_000)).alias("q")).collect())
    values = [np.unique(np.array(found.get(j) or [0.0], np.float64)) for j in range(width)]
    return [(v[:-1] / 2 + v[1:] / 2)[:BINS - 1] for v in values]


def _binned(rows: DataFrame, label: str, row_hash: Column, held_out: Column, edges: list[np.ndarray]) -> DataFrame:
    """Blocks of rows: bins (column by column), labels, row hashes and held-out marks as packed bytes."""
    plain = rows.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), row_hash.alias("h"), held_out.alias("held"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            x = t.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(edges))
            bins = np.stack([np.searchsorted(e, x[:, j], side="left").astype(np.uint8) for j, e in enumerate(edges)])
            cells = (bins.tobytes(), t.column("y").to_numpy().tobytes(), t.column("h").to_numpy().tobytes(), t.column("held").to_numpy().astype(np.uint8).tobytes())
            return pa.record_batch([pa.array([t.num_rows], pa.int64()), *[pa.array([c], pa.binary()) for c in cells]], names=["n", "bins", "y", "h", "held"])

        have, n = [], 0
        for b in batches:
            have, n = [*have, b], n + b.num_rows
            if n >= BLOCK_ROWS:
                yield block(have)
                have, n = [], 0
        if n:
            yield block(have)

    return plain.mapInArrow(pack, "n long, bins binary, y binary, h binary, held binary")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


#: Newest scores and nodes of the blocks that this worker has seen: (fit, block) -> [round, scores, level, nodes].
_KEPT: OrderedDict[tuple, list] = OrderedDict()


def _state(fit: str, place: tuple, block: tuple, since: int, trees: list) -> tuple[list, np.ndarray, np.ndarray]:
    """A block's scores after all of ``trees``, the first of which is round ``since``; its bins and row numbers."""
    n, bins, scores = block[0], np.frombuffer(block[1], np.uint8), np.frombuffer(block[5], np.float64)
    own = _KEPT.pop((fit, *place), None)
    if own is None or not since <= own[0] <= since + len(trees):
        own = [since, scores, 0, None]
    rows = np.arange(n)
    for feature, cut, value in trees[own[0] - since:]:
        at = np.zeros(n, np.int64)
        while n and at[0] < len(feature):
            at = 2 * at + 1 + (bins[feature[at] * n + rows] > cut[at])
        own = [own[0] + 1, own[1] + value[at - len(feature)] if n else own[1], 0, None]
    _KEPT[(fit, *place)] = own
    while len(_KEPT) > 1 and sum(16 * len(x[1]) for x in _KEPT.values()) > KEPT_BYTES:
        _KEPT.popitem(last=False)
    return own, bins, rows


def _level(fit: str, since: int, trees: list, partial: tuple, level: int, read: np.ndarray, columns: np.ndarray, sizes: np.ndarray, draw: tuple) -> Callable:
    """Task of one level: [squared held-out error, held-out rows], and of each node to read and bin of the drawn columns
    the gradients' sum and the rows."""
    read = np.asarray(read, np.int64)

    def run(part: int, blocks: Iterator[tuple]) -> Iterator[tuple]:
        offsets = np.concatenate(([0], np.cumsum(sizes[columns])))
        total = int(offsets[-1])
        judged, sums, counts = np.zeros(2), np.zeros(len(read) * total), np.zeros(len(read) * total, np.int64)
        slot = np.full(2 ** level, -1, np.int64)
        slot[read] = np.arange(len(read))
        for number, block in enumerate(blocks):
            own, bins, rows = _state(fit, (part, number), block, since, trees)
            n, y, held = block[0], np.frombuffer(block[2], np.float64), np.frombuffer(block[4], np.uint8).astype(bool)
            if level == 0:
                missed = (own[1] - y)[held]
                judged += missed @ missed, len(missed)
            if own[3] is None or own[2] > level:       # (a task may run again)
                own[2:] = 0, np.zeros(n, np.int64)
            feature, cut = partial
            while own[2] < level:
                own[3] = 2 * own[3] + 1 + (bins[feature[own[3]] * n + rows] > cut[own[3]])
                own[2] += 1
            at = slot[own[3] - (2 ** level - 1)]
            share, round_ = draw
            use = (at >= 0) & ~held
            if share < 1:
                use &= _mix(np.frombuffer(block[3], np.uint64) + np.uint64(round_ * 0x9E3779B97F4A7C15 & 2 ** 64 - 1)) < np.uint64(share * 2.0 ** 64)
            use = np.flatnonzero(use)
            matrix, g = bins.reshape(len(sizes), n), own[1] - y
            for first in range(0, len(use), 1 << 13):
                pick = use[first:first + (1 << 13)]
                cell = (matrix[np.ix_(columns, pick)] + (offsets[:-1, None] + at[pick] * total)).ravel()
                sums += np.bincount(cell, np.tile(g[pick], len(columns)), len(sums))
                counts += np.bincount(cell, minlength=len(sums))
        yield judged, sums, counts.astype(np.int32)

    return run


def _renewed(fit: str, since: int, trees: list) -> Callable:
    def run(part: int, blocks: Iterator[tuple]) -> Iterator[tuple]:
        for number, block in enumerate(blocks):
            own, _, _ = _state(fit, (part, number), block, since, trees)
            yield (*block[:5], own[1].tobytes())

    return run


def _add(a: tuple, b: tuple) -> tuple:
    return tuple(x + y.astype(np.int64) if x.dtype.kind == "i" else x + y for x, y in zip(a, b))


def _scratch() -> str | None:
    """Folder of the task's own files; None for the system's."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return folder if os.path.isdir(folder) else None


def _mapped(file, kind: type) -> np.ndarray:
    """What a nameless file holds, which goes with the array. Its pages are in memory while there is room for them."""
    with file:
        file.flush()
        return np.memmap(file, kind, "r+", shape=file.tell() // np.dtype(kind).itemsize).view(np.ndarray) if file.tell() else np.zeros(0, kind)


class _InTask:
    """Sums of levels over the rows that one task holds. The rows of a node stay together: a split parts them in two, and
    after the last one they take up the values of their leaves. What a row has is in mapped files, and rows are parted a
    segment at a time; numbers of rows count from the start of their segment."""

    def __init__(self, blocks: Iterable[tuple], width: int, start: float):
        files = [tempfile.TemporaryFile(dir=_scratch()) for _ in range(width + 3)]
        for n, bins, *others in (b[:5] for b in blocks):
            for f, part in zip(files, [*(bins[j * n:(j + 1) * n] for j in range(width)), *others]):
                f.write(part)
        self.bins = [_mapped(f, np.uint8) for f in files[:width]]
        self.y, self.hash, self.held = (_mapped(f, kind) for f, kind in zip(files[width:], (np.float64, np.uint64, bool)))
        self.segments = [slice(low, min(low + SEGMENT, len(self.y))) for low in range(0, len(self.y), SEGMENT)]
        self.scores = self._written(np.float64, lambda own: np.full(own.stop - own.start, start))
        self.level, self.nodes = 0, []      # of each segment: node -> its drawn rows, its other rows
        self.bundles = None

    def _written(self, kind: type, part: Callable[[slice], np.ndarray]) -> np.ndarray:
        f = tempfile.TemporaryFile(dir=_scratch())
        for own in self.segments:
            f.write(part(own))
        return _mapped(f, kind)

    def _bundled(self, sizes: np.ndarray) -> None:
        """Columns of few bins are summed together, by one number for what a row has in all of them."""
        bundles: list[list[int]] = []
        for j in np.argsort(-sizes, kind="stable").tolist():
            fits = [b for b in bundles if np.prod(sizes[b]) * sizes[j] <= CELLS]
            if fits:
                fits[0].append(j)
            else:
                bundles.append([j])

        def joint(columns: list[int], own: slice) -> np.ndarray:
            cells = np.zeros(own.stop - own.start, np.uint16)
            for j in columns:
                cells = cells * np.uint16(sizes[j]) + self.bins[j][own]
            return cells

        self.bundles = [(columns, self._written(np.uint16, lambda own, columns=columns: joint(columns, own))) for columns in bundles]
        self.bins = None      # (the joint numbers tell them)
        self.bin_of = {}      # column -> its bundle, and its bin by the joint number
        for cells, columns in enumerate(bundles):
            for i, j in enumerate(columns):
                numbers = np.arange(np.prod(sizes[columns])) // np.prod(sizes[columns[i + 1:]], dtype=np.int64) % sizes[j]
                self.bin_of[j] = cells, numbers

    def _down(self, feature: np.ndarray, cut: np.ndarray, level: int) -> None:
        for low in range(self.level, level):
            first, sides = 2 ** low - 1, {}
            for at in range(first, 2 * first + 1):
                if cut[at] < 255:
                    bundle, bin_ = self.bin_of[int(feature[at])]
                    sides[at - first] = self.bundles[bundle][1], bin_ > cut[at]
            for number, own in enumerate(self.segments):
                parted = {}
                for node, rows in self.nodes[number].items():
                    parted[2 * node] = rows
                    if node in sides:
                        cells, is_right = sides[node]
                        cells = cells[own]
                        right = [is_right.take(cells.take(r)) for r in rows]
                        parted[2 * node] = [r.take(np.flatnonzero(~x)) for r, x in zip(rows, right)]
                        parted[2 * node + 1] = [r.take(np.flatnonzero(x)) for r, x in zip(rows, right)]
                self.nodes[number] = parted
        self.level = level

    def sums(self, trees: list, partial: tuple, level: int, read: np.ndarray, columns: np.ndarray, sizes: np.ndarray, draw: tuple) -> tuple:
        judged = np.zeros(2)
        if self.bundles is None:
            self._bundled(sizes)
        if level == 0:
            grown, (share, round_) = bool(self.nodes), draw
            if grown:
                feature, cut, value = trees[-1]
                self._down(feature, cut, len(value).bit_length() - 1)
            for number, own in enumerate(self.segments):
                scores, held = self.scores[own], self.held[own]
                if grown:
                    for node, rows in self.nodes[number].items():
                        for r in rows:
                            scores[r] += value[node]
                missed = (scores - self.y[own])[held]
                judged += missed @ missed, len(missed)
                use = ~held
                if share < 1:
                    use &= _mix(self.hash[own] + np.uint64(round_ * 0x9E3779B97F4A7C15 & 2 ** 64 - 1)) < np.uint64(share * 2.0 ** 64)
                self.nodes[number:number + 1] = [{0: [np.flatnonzero(use), np.flatnonzero(~use)]}]
            self.level = 0
        self._down(*partial, level)
        offsets = np.concatenate(([0], np.cumsum(sizes[columns])))
        sums, counts = np.zeros((len(read), offsets[-1])), np.zeros((len(read), offsets[-1]), np.int64)
        place = {int(j): slice(a, b) for j, a, b in zip(columns, offsets, offsets[1:])}
        joint = [(own, cells, (np.zeros((len(read), n)), np.zeros((len(read), n), np.int64)))
                 for own, cells in self.bundles if not place.keys().isdisjoint(own) for n in [int(np.prod(sizes[own]))]]
        for number, segment in enumerate(self.segments):
            scores, y = self.scores[segment], self.y[segment]
            parts = [(cells[segment], both) for _, cells, both in joint]
            for k, node in enumerate(read):
                drawn = self.nodes[number].get(int(node), ((), ()))[0]
                for first in range(0, len(drawn), CHUNK):
                    rows = drawn[first:first + CHUNK]
                    slope = scores.take(rows) - y.take(rows)
                    for cells, (total, count) in parts:
                        cell = cells.take(rows).astype(np.intp)
                        total[k] += np.bincount(cell, slope, total.shape[1])
                        count[k] += np.bincount(cell, minlength=total.shape[1])
        for own, _, both in joint:
            for i, j in enumerate(own):
                if j in place:
                    shape = len(read), int(np.prod(sizes[own[:i]])), int(sizes[j]), int(np.prod(sizes[own[i + 1:]]))
                    for into, of in zip((sums, counts), both):
                        into[:, place[j]] = of.reshape(shape).sum(axis=(1, 3))
        return judged, sums.ravel(), counts.ravel().astype(np.int32)

    def check(self) -> None:
        pass


class _InStage(_InTask):
    """Sums of levels over the rows of all tasks of one barrier stage: each tells the others its own and goes on alike.

    They are told by files in the shared folder, as a message between barrier tasks takes a second. A task that has the
    others' files of a step knows that all have read those of the step before.
    """

    def __init__(self, blocks: Iterable[tuple], width: int, start: float, folder: str):
        super().__init__(blocks, width, start)
        context = BarrierTaskContext.get()
        self.part, names = context.partitionId(), context.allGather(uuid.uuid4().hex)
        self.folder, self.tasks, self.step = f"{folder}/{names[0]}", len(names), 0
        os.makedirs(f"{self.folder}/{self.part}", exist_ok=True)
        context.barrier()
        seen = all(os.path.isdir(f"{self.folder}/{k}") for k in range(self.tasks))
        self.shared = all(x == "True" for x in context.allGather(str(seen)))

    def _file(self, part: int, step: int) -> str:
        return f"{self.folder}/{part}/{step}"

    def sums(self, trees: list, *level) -> tuple:
        own, parts, self.step = super().sums(trees, *level), [], self.step + 1
        ends, mine = np.cumsum([x.nbytes for x in own])[:-1], self._file(self.part, self.step)
        with open(f"{mine}.new", "wb") as f:
            f.write(b"".join(x.tobytes() for x in own))
        os.rename(f"{mine}.new", mine)
        for part in range(self.tasks):          # (a task that is lost ends all of a barrier stage)
            while not os.path.exists(self._file(part, self.step)):
                time.sleep(0.0005)
            told = np.split(np.fromfile(self._file(part, self.step), np.uint8), ends)
            parts.append(tuple(x.view(y.dtype) for x, y in zip(told, own)))
        if self.step > 1:
            os.remove(self._file(self.part, self.step - 1))
        return reduce(_add, parts)


def _in_stage(table: DataFrame, tasks: int, folder: str, grow: Callable, *given) -> tuple | None:
    """What ``grow`` makes of the rows in one barrier stage, or None where its tasks do not share the folder."""
    def run(part: int, blocks: Iterator[tuple]) -> Iterator:
        over = _InStage(blocks, *given, folder)
        made = grow(over) if over.shared else None
        return iter([made] if part == 0 else [])

    return _dealt(table, tasks).barrier().mapPartitionsWithIndex(run).collect()[0]


class _InJobs:
    """Sums of levels over cached blocks, a job each; every ``RENEW`` rounds the blocks take up their scores."""

    def __init__(self, blocks, cancelled: Callable[[], bool]):
        self.blocks, self.name, self.since, self.cancelled = blocks.persist(StorageLevel.MEMORY_AND_DISK), uuid.uuid4().hex, 0, cancelled

    def sums(self, trees: list, *level) -> tuple:
        if len(trees) - self.since >= RENEW:
            older = self.blocks
            self.blocks = older.mapPartitionsWithIndex(_renewed(self.name, self.since, trees[self.since:]), True).persist(StorageLevel.MEMORY_AND_DISK)
            self.blocks.count()
            older.unpersist()
            self.since = len(trees)
        parts = self.blocks.mapPartitionsWithIndex(_level(self.name, self.since, trees[self.since:], *level))
        return parts.treeReduce(_add, 2) if self.blocks.getNumPartitions() > 32 else reduce(_add, parts.collect())

    def check(self) -> None:
        if self.cancelled():
            raise TimeoutError("cancelled")

    def end(self) -> None:
        self.blocks.unpersist()


def _best_splits(hist: np.ndarray, shape: Shape, columns: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each node: gain, column and bin of the best split and the rows on its left; hist is (nodes, bins of all columns, 2)."""
    nodes = len(hist)
    best = np.zeros(nodes), np.zeros(nodes, np.int64), np.full(nodes, 255, np.int64), np.zeros(nodes)
    for i, j in enumerate(columns):
        part = hist[:, offsets[i]:offsets[i + 1]]
        if part.shape[1] < 2:
            continue
        left = part.cumsum(axis=1)[:, :-1]
        whole = part.sum(axis=1)[:, None]
        right = whole - left
        term = lambda a: a[..., 0] ** 2 / np.maximum(a[..., 1] + shape.l2, 1e-12)
        gain = term(left) + term(right) - term(whole)
        gain[(left[..., 1] < max(1, shape.least)) | (right[..., 1] < max(1, shape.least))] = -1.0
        k = gain.argmax(axis=1)
        top = gain[np.arange(nodes), k]
        better = top > best[0] + 1e-9
        for into, new in zip(best, (top, np.full(nodes, j), k, left[np.arange(nodes), k, 1])):
            into[better] = new[better]
    return best


def _grown(over: _InTask | _InJobs, shape: Shape, sizes: np.ndarray, ended: Callable | None) -> tuple[list, list[float]]:
    """(feature, bin, leaf values, gains) of each tree, and the held-out error after each."""
    rng, inner, found, errors = np.random.default_rng(shape.seed), 2 ** shape.depth - 1, [], []
    value_of = lambda part: -shape.rate * part[..., 0] / np.maximum(part[..., 1] + shape.l2, 1e-12)

    def judge(judged: np.ndarray) -> bool:
        if ended is None or not found or not judged[1]:
            return False
        errors.append(float(judged[0] / judged[1]))
        return ended(errors)[1]

    def one_tree(round_: int) -> tuple | None:
        columns = np.sort(rng.permutation(len(sizes))[:max(1, int(shape.column_share * len(sizes)))])
        offsets = np.concatenate(([0], np.cumsum(sizes[columns])))
        feature, cut, gain, value = np.zeros(inner, np.int64), np.full(inner, 255, np.int64), np.zeros(inner), np.zeros(inner + 1)
        active, parents, right = np.zeros(1, np.int64), None, None      # nodes of a level that have rows, by their number in it
        for level in range(shape.depth):
            read = active if level == 0 else active[::2] + right      # the sides of fewer rows
            judged, sums, counts = over.sums([t[:3] for t in found], (feature, cut), level, read, columns, sizes, (shape.row_share, round_))
            if level == 0 and judge(judged):
                return None
            hist = np.stack([sums, counts], axis=-1).reshape(len(read), -1, 2)
            if level:
                rest, on = parents - hist, right[:, None, None] == 1
                hist = np.stack([np.where(on, rest, hist), np.where(on, hist, rest)], axis=1).reshape(len(active), -1, 2)
            top, column, bin_, on_left = _best_splits(hist, shape, columns, offsets)
            split = top > 0
            if shape.leaves is not None:                   # a split adds a leaf
                split[np.argsort(-top, kind="stable")[max(0, shape.leaves - 1 - int((gain > 0).sum())):]] = False
            value[active[~split] << shape.depth - level] = value_of(hist[~split, offsets[0]:offsets[1]].sum(axis=1))
            node = 2 ** level - 1 + active[split]
            feature[node], cut[node], gain[node] = column[split], bin_[split], top[split]
            parents = hist[split]
            right = (2 * on_left[split] > parents[:, offsets[0]:offsets[1], 1].sum(axis=1)).astype(np.int64)
            active = np.stack([2 * active[split], 2 * active[split] + 1], axis=1).ravel()
            if level == shape.depth - 1:                   # the last splits' sides are leaves
                for p, c, k, at in zip(parents, np.searchsorted(columns, column[split]), bin_[split], active[::2]):
                    own = p[offsets[c]:offsets[c + 1]]
                    value[at:at + 2] = value_of(np.stack([own[:k + 1].sum(axis=0), own[k + 1:].sum(axis=0)]))
            if not len(active):
                break
        return feature, cut, value, gain

    for round_ in range(shape.rounds):
        over.check()
        tree = one_tree(round_)
        if tree is None:
            break
        found.append(tree)
        if not tree[3].any():
            break
    if ended is not None and len(errors) < len(found):
        none = np.zeros(1, np.int64)
        judge(over.sums([t[:3] for t in found], (none, none), 0, none[:0], none, sizes, (1.0, 0))[0])
    return found, errors


def _slots(spark: SparkSession, share: float) -> int:
    """Tasks of one barrier stage; 1 where the cores that run at the same time are not known."""
    conf = spark.sparkContext.getConf()
    if conf.get("spark.dynamicAllocation.enabled", "false") == "true" or conf.get("spark.default.parallelism"):
        return 1
    return int(spark.sparkContext.defaultParallelism // int(conf.get("spark.task.cpus", "1")) * share)


def _dealt(table: DataFrame, tasks: int) -> RDD:
    """The blocks in ``tasks`` partitions of like size, which a barrier stage asks for."""
    marked = table.withColumn("mark", F.xxhash64("h", "y"))
    order = Window.orderBy(F.desc("n"), "mark")      # of small rows, one for each block
    place = marked.select("mark", "n").distinct().select("mark", (F.row_number().over(order) % tasks).cast("int").alias("place"))
    dealt = marked.join(F.broadcast(place), "mark").repartitionById(tasks, "place")
    return dealt.select("n", "bins", "y", "h", "held").rdd


@dataclass(frozen=True)
class Binned:
    """The written blocks of rows with label, which several fits may read, and the bin edges of their columns."""
    table: DataFrame
    edges: list[np.ndarray]


def bin_rows(rows: DataFrame, label: str, row_hash: Column, held_out: Column | None = None) -> Binned | None:
    """(features, label) rows binned and written; None where no row has a label."""
    spark = rows.sparkSession
    ship(spark)
    known = rows.where(F.col(label).isNotNull())
    head = known.select(F.size(vector_to_array("features")).alias("w")).first()
    if head is None:
        return None
    edges, path = column_edges(known, head["w"]), scratch_path(spark, "blocks")
    _binned(known, label, row_hash, F.lit(False) if held_out is None else held_out, edges).write.parquet(path)
    return Binned(spark.read.parquet(path), edges)


def fit(rows: DataFrame, label: str, row_hash: Column, shape: Shape, held_out: Column | None = None, ended: Callable | None = None,
        cancelled: Callable[[], bool] = lambda: False, share: float = 0.5, bins: Callable[[], Binned | None] | None = None) -> Trees:
    """Fit on (features, label) rows. ``ended(errors)``, given the held-out errors after each round, returns (rounds to
    keep, stop now). Rows without label are left out; a table without rows gives a model without trees. ``share`` of the
    cores grow the trees, so that another family may be fitted beside. ``bins`` gives the same rows as ``bin_rows`` has
    written them; marks of held-out rows count only where ``held_out`` is given."""
    binned = bins() if bins else bin_rows(rows, label, row_hash, held_out)
    if binned is None:
        return Trees(0.0, 0, np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 1)))
    table, edges, spark = binned.table, binned.edges, binned.table.sparkSession
    sizes = np.array([len(e) + 1 for e in edges])
    if held_out is None:
        table = table.withColumn("held", F.repeat(F.lit("\0"), F.col("n").cast("int")).cast("binary"))
    rows_in = table.agg(F.sum("n")).first()[0]
    tasks = max(1, -(-rows_in // BLOCK_ROWS))
    together = min(tasks, _slots(spark, share), table.count())
    read = table.coalesce(tasks).rdd
    sums = read.map(lambda r: np.array([np.frombuffer(r.y)[np.frombuffer(r.held, np.uint8) == 0].sum(), r.n - sum(r.held)])).treeReduce(np.add, 2)
    start = float(sums[0] / max(1, sums[1]))
    blocks = read.map(lambda r: (r.n, bytes(r.bins), bytes(r.y), bytes(r.h), bytes(r.held), np.full(r.n, start).tobytes()))
    if tasks == 1:
        found, errors = blocks.mapPartitions(lambda own: [_grown(_InTask(own, len(sizes), start), shape, sizes, ended)]).collect()[0]
    else:
        made, folder = None, re.sub("^file:/+", "/", scratch_path(spark, "levels"))
        if together > 1 and folder.startswith("/") and rows_in * ROW_BYTES <= together * STAGE_BYTES:
            made = _in_stage(table, together, folder, lambda over: _grown(over, shape, sizes, ended), len(sizes), start)
        if made is None:
            over = _InJobs(blocks, cancelled)
            try:
                made = _grown(over, shape, sizes, ended)
            finally:
                over.end()
        found, errors = made
    inner = 2 ** shape.depth - 1
    stack = lambda i, width: np.stack([t[i] for t in found]) if found else np.zeros((0, width), np.int64)
    feature, cut = stack(0, inner), stack(1, inner)
    threshold = np.array([[edges[j][k] if k < len(edges[j]) else np.inf for j, k in zip(f, c)] for f, c in zip(feature, cut)], np.float64)
    made = Trees(start, len(sizes), feature, threshold.reshape(len(found), inner), stack(3, inner), stack(2, inner + 1), errors)
    return made.first(ended(errors)[0]) if ended is not None and errors else made


def permutation_importance(rows: DataFrame, label: str, columns: Sequence[str], predict: Callable[[DataFrame], DataFrame], row_hash: Column, seed: int = 42) -> DataFrame:
    """(feature, increase): by how much the mean squared error grows when a column's values change rows.

    A row's stand-in is the row next to it in hash order: one join over all columns by position within a hash bucket,
    and each column is swapped in a copy of the row.
    """
    spark = rows.sparkSession
    parts = max(2, spark.sparkContext.defaultParallelism)
    marked = rows.select(*columns, label, F.xxhash64(row_hash, F.lit(seed)).alias("_h"))
    dealt = marked.repartition(parts, F.pmod("_h", F.lit(parts))).sortWithinPartitions("_h")
    path = scratch_path(spark, "dealt")
    dealt.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    own = dealt.withColumn("_part", F.shiftright("_at", 33))
    bounds = own.groupBy("_part").agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    own = own.join(F.broadcast(bounds), "_part").withColumn("_other", F.when(F.col("_at") < F.col("_high"), F.col("_at") + 1).otherwise(F.col("_low")))
    other = dealt.select(F.col("_at").alias("_other"), F.struct(*columns).alias("_given"))
    paired = own.join(other, "_other")
    changed = F.explode(F.array(F.lit(None).cast("string"), *[F.lit(c) for c in columns])).alias("feature")
    tall = paired.select("*", changed).withColumns({c: F.when(F.col("feature") == c, F.col(f"_given.{c}")).otherwise(F.col(c)) for c in columns})
    errors = predict(tall).groupBy("feature").agg(F.avg(F.pow(F.col(label) - F.col("prediction"), 2)).alias("mse"))
    plain = errors.where("feature is null").agg(F.max("mse"))
    return errors.where("feature is not null").select("feature", (F.col("mse") - plain.scalar()).alias("increase"))
