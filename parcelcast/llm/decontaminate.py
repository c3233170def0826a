"""Benchmark decontamination by the q-gram lemma.

Benchmark texts are cut into overlapping segments. A segment of ``m`` bytes that occurs with at most ``e`` edits keeps
``m + 1 - Q (e + 1)`` of its Q-grams, on diagonals that are at most ``e`` apart. So matching Q-grams are counted in
overlapping bands of diagonals, bands that reach the bound are verified by banded alignment, and nothing within the
edit budget is missed. Texts and segments are compared in lower case with runs of white space as one space.

The segments are dealt in blocks of about ``BLOCK_BYTES`` by hash, which bounds what is broadcast; texts pass one block
after the other. Bands are counted in ranges of about ``PAIRS`` matching Q-grams, and of a stretch that repeats itself
(rules of one character, a line again and again) only what differs from the rest of it is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from parcelcast.llm.common import as_bytes, by_batch, filled, spans, steps

Q = 8
SEGMENT, STRIDE = 80, 40
RATE = 0.08
BAND = 8
BLOCK_BYTES = 2 << 20
STEP = 6 << 20
PAIRS = 2 << 20  # matching Q-grams counted at once
PERIODS = range(BAND, 64 * BAND + 1, BAND)
_BITS = 22
_MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                       T.StructField("edits", T.IntegerType())])


def plain(texts: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(filled(texts)), r"\s+", " "), " ")


def budget(size: int, rate: float = RATE) -> int:
    """Edits allowed in a segment: its share, and no more than the lemma can tell from nothing."""
    return max(0, min(int(size * rate), (size - Q) // Q))


def _codes(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint64)
    x = x[:-1] << np.uint64(8) | x[1:]
    x = x[:-2] << np.uint64(16) | x[2:]
    return x[:-4] << np.uint64(32) | x[4:]


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)


class Segments:
    """Segments of a block of items and the index of their Q-grams."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float):
        self.item, self.text = [], []
        for item, text in items:
            if len(text) < Q:
                continue
            last = max(0, len(text) - SEGMENT)
            for start in dict.fromkeys([*range(0, last, STRIDE), last]):
                self.item.append(item)
                self.text.append(text[start:start + SEGMENT])
        self.size = np.array([len(t) for t in self.text], np.int64)
        self.edits = np.array([budget(n, rate) for n in self.size], np.int64)
        self.need = self.size + 1 - Q * (self.edits + 1)
        known: dict[bytes, int] = {}
        alike = np.array([known.setdefault(t, i) for i, t in enumerate(self.text)], np.int64)  # equal segments are looked for once
        self.alike, self.copies = np.argsort(alike, kind="stable"), np.bincount(alike, minlength=len(alike))
        self.group = np.cumsum(self.copies) - self.copies
        grams = [_codes(np.frombuffer(t, np.uint8)) for t in known]
        codes = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        seg = np.repeat(np.array(list(known.values()), np.int64), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else seg
        order = np.argsort(codes, kind="stable")
        self.codes, first, count = np.unique(codes[order], return_index=True, return_counts=True)
        self.seg, self.at, self.first, self.count = seg[order], at[order], first, count
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[_slot(self.codes)] = True

    def matches(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, item, start, end and edits of every segment found in the texts ``data[at[i]:at[i + 1]]``."""
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        if len(data) < Q or not len(self.codes):
            return none
        codes = _codes(data)
        hit = self.bitmap[_slot(codes)]
        for edge in at[1:-1]:
            hit[max(0, edge - Q + 1):edge] = False
        hits = np.flatnonzero(hit)
        gram = np.minimum(np.searchsorted(self.codes, codes[hits]), len(self.codes) - 1)
        true = self.codes[gram] == codes[hits]
        hits, gram = hits[true], gram[true]
        if not len(hits):
            return none
        # a hit counts only if some window as wide as a match holds as many as the lemma asks for
        width, need = int((self.size + self.edits).max()), int(self.need.min())
        tight = np.zeros(len(hits) + 1, np.int64)
        if len(hits) >= need:
            group = np.flatnonzero(hits[need - 1:] - hits[:len(hits) - need + 1] < width)
            np.add.at(tight, group, 1)
            np.add.at(tight, group + need, -1)
        near = np.cumsum(tight[:-1]) > 0
        hits, gram = hits[near], gram[near]
        if self.count[gram].sum() > PAIRS:
            told = self._told(data, at, hits)
            hits, gram = hits[told], gram[told]
        found = []
        for text, seg, band in self._bands(at, hits, gram):
            found += [self._align(data, at, text[i:i + 4096], seg[i:i + 4096], band[i:i + 4096]) for i in range(0, len(text), 4096)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else none

    def _told(self, data: np.ndarray, at: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """The hits that tell something. Where a text repeats itself at a distance P, a multiple of BAND, a band finds
        what the band P further finds. So the bands that lie wholly in such a stretch need be looked at only within P of
        its first and last one: these have the first start, the last end and the fewest edits of all of them."""
        reach = SEGMENT + 2 * BAND + 4 * int(self.edits.max())
        keep = np.ones(len(hits), bool)
        for p in PERIODS:
            if len(data) <= p:
                break
            same = np.zeros(len(data) - p + 2, bool)
            same[1:-1] = data[p:] == data[:-p]
            for edge in at[1:-1]:
                same[max(0, edge - p) + 1:edge + 1] = False
            begin, end = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).T
            begin, end = begin + 2 * reach + p, end + p - 2 * reach - p
            long = end > begin
            for a, b in zip(np.searchsorted(hits, begin[long]), np.searchsorted(hits, end[long])):
                keep[a:b] = False
        return keep

    def _bands(self, at: np.ndarray, hits: np.ndarray, gram: np.ndarray) -> Iterator[np.ndarray]:
        """(text, segment, band) with as many Q-grams as the lemma asks for, about PAIRS Q-grams at once: the bands in
        a range, for which the hits from the range's first diagonal to a segment's length after its last one count."""
        n = self.count[gram]
        total = np.cumsum(n)
        if not len(hits):
            return
        cuts = np.searchsorted(total, np.arange(PAIRS, total[-1], PAIRS))
        cuts = np.unique(np.concatenate([[-1], (hits[cuts] + SEGMENT) // BAND, [(hits[-1] + SEGMENT) // BAND + 1]]))
        for begin, end in zip(cuts[:-1], cuts[1:]):
            a, b = np.searchsorted(hits, [begin * BAND - SEGMENT, end * BAND + int(self.edits.max())])
            where = spans(self.first[gram[a:b]], n[a:b])
            hit = np.repeat(hits[a:b], n[a:b])
            seg, diagonal = self.seg[where], hit - self.at[where] + SEGMENT
            text = np.searchsorted(at, hit, side="right") - 1
            band = diagonal // BAND
            low = diagonal % BAND <= self.edits[seg]  # it also belongs to the band before, whose range overlaps
            keys = np.stack([np.concatenate([x, x[low]]) for x in (text, seg)] + [np.concatenate([band, band[low] - 1])])
            keys = keys[:, (keys[2] >= begin) & (keys[2] < end)]
            keys = keys[:, np.lexsort(keys[::-1])]
            heads = np.flatnonzero((np.diff(keys, prepend=-2) != 0).any(axis=0))
            enough = np.diff(np.append(heads, keys.shape[1])) >= self.need[keys[1, heads]]
            yield keys[:, heads[enough]]

    def _align(self, data, at, text, seg, band) -> tuple[np.ndarray, ...]:
        """Best alignment of each segment within its band of diagonals, which is free to start and end in it."""
        edits = int(self.edits[seg].max(initial=0))
        first = band * BAND - SEGMENT - edits  # lowest diagonal, as a position in data
        width = BAND + 3 * edits + 1
        lo, hi = at[text][:, None], at[text + 1][:, None]
        columns = np.arange(width)
        cost = np.where((first[:, None] + columns >= lo) & (first[:, None] + columns <= hi), 0, 1 << 20)
        begin = first[:, None] + columns + np.zeros_like(cost)
        pattern = np.zeros((len(seg), SEGMENT), np.uint8)
        for i, s in enumerate(seg):
            pattern[i, :self.size[s]] = np.frombuffer(self.text[s], np.uint8)
        best = np.full(len(seg), 1 << 20)
        start, end = np.zeros(len(seg), np.int64), np.zeros(len(seg), np.int64)
        rows = np.arange(len(seg))
        for i in range(int(self.size[seg].max(initial=0))):
            where = first[:, None] + columns + i
            inside = (where >= lo) & (where < hi)
            other = data[np.clip(where, 0, len(data) - 1)] != pattern[:, i:i + 1]
            new = cost + np.where(inside, other, 1 << 20)
            came = begin
            skip = np.concatenate([cost[:, 1:] + 1, np.full((len(seg), 1), 1 << 20)], axis=1)  # a byte of the segment is missing
            take = skip < new
            new = np.where(take, skip, new)
            came = np.where(take, np.concatenate([begin[:, 1:], begin[:, :1]], axis=1), came)
            lead = np.minimum.accumulate(((new - columns) << 8) | columns, axis=1)  # bytes of the text that the segment lacks
            source = lead & 255
            cost = (lead >> 8) + columns
            begin = np.take_along_axis(came, source, axis=1)
            done = self.size[seg] == i + 1
            if done.any():
                j = cost.argmin(axis=1)
                best = np.where(done, cost[rows, j], best)
                start, end = np.where(done, begin[rows, j], start), np.where(done, first + j + i + 1, end)
        ok = best <= self.edits[seg]
        seg, n = seg[ok], self.copies[seg[ok]]
        item = np.array(self.item, np.int64)[self.alike[spans(self.group[seg], n)]]
        text, start, end, best = (np.repeat(x[ok], n) for x in (text, start - lo[:, 0], np.minimum(end, hi[:, 0]) - lo[:, 0], best))
        return text, item, start, end, best


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        yield list(zip(rows.column("item_id").to_pylist(), [t.encode() for t in plain(rows.column("text").combine_chunks()).to_pylist()]))


def find(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, matches): each row of ``docs`` and the benchmark items found in its text, (item_id, start, end, edits) with
    one entry for each item; the range, in bytes of the plain text, spans all of its segments, edits are of the best one.

    Null and empty texts have no match; items without id or text and items under Q bytes of plain text are not looked
    for, and items that share an id count as one; an empty table on either side gives no matches. Rows that repeat are
    each searched; ``row`` has all columns whatever their names.
    """
    spark = docs.sparkSession
    have = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"), F.array().cast(T.ArrayType(_MATCH)).alias("matches"))
    schema = T.StructType([have.schema["row"], T.StructField("matches", T.ArrayType(_MATCH))])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
    for items in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(Segments(items, rate))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, known = batch.column("row"), batch.column("matches").to_pylist()
                flat = pa.record_batch([rows.field("text"), pa.array(np.arange(batch.num_rows))], names=["text", "at"])
                for b in steps([flat], limit=STEP):
                    data, at = as_bytes(plain(b.column("text")))
                    begin = int(b.column("at")[0].as_py())
                    for text, item, start, end, edits in zip(*(x.tolist() for x in shared.value.matches(data, at))):
                        own = known[begin + text]
                        old = next((m for m in own if m["item_id"] == item), None)
                        if old is None:
                            own.append({"item_id": item, "start": start, "end": end, "edits": edits})
                        else:
                            old |= {"start": min(old["start"], start), "end": max(old["end"], end), "edits": min(old["edits"], edits)}
                yield pa.record_batch([rows, pa.array(known, kind)], names=["row", "matches"])

        have = by_batch(have, run, schema)
    return have


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows in which a benchmark item is found, all columns as they are."""
    clean = find(docs, benchmark, **options).where("size(matches) = 0")
    return clean.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
