"""Log-probabilities of texts under an n-gram model in a log-frequency Bloom filter.

The filter holds, for every n-gram of two or more tokens, its count on a logarithmic scale: level ``q`` stands for
counts from ``2**(q-1)`` to ``2**q - 1``, and an n-gram of level ``q`` is entered once for each level up to ``q``. A
count is read by probing level after level until one is missing; a wrong level is at most a false positive too high.
Single tokens have exact counts beside it. The filter is made of segments of about a million characters' n-grams,
each built in one group; all segments with the exact counts form shards of at most ``shard_bytes``, which is what is
broadcast at a time. With one shard, texts are probed while they are scored; with more, each shard fills in what it
knows of every token in a pass of its own over a written table, and the result is the same.

Model: p(w | context) = b p_longer + (1 - b) p_shorter, from the base model for single tokens upward, where b depends
on the order and on the context's count (in powers of two). b is the most likely value on the training texts with each
token left out of its own counts. Tokens and base model are those of ``score``'s docstring.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from parcelcast.llm.common import as_bytes, binaries, by_batch, by_group, filled, hash_spans, mix, steps, written

ORDER = 2
BITS_PER_ENTRY = 8
PROBES = 4
SEGMENT_CHARS = 1 << 20
SHARD_BYTES = 256 << 20
#: Text bytes that a worker tokenises at once.
STEP = 6 << 20
#: Stands for the end of a text, and as context for its beginning.
END = np.uint64(0xE7037ED1A0B428DB)
LEVELS = 48
_BINS, _PER_OCTAVE, _LOWEST = 400, 4, -40


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each distinct token, the tokens as indices into them (an end after each text), and where texts start."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(filled(texts))))
    cuts = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(cuts[0], cuts[-1] - cuts[0]).dictionary_encode()
    data, at = as_bytes(coded.dictionary)
    keys = np.append(hash_spans(data, at[:-1], at[1:]), END)
    codes = coded.indices.to_numpy().astype(np.int64)
    word = np.append(np.diff(at) > 0, True)  # splitting leaves empty strings at the edges
    codes = np.insert(codes, cuts[1:] - cuts[0], len(keys) - 1)
    at = cuts - cuts[0] + np.arange(len(cuts))
    keep = word[codes]
    return keys, codes[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def ngrams(keys: np.ndarray, codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams of 2 to ``order`` tokens that end at each token; contexts don't cross into another text."""
    end = len(keys) - 1
    gram, out, last = keys[codes], [], codes
    for n in range(2, order + 1):
        before = np.empty_like(last)
        before[:1], before[1:] = end, last[:-1]
        if n > 2:
            before[last == end] = end
        last = before
        gram = mix(gram * np.uint64(0xA24BAED4963EE407) + keys[last] + np.uint64(n))
        out.append(gram)
    return out


def _probe(keys: np.ndarray, level: int, size: np.ndarray) -> Iterator[np.ndarray]:
    h = mix(keys.astype(np.uint64) + np.uint64(level * 0xD1342543DE82EF95 & (1 << 64) - 1))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((h + np.uint64(i) * step) & np.uint64(0xFFFFFFFF)) * size >> np.uint64(32)


def filter_segment(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmap of distinct 32-bit keys with their counts, and its size in bits."""
    levels = 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)
    size = max(64, -(-int(levels.sum()) * BITS_PER_ENTRY // 64) * 64)
    bits = np.zeros(size, np.uint8)
    for q in range(1, int(levels.max(initial=0)) + 1):
        for at in _probe(keys[levels >= q], q, np.uint64(size)):
            bits[at] = 1
    return np.packbits(bits, bitorder="little"), size


class Shard:
    """A run of segments: exact counts of single tokens by sorted hash, and the segments' bitmaps end to end."""

    def __init__(self, rows: pa.Table, shift: int):
        segs = rows.column("seg").to_numpy().astype(np.int64)
        order = np.argsort(segs)
        self.shift, segs = shift, segs[order]
        join = lambda c, t: np.frombuffer(b"".join([rows.column(c)[i].as_buffer() for i in order.tolist()]), t)
        self.keys, self.counts = join("ukeys", np.uint64), join("ucounts", np.int64)
        self.bits = join("bitmap", np.uint8)
        sizes = rows.column("bits").to_numpy().astype(np.uint64)[order]
        n = 1 << (64 - shift)
        self.size, self.start = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.size[segs], self.start[segs] = sizes, np.cumsum(sizes) - sizes

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, self.counts[i], 0)

    def level(self, grams: np.ndarray) -> np.ndarray:
        """Level of each n-gram, 0 where it isn't found."""
        seg = (grams >> np.uint64(self.shift)).astype(np.int64)
        out, here = np.zeros(len(grams), np.uint8), np.flatnonzero(self.size[seg])
        keys, size, start = (grams[here] & np.uint64(0xFFFFFFFF)), self.size[seg[here]], self.start[seg[here]]
        for q in range(1, LEVELS):
            ok = np.ones(len(here), bool)
            for at in _probe(keys, q, size):
                at += start
                ok &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            here, keys, size, start = here[ok], keys[ok], size[ok], start[ok]
            if not len(here):
                break
            out[here] = q
        return out


def build(train: DataFrame, order: int) -> tuple[DataFrame, int]:
    """Written table of the filter's segments over all training texts, and the shift from a hash to its segment."""
    chars = train.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shift = 64 - max(4, (int(chars) // SEGMENT_CHARS).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, limit=STEP):
            keys, codes, _ = tokens_of(b.column("text"))
            single = np.bincount(codes, minlength=len(keys))
            by = np.argsort(keys, kind="stable")
            by = by[single[by] > 0]
            ukeys, ucounts = keys[by], single[by]
            grams, n = np.unique(np.concatenate([*ngrams(keys, codes, order), np.zeros(0, np.uint64)]), return_counts=True)
            edges = np.arange((1 << (64 - shift)) + 1, dtype=np.uint64)
            cut = lambda x: np.append(np.searchsorted(x, edges[:-1] << np.uint64(shift)), len(x))
            at, g = cut(ukeys), cut(grams)
            yield pa.record_batch([pa.array(edges[:-1].astype(np.int64)), binaries(ukeys, at), binaries(ucounts, at),
                                   binaries(grams.astype(np.uint32), g), binaries(n.astype(np.uint32), g)],
                                  names=["seg", "ukeys", "ucounts", "grams", "n"])

    def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)

    def segment(group: pa.Table) -> pa.Table:
        parts = lambda c, t: [np.frombuffer(x.as_py(), t) for x in group.column(c)]
        ukeys, ucounts = summed(parts("ukeys", np.uint64), parts("ucounts", np.int64))
        bitmap, size = filter_segment(*summed(parts("grams", np.uint32), parts("n", np.uint32)))
        return pa.table({"seg": group.column("seg")[:1], "ukeys": [ukeys.tobytes()], "ucounts": [ucounts.tobytes()], "bitmap": [bitmap.tobytes()],
                         "bits": [size], "n_tokens": [int(ucounts.sum())], "n_words": [len(ukeys)]})

    packed = by_batch(train.select("text"), count, "seg long, ukeys binary, ucounts binary, grams binary, n binary")
    made = by_group(packed, "seg", segment, "seg long, ukeys binary, ucounts binary, bitmap binary, bits long, n_tokens long, n_words long")
    return written(made, "ngram-filter"), shift


def _shards(segments: DataFrame, limit: int) -> list[list[int]]:
    """Segment numbers of each shard, so that none takes more than ``limit`` bytes (a single segment may)."""
    rows = segments.select("seg", (F.octet_length("ukeys") + F.octet_length("ucounts") + F.octet_length("bitmap")).alias("b")).collect()
    out, held = [[]], 0
    for r in sorted(rows):
        if out[-1] and held + r.b > limit:
            out.append([])
            held = 0
        out[-1].append(r.seg)
        held += r.b
    return out


def _look_up(batch: pa.RecordBatch, shard: Shard, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    keys, codes, at = tokens_of(batch.column("text"))
    return at, shard.count(keys)[codes], [shard.level(g) for g in ngrams(keys, codes, order)]


def _stored(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    counts = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("counts")]
    at = np.concatenate(([0], np.cumsum([len(x) for x in counts], dtype=np.int64)))
    rows = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, len(c)) for x, c in zip(batch.column("levels"), counts)]
    return at, np.concatenate(counts), list(np.concatenate(rows, axis=1))


def _filled_in(docs: DataFrame, segments: DataFrame, shards: list[list[int]], shift: int, order: int) -> DataFrame:
    """Counts and levels of every token, from one shard after the other; each pass is written."""
    spark = docs.sparkSession
    have = docs.withColumns({"counts": F.lit(None).cast("binary"), "levels": F.lit(None).cast("binary")})
    for segs in shards:
        shared = spark.sparkContext.broadcast(Shard(segments.where(F.col("seg").between(segs[0], segs[-1])).toArrow(), shift))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in steps(batches, limit=STEP):
                at, counts, levels = _look_up(b, shared.value, order)
                if b.column("counts").null_count == 0:
                    _, c, q = _stored(b)
                    counts, levels = counts + c, [np.maximum(x, y) for x, y in zip(levels, q)]
                both = np.array(levels, np.uint8).reshape(order - 1, -1)
                lv = [both[:, i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
                yield pa.record_batch([*(b.column(c) for c in ("doc_id", "text", "held_out")), binaries(counts, at), pa.array(lv, pa.binary())],
                                      names=["doc_id", "text", "held_out", "counts", "levels"])

        have = written(by_batch(have, run, "doc_id long, text string, held_out boolean, counts binary, levels binary"), "ngram-probes")
        shared.unpersist()
    return have


def _estimate(levels: np.ndarray) -> np.ndarray:
    """Middle of the counts that a level stands for."""
    return np.where(levels > 0, (3.0 * 2.0 ** (levels.astype(np.float64) - 1) - 1) / 2, 0.0)


def _bucket(counts: np.ndarray) -> np.ndarray:
    return np.where(counts >= 1, np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1, 0)


def _contexts(at: np.ndarray, counts: np.ndarray, levels: list[np.ndarray], n: int, end_count: int) -> np.ndarray:
    """Count of the context of each token's n-gram."""
    first = np.zeros(len(counts), bool)
    first[at[:-1]] = True
    source = counts if n == 2 else _estimate(levels[n - 3])
    before = np.empty(len(counts), np.float64)
    before[:1], before[1:] = end_count, source[:-1]
    before[first] = end_count if n == 2 else 0
    return before


def _probabilities(at, counts, levels, total, distinct, end_count, weights, left_out: int) -> Iterator[tuple]:
    """For n = 1, 2, ...: probability so far, and for the next order its estimate and the contexts' buckets."""
    p = (np.maximum(counts - left_out, 0) + 0.5) / (total + 0.5 * (distinct + 1))
    for n in range(2, len(levels) + 2):
        context = np.maximum(_contexts(at, counts, levels, n, end_count) - left_out, 0)
        longer = np.where(context > 0, np.minimum(1.0, np.maximum(_estimate(levels[n - 2]) - left_out, 0) / np.maximum(context, 1e-9)), 0.0)
        bucket = np.minimum(_bucket(context), LEVELS - 1)
        yield p, longer, bucket
        if n - 2 < len(weights):
            b = weights[n - 2][bucket]
            p = b * longer + (1 - b) * p
    yield p, None, None


def _best_weight(ratios: np.ndarray, counts: np.ndarray) -> float:
    """Maximum of sum(counts * log(1 - b + b * ratios)) over b in [0, 0.999]; the sum is concave."""
    low, high = 0.0, 0.999
    slope = lambda b: float((counts * (ratios - 1) / (1 + b * (ratios - 1))).sum())
    if slope(low) <= 0:
        return low
    if slope(high) >= 0:
        return high
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if slope(mid) > 0 else (low, mid)
    return (low + high) / 2


def score(docs: DataFrame, held_out: Column, order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learns from the rows whose ``held_out`` is not true. Texts are lower-cased in A-Z; tokens are the runs of characters
    other than ASCII white space, then one end. With c the count of a token in the training texts, N of all and V of
    distinct ones, the base model gives it (c + 0.5) / (N + 0.5 (V + 1)). A null text counts as empty and has one token,
    the end; rows that repeat are scored and learned from each by itself; a null ``doc_id`` is kept. An empty table gives
    an empty result, and without training texts every token has probability 1. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    segments, shift = build(docs.where("not held_out"), order)
    total, distinct = segments.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    end_count = docs.where("not held_out").count()
    shards, shared = _shards(segments, shard_bytes), None
    if len(shards) == 1:
        shared = spark.sparkContext.broadcast(Shard(segments.toArrow(), shift))
    else:
        docs = _filled_in(docs, segments, shards, shift, order)
    look_up = (lambda b: _look_up(b, shared.value, order)) if shared else _stored

    weights: list[np.ndarray] = []
    for n in range(2, order + 1):
        def tally(batches: Iterator[pa.RecordBatch], n=n, weights=tuple(weights)) -> Iterator[pa.RecordBatch]:
            table = np.zeros(LEVELS * _BINS, np.int64)
            for b in steps(batches, limit=STEP):
                at, counts, levels = look_up(b)
                p, longer, bucket = list(_probabilities(at, counts, levels[: n - 1], total, distinct, end_count, weights, 1))[n - 2]
                with np.errstate(divide="ignore"):
                    place = np.floor(np.log2(longer / p) * _PER_OCTAVE) - _LOWEST * _PER_OCTAVE + 1
                place = np.where(longer > 0, np.clip(place, 1, _BINS - 1), 0).astype(np.int64)
                table += np.bincount(bucket * _BINS + place, minlength=len(table))
            seen = np.flatnonzero(table)
            yield pa.record_batch([pa.array(seen), pa.array(table[seen])], names=["cell", "n"])

        cells = by_batch(docs.where("not held_out"), tally, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        table = np.zeros((LEVELS, _BINS))
        for r in cells:
            table[divmod(r.cell, _BINS)] = r.n
        ratios = np.append(0.0, 2.0 ** ((np.arange(_BINS - 1) + 0.5) / _PER_OCTAVE + _LOWEST))
        weights.append(np.array([0.0] + [_best_weight(ratios, row) for row in table[1:]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, limit=STEP):
            at, counts, levels = look_up(b)
            chain = [x[0] for x in _probabilities(at, counts, levels, total, distinct, end_count, weights, 0)]
            add = lambda x: np.add.reduceat(x, at[:-1])
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(np.diff(at)), pa.array(add((counts > 0).astype(np.int64))),
                                   pa.array(np.full(b.num_rows, total, np.int64)), pa.array(add(np.log10(chain[0]))), pa.array(add(np.log10(chain[-1])))],
                                  names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return by_batch(docs, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
