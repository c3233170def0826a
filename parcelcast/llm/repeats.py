"""Removal of byte strings that repeat across documents, by suffix arrays of shards.

A string of ``length`` bytes is removed where it also starts in a document with a smaller id. Two equal strings choose
the same anchor: of their ``length - GRAM + 1`` byte GRAM-grams the one with the smallest hash, the leftmost of equals.
So each text falls into fragments, the runs of strings with one anchor, and only fragments with equal anchors can share
a string. An anchor that many different fragments share, as found on a sample, is no meeting place: its fragments fall
into their single strings, each keyed by its own hash. The sample only says which way a string goes.

1. Tasks send each fragment's anchor, hash and place to a bucket by anchor; of equal fragments in a task only those of
   the smallest document, the others are removed at once. A bucket drops anchors of one document, removes fragments that
   equal one of a smaller document, and marks the rest, whose anchors meet in different surroundings.
2. The marked fragments' bytes go to shards by anchor. A shard sorts all their suffixes by induced sorting, takes the
   permuted common prefixes, and runs of suffixes that share ``length`` bytes show which strings a smaller document has.
3. Documents meet their removed ranges in chunks by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from parcelcast.llm.common import _BYTES, as_bytes, binaries, by_batch, by_group, hash_spans, mix, ship, spans, steps, written
from parcelcast.llm.suffixes import permuted_lcp, suffix_array

LENGTH = 50
GRAM = 20
STEP = 2 << 20
BUCKET_BYTES = 4 << 20
SHARD_BYTES = 1 << 20
HOT = 10_000  # different fragments of one anchor from which they are split, about a shard's bytes
SAMPLE_BYTES = 32 << 20  # of texts on which anchors are counted, at least
SAMPLE_SHARE = 1 / 256  # of all texts, at least: an anchor of HOT fragments has about 40 in the sample at any size
_PLACES = "chunk long, doc binary, lo binary, len binary, key binary, open boolean"


def fragments(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For each fragment: the text it is in, its start and end in ``data``, and its anchor's hash."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if n < length:
        return none
    h, have, total = _BYTES[data], 1, np.zeros(0, np.uint64)
    need, covered = gram, 0
    while need:  # hashes of 1, 2, 4, ... bytes; those that make up ``gram`` in binary are joined
        if need & 1:
            piece = h[covered:]
            size = n - covered - have + 1
            total = piece[:size] if not covered else total[:size] * np.uint64(0xA24BAED4963EE407) + piece[:size]
            covered += have
        need >>= 1
        if need:
            h = h[:-have] * np.uint64(0x9FB21C651E98DF25 + 2 * have) + h[have:]
            have *= 2
    h = mix(total)
    order = (h >> np.uint64(30) << np.uint64(30)) | np.arange(len(h), dtype=np.uint64)
    width, low, have = length - gram + 1, order, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[:-(width - have)], low[width - have:])
    anchor = (low & np.uint64((1 << 30) - 1)).astype(np.int64)
    sizes = np.maximum(np.diff(at) - length + 1, 0)
    starts = spans(at[:-1], sizes)
    if not len(starts):
        return none
    anchor = anchor[starts]
    heads = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(heads[1:], len(anchor)) - 1
    lo = starts[heads]
    return np.searchsorted(at, lo, side="right") - 1, lo, starts[last] + length, h[anchor[heads]]


def _hot(docs: DataFrame, total: int, length: int, gram: int) -> np.ndarray:
    """Sorted anchors of more than about ``HOT`` different fragments, counted on a share of the texts."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_BYTES / max(1, total)))
    least = max(4.0, HOT * share)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, limit=STEP):
            data, at = as_bytes(b.column("text"))
            _, lo, hi, key = fragments(data, at, length, gram)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(hash_spans(data, lo, hi).view(np.int64))], names=["key", "frag"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    counted = by_batch(sample, send, "key long, frag long").distinct().groupBy("key").count().where(F.col("count") > least)
    return np.sort(np.array([r.key for r in counted.select("key").collect()], np.int64).view(np.uint64))


def _split(data: np.ndarray, found: tuple[np.ndarray, ...], hot: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``found`` with the fragments of ``hot`` anchors as single strings, whose keys are hashes of their bytes."""
    text, lo, hi, key = found
    pick = np.zeros(len(key), bool)
    if len(hot):
        pick = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
    if not pick.any():
        return found
    n = (hi - lo - length + 1)[pick]
    start = spans(lo[pick], n)
    own = mix(hash_spans(data, start, start + length))
    return tuple(np.concatenate((x[~pick], y)) for x, y in zip(found, (np.repeat(text[pick], n), start, start + length, own)))


def _chunk(doc: np.ndarray, chunks: int) -> np.ndarray:
    return (doc ^ (doc >> 7) ^ (doc >> 17)) % chunks


def _chunk_of(doc: Column, chunks: int) -> Column:
    return F.pmod(doc.bitwiseXOR(F.shiftright(doc, 7)).bitwiseXOR(F.shiftright(doc, 17)), F.lit(chunks).cast("long"))


def _dealt(key: np.ndarray, parts: int, columns: list[np.ndarray]) -> tuple[pa.Array, list[pa.Array]]:
    """Rows of packed columns, one for each value of ``key`` that occurs."""
    order = np.argsort(key, kind="stable")
    counts = np.bincount(key, minlength=parts)
    used = np.flatnonzero(counts)
    ends = np.concatenate(([0], np.cumsum(counts[used])))
    return pa.array(used), [binaries(c[order], ends) for c in columns]


def _joined(group: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in group.column(name)), dtype)


def _places(doc, lo, n, key, chunks: int, still_open: bool) -> pa.Table:
    used, columns = _dealt(_chunk(doc, chunks), chunks, [doc, lo.astype(np.uint32), n.astype(np.uint32), key])
    return pa.table([used, *columns, pa.array(np.full(len(used), still_open))], names=["chunk", "doc", "lo", "len", "key", "open"])


def _first_round(bucketed: DataFrame, chunks: int) -> DataFrame:
    def resolve(group: pa.Table) -> pa.Table:
        bucket = int(group.column("bucket")[0].as_py())
        done = np.concatenate([np.full(len(x.as_py()) // 8, d) for x, d in zip(group.column("doc"), group.column("done").to_pylist())]).astype(bool)
        doc, lo, n = _joined(group, "doc", np.int64), _joined(group, "lo", np.uint32), _joined(group, "len", np.uint32)
        key, frag = _joined(group, "key", np.uint32), _joined(group, "frag", np.uint64)
        out = [_places(doc[done], lo[done], n[done], key[done].astype(np.int64), chunks, False)]
        doc, lo, n, key, frag = (x[~done] for x in (doc, lo, n, key, frag))
        order = np.lexsort((doc, frag, key))
        doc, lo, n, key, frag = (x[order] for x in (doc, lo, n, key, frag))
        if len(doc):
            new_key = np.diff(key, prepend=~key[:1]) != 0
            new_frag = new_key | (np.diff(frag, prepend=frag[:1]) != 0)
            of_key, of_frag = np.cumsum(new_key) - 1, np.cumsum(new_frag) - 1
            k_at, f_at = np.flatnonzero(new_key), np.flatnonzero(new_frag)
            single = np.minimum.reduceat(doc, k_at) == np.maximum.reduceat(doc, k_at)
            alone = np.bincount(of_key[f_at]) == 1
            repeat = doc > doc[f_at][of_frag]
            unsure = ~repeat & ~(single | alone)[of_key]
            for pick, still_open in ((repeat, False), (unsure, True)):
                out.append(_places(doc[pick], lo[pick], n[pick], key[pick].astype(np.int64) << 20 | bucket, chunks, still_open))
        return pa.concat_tables(out)

    return by_group(bucketed, "bucket", resolve, _PLACES)


def _bucketed(docs: DataFrame, buckets: int, length: int, gram: int, hot: np.ndarray) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, limit=STEP):
            data, at = as_bytes(b.column("text"))
            text, lo, hi, key = _split(data, fragments(data, at, length, gram), hot, length)
            frag = hash_spans(data, lo, hi)
            doc = b.column("doc_id").to_numpy()[text]
            order = np.lexsort((lo, doc, frag, key))
            same = np.zeros(len(order), bool)
            k, f, d = key[order], frag[order], doc[order]
            same[1:] = (k[1:] == k[:-1]) & (f[1:] == f[:-1])
            heads = np.flatnonzero(~same)
            done = np.zeros(len(order), bool)
            if len(order):
                done[order] = d > np.repeat(d[heads], np.diff(np.append(heads, len(d))))
            bucket = ((mix(key) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # an anchor is a smallest hash: itself far from even
            for flag in (False, True):
                pick = np.flatnonzero(done == flag)
                pick = pick[np.lexsort((lo[pick], doc[pick]))]
                until = hi[pick]
                if flag:  # neighbours that are settled are one range
                    pick = pick[np.argsort(lo[pick], kind="stable")]
                    heads = np.flatnonzero(np.append(True, (text[pick[1:]] != text[pick[:-1]]) | (lo[pick[1:]] > hi[pick[:-1]]))[:len(pick)])
                    until = hi[pick[np.append(heads[1:], len(pick)) - 1]] if len(pick) else until
                    pick = pick[heads]
                # what is settled needs no meeting place: by document, so that a frequent anchor's copies spread
                to = _chunk(doc[pick], buckets) if flag else bucket[pick]
                used, columns = _dealt(to, buckets, [doc[pick], (lo - at[text])[pick].astype(np.uint32), (until - lo[pick]).astype(np.uint32),
                                                     key[pick].astype(np.uint32) * np.uint32(not flag), frag[pick] * np.uint64(not flag)])
                yield pa.record_batch([used, *columns, pa.array(np.full(len(used), flag))], names=["bucket", "doc", "lo", "len", "key", "frag", "done"])

    return by_batch(docs, send, "bucket long, doc binary, lo binary, len binary, key binary, frag binary, done boolean")


def _covered(group: pa.Table, length: int, chunks: int) -> pa.Table:
    """Ranges of a shard's fragments that a smaller document also has."""
    doc, lo, n = _joined(group, "doc", np.int64), _joined(group, "lo", np.uint32).astype(np.int64), _joined(group, "len", np.uint32).astype(np.int64)
    data = _joined(group, "bytes", np.uint8)
    ends = np.cumsum(n)
    at = ends - n + np.arange(len(n))  # a separator after each fragment
    s = np.ones(len(data) + len(n) + 1, np.int64)
    s[spans(at, n)] = data.astype(np.int64) + 2
    s[-1] = 0
    sa = suffix_array(s, 258)
    run = np.cumsum(permuted_lcp(s, sa, length)[sa] < length)
    window, of = spans(at, n - length + 1), np.repeat(np.arange(len(n)), n - length + 1)
    run_at = np.empty(len(s), np.int64)
    run_at[sa] = run
    run_at = run_at[window]
    least = np.full(int(run[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, run_at, doc[of])
    hit = np.flatnonzero(doc[of] > least[run_at])
    heads = np.flatnonzero(np.diff(window[hit], prepend=-9) != 1)
    first, last = hit[heads], hit[np.append(heads[1:], len(hit)) - 1] if len(hit) else hit
    start = lo[of[first]] + window[first] - at[of[first]]
    return _places(doc[of[first]], start, window[last] - window[first] + length, np.zeros(len(first), np.int64), chunks, False)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, kept, starts, ends) for every row of ``docs``: the row itself, the bytes left, and the removed byte ranges.

    A null text counts as empty and texts under ``length`` bytes stay whole. Rows with a null id are not compared and
    stay whole; so do all texts of an id that has several, but for the one with the smallest MD5. Rows that repeat are
    cut alike and never cut each other. ``row`` has all columns as they are, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    row = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"))
    own = row.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    md5 = F.md5(F.col("text").cast("binary"))
    twice = own.groupBy("doc_id").agg(F.min(md5).alias("low"), F.max(md5).alias("high")).where("low <> high or doc_id is null")
    if twice.limit(1).count():
        twice = written(twice.select(F.col("doc_id").alias("_id"), "low"), "shared-ids")
        own = own.join(twice, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        own = own.withColumn("doc_id", F.when(F.col("low").isNull() | (F.col("low") == md5), F.col("doc_id"))).select("row", "doc_id", "text")
    judged = own.where("doc_id is not null").select("doc_id", "text")
    total = judged.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = int(total // BUCKET_BYTES) + 1
    places = written(_first_round(_bucketed(judged, chunks, length, gram, _hot(judged, total, length, gram)), chunks), "repeat-places")
    open_bytes = places.where("open").agg(F.sum(F.octet_length("doc"))).first()[0] or 0
    shards = int(open_bytes // 8 * (length + 16) // SHARD_BYTES) + 1

    home = own.withColumn("chunk", F.coalesce(_chunk_of(F.col("doc_id"), chunks), F.pmod(F.xxhash64("text"), F.lit(chunks))))
    home = home.select("chunk", "doc_id", "row").groupBy("chunk")

    def cut_out(group: pa.Table, marks: pa.Table) -> pa.Table:
        names = ["shard", "doc", "lo", "len", "bytes"]
        if not group.num_rows or not marks.num_rows:
            return pa.table([pa.array([], pa.int64()), *[pa.array([], pa.binary())] * 4], names=names)
        ids, texts = group.column("doc_id").combine_chunks(), group.column("row").combine_chunks().field("text")
        data, at = as_bytes(texts)
        known = ids.fill_null(-1).to_numpy()
        order = np.argsort(known, kind="stable")
        doc, lo, n = _joined(marks, "doc", np.int64), _joined(marks, "lo", np.uint32), _joined(marks, "len", np.uint32).astype(np.int64)
        start = at[order[np.searchsorted(known[order], doc)]] + lo
        shard = (mix(_joined(marks, "key", np.uint64)) % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        used, columns = _dealt(shard, shards, [doc, lo, n.astype(np.uint32)])
        sizes = np.concatenate(([0], np.cumsum(np.bincount(shard, n, shards)[used.to_numpy()]))).astype(np.int64)
        return pa.table([used, *columns, binaries(data[spans(start[by], n[by])], sizes)], names=names)

    cut = home.cogroup(places.where("open").groupBy("chunk")).applyInArrow(cut_out, "shard long, doc binary, lo binary, len binary, bytes binary")
    more = by_group(cut, "shard", lambda g: _covered(g, length, chunks), _PLACES)
    removed = places.where("not open").union(more).select("chunk", "doc", "lo", "len")

    def cut_off(group: pa.Table, marks: pa.Table) -> pa.Table:
        ids, rows = group.column("doc_id").combine_chunks(), group.column("row").combine_chunks()
        data, at = as_bytes(rows.field("text"))
        known = ids.fill_null(-1).to_numpy()
        order = np.argsort(known, kind="stable")
        doc, lo, n = _joined(marks, "doc", np.int64), _joined(marks, "lo", np.uint32).astype(np.int64), _joined(marks, "len", np.uint32).astype(np.int64)
        left, right = (np.searchsorted(known[order], doc, side=x) for x in ("left", "right"))
        copies = right - left  # rows that repeat get the ranges of their id
        start = at[order[spans(left, copies)]] + np.repeat(lo, copies)
        change = np.bincount(start, minlength=len(data) + 1) - np.bincount(start + np.repeat(n, copies), minlength=len(data) + 1)
        gone = np.cumsum(change[:-1]) > 0
        first = gone & np.diff(gone, prepend=False)
        first[at[:-1][at[:-1] < len(data)]] |= gone[at[:-1][at[:-1] < len(data)]]
        last = np.append(first[1:] | ~gone[1:], True)[:len(gone)] & gone
        first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
        base = at[np.searchsorted(at, first, side="right") - 1]
        cuts = np.searchsorted(first, at).astype(np.int32)
        kept = binaries(data[~gone], np.concatenate(([0], np.cumsum(~gone)))[at])
        lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array((x - base).astype(np.int32))) for x in (first, last)]
        return pa.table([rows, kept, *lists], names=["row", "kept", "starts", "ends"])

    return home.cogroup(removed.groupBy("chunk")).applyInArrow(cut_off, _schema(row))


def _schema(row: DataFrame):
    """The result's schema with the row's type as it is, whatever its columns are called."""
    from pyspark.sql import types as T

    return T.StructType([row.schema["row"], T.StructField("kept", T.BinaryType()), T.StructField("starts", T.ArrayType(T.IntegerType())),
                         T.StructField("ends", T.ArrayType(T.IntegerType()))])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text`` (and ``n_chars`` set anew where it is there).

    A character that loses some of its bytes becomes the replacement character. Rows of which nothing is left are dropped; rows that had no text
    stay.
    """
    found = repeats(docs, length).where("size(starts) = 0 or octet_length(kept) > 0")
    whole = F.size("starts") == 0
    text = F.when(whole, F.col("row.text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string")))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(whole, F.col("row.n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType))
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
