"""Token ids in files of canonical Huffman code, in blocks that decode on their own.

A token file is a folder with two Parquet tables. ``code`` has one row with the code length of every id. ``blocks``
has rows of whole documents in ascending ``doc_id``: the packed bits, the bit offset of every ``STRIDE``-th token,
the documents' ids and token counts, and the number of tokens before the block. Each block can be decoded alone.

Lengths come from the counts of all ids and are limited by package-merge; codes are canonical, so the lengths are the
whole code book. Decoding looks up ``max_bits`` bits in one table, for all checkpoints of a block in lockstep.

Null texts count as empty, a null ``doc_id`` sorts first, rows that share an id are ordered by their ids and all kept;
an empty table gives a file without blocks. Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelcast.llm.common import binaries, by_batch, filled, forget_others, kept, spans, steps, written

MAX_BITS = 18
STRIDE = 128
BLOCK_TOKENS = 1 << 20
#: Words a worker remembers the ids of, before it starts anew.
CACHE_WORDS = 900_000
PART_TOKENS = 8_000_000
STEP = 4 << 20  # text bytes that are encoded at once, at about twenty times that in a worker

#: A letter that is always a piece's last where ASCII punctuation other than an apostrophe follows.
_WORD_END = r"([a-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"


class WordEncoder:
    """Ids of texts from a tokenizer that lower-cases, drops white space and never joins over it.

    Such a tokenizer gives a text the ids of its words in a row, so each distinct word is encoded once by the library.
    Words are cut at ASCII white space, and between a Latin-1 letter and following ASCII punctuation, where its pattern
    always ends a piece. The apostrophe stays, as the pattern has pieces that begin with it.
    """

    def __init__(self, model: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(model)
        self.tok.encode_special_tokens = True
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.size = max(max(vocab.values()), end_id) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        suffix = json.loads(model)["model"].get("end_of_word_suffix") or "\0"
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.end = np.array([end_id], self.dtype).tobytes()
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        if plain:
            ids = np.array(self.tok.encode_batch_fast(["\n".join(plain)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(plain):  # each word has one end at least, so each has exactly one
                data, cuts = ids.tobytes(), [0, *(ends * self.dtype.itemsize).tolist()]
                self.known.update(zip(plain, [data[a:b] for a, b in zip(cuts, cuts[1:])]))
            else:
                self._each(plain)
        self._each([w for w in words if not w.isalpha()])

    def _each(self, words: list[str]) -> None:
        found = self.tok.encode_batch_fast(words, add_special_tokens=False) if words else []
        self.known.update((w, np.array(e.ids, self.dtype).tobytes()) for w, e in zip(words, found))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, the end id after each, and where each text starts."""
        texts = pc.replace_substring_regex(pc.ascii_lower(filled(texts)), _WORD_END, r"\1 \2")
        lists = pc.ascii_split_whitespace(texts)
        cuts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(cuts[0], cuts[-1] - cuts[0]).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()      # (several times faster than to_pylist)
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = words
        for i in range(0, len(new), 50_000):
            self.learn(new[i:i + 50_000])
        parts = [self.known[w] for w in words] + [self.end]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(parts), self.dtype)
        order = np.insert(coded.indices.to_numpy().astype(np.int64), cuts[1:] - cuts[0], len(words))
        lengths = sizes[order]
        at = np.concatenate(([0], np.cumsum(lengths)))[cuts - cuts[0] + np.arange(len(cuts))]
        return flat[spans((np.cumsum(sizes) - sizes)[order], lengths)], at


def encoder(model: str, end_id: int) -> WordEncoder:
    """The worker's encoder for this model; it lives as long as the worker."""
    return kept("tokens", (zlib.crc32(model.encode()), end_id), lambda: WordEncoder(model, end_id))


def forget_encoder() -> None:
    """Drop the worker's encoder with the words it knows."""
    forget_others(None)


def token_table(docs: DataFrame, model: str, end_id: int) -> DataFrame:
    """Written table of (doc_id, n_tokens, ids), and one row of id counts (sym, cnt) for each task."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, end_id)
        counts = np.zeros(enc.size, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()),
                            ("sym", pa.list_(pa.int32())), ("cnt", pa.list_(pa.int64()))])
        for b in steps(batches, limit=STEP):
            ids, at = enc.encode(b.column("text"))
            counts += np.bincount(ids, minlength=enc.size)
            none = [None] * b.num_rows
            yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(at)), binaries(ids, at), pa.array(none, schema.field(3).type),
                                   pa.array(none, schema.field(4).type)], schema=schema)
        seen = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()),
                               pa.array([seen.tolist()], schema.field(3).type), pa.array([counts[seen].tolist()], schema.field(4).type)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return written(by_batch(rows, run, "doc_id long, n_tokens long, ids binary, sym array<int>, cnt array<bigint>", "tokens"), "tokens")


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with at most ``max_bits`` bits, by package-merge; 0 for unused ids."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need more than {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used].astype(np.float64)
    level, own = coins, [np.ones(len(coins), bool)]
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([coins, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        own.append(order < len(coins))
    take, depth = 2 * len(coins) - 2, np.zeros(len(coins), np.int64)
    for flags in reversed(own):  # of what is taken, coins lengthen their codes, packages are opened a level below
        coin = int(flags[:take].sum())
        depth[:coin] += 1
        take = 2 * (take - coin)
    lengths[used] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each in the low bits of its number."""
    codes = np.zeros(len(lengths), np.uint64)
    code = previous = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[i])
        if n:
            code <<= n - previous
            codes[i], previous = code, n
            code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the ids, most significant first, as bytes; and the bit offset of every STRIDE-th id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    word, room = at >> 6, 64 - (at & 63) - n
    value = codes[ids]
    fits = room >= 0
    first = np.where(fits, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    out = np.zeros((int(ends[-1]) >> 6) + 2 if len(ids) else 1, np.uint64)
    if len(ids):
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[heads]] = np.bitwise_or.reduceat(first, heads)
        over = ~fits
        out[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return np.frombuffer(out.astype(">u8").tobytes(), np.uint8), at[::STRIDE].astype(np.uint32)


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits to look at, and for each value of them the id that starts there and its length."""
    bits = max(1, int(lengths.max(initial=0)))
    symbols, sizes = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    runs = 1 << (bits - lengths[order].astype(np.int64))
    total = int(runs.sum())
    symbols[:total], sizes[:total] = np.repeat(order, runs), np.repeat(lengths[order], runs)
    return bits, symbols, sizes


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ``n`` ids of a block; every checkpoint is a lane, and lanes advance together."""
    bits, symbols, sizes = table
    raw = np.frombuffer(payload + bytes(8 + STRIDE * 4), np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    last, mask = len(window) - 1, (1 << bits) - 1
    at = checkpoints.astype(np.int64)
    out = np.empty((STRIDE, len(at)), np.uint32)
    for j in range(STRIDE):
        seen = (window[np.minimum(at >> 3, last)] >> (32 - bits - (at & 7)).astype(np.uint32)) & mask
        out[j] = symbols[seen]
        at += sizes[seen]
    return out.T.reshape(-1)[:n]


def write_token_file(docs: DataFrame, path: str, model: str, end_id: int, max_bits: int = MAX_BITS) -> None:
    """Encode ``docs`` (doc_id, text) with the tokenizer ``model`` (its JSON) and write a token file to ``path``."""
    spark = docs.sparkSession
    tokens = token_table(docs, model, end_id)
    rows = tokens.where("sym is null").select("doc_id", "n_tokens", "ids")
    size, dtype = encoder(model, end_id).size, encoder(model, end_id).dtype
    counts = np.zeros(size, np.int64)  # one number for each id of the vocabulary
    pairs = tokens.where("sym is not null").select(F.explode(F.arrays_zip("sym", "cnt")).alias("p"))
    for r in pairs.groupBy(F.col("p.sym").alias("sym")).agg(F.sum("p.cnt").alias("cnt")).collect():
        counts[r.sym] = r.cnt
    lengths = code_lengths(counts, max_bits)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")

    n_parts = int(counts.sum() // PART_TOKENS) + 1
    bounds = sorted(set(rows.approxQuantile("doc_id", [i / n_parts for i in range(1, n_parts)], 0.2 / n_parts))) if n_parts > 1 else []
    part = F.lit(0)
    if bounds:
        part = F.coalesce(F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b < F.col("doc_id"))), F.lit(0))
    rows = rows.withColumn("part", part)
    sums = {r.part: r.n for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, before = {}, 0
    for p in sorted(sums):
        base[p] = before
        before += sums[p]
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths), base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, codes, firsts = shared.value
        held: list = []
        n_held, current, start = 0, None, 0

        def block():
            ids = np.concatenate([np.frombuffer(x[2], dtype) for x in held])
            bits, marks = pack(ids, codes, sizes)
            doc_ids = pa.array([[x[0] for x in held]], pa.list_(pa.int64()))
            doc_n = pa.array([[x[1] for x in held]], pa.list_(pa.int64()))
            return pa.record_batch([pa.array([start]), doc_ids, doc_n, pa.array([marks.tobytes()], pa.binary()),
                                    pa.array([bits.tobytes()], pa.binary())], names=["start", "doc_ids", "doc_n", "checkpoints", "payload"])

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids", "part")]
            for doc, n, ids, p in zip(*columns):
                if held and (p != current or n_held >= BLOCK_TOKENS):
                    yield block()
                    start += n_held
                    held, n_held = [], 0
                if p != current:
                    current, start = p, firsts[p]
                held.append((doc, n, ids))
                n_held += n
        if held:
            yield block()

    ordered = rows.repartitionByRange(n_parts, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
    blocks = by_batch(ordered, run, "start long, doc_ids array<bigint>, doc_n array<bigint>, checkpoints binary, payload binary")
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")


def _decoded(spark: SparkSession, path: str, schema: str, of: Callable[[np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first().lengths), np.uint8)
    shared = spark.sparkContext.broadcast(decode_table(lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                start, doc_ids, doc_n, marks, payload = (b.column(i)[row] for i in range(5))
                n = doc_n.values.to_numpy()
                at = np.concatenate(([0], np.cumsum(n)))
                ids = unpack(payload.as_py(), np.frombuffer(marks.as_py(), np.uint32), int(at[-1]), shared.value)
                yield pa.record_batch([doc_ids.values, pa.array(start.as_py() + at[:-1]), pa.array(n), of(ids, at)],
                                      names=["doc_id", "start", "n_tokens", "value"])

    return by_batch(spark.read.parquet(f"{path}/blocks"), run, schema)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of a token file; ``start`` counts the tokens of all documents before."""
    made = _decoded(spark, path, "doc_id long, start long, n_tokens long, value array<int>",
                    lambda ids, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
    return made.withColumnRenamed("value", "ids")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the checksum of each document's ids as little-endian 32-bit numbers."""

    def crc(ids: np.ndarray, at: np.ndarray) -> pa.Array:
        data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        return pa.array([zlib.crc32(data[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.int64())

    return _decoded(spark, path, "doc_id long, start long, n_tokens long, value long", crc).withColumnRenamed("value", "ids_crc32")
