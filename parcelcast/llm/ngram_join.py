"""N-gram Jaccard join by MinHash banding: near-duplicate classes and their links.

A text's set is its runs of ``n`` words (lower-cased, cut at white space); a shorter text has all its words as its one
n-gram, a text without words has none and is only like equal texts. Texts that are equal byte for byte are one node
with the smallest id. Bands and rows are chosen for the wanted recall at the threshold; nodes that share a band are
candidates, and all candidates are verified on their full sets.

Candidate pairs are never listed. Nodes that share a band hang on the smallest of them, which gives components; a
component is dealt in blocks of ``BLOCK`` nodes and a task takes two blocks, compares bands, and intersects the sets of
the candidates. It returns a number of links for each node and edges that span what is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from parcelcast.llm.common import binaries, by_batch, filled, hash_words, mix, steps, written
from parcelcast.llm.graph import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
MAX_HASHES = 128
BLOCK = 256
#: Text bytes that a worker hashes at once.
STEP = 5 << 20


def bands_for(threshold: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows) that find a pair at ``threshold`` with probability ``recall``: the most rows that ``most`` hashes allow."""
    for rows in range(most, 0, -1):
        hit = threshold ** rows
        bands = 1 if hit >= 1 else int(np.ceil(np.log(1 - recall) / np.log(1 - hit)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError(f"no banding with {most} hashes reaches a recall of {recall} at {threshold}")


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' n-grams in a row, and where each text starts."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(filled(texts))))
    cuts = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(cuts[0], cuts[-1] - cuts[0]).dictionary_encode()
    codes = coded.indices.to_numpy()
    word = (pc.binary_length(coded.dictionary).to_numpy() > 0)[codes]
    at = np.concatenate(([0], np.cumsum(word)))[cuts - cuts[0]]
    keys = hash_words(coded.dictionary)[codes[word]]
    sizes = np.diff(at)
    left = np.repeat(at[1:], sizes) - np.arange(len(keys))  # words from here to the end of the text
    gram, factor = np.zeros(len(keys), np.uint64), 1
    for j in range(n):
        inside = left > j
        gram[inside] += keys[np.flatnonzero(inside) + j] * np.uint64(factor)
        factor = factor * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    first = np.zeros(len(keys), bool)
    first[at[:-1][sizes > 0]] = True
    keep = (left >= n) | first
    return mix(gram[keep] + np.minimum(left[keep], n).astype(np.uint64)), np.concatenate(([0], np.cumsum(keep)))[at]


def band_hashes(grams: np.ndarray, at: np.ndarray, bands: int, rows: int, seed: int = 7) -> np.ndarray:
    """One row of band hashes for each text that has n-grams."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flips = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    starts = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(starts), bands), np.uint64)
    edges = np.searchsorted(starts, np.arange(0, len(grams) + 1, 1 << 16))
    for lo, hi in zip(edges, np.append(edges[1:], len(starts))):  # pieces that stay in the cache
        if lo == hi:
            continue
        piece = grams[starts[lo]: starts[hi] if hi < len(starts) else len(grams)]
        for k in range(bands * rows):
            low = np.minimum.reduceat((piece ^ flips[k]) * factors[k], starts[lo:hi] - starts[lo])
            out[lo:hi, k // rows] = mix(out[lo:hi, k // rows] + low + np.uint64(k))
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, of batches that are sorted by them."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        ids = np.stack([held.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1
        if len(cuts):
            for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                yield held.slice(a, b - a)
            held = held.slice(int(cuts[-1])).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    both = n[at] > 1
    owner, at = owner[both], at[both]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], np.cumsum(np.diff(at[order], prepend=-1) > 0) - 1
    out = np.zeros((len(sets), len(sets)), np.float64)
    width = max(256, (1 << 22) // len(sets))
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        i, j = np.searchsorted(at, (lo, lo + width))
        block = np.zeros((len(sets), width), np.float32)
        block[owner[i:j], at[i:j] - lo] = 1
        out += block @ block.T
    return out


def _verify(group: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, the node at the root of what each is linked with here, and numbers of links."""
    nodes, block = group.column("node").to_numpy(), group.column("block").to_numpy()
    bands = np.stack([np.frombuffer(x.as_py(), np.uint64) for x in group.column("bands")])
    i, j = int(group.column("i")[0].as_py()), int(group.column("j")[0].as_py())
    ours = np.triu(np.ones((len(nodes),) * 2, bool), 1) if i == j else (block[:, None] == i) & (block[None, :] == j)
    same = np.zeros_like(ours)
    for k in range(bands.shape[1]):
        same |= bands[:, None, k] == bands[None, :, k]
    ours &= same
    n_links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    if ours.any():
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("grams")]
        both = shared_counts(sets)
        size = np.array([len(s) for s in sets], np.float64)
        linked = ours & (both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9)
        n_links = linked.sum(axis=0) + linked.sum(axis=1)
        linked |= linked.T
        while True:  # smallest reachable position, in a few rounds
            new = np.minimum(root, np.where(linked, root[None, :], len(nodes)).min(axis=1))
            new = new[new]
            if (new == root).all():
                break
            root = new
    return nodes, nodes[root], n_links


def classes(docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, text_id, n_links, n_copies) for every row of ``docs``.

    ``class_id`` is the smallest id of all documents that a chain of links joins, ``text_id`` the smallest id with the
    same text, ``n_copies`` the number of rows with this text, ``n_links`` the number of other texts with a Jaccard
    similarity of ``threshold`` or more. A null text counts as empty; empty texts are copies of each other without
    links. Rows with a null id get the class of their text if a row with an id has it, else a null class. Of texts whose
    smallest ids agree (ids that repeat), the one with the smallest MD5 is compared with others. An empty table gives an
    empty result; other columns are not read.
    """
    bands, rows = bands_for(threshold, recall)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("md5", F.md5(F.col("text").cast("binary")))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, limit=STEP):
            grams, at = shingles(b.column("text"), n)
            signed = band_hashes(grams, at, bands, rows)
            ends = np.concatenate(([0], np.cumsum(np.diff(at) > 0))) * bands
            yield pa.record_batch([b.column("doc_id"), b.column("md5"), binaries(signed.reshape(-1), ends)], names=["doc_id", "md5", "bands"])

    signed = written(by_batch(docs, sign, "doc_id long, md5 string, bands binary"), "band-hashes")
    texts = signed.groupBy("md5").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_copies"))
    texts = written(texts, "texts")
    own = texts.where("node is not null").groupBy("node").agg(F.min("md5").alias("md5"))
    # one signature for each text: that of its smallest id
    nodes = (signed.where("octet_length(bands) > 0").withColumnRenamed("doc_id", "node").join(own, ["node", "md5"])
             .dropDuplicates(["node"]).select("node", "md5", "bands"))
    nodes = written(nodes, "nodes")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            values = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in b.column("bands")]).reshape(-1, bands)
            values = mix(values + np.arange(bands, dtype=np.uint64))
            yield pa.record_batch([pa.array(np.repeat(b.column("node").to_numpy(), bands)), pa.array(values.reshape(-1).view(np.int64))], names=["node", "band"])

    dealt = by_batch(nodes.select("node", "bands"), deal, "node long, band long")
    low = dealt.groupBy("band").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1")
    groups = components(dealt.join(low, "band").select(F.col("node").alias("a"), F.col("low").alias("b")))
    sizes = groups.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = groups.join(sizes, "label").withColumn("block", F.pmod(F.hash("node"), "blocks"))

    wanted = nodes.join(groups.select("node"), "node")
    texts_of = docs.withColumnRenamed("doc_id", "node").join(wanted, ["node", "md5"]).select("node", "bands", "text")

    def gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, limit=STEP):
            grams, at = shingles(b.column("text"), n)
            sets = [np.unique(grams[i:j]).tobytes() for i, j in zip(at[:-1], at[1:])]
            yield pa.record_batch([b.column("node"), b.column("bands"), pa.array(sets, pa.binary())], names=["node", "bands", "grams"])

    sets = written(by_batch(texts_of, gram_sets, "node long, bands binary, grams binary").dropDuplicates(["node"]), "gram-sets")
    pairs = members.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("label", "node", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    tasks = pairs.join(sets, "node").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["label", "i", "j"]):
            if group.num_rows > 1:
                yield pa.record_batch([pa.array(x) for x in _verify(group, threshold)], names=["node", "root", "n"])

    links = written(by_batch(tasks, verify, "node long, root long, n long").where("n > 0"), "links")
    joined = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("node").agg(F.sum("n").alias("n_links"))
    found = texts.join(counted, "node", "left").join(joined, "node", "left")
    found = found.select("md5", F.col("node").alias("text_id"), F.coalesce("label", "node").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return signed.select("doc_id", "md5").join(found, "md5").select("doc_id", "class_id", "text_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the smallest id of each class only, all columns as they are. Rows with a null id stay; of rows that
    share an id all stay or none."""
    found = classes(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("_other")).distinct()
    return docs.join(found, docs["doc_id"] == found["_other"], "left_anti")
