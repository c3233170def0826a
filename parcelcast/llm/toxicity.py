"""Toxicity by multiple-instance learning: a text is toxic if one of its sentences is.

A sentence's score is logistic in its words and their beginnings, which inflections share; a text's score is the
noisy-or of its sentences and of a base rate, so labels of whole texts train the sentence scores, which then show the
sentences at fault. The classifier learns from at most ``SAMPLE_ROWS`` labelled texts (those with the smallest hashes of
their ids, so any bound gives an even sample), by proximal steps with an L1 penalty on what occurs in ``MIN_TEXTS``
texts or more. The texts stay on the executors as packed rows; each step sums their gradients in one job, whose few
tasks return one vector each. After ``SETTLED`` steps the weights that the penalty holds at zero leave.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from parcelcast.llm.common import by_batch, filled, hash_words, steps, written

BUCKETS = 1 << 18
SAMPLE_ROWS = 20_000
MIN_TEXTS = 3
ROUNDS = 60
SETTLED = 30
RATE = 0.25
BEGINNINGS = (4, 5)      # code points of a word's beginnings that count beside it
TASK_ROWS = 2_500        # sampled texts of a task
L1 = 1e-4
STEP = 2 << 20       # text bytes at once, at about fifty times that in a worker
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~“”‘’«»…¡¿"
_BREAK = re.compile(r"\n|\S+")


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    base: float

    def sentence_scores(self, words: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(sentence, self.weights[words], n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words and their beginnings, the sentence of each, and for each sentence its text and its number
    within the text.

    Sentences end with a word that ends in ``.``, ``!`` or ``?``, and at line ends; only those with words count.
    """
    texts = pc.utf8_lower(pc.replace_substring(filled(texts), "\n", " .\n"))
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))  # untrimmed, a blank text may give a blank word
    cuts = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(cuts[0], cuts[-1] - cuts[0]).dictionary_encode()
    raw = coded.dictionary
    codes = coded.indices.to_numpy()
    bare = pc.utf8_trim(raw, _EDGE)
    forms = [bare, *[pc.binary_join_element_wise(pc.utf8_slice_codeunits(bare, 0, n), str(n), "\n") for n in BEGINNINGS]]
    bucket = np.stack([(hash_words(f) % np.uint64(BUCKETS)).astype(np.int64) for f in forms], axis=1)
    ends = pc.match_substring_regex(raw, r"[.!?]$").to_numpy(zero_copy_only=False)[codes]
    text = np.repeat(np.arange(len(texts)), np.diff(cuts))
    before = np.concatenate(([0], np.cumsum(ends)))
    number = before[:-1] - before[cuts[:-1] - cuts[0]][text]  # ends seen before this word, within its text
    keep = (np.minimum(pc.binary_length(bare).to_numpy(), pc.binary_length(raw).to_numpy()) > 0)[codes]
    text, number, words = text[keep], number[keep], bucket[codes[keep]]
    new = (np.diff(text, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0)
    return words.ravel(), np.repeat(np.cumsum(new) - 1, len(forms)), text[new], number[new]


def sentences(text: str) -> dict[int, tuple[int, int]]:
    """Range of code points of each sentence by its number, as ``bags`` counts them."""
    out: dict[int, tuple[int, int]] = {}
    number = 0
    for m in _BREAK.finditer(text):
        if m[0] == "\n":
            number += 1
            continue
        out[number] = (out.get(number, m.span())[0], m.end())
        number += m[0][-1] in ".!?"
    return out


def _packed(labelled: DataFrame, sample_rows: int) -> DataFrame:
    """Blocks of sampled texts: labels, the buckets of each sentence in turn, how many they are, and the sentence's text."""
    rows = labelled.where("toxic is not null").select(_even("doc_id").alias("h"), "text", F.col("toxic").cast("int").alias("y"))
    last = rows.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    few = rows.where(F.col("h") <= F.lit(last)).select("text", "y").repartition(sample_rows // TASK_ROWS + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in steps(batches, limit=STEP):
            words, sentence, text, _ = bags(b.column("text"))
            pair = np.unique(sentence * BUCKETS + words)      # what a sentence repeats counts once
            cells = b.column("y").to_numpy().astype(np.float64), (pair % BUCKETS).astype(np.int32), np.bincount(pair // BUCKETS, minlength=len(text)).astype(np.int32), text.astype(np.int32)
            yield pa.record_batch([pa.array([c.tobytes()], pa.binary()) for c in cells], names=["y", "words", "sizes", "text"])

    return written(by_batch(few, pack, "y binary, words binary, sizes binary, text binary"), "labelled")


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on rows (doc_id, text, toxic) whose label isn't null."""
    names = (("y", np.float64), ("words", np.int32), ("sizes", np.int32), ("text", np.int32))
    context = labelled.sparkSession.sparkContext
    raw = _packed(labelled, sample_rows).coalesce(sample_rows // TASK_ROWS + 1).rdd.map(lambda r: tuple(np.frombuffer(r[c], t) for c, t in names))

    def over(blocks, run: Callable) -> np.ndarray:
        return sum(blocks.mapPartitions(lambda own: [sum(map(run, own), np.zeros(1))]).collect(), np.zeros(1))

    def counted(block: tuple) -> np.ndarray:
        y, words, sizes, text = block
        once = np.unique(np.repeat(text, sizes).astype(np.int64) * BUCKETS + words)
        return np.concatenate([[len(y), y.sum()], np.bincount(once % BUCKETS, minlength=BUCKETS), np.bincount(once % BUCKETS, y[once // BUCKETS], BUCKETS)])

    got = over(raw, counted)
    n, positive = (float(got[0]), float(got[1])) if len(got) > 1 else (0.0, 0.0)
    frequent = np.flatnonzero(got[2:2 + BUCKETS] >= MIN_TEXTS)
    if not 0 < positive < n or not len(frequent):
        return Model(np.zeros(BUCKETS), -12.0, positive / n if n else 0.0)
    place = np.full(BUCKETS, -1, np.int32)
    place[frequent] = np.arange(len(frequent), dtype=np.int32)
    held = [raw.map(_known(context.broadcast(place))).persist(StorageLevel.MEMORY_AND_DISK)]
    found, toxic = got[2 + frequent], got[2 + BUCKETS + frequent]
    w = np.clip(np.log((toxic + 0.5) / (found - toxic + 0.5)) - np.log(positive / (n - positive)) - 1, 0, 5)      # log-odds to start from
    bias, base = -5.0, -3.0
    m, v = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    try:
        for k in range(1, ROUNDS + 1):
            if k == SETTLED + 1:
                live = np.flatnonzero(w)
                place = np.full(len(w), -1, np.int32)
                place[live] = np.arange(len(live), dtype=np.int32)
                held.append(held[0].map(_known(context.broadcast(place))).persist(StorageLevel.MEMORY_AND_DISK))
                frequent, w, ends = frequent[live], w[live], np.append(live, (len(w), len(w) + 1))
                m, v = m[ends], v[ends]
            grad = over(held[-1], _pull(w.astype(np.float32), bias, base)) / n
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            scale = RATE / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-4)
            move = scale * m / (1 - 0.9 ** k)
            w = w - move[:-2]
            w = np.sign(w) * np.maximum(np.abs(w) - scale[:-2] * L1, 0)
            bias, base = bias - move[-2], base - move[-1]
    finally:
        for blocks in held:
            blocks.unpersist()
    weights = np.zeros(BUCKETS)
    weights[frequent] = w
    return Model(weights, float(bias), float(1 / (1 + np.exp(-base))))


def _known(place) -> Callable:
    """A block with its frequent buckets only, by their places."""
    def run(block: tuple) -> tuple:
        y, words, sizes, text = block
        feature = place.value[words]
        kept = np.concatenate(([0], np.cumsum(feature >= 0)))
        ends = np.cumsum(sizes)
        return y, feature[feature >= 0], kept[ends] - kept[ends - sizes], text

    return run


def _pull(w: np.ndarray, bias: float, base: float) -> Callable:
    """The gradient of a block's negative log-likelihood by weights, bias and base."""
    def run(block: tuple) -> np.ndarray:
        y, feature, sizes, text = block
        sums = np.concatenate(([0.0], np.cumsum(w[feature], dtype=np.float64)))
        ends = np.cumsum(sizes)
        s = 1 / (1 + np.exp(-np.clip(bias + sums[ends] - sums[ends - sizes], -30, 30)))
        b = 1 / (1 + np.exp(-base))
        stay = np.bincount(text, np.log1p(-np.minimum(s, 1 - 1e-9)), len(y)) + np.log1p(-b)
        pull = 1 - y / np.maximum(1 - np.exp(stay), 1e-6)
        dz = s * pull[text]
        return np.concatenate([np.bincount(feature, np.repeat(dz, sizes), len(w)), [dz.sum(), b * pull.sum()]])

    return run


def score(docs: DataFrame, model: Model, at_fault: float = 0.2) -> DataFrame:
    """``docs`` as struct ``row``, with score (0 to 1), n_sentences, and the sentences at fault of texts that score 0.5 or
    more: (start, end, score) in code points, ``at_fault`` or more each, at least the worst one.

    Null and empty texts have no sentence and get the base rate; equal texts get equal scores; an empty table gives an
    empty result; other columns are kept in ``row`` whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            flat = pa.record_batch([rows.field("text"), pa.array(np.arange(batch.num_rows))], names=["text", "at"])
            for b in steps([flat], limit=STEP):
                words, sentence, text, number = bags(b.column("text"))
                s = shared.value.sentence_scores(words, sentence, len(text))
                stay = np.bincount(text, np.log1p(-np.minimum(s, 1 - 1e-12)), b.num_rows) + np.log1p(-min(shared.value.base, 1 - 1e-12))
                total = 1 - np.exp(stay)
                first = np.searchsorted(text, np.arange(b.num_rows + 1))
                found = [[] for _ in range(b.num_rows)]
                for i in np.flatnonzero(total >= 0.5).tolist():
                    own = np.arange(first[i], first[i + 1])
                    if len(own):
                        where = sentences(b.column("text")[i].as_py())
                        worst = s[own] >= min(at_fault, s[own].max())
                        found[i] = [{"start": where[k][0], "end": where[k][1], "score": float(p)} for k, p in zip(number[own[worst]].tolist(), s[own[worst]])]
                at = int(b.column("at")[0].as_py())
                yield pa.record_batch([rows.slice(at, b.num_rows), pa.array(total), pa.array(np.bincount(text, minlength=b.num_rows)), pa.array(found, kind)],
                                      names=["row", "score", "n_sentences", "at_fault"])

    spot = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    schema = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("n_sentences", T.LongType()), T.StructField("at_fault", spot)])
    return by_batch(packed, run, schema)


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of the sample: documents with a label that aren't held out, at most ``sample_rows`` ids.

    Of several labels of an id the largest counts. Only ids are shuffled; the sampled ones, whose number is bounded, are
    broadcast to the texts.
    """
    own = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    texts = docs.where(~held_out).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = own.join(texts.select(F.col("doc_id").alias("_id")), "_id", "left_semi")
    few = known.orderBy(_even("_id"), "_id").limit(sample_rows)
    return texts.join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("doc_id", "text", F.col("_toxic").alias("toxic"))


def _even(name: str) -> Column:
    """Hash of an id; the smallest ones are an even sample."""
    return F.xxhash64(F.col(name).cast("long"), F.lit(11))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the texts that score 0.5 or more, all columns as they are."""
    kept = score(docs, model).where("score < 0.5")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
