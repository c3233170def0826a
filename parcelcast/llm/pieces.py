"""SentencePiece encoding and decoding by a Viterbi search that words with a common beginning share.

A text is cut into marked words: spaces become marks, and a word begins at a run of marks or at a line end, over which
no piece reaches. The distinct words of a batch are sorted, which is the order in which a depth-first walk meets them
in their trie, and each word reuses the forward states of the beginning that it has in common with the word before.

A state holds the best score of its prefix and the last piece. For a unigram model every piece that fits the text may
follow. For a BPE model (merges by score, as the library applies them to such a model) a piece may follow another only
if merging the two pieces' text gives exactly these two; one path of such steps leads to each prefix, the library's.
Characters without a piece become their bytes' pieces and nothing merges over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from parcelcast.llm.common import as_bytes, by_batch, filled, kept, spans, steps

MARK = "▁"
STEP = 5 << 20
STEP_IDS = 1 << 20
#: Pairs of pieces of which a worker remembers whether the second may follow the first.
KNOWN_PAIRS = 400_000
_SHIFT = 1 << 24
_OPEN, _BYTES = -1, -2  # before the first piece; after a character without a piece


@dataclass
class Vocabulary:
    """Pieces by id. ``special`` are ids that stand for no text, ``byte`` gives the id of each byte."""

    pieces: list[str]
    scores: list[float]
    special: frozenset[int]
    byte: list[int]
    kind: str = "bpe"

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = frozenset(i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        byte = [0] * 256
        for i in range(n):
            if model.is_byte(i):
                byte[int(pieces[i][3:5], 16)] = i
        return cls(pieces, [model.get_score(i) for i in range(n)], special, byte, kind)


@dataclass
class Search:
    vocabulary: Vocabulary
    known: dict[str, int] = field(default_factory=dict)
    fits: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        v = self.vocabulary
        bytes_ = set(v.byte)
        self.known = {p: i for i, p in enumerate(v.pieces) if i not in v.special and i not in bytes_}
        self.longest = max(map(len, self.known), default=0)

    def merged(self, text: str) -> list[str]:
        """Pieces after all merges: the best score first, the leftmost of equals."""
        parts, known, scores = list(text), self.known, self.vocabulary.scores
        while len(parts) > 1:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                i = known.get(parts[k] + parts[k + 1])
                if i is not None and scores[i] > best:
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, before: int, piece: int) -> bool:
        key = before * _SHIFT + piece
        found = self.fits.get(key)
        if found is None:
            p = self.vocabulary.pieces
            if before < 0:
                found = self.merged(p[piece]) == [p[piece]]
            else:
                found = self.may_follow(_OPEN, piece) and self.merged(p[before] + p[piece]) == [p[before], p[piece]]
            if len(self.fits) > KNOWN_PAIRS:
                self.fits.clear()
            self.fits[key] = found
        return found

    def encode(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of all ``words``, which are sorted, in a row; and how many each has."""
        v, known, longest, bpe = self.vocabulary, self.known, self.longest, self.vocabulary.kind == "bpe"
        fits, may_follow = self.fits, self.may_follow
        last, score = [_OPEN], [0.0]
        flat, counts, before = [], [], ""
        for word in words:
            n, shared = len(word), 0
            top = min(n, len(before))
            while shared < top and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1:], score[shared + 1:]
            for i in range(shared + 1, n + 1):
                best, choice = -np.inf, None
                for start in range(max(0, i - longest), i):
                    piece = known.get(word[start:i])
                    if piece is None:
                        continue
                    if bpe:
                        fit = fits.get(last[start] * _SHIFT + piece)
                        if may_follow(last[start], piece) if fit is None else fit:
                            best, choice = score[start] + v.scores[piece], piece
                            break
                    elif score[start] + v.scores[piece] > best:
                        best, choice = score[start] + v.scores[piece], piece
                if choice is None:
                    if word[i - 1] in known:
                        choice = known[self.merged(word[:i])[-1]]
                    else:
                        best, choice = score[i - 1], _BYTES
                last.append(choice)
                score.append(best)
            ids, i = [], n
            while i:
                piece = last[i]
                if piece == _BYTES:
                    ids += [v.byte[b] for b in reversed(word[i - 1].encode())]
                    i -= 1
                else:
                    ids.append(piece)
                    i -= len(v.pieces[piece])
            ids.reverse()
            flat += ids
            counts.append(len(ids))
            before = word
        return flat, counts


def _search(vocabulary: Vocabulary) -> Search:
    """The worker's search for this vocabulary; which pieces may follow which is learned once."""
    return kept("pieces", crc32("\n".join([vocabulary.kind, *vocabulary.pieces]).encode()), lambda: Search(vocabulary))


def marked_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Bytes of all marked words in a row, a space for each mark, and the first word of each text."""
    texts = pc.replace_substring(filled(texts), MARK, " ")
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))
    data, at = as_bytes(texts)
    begins = np.zeros(len(data) + 1, bool)
    space, line = data == 32, data == 10
    begins[:-1] = space | line
    begins[1:-1] &= ~(space[1:] & space[:-1])
    begins[1:] |= line
    begins[at] = True
    begins[-1] = False
    cuts = np.append(np.flatnonzero(begins), len(data))
    words = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return words, np.searchsorted(cuts, at)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``. Null and empty texts have no ids; marks that are in a text count as spaces,
    as they do for the library; rows that repeat are each encoded; an empty table gives an empty result; other columns
    are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _search(shared.value)
        for b in steps(batches, limit=STEP):
            words, first = marked_words(b.column("text"))
            coded = words.dictionary_encode()
            order = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
            distinct = [w.decode().replace(" ", MARK) for w in coded.dictionary.take(pa.array(order)).to_pylist()]
            flat, counts = search.encode(distinct)
            flat, counts = np.array(flat, np.int32), np.array(counts, np.int64)
            start, n = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            start[order], n[order] = np.cumsum(counts) - counts, counts
            codes = coded.indices.to_numpy()
            ids = flat[spans(start[codes], n[codes])]
            ends = np.concatenate(([0], np.cumsum(n[codes])))[first].astype(np.int32)
            yield pa.record_batch([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return by_batch(rows, run, "doc_id long, ids array<int>", "pieces")


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``STEP_IDS`` ids each."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column("ids")), 0).to_numpy(), dtype=np.int64)
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP_IDS, side="right")))
            yield b.slice(start, stop - start)
            start = stop


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids): the pieces' text without the mark that encoding put first. Null ids give
    an empty text, bytes that aren't UTF-8 the replacement character."""
    table = [b"" if i in vocabulary.special else p.replace(MARK, " ").encode() for i, p in enumerate(vocabulary.pieces)]
    for value, i in enumerate(vocabulary.byte):
        table[i] = bytes([value])
    shared = encoded.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = np.frombuffer(b"".join(shared.value), np.uint8)
        size = np.array([len(p) for p in shared.value], np.int64)
        start = np.cumsum(size) - size
        for b in _few(batches):
            ids = b.column("ids")
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
            flat = ids.flatten().to_numpy()
            data = pieces[spans(start[flat], size[flat])].tobytes()
            at = np.concatenate(([0], np.cumsum(size[flat])))[np.concatenate(([0], np.cumsum(counts)))].tolist()
            texts = [data[i + (data[i:i + 1] == b" "):j].decode("utf-8", "replace") if j > i else "" for i, j in zip(at, at[1:])]
            yield pa.record_batch([b.column("doc_id"), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return by_batch(encoded, run, "doc_id long, ids array<int>, text string")
