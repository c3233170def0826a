import random

import pyarrow as pa
import pytest

from parcelcast.llm import pieces, queries
from tests.llm.data import documents, nothing, texts


@pytest.fixture(scope="module")
def vocabulary():
    return queries.piece_vocabulary()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_ids_are_the_library_s_and_decode(spark, vocabulary, library):
    docs = documents(spark)
    got = pieces.decode(pieces.encode(docs, vocabulary), vocabulary).collect()
    assert len(got) == docs.count()
    want = {(r.doc_id, tuple(library.encode(r.text or "")), r.text or "") for r in docs.collect()}
    assert {(r.doc_id, tuple(r.ids), r.text) for r in got} == want
    assert pieces.encode(nothing(spark), vocabulary).count() == 0


def test_mixed_characters(vocabulary, library):
    rng = random.Random(3)
    alphabet = [" ", "  ", "     ", "\n", "a", "b", "the", "ing", "é", "①", "▁", "\t", "0", "12", "\x00", "ﬁ", "漢", "e", "er"]
    own = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    words, first = pieces.marked_words(pa.array(own))
    distinct = sorted(set(words.to_pylist()))
    flat, counts = pieces.Search(vocabulary).encode([w.decode().replace(" ", pieces.MARK) for w in distinct])
    ids, at = {}, 0
    for w, n in zip(distinct, counts):
        ids[w], at = flat[at:at + n], at + n
    split = words.to_pylist()
    for i, t in enumerate(own):
        assert [x for w in split[first[i]:first[i + 1]] for x in ids[w]] == library.encode(t)


def test_unigram_viterbi_is_the_best_segmentation():
    table = {"▁": -4.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -5.0, "ba": -4.2, "aba": -7.5, "▁ab": -6.0}
    v = pieces.Vocabulary([*table, "<0x63>"], [*table.values(), 0.0], frozenset(), [len(table)] * 256, "unigram")

    def best(w):
        return max([(table[w[:n]] + best(w[n:])[0], [w[:n], *best(w[n:])[1]]) for n in range(1, len(w) + 1) if w[:n] in table], default=(0.0, [])) if w else (0.0, [])

    for w in ["▁a", "▁abab", "▁bababba", "▁aabbaba"]:
        flat, _ = pieces.Search(v).encode([w])
        assert sum(v.scores[i] for i in flat) == pytest.approx(best(w)[0])


def test_sharing_changes_nothing(vocabulary):
    words = sorted({"▁" + w for t in texts().values() if t for w in t.split() if len(w) < 30})
    search = pieces.Search(vocabulary)
    flat, counts = search.encode(words)
    assert flat == [i for w in words for i in search.encode([w])[0]] and len(counts) == len(words)
