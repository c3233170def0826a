import zlib

import numpy as np
import pyarrow as pa
import pytest

from parcelcast.llm import common, queries, token_file as tf
from parcelcast.session import scratch_path
from tests.llm.data import documents, nothing


def library_ids(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(queries.tokenizer_json())
    tok.encode_special_tokens = True
    return [tok.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def test_files_give_back_the_library_ids(spark):
    docs = documents(spark)
    path = scratch_path(spark, "tokens")
    tf.write_token_file(docs, path, queries.tokenizer_json(), 2)
    rows = sorted(((-1 if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0], r[1] or ""))
    want = library_ids([t for _, t in rows])
    got = sorted(tf.read_token_file(spark, path).collect(), key=lambda r: r.start)
    assert [(-1 if r.doc_id is None else r.doc_id) for r in got] == [d for d, _ in rows]
    assert [r.ids for r in got] == want
    assert [r.start for r in got] == [sum(map(len, want[:i])) for i in range(len(want))]
    crc = {r.start: r.ids_crc32 for r in tf.read_digests(spark, path).collect()}
    assert all(crc[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


def test_empty_table(spark):
    path = scratch_path(spark, "tokens")
    tf.write_token_file(nothing(spark), path, queries.tokenizer_json(), 2)
    assert tf.read_token_file(spark, path).count() == 0


@pytest.mark.parametrize("counts, limit", [([5, 9, 12, 13, 16, 45], 18), ([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89], 5), ([7, 0, 0], 4), ([1, 1, 0, 1], 2)])
def test_code_is_optimal_and_limited(counts, limit):
    import itertools

    counts = np.array(counts)
    n = tf.code_lengths(counts, limit)
    used = counts > 0
    assert (n[~used] == 0).all() and n.max() <= limit
    if used.sum() > 1:
        assert sum(2.0 ** -n[used].astype(float)) == 1.0
    if used.sum() in (3, 6):
        best = min(sum(c * x for c, x in zip(sorted(counts[used])[::-1], lengths)) for lengths in itertools.combinations_with_replacement(range(1, limit + 1), int(used.sum()))
                   if sum(2.0 ** -x for x in lengths) <= 1)
        assert (counts * n).sum() == best


def test_pack_and_unpack():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 50, 3000) ** 3
    lengths = tf.code_lengths(counts)
    ids = rng.choice(np.flatnonzero(counts), 5000)
    bits, marks = tf.pack(ids, tf.canonical(lengths), lengths)
    assert len(marks) == -(-len(ids) // tf.STRIDE)
    assert (tf.unpack(bits.tobytes(), marks, len(ids), tf.decode_table(lengths)) == ids).all()


def test_encoding_takes_small_steps(spark, monkeypatch):
    def bounded(batches, column="text", limit=common.STEP_BYTES):
        assert limit <= 8 << 20      # a worker holds about twenty times as much
        yield from common.steps(batches, column, limit)

    monkeypatch.setattr(tf, "steps", bounded)
    docs = documents(spark)
    path = scratch_path(spark, "tokens")
    tf.write_token_file(docs, path, queries.tokenizer_json(), 2)
    assert tf.read_token_file(spark, path).count() == docs.count()


def test_worker_forgets_words():
    tf.encoder(queries.tokenizer_json(), 2).known["a"] = b""
    tf.forget_encoder()
    assert not tf.encoder(queries.tokenizer_json(), 2).known


def test_hashing_long_texts_leaves_no_table():
    data = np.arange(3 << 20, dtype=np.int64).astype(np.uint8)
    ends = np.array([256, 1 << 20, 3 << 20])
    alone = common.hash_spans(data[:256], np.array([0]), np.array([256]))
    assert (common.hash_spans(data, ends - 256, ends) == alone).all()
    assert sum(x.nbytes for x in common._POWERS.values()) <= 8 << 20


def test_punctuation_is_cut_from_words_and_ids_stay():
    texts = ["good!! good%%% good* (good) fin. été, été; Straße: isn't it's 'tis a-b x<s> y</s> d'été\u0301. İ. İ, Ǆ! ºª. n\u0303? end\"", "good? été! </s>word", None]
    enc = tf.WordEncoder(queries.tokenizer_json(), 2)
    ids, at = enc.encode(pa.array(texts))
    for text, a, b in zip(texts, at, at[1:]):
        assert ids[a:b].tolist() == [*enc.tok.encode(text or "", add_special_tokens=False).ids, 2]
    assert {"good", "été", "!!", "%%%"} <= set(enc.known) and not {"good!!", "good%%%", "été,", "été;"} & set(enc.known)


def test_a_worker_gives_up_what_another_operator_keeps():
    common.kept("a", 1, lambda: "held")
    assert common.kept("a", 1, lambda: "new") == "held" and common.kept("a", 2, lambda: "new") == "new"
    common.forget_others("a")
    assert common.kept("a", 2, lambda: "newer") == "new"
    common.forget_others(None)
    assert common.kept("a", 2, lambda: "newer") == "newer"
    common.forget_others(None)
