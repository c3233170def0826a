import math
import zlib
from collections import Counter

import numpy as np
import pytest

from parcelcast.llm import lm_score, queries
from tests.llm.data import documents, nothing


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def scored(docs, **options):
    return sorted(lm_score.score(docs, queries.fold() == 1, **options).collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id))


def test_base_model_and_gain(spark):
    docs = documents(spark, n=120)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = {d for d, _ in rows if d is not None and zlib.crc32(str(d).encode()) % 5 == 1}
    counts = Counter(t for d, x in rows if d not in out for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    base = {d: sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x)) for d, x in rows}
    got = scored(docs)
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id in out) and r.train_tokens == n and r.base_score == pytest.approx(base[r.doc_id])
        text = next(x for d, x in rows if d == r.doc_id)
        assert (r.n_tokens, r.n_known) == (len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)))
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [2, 3])
def test_shards_change_nothing(spark, order):
    docs = documents(spark)
    one, many = scored(docs, order=order), scored(docs, order=order, shard_bytes=20_000)
    assert [tuple(r)[:6] for r in one] == [tuple(r)[:6] for r in many]
    assert [r.score for r in one] == pytest.approx([r.score for r in many])


def test_filter_reads_levels_back():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 32, 4000, dtype=np.uint32))
    counts = rng.integers(1, 300, len(keys))
    bitmap, size = lm_score.filter_segment(keys, counts)
    import pyarrow as pa

    shard = lm_score.Shard(pa.table({"seg": [0], "ukeys": [b""], "ucounts": [b""], "bitmap": [bitmap.tobytes()], "bits": [size]}), 60)
    level = shard.level(keys.astype(np.uint64))
    true = 1 + np.floor(np.log2(counts))
    assert (level >= true).all() and (level == true).mean() > 0.9
    other = np.setdiff1d(rng.integers(0, 1 << 32, 4000, dtype=np.uint32), keys).astype(np.uint64)
    assert (shard.level(other) > 0).mean() < 0.1


def test_no_texts_and_no_training(spark):
    assert scored(nothing(spark)) == []
    only = scored(documents(spark).where("doc_id = 6"), **{})
    assert len(only) == 1
    from pyspark.sql import functions as F

    got = lm_score.score(documents(spark), F.lit(True)).collect()
    assert all(r.score == pytest.approx(0) and r.train_tokens == 0 for r in got)
