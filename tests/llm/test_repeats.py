import hashlib
import random
import sys
from collections import Counter

import numpy as np
import pytest

from parcelcast.llm import queries, repeats, suffixes
from tests.llm.data import documents, nothing, words


def brute(rows, length=50):
    first, out = {}, {}
    for d, t in sorted((d, t or "") for d, t in rows if d is not None):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first.setdefault(b[i:i + length], d) < d:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), sum(bool(x) for x in bytes(gone).split(b"\0")), hashlib.sha256(kept).hexdigest())
    return out


def test_bytes_of_smaller_documents_go(spark, tmp_path):
    docs = documents(spark, n=90)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_repeats(spark, str(tmp_path)).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None} == want
    assert all(r.n_removed == 0 for r in got if r.doc_id is None) and sum(r.n_removed for r in got) > 5000


def test_runs_and_periods(spark):
    rows = [(1, "a" * 300), (2, "b" * 20 + "a" * 60 + "b" * 20), (3, "ab" * 100), (4, "x" * 10 + "ab" * 40 + "a" * 55), (5, "ba" * 30), (0, "z" * 49), (6, "z" * 49)]
    got = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("row.doc_id", "octet_length(kept) as n", "sha2(kept, 256) as h").collect()
    want = brute(rows)
    assert {r.doc_id: r.h for r in got} == {d: x[3] for d, x in want.items()}


def test_a_passage_in_ever_different_surroundings(spark, monkeypatch):
    rng = random.Random(3)
    passage = words(rng, 25, 0.6)
    rows = [(i, f"{words(rng, 12, 1.0)} {passage} {words(rng, 12, 1.0)}") for i in range(400)]
    monkeypatch.setattr(repeats, "HOT", 40, raising=False)
    tables = {}

    def kept(df, name, real=repeats.written):
        return tables.setdefault(name, real(df, name))

    monkeypatch.setattr(repeats, "written", kept)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = repeats.repeats(docs).selectExpr("row.doc_id", "sha2(kept, 256) as h").collect()
    assert {r.doc_id: r.h for r in got} == {d: x[3] for d, x in brute(rows).items()}
    keys = Counter(k for r in tables["repeat-places"].where("open").collect() for k in np.frombuffer(r.key, np.int64).tolist())
    assert max(keys.values(), default=0) <= 40


def test_texts_that_share_an_id(spark):
    text = "one sentence that is certainly longer than fifty bytes in this table."
    rows = [(1, text), (2, text), (2, text), (3, text), (3, "another " + text)]
    got = sorted((r.row.doc_id, r.row.text, len(r.kept)) for r in repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [n for d, _, n in got if d == 2] == [0, 0] and [n for d, _, n in got if d == 1] == [len(text)]
    assert sorted(n for d, _, n in got if d == 3)[-1] > 0
    assert repeats.repeats(nothing(spark)).count() == 0


def test_filtered_documents(spark):
    docs = documents(spark)
    kept = repeats.remove_repeats(docs)
    assert kept.columns == docs.columns and dict(kept.dtypes) == dict(docs.dtypes)
    rows = kept.collect()
    assert all(r.n_chars == len(r.text) for r in rows if r.text is not None and r.doc_id is not None and r.text)
    assert {60, 61, 62} <= {r.doc_id for r in rows}


@pytest.mark.parametrize("small", [512, 0])
def test_suffix_arrays(monkeypatch, small):
    monkeypatch.setattr(suffixes, "SMALL_ALPHABET", small)
    rng = np.random.default_rng(4)
    for _ in range(150):
        k = int(rng.integers(2, 6))
        s = np.append(rng.integers(1, k, int(rng.integers(0, 60))), 0).astype(np.int64)
        sa = suffixes.suffix_array(s, k)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        plcp = suffixes.permuted_lcp(s, sa, 9)
        for a, b in zip(sa[:-1], sa[1:]):
            n = 0
            while n < 9 and max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert plcp[b] == n


def test_large_alphabets_take_few_steps():
    rng = np.random.default_rng(5)
    s = np.append(np.tile(rng.integers(2, 200, 30_000), 4), 0)
    lines = 0

    def count(frame, event, arg):
        nonlocal lines
        lines += frame.f_code.co_filename == suffixes.__file__
        return count

    sys.settrace(count)      # lines of Python, however fast the machine is
    try:
        sa = suffixes.suffix_array(s, 258)
    finally:
        sys.settrace(None)
    assert lines < len(s) and sorted(sa.tolist()) == list(range(len(s)))
    rank = np.empty(len(s), np.int64)
    rank[sa] = np.arange(len(s))
    a, b = sa[:-1], sa[1:]
    assert ((s[a] < s[b]) | ((s[a] == s[b]) & (rank[np.minimum(a + 1, len(s) - 1)] < rank[np.minimum(b + 1, len(s) - 1)]))).all()
