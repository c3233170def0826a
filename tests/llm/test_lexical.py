import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from parcelcast.llm import lexical, queries
from tests.llm.data import documents, nothing, texts

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [(d, Counter(split(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    out = {}
    for item, text in items:
        own = Counter(split(text))
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in c for _, c in counts) + 1))) for t in own}
        scored = []
        for d, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // max(1, n_terms)
            s = sum(q * weight[t] * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in own.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out[item] = [(rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def result(found):
    out = {}
    for r in found.orderBy("item_id", "rank").collect():
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return out


@pytest.mark.parametrize("step, query_bytes", [(6 << 20, 2 << 20), (3000, 900)])
def test_equal_to_all_scores(spark, tmp_path, monkeypatch, step, query_bytes):
    monkeypatch.setattr(lexical, "STEP", step)
    monkeypatch.setattr(lexical, "QUERY_BYTES", query_bytes)
    monkeypatch.setattr(lexical, "WINDOW", 3)
    docs = documents(spark, n=150)
    own = texts(n=150)
    items = [(i, own[i]) for i in (3, 8, 15)] + [(20, "The THE the w1 ñu ①漢字"), (21, None), (22, ""), (23, "nowhere-seen"), (24, own[151 + 4][:900]), (24, own[151 + 4][:900])]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = queries.op11_ranked_search(spark, str(tmp_path))
    assert dict(found.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    want = brute([(r.doc_id, r.text) for r in docs.collect()], dict(items).items())
    assert result(found) == {k: v for k, v in want.items() if v}
    assert lexical.search(nothing(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert lexical.search(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("short", [0, 30, 10 ** 6])
def test_skipping_loses_nothing(monkeypatch, short):
    rng = random.Random(short)
    monkeypatch.setattr(lexical, "WINDOW", 8)
    for _ in range(60):
        n = rng.randint(1, 300)
        ids = np.sort(np.array([rng.randint(0, 400) for _ in range(n)], np.int64))
        lists = []
        for _ in range(rng.randint(1, 9)):
            docs = np.array(sorted(rng.sample(range(n), rng.randint(1, n))))
            gains = np.array([rng.choice([1, 2, 5, 5, 40]) * rng.choice([1, 1, 9]) for _ in docs], np.int64)
            lists.append((docs, gains, int(gains.max())))
        best, total = lexical._Best(5), np.zeros(n, np.int64)
        start = [(rng.randint(1, 60), rng.randint(0, 400)) for _ in range(rng.choice([0, 3, 8]))]
        if start:
            best.add(*map(np.array, zip(*start)))
        for docs, gains, _ in lists:
            total[docs] += gains
        lexical.run_query(lists, ids, best, short)
        want = sorted([(-s, i) for s, i in start] + [(-int(s), int(i)) for s, i in zip(total, ids) if s])[:5]
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == want


def test_terms_end_at_row_borders():
    import pyarrow as pa

    rows = ["ab Cd", None, "", "eF", "é-ß", "\x00x\x7fY", "  "]
    hashes, row = lexical.terms(pa.array(rows))
    assert Counter(row.tolist()) == Counter(i for i, t in enumerate(rows) for _ in split(t))
    again, _ = lexical.terms(pa.array(["ef ab cd"]))
    assert sorted(again.tolist()) == sorted(hashes[:3].tolist())
