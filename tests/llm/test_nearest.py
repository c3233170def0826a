import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelcast.llm import nearest, queries

SCHEMA = "vec_id long, embedding array<float>, label int, key string, v double, shard long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", 0.5, 3) for i, v in rows], SCHEMA)


def brute(rows, asked, k=10):
    ok = [(i, np.float32(v).astype(float)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in asked:
        own = min(tuple(v) for i, v in ok if i == q)
        best = {}
        for i, v in ok:
            if i != q:
                d = float(np.sqrt(((v - np.array(own)) ** 2).sum()))
                best[i] = min(d, best.get(i, d))
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * (i % 3 > 0) + 0.3 * rng.normal(size=8)).tolist()) for i in range(1500)]
    rows += [(2000 + i, (centres[0] + 1e-4 * rng.normal(size=8)).tolist()) for i in range(700)]         # one full bucket
    rows += [(3000 + i, centres[1].tolist()) for i in range(40)]                                         # copies
    rows += [(0, None), (5001, []), (5002, [0.0] * 8), (5003, [1.0] * 7 + [None]), (5004, [math.nan] * 8), (5005, [math.inf] + [1.0] * 7), (5006, [1.0] * 9),
             (None, [1.0] * 8), (7, [9.0] * 8), rows[300], rows[301], (6000, [500.0] * 8)]
    return rows


def recall(got, want):
    return sum(len({r.vec_id for r in got[q]} & {i for _, i in near}) for q, near in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("rows_in_shard, asked_at_once", [(8192, 2048), (150, 5)])
def test_recall_and_exact_distances(spark, rows, monkeypatch, rows_in_shard, asked_at_once):
    monkeypatch.setattr(nearest, "SHARD_ROWS", rows_in_shard)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", asked_at_once)
    found = nearest.search(table(spark, rows).repartition(5), F.col("vec_id") % 20 == 0)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append(r)
    want = brute(rows, [i for i in {i for i, v in rows if i is not None and i % 20 == 0 and v}])
    assert set(got) == set(want) and recall(got, want) >= 0.9
    dist = dict()
    for q, near in got.items():
        near.sort(key=lambda r: r.rank)
        assert [r.rank for r in near] == list(range(1, 11)) and [(r.score, r.vec_id) for r in near] == sorted((r.score, r.vec_id) for r in near)
        dist |= {(q, i): d for d, i in brute(rows, [q], 5000)[q]}
        assert all(abs(dist[q, r.vec_id] - r.score) < 1e-12 and r.vec_id != q for r in near)
    assert [r.vec_id for r in got[3000]] == list(range(3001, 3011))                                      # ties to smaller ids


def test_few_rows(spark):
    few = [(100, [1.0] * 8), (1, [2.0] * 8), (2, [3.0] * 8), (2, [0.5] * 8)]
    got = nearest.search(table(spark, few), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(100, 1, 2), (100, 2, 1)] and got[0].score == pytest.approx(0.5 * math.sqrt(8))
    assert nearest.search(table(spark, few[:1]), F.col("vec_id") % 100 == 0).count() == 0
    assert nearest.search(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert nearest.search(table(spark, few[1:]), F.col("vec_id") % 100 == 0).count() == 0
    same = [(i, [1.0] * 8) for i in range(200)]
    assert [r.vec_id for r in nearest.search(table(spark, same), F.col("vec_id") == 100).orderBy("rank").collect()] == list(range(10))


def test_likelier_buckets_come_first():
    rng = np.random.default_rng(0)
    tables = nearest.Tables(rng.normal(size=(1, 4, 8)), rng.uniform(0, 2, (1, 4)), 2.0, 0.7, 1)
    x = rng.normal(size=8)
    slots = tables.visited(0, x, 0.9)
    near = x + 0.7 * (lambda v: v / np.linalg.norm(v, axis=1)[:, None])(rng.normal(size=(4000, 8)))
    own = tables.slots(x[None])[0, 0]
    assert (slots[0] == own).all() and len(np.unique(slots, axis=0)) == len(slots)
    place = {tuple(s): i for i, s in enumerate(slots.tolist())}
    hits = [place.get(tuple(s)) for s in tables.slots(near)[0].tolist()]
    assert sum(h is not None for h in hits) / len(hits) > 0.8
    counts = np.bincount([h for h in hits if h is not None], minlength=len(slots))
    assert counts[0] == counts.max()


def test_registered_query(spark, tmp_path, rows):
    table(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_nearest(spark, str(tmp_path))
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"} and got.count() > 0
