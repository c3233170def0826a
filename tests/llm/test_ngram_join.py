from collections import Counter, defaultdict

import numpy as np
import pytest

from parcelcast.llm import graph, ngram_join as nj
from tests.llm.data import documents, nothing


def grams(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows):
    """class, text id and number of links by id, from all pairs."""
    first, sets = {}, {}
    for d, t in sorted((d, t or "") for d, t in rows if d is not None):
        first.setdefault(t, d)
        sets[first[t]] = grams(t)
    links, root = Counter(), {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (find(first[t or ""]), first[t or ""], links[first[t or ""]]) for d, t in rows if d is not None}


@pytest.mark.parametrize("block", [256, 4])
def test_classes_and_links_of_all_pairs(spark, block):
    docs = documents(spark, n=90)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = nj.classes(docs, block=block).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.class_id, r.text_id, r.n_links) for r in got if r.doc_id is not None} == want
    assert any(r.n_links for r in got) and any(r.n_copies > 1 for r in got)
    assert [r.class_id for r in got if r.doc_id is None] == [None]


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        w = list(base)
        w[i * 2] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = nj.classes(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()
    assert {r.class_id for r in got} == {0} and {r.n_links for r in got} == {149}


def test_one_of_each_class_stays(spark):
    docs = documents(spark)
    kept = nj.keep_one(docs)
    assert kept.columns == docs.columns
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert sorted(set(ids)) == sorted({c for c, _, _ in want.values()})
    assert nj.classes(nothing(spark)).count() == 0 and nj.keep_one(nothing(spark)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = nj.bands_for(0.8, 0.9995)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9995 and bands * rows <= nj.MAX_HASHES


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    for node, label in got.items():
        seen, todo = {node}, [node]
        while todo:
            todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
        assert label == min(seen)
