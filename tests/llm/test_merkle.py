import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from parcelcast.llm import merkle, queries
from tests.llm.data import documents, nothing


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def climb(hashes):
    """Root, and of each leaf its siblings (left, right) level by level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k, i in enumerate(at):
            first = i - i % 3
            run = hashes[first:first + 3]
            paths[k].append((run[:i - first], run[i - first + 1:]))
        at = [i // 3 for i in at]
        hashes = [sha(*hashes[i:i + 3]) for i in range(0, len(hashes), 3)]
    return hashes[0], paths


def brute(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    own = {}
    for s in order:
        group = sorted(by_source[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        own[s] = (group, *climb([leaf(r, r.text) for r in group]))
    root, upper = climb([own[s][1] for s in order])
    out = []
    for s, up in zip(order, upper):
        group, subroot, paths = own[s]
        for r, path in zip(group, paths):
            path = path + up
            cut = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None
            h = leaf(r, r.text.replace("\n", "") if cut else r.text)
            for left, right in path:
                h = sha(*left, h, *right)
            out.append((r.doc_id, leaf(r, r.text), subroot, root, sha(*(x for p in path for side in p for x in side)), h, h == root))
    return out


def key(row):
    return tuple("" if v is None else str(v) for v in row)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_equal_to_a_plain_tree(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    source = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("é"), F.col("doc_id") % 5)).when(F.col("doc_id") % 7 == 1, F.lit(None)).otherwise(F.lit("hot"))
    docs = documents(spark, n=130).withColumn("source", source)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_merkle(spark, str(tmp_path)).collect()]
    want = brute(docs.collect())
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {r[-1] for r in got} == {True, False}


def test_one_row_and_none(spark):
    docs = documents(spark).where("doc_id = 3")
    (row,) = merkle.manifest(docs).collect()
    assert row.leaf == row.subroot == row.root == leaf(docs.first(), docs.first().text) and row.path == [] and row.held_leaf is None
    assert merkle.manifest(nothing(spark)).count() == 0


def test_a_hot_source_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    docs = spark.range(400).selectExpr("id as doc_id", "cast(id as string) as text", "'en' as lang", "'one' as source", "1L as n_chars")
    numbered = merkle.numbered(docs.selectExpr("source as g", "doc_id", "text as h"), ["doc_id", "h"], "t")
    assert [r.i for r in numbered.orderBy("doc_id").collect()] == list(range(400)) and numbered.select("n").distinct().count() == 1
    blocks = merkle._climbed(numbered.select("g", "doc_id", "i", "n", "h"), 2).groupBy("g", "block").count().agg(F.max("count")).first()[0]
    assert blocks == 9
    found = merkle.manifest(docs)
    assert found.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0 and found.select("root").distinct().count() == 1
