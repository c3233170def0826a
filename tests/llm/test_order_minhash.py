import hashlib
import random

from pyspark.sql import functions as F

from parcelcast.llm import order_minhash as om
from tests.llm.data import documents, nothing, words


def test_edited_texts_of_all_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = {}
    for i, (d, t) in enumerate(rows):
        n, k = rows[(i + 1) % len(rows)][1], len(t) // 3
        want.setdefault(d, set()).add((len(t), hashlib.sha256((t[:len(t) - k] + n[:k]).encode()).hexdigest()))
    got = om.compare_edited(docs).collect()
    assert len(got) == len(rows)
    found = {}
    for r in got:
        found.setdefault(r.doc_id, set()).add((r.n_chars, r.edited_sha256))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert found == want
    prints = {}
    by_id = dict(rows)
    for r in got:
        assert prints.setdefault(by_id[r.doc_id], r.fingerprint) == r.fingerprint
    long = [r for r in got if r.n_chars > 200]
    assert sum(r.near_edited for r in long) > 5 * sum(r.near_next for r in long)


def test_ranges_agree_with_one_range(spark, monkeypatch):
    docs = documents(spark)
    one = sorted(map(tuple, om.compare_edited(docs).collect()), key=str)
    monkeypatch.setattr(om, "ROWS_PER_RANGE", 5)
    assert sorted(map(tuple, om.compare_edited(docs).collect()), key=str) == one


def likeness(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string").select(om.likeness(om.signature(F.col("a")), om.signature(F.col("b"))).alias("x"))
    return [r.x for r in df.collect()]


def test_order_and_edits_lower_the_likeness(spark):
    rng = random.Random(2)
    base = words(rng, 800, 0.8).split()
    few = [w if i % 100 else "new" for i, w in enumerate(base)]
    many = [w if i % 12 else "new" for i, w in enumerate(base)]
    turned = base[400:] + base[:400]
    mixed = [w for i in range(0, 800, 8) for w in base[i:i + 8][::-1]]
    a = " ".join(base)
    same, little, much, swapped, shuffled = likeness(spark, [(a, " ".join(x)) for x in (base, few, many, turned, mixed)])
    assert same == 1 > little > much > shuffled and same > swapped > shuffled
    assert likeness(spark, [("", ""), ("", "a"), ("a", "a")]) == [1.0, 0.0, 1.0]


def test_repeated_kmers_are_numbered(spark):
    (x,) = likeness(spark, [("ab " * 50, "ab " * 100)])
    assert 0 < x < 1


def test_small_tables(spark):
    assert om.compare_edited(nothing(spark)).count() == 0
    (r,) = om.compare_edited(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and r.near_next == 1.0


def test_native_plan(spark):
    plan = om.compare_edited(documents(spark).select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
