from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm import test_ngram_join, test_repeats
from tests.llm.data import documents, words


def test_stages_on_their_own_input(spark, sf, tmp_path):
    import random

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    rng = random.Random(4)
    planted = [(10 ** 6, f"{words(rng, 60, 0.9)} {item} {words(rng, 10, 0.9)}"), (10 ** 6 + 1, words(rng, 200, 0.9)), (10 ** 6 + 2, None), (None, words(rng, 90, 0.9))]
    extra = spark.createDataFrame(planted, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    docs = docs.unionByName(extra)
    found = {}
    for name, stage in cp.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        rows = after.collect()
        found[name] = {r.doc_id for r in rows}
        if name != "pieces":
            assert after.columns == columns
        if name == "near_duplicates":
            want = test_ngram_join.brute(before)
            assert {d for d in found[name] if d is not None} == {c for c, _, _ in want.values()}
        if name == "repeats":
            want = test_repeats.brute(before)
            for r in rows:
                if r.doc_id is not None and want[r.doc_id][1] == 0:
                    assert r.text == dict(before)[r.doc_id]
            assert found[name] >= {d for d, x in want.items() if x[0] == 0 or x[1] < x[0]}
        if name == "benchmark":
            assert 10 ** 6 not in found[name] and 10 ** 6 in found["repeats"]
        docs = after
    assert {10 ** 6 + 1, 10 ** 6 + 2, None} <= found["pieces"]
    assert len(found["pieces"]) > 0.7 * len(found["toxicity"])


def test_empty_documents(spark, sf, tmp_path):
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
