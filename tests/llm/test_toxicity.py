import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelcast.llm import toxicity as tx
from tests.llm.data import documents, nothing, words

BAD = ["scoundrel", "wretch", "fiend"]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        parts = [words(rng, rng.randint(4, 14)).capitalize() for _ in range(rng.randint(1, 8))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            k = rng.randrange(len(parts))
            parts[k] += f" {rng.choice(BAD)}"
        rows.append((i, ". ".join(parts) + ".", toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


@pytest.fixture(scope="module")
def model(labelled):
    return tx.train(labelled.where("doc_id % 5 <> 0"))


def test_held_out_texts_and_their_sentences(labelled, model):
    rows = tx.score(labelled.where("doc_id % 5 = 0"), model).collect()
    hits = [(r.row.toxic, r.score >= 0.5) for r in rows]
    assert sum(a == b for a, b in hits) / len(hits) > 0.95
    for r in rows:
        assert 0 <= r.score <= 1
        if r.score >= 0.5 and r.row.toxic:
            worst = max(r.at_fault, key=lambda s: s.score)
            assert any(b in r.row.text[worst.start:worst.end] for b in BAD)


def test_noisy_or_of_sentences(model):
    text = "The scoundrel came. All was well.\nIt is for you!"
    words_, sentence, owner, number = tx.bags(pa.array([text, None, ""]))
    assert len(owner) == 3 and set(owner) == {0}
    where = tx.sentences(text)
    assert [text[slice(*where[k])] for k in number] == ["The scoundrel came.", "All was well.", "It is for you!"]
    s = model.sentence_scores(words_, sentence, 3)
    assert s[0] > 0.9 > 0.3 > s[1:].max()
    assert 1 - (1 - model.base) * np.prod(1 - s) > 0.9


def test_odd_rows(spark, model):
    docs = documents(spark)
    got = tx.score(docs, model).collect()
    assert len(got) == docs.count()
    empty = {r.score for r in got if not (r.row.text or "").strip()}
    assert len(empty) == 1 and next(iter(empty)) == pytest.approx(model.base)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r.row.text, r.score) == r.score
    kept = tx.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.5 for r in got)
    assert tx.score(nothing(spark), model).count() == 0


def test_without_labels(spark):
    for rows in ([], [(1, "a b c", 1)], [(1, None, 0), (2, "", 1)]):
        fitted = tx.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
        assert 0 <= fitted.base <= 1
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    assert [(r.doc_id, r.toxic) for r in tx.labelled(docs, labels, F.lit(False)).collect()] == [(1, 1)]
