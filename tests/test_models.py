"""Fitted models against closed forms, and their saving, choosing and scoring."""

import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from parcelcast.operators import boost, encode, models, registry as reg
from parcelcast.plans import catalog
from parcelcast.plans.catalog import _requests
from parcelcast.operators.requests import accepted, validate_requests
from parcelcast.session import scratch_path
from parcelcast.schema import TARGET
from parcelcast.sources.deliveries import KEYS, ORDER


@pytest.fixture(scope="module")
def parts(prepared):
    train, validation = (prepared.where(f"split = '{s}'").cache() for s in ("train", "validation"))
    yield train, validation
    train.unpersist()
    validation.unpersist()


@pytest.fixture(scope="module")
def matrix(parts):
    train, _ = parts
    rows = encode.fit_linear_features(train).transform(train).select(vector_to_array("features").alias("x"), TARGET).collect()
    return np.array([r["x"] for r in rows]), np.array([r[TARGET] for r in rows])


@pytest.fixture(scope="module")
def trained(parts):
    return models.train_all(*parts, ORDER, rounds=8)


def test_ridge_equals_the_closed_form(parts, matrix):
    x, y = matrix
    centred = x - x.mean(0)
    w = np.linalg.solve(centred.T @ centred + np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    fitted = models.fit_family("linear", parts[0], ORDER).regressor
    assert np.allclose(fitted.coefficients.toArray(), w, atol=1e-6)
    assert fitted.intercept == pytest.approx(y.mean() - x.mean(0) @ w, abs=1e-6)


def test_gamma_regression_equals_reweighted_least_squares(parts, matrix):
    x, y = matrix
    x1 = np.column_stack([np.ones(len(x)), x])
    mu = y.copy()
    for _ in range(50):        # log link: unit weights, working response log(mu) + (y - mu) / mu
        beta = np.linalg.pinv(x1) @ (np.log(mu) + (y - mu) / mu)
        mu = np.exp(x1 @ beta)
    fitted = models.fit_family("glm", parts[0], ORDER)
    assert fitted.note == "link=log"
    got = np.array([r[0] for r in fitted.predict(parts[0]).select("prediction").collect()])
    assert np.abs(np.sort(got) - np.sort(mu)).max() < 1e-6


def test_all_models_beat_the_mean(trained, parts):
    fitted, status, registry = trained
    assert [r["trained"] for r in status.collect()] == [True] * 4
    spread = parts[1].agg(F.stddev_pop(TARGET)).first()[0]
    rows = registry.collect()
    assert len(rows) == 4 and all(0 < r["rmse"] < spread for r in rows)
    assert {r["n_train"] for r in rows} == {parts[0].count()}


def test_a_failing_family_does_not_stop_the_others(parts):
    fitted, status, registry = models.train_all(*parts, ORDER, families=["nonsense", "linear"])
    assert list(fitted) == ["linear"] and registry.count() == 1
    assert [(r["model_name"], r["trained"]) for r in status.collect()] == [("nonsense", False), ("linear", True)]


def test_importances_are_named_and_sorted(trained):
    rows = models.feature_importance(trained[0]["xgboost"]).collect()
    assert len(rows) == 5 and rows == sorted(rows, key=lambda r: -r["importance"])
    assert {r["feature"] for r in rows} & {"tipo_via", "nivel_trafico", "tiempo_estimado_min"}


def test_saved_models_predict_the_same(spark, trained, parts):
    root = scratch_path(spark, "models")
    models.save_models({k: trained[0][k] for k in ("linear", "histgb")}, root)
    registry = reg.load_registry(trained[2].withColumn("ord", F.monotonically_increasing_id()))
    state = {r["model_name"]: r for r in models.model_availability(spark, root, registry).collect()}
    assert [f for f in state if state[f]["available"]] == ["linear", "histgb"]
    assert state["glm"]["status"] == "ok" and state["glm"]["metrics_available"] and state["linear"]["is_default"]
    for family in ("linear", "histgb"):
        rows = parts[1].limit(20)
        again = models.load_model(root, family).predict(rows).select("prediction").collect()
        assert again == trained[0][family].predict(rows).select("prediction").collect()


def test_nothing_saved_is_degraded(spark):
    empty = spark.createDataFrame([], "model_name string")
    rows = models.model_availability(spark, scratch_path(spark, "none"), empty).collect()
    assert {(r["available"], r["status"], r["metrics_available"]) for r in rows} == {(False, "degraded", False)}


def test_stand_ins():
    assert models.choose_model("glm", ["linear", "glm"]) == "glm"
    assert models.choose_model("glm", ["xgboost", "histgb"]) == "histgb"
    with pytest.raises(ValueError):
        models.choose_model("glm", [])


@pytest.mark.parametrize("family", ["linear", "xgboost"])
def test_batch_scoring(spark, sf, trained, family):
    registry = reg.load_registry(trained[2].withColumn("ord", F.monotonically_increasing_id()))
    checked = validate_requests(_requests(spark, sf))
    good = accepted(checked).count()
    scored = models.batch_score(checked, family, trained[0][family].predict, registry, KEYS)
    assert scored.count() == checked.count() > good > 0
    assert scored.where("status = 'success' and prediction >= 0.1 and violations = ''").count() == good
    assert scored.where("status = 'rejected' and prediction is null and violations <> ''").count() == checked.count() - good
    assert scored.select("input_features.localidad", "input_features.lluvia_mm").count() == checked.count()
    rmse = {r["model_name"]: r["rmse"] for r in registry.collect()}[family]
    assert scored.select("rmse_validation").distinct().collect() == [(rmse,)]


def test_registered_trainings_run_all_rounds(spark, sf, monkeypatch):
    asked = []

    def short(rows, label, row_hash, shape, *given, real=boost.fit, **options):
        asked.append((shape.rounds, shape.depth))
        return real(rows, label, row_hash, replace(shape, rounds=2), *given, **options)

    monkeypatch.setattr(boost, "fit", short)
    monkeypatch.setattr(catalog, "once", lambda spark, key, build, inputs=(): build())
    catalog._trained(spark, sf)
    assert sorted(asked) == [(500, 5), (1000, 6)]        # the published rounds, and no other end but patience


def test_boosting_takes_a_fixed_number_of_rounds(parts):
    assert models.fit_family("xgboost", parts[0], ORDER, rounds=7).regressor.getNumTrees == 7


def test_patience_outlasts_weak_rounds():
    weak = [9.0, 8.0, 8.5, 8.4, 8.3, 7.0, *[7.5] * 9]
    assert models.best_round(weak, 10) == (6, False) and models.best_round([*weak, 7.2], 10) == (6, True)
    assert models.best_round([*weak, 7.2, 1.0], 10) == (6, True) and models.best_round([*weak, 6.9, 7.0], 10) == (16, False)


def _rows(spark, n=3000, parts=4, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 4, n), rng.normal(size=n)])
    y = 5 + 2 * (x[:, 0] > 0.3) - 3 * (x[:, 1] == 2) + 0.1 * rng.normal(size=n)
    rows = _vectors(spark, [(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))])
    return rows.repartition(parts, "id"), x, y


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, x array<double>, y double").select("id", array_to_vector("x").alias("features"), "y")


def _plain(x, y, edges, rounds, depth, rate, l2):
    """The same trees by exhaustive search over rows."""
    score = np.full(len(y), y.mean())
    for _ in range(rounds):
        leaf, values = np.zeros(len(y), int), np.zeros(len(y))
        groups = [np.arange(len(y))]
        for _ in range(depth):
            after = []
            for rows in groups:
                g, best = (score - y)[rows], (1e-9, None)
                for j, cuts in enumerate(edges):
                    for c in cuts:
                        left = x[rows, j] <= c
                        if left.all() or not left.any():
                            continue
                        gain = sum(g[m].sum() ** 2 / (m.sum() + l2) for m in (left, ~left)) - g.sum() ** 2 / (len(g) + l2)
                        best = max(best, (gain + 1e-12, left), key=lambda t: t[0])
                after += [rows] if best[1] is None else [rows[best[1]], rows[~best[1]]]
            groups = after
        for rows in groups:
            values[rows] = -rate * (score - y)[rows].sum() / (len(rows) + l2)
        score = score + values
    return score


def test_trees_equal_an_exhaustive_search(spark, monkeypatch):
    rows, x, y = _rows(spark, 400)
    shape = boost.Shape(5, depth=3, rate=0.3, l2=1.0)
    edges = boost.column_edges(rows, 3)
    want = _plain(x, y, [e[::12] if len(e) > 12 else e for e in edges], 5, 3, 0.3, 1.0)
    monkeypatch.setattr(boost, "column_edges", lambda rows, width: [e[::12] if len(e) > 12 else e for e in edges])
    assert np.allclose(boost.fit(rows, "y", F.xxhash64("id"), shape).predict(x), want)
    monkeypatch.setattr(boost, "BLOCK_ROWS", 100)        # four tasks, a job a level
    monkeypatch.setattr(boost, "RENEW", 2)
    assert np.allclose(boost.fit(rows, "y", F.xxhash64("id"), shape).predict(x), want)


def test_one_block_and_many_give_the_same_trees(spark, monkeypatch):
    rows, x, _ = _rows(spark)
    shape = boost.Shape(12, depth=4, l2=1.0, least=20, leaves=12, row_share=0.8, column_share=0.7)
    held = F.col("id") % 5 == 0
    judge = lambda errors: (len(errors), False)
    monkeypatch.setattr(boost, "column_edges", lambda rows, width, known=boost.column_edges(rows, 3): known)
    one = boost.fit(rows, "y", F.xxhash64("id"), shape, held, judge)
    monkeypatch.setattr(boost, "BLOCK_ROWS", 700)
    monkeypatch.setattr(boost, "RENEW", 5)
    many = boost.fit(rows, "y", F.xxhash64("id"), shape, held, judge)
    assert np.allclose(one.predict(x), many.predict(x)) and np.allclose(one.errors, many.errors)
    assert len(one.errors) == 12 and one.errors == sorted(one.errors, reverse=True)
    assert ((one.gain > 0).sum(axis=1) <= 11).all()


def test_many_blocks_grow_in_one_stage_without_a_job_a_level(spark, monkeypatch):
    rows, held = _rows(spark, 3000, 6)[0], F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    shape = boost.Shape(12, depth=4, l2=1.0, least=20, leaves=12, row_share=0.8, column_share=0.7)
    monkeypatch.setattr(boost, "column_edges", lambda rows, width, known=boost.column_edges(rows, 3): known)
    one = boost.fit(rows, "y", F.xxhash64("id"), shape, held, lambda errors: (len(errors), False))
    monkeypatch.setattr(boost, "BLOCK_ROWS", 700)
    in_jobs, refuse = boost._InJobs, lambda *_: pytest.fail("a job for each level")
    monkeypatch.setattr(boost, "_slots", lambda *_: 2)
    monkeypatch.setattr(boost, "_InJobs", refuse)
    staged = boost.fit(rows, "y", F.xxhash64("id"), shape, held, lambda errors: (len(errors), False))
    monkeypatch.setattr(boost, "_InJobs", in_jobs)
    monkeypatch.setattr(boost, "_slots", lambda *_: 1)          # cores that run together not known
    jobs = boost.fit(rows, "y", F.xxhash64("id"), shape, held, lambda errors: (len(errors), False))
    for many in (staged, jobs):
        assert (many.feature == one.feature).all() and (many.threshold == one.threshold).all()
        assert np.allclose(many.value, one.value) and np.allclose(many.errors, one.errors)


def test_rounds_end_at_the_best_validated_one(spark):
    rows, _, _ = _rows(spark)
    held = F.col("id") % 5 == 0
    found = boost.fit(rows, "y", F.xxhash64("id"), boost.Shape(60, depth=3), held, lambda errors: (3, len(errors) >= 7))
    longer = boost.fit(rows, "y", F.xxhash64("id"), boost.Shape(3, depth=3), held)
    assert len(found) == 3 and len(found.errors) == 3
    assert np.array_equal(found.threshold, longer.threshold) and np.array_equal(found.value, longer.value)


def test_rows_without_anything_to_learn(spark):
    nothing = boost.fit(_vectors(spark, []), "y", F.xxhash64("id"), boost.Shape(3, depth=2))
    same = boost.fit(_vectors(spark, [(1, [1.0], 4.0), (2, [1.0], 4.0), (3, [2.0], None)]), "y", F.xxhash64("id"), boost.Shape(3, depth=2))
    assert len(nothing) == 0 and same.predict(np.array([[1.0], [9.0]])).tolist() == [4.0, 4.0]


def test_a_family_that_never_ends_is_cancelled(parts, monkeypatch):
    def endless(features, preparation, keys, **_):
        features.rdd.coalesce(1).mapPartitions(lambda rows: [time.sleep(3600)]).count()      # leaves cores to the others

    monkeypatch.setattr(models, "fit_boost", endless)
    start = time.monotonic()
    fitted, status, registry = models.train_all(*parts, ORDER, families=["linear", "xgboost"], limit_s=40)
    assert time.monotonic() - start < 100 and list(fitted) == ["linear"] and registry.count() == 1
    assert [(r["trained"], r["note"]) for r in status.collect()] == [(True, ""), (False, "timed out after 40 s")]


def test_shuffled_columns_raise_the_error(trained, parts):
    rows = models.permutation_importance(trained[0]["histgb"], parts[1], ORDER).collect()
    assert len(rows) == 5 and rows[0]["increase"] > 0 and rows == sorted(rows, key=lambda r: -r["increase"])
    assert rows[0]["feature"] in ("tipo_via", "tiempo_estimado_min", "nivel_trafico")


def test_leaves_by_bits_are_those_of_a_walk():
    rng = np.random.default_rng(3)
    for depth, n in ((1, 2), (5, 40), (6, 1100), (7, 3)):      # (over 64 leaves a row walks)
        inner = 2 ** depth - 1
        grid = rng.random((4, 30))
        feature = rng.integers(0, 4, (n, inner))
        threshold = grid[feature, rng.integers(0, 30, (n, inner))]
        threshold[rng.random(threshold.shape) < 0.2] = np.inf
        trees = boost.Trees(0.5, 4, feature, threshold, np.ones((n, inner)), rng.normal(size=(n, inner + 1)))
        x = np.concatenate([rng.random((70, 4)), grid[:, :20].T, np.full((1, 4), np.nan), np.full((1, 4), np.inf), np.full((1, 4), -np.inf)])
        x[::7, 2] = np.nan
        assert np.array_equal(trees.predict(x), trees._walked(x, np.full(len(x), 0.5)))
        assert depth == 7 or trees._bits[0][0]      # it was not walked


def test_columns_of_few_bins_are_summed_together():
    rng, n = np.random.default_rng(4), 5000
    sizes = np.array([3, 250, 17, 1, 60, 40])
    bins = np.stack([rng.integers(0, s, n).astype(np.uint8) for s in sizes])
    y, held = bins[1] * 0.5 + bins[2] + rng.random(n), np.zeros(n, np.uint8)
    task = boost._InTask([(n, bins.tobytes(), y.tobytes(), rng.integers(0, 2 ** 62, n).astype(np.uint64).tobytes(), held.tobytes())], 6, 1.0)
    columns = np.array([0, 1, 3, 5])
    feature, cut = np.array([1]), np.array([100])
    root = task.sums([], (feature, cut), 0, np.array([0]), columns, sizes, (1.0, 0))
    right = task.sums([], (feature, cut), 1, np.array([1]), columns, sizes, (1.0, 0))
    assert len(task.bundles) == 3 and sorted(j for own, _ in task.bundles for j in own) == list(range(6))
    for (_, sums, counts), rows in ((root, bins[1] >= 0), (right, bins[1] > 100)):
        assert np.allclose(sums, np.concatenate([np.bincount(bins[j][rows], (1.0 - y)[rows], sizes[j]) for j in columns]))
        assert np.array_equal(counts, np.concatenate([np.bincount(bins[j][rows], minlength=sizes[j]) for j in columns]))


def test_the_side_of_fewer_rows_is_read():
    rng, n = np.random.default_rng(5), 1000
    bins = np.zeros((1, n), np.uint8)
    bins[0] = np.minimum(np.arange(n) // 10, 99)
    y = np.where(bins[0] > 89, 50.0, rng.random(n))      # the first split leaves nine tenths on the left
    task = boost._InTask([(n, bins.tobytes(), y.tobytes(), np.zeros(n, np.uint64).tobytes(), np.zeros(n, np.uint8).tobytes())], 1, 5.0)
    read, real = [], task.sums
    task.sums = lambda *given: (read.append((given[2], given[3].tolist())), real(*given))[1]
    boost._grown(task, boost.Shape(1, depth=2), np.array([100]), None)
    assert read == [(0, [0]), (1, [1])]


@pytest.mark.parametrize(("query", "family", "fit"), [("train_boost", "xgboost", "fit_boost"), ("train_hist_boost", "histgb", "fit_hist_boost"),
                                                      ("scenario_with_model", "xgboost", "fit_boost")])
def test_a_failed_training_is_an_error_of_its_query(spark, sf, parts, monkeypatch, query, family, fit):
    def broken(*_, **__):
        raise ValueError("no trees today")

    train_all = models.train_all
    monkeypatch.setattr(models, fit, broken)
    monkeypatch.setattr(models, "train_all", lambda *given: train_all(*given, families=["linear", family]))
    monkeypatch.setattr(catalog, "once", lambda _spark, _name, build, _inputs: build())
    monkeypatch.setattr(catalog, "_train", lambda *_: parts[0])
    monkeypatch.setattr(catalog, "_validation", lambda *_: parts[1])
    with pytest.raises(RuntimeError, match=f"{family} was not trained: no trees today"):
        catalog.QUERIES[query](spark, sf)


@pytest.mark.parametrize("family", ["linear", "xgboost"])
def test_executors_keep_no_feature_rows(parts, family):
    level = models.feature_rows(family, parts[0], ORDER)[1].storageLevel
    assert not (level.useMemory or level.useDisk)


def test_a_task_keeps_its_rows_in_mapped_files(monkeypatch):
    rng, n, width = np.random.default_rng(6), 9000, 6
    sizes = np.array([3, 250, 17, 1, 60, 40])
    bins = np.stack([rng.integers(0, s, n).astype(np.uint8) for s in sizes])
    y, held = bins[1] * 0.5 + bins[2] + rng.random(n), (rng.random(n) < 0.2).astype(np.uint8)
    keys = rng.integers(0, 2 ** 62, n).astype(np.uint64)
    at = np.array_split(np.arange(n), 4)
    grown = []
    for segment in (1 << 20, 1000):
        monkeypatch.setattr(boost, "SEGMENT", segment, raising=False)
        blocks = ((len(a), bins[:, a].tobytes(), y[a].tobytes(), keys[a].tobytes(), held[a].tobytes()) for a in at)
        task = boost._InTask(blocks, width, 1.0)
        shape = boost.Shape(6, depth=4, least=20, leaves=9, l2=1.0, row_share=0.8, column_share=0.8)
        grown.append((boost._grown(task, shape, sizes, lambda errors: (len(errors), False)), task.scores))
        whole = [a for a in vars(task).values() if isinstance(a, np.ndarray)]
        assert sum(a.nbytes for a in whole if not isinstance(a.base, np.memmap)) == 0
        assert sum(r.nbytes for nodes in task.nodes for both in nodes.values() for r in both) <= boost.ROW_BYTES * n
    (trees, errors), scores = grown[0]
    for others, seen in grown[1:]:
        assert np.allclose(errors, others[1]) and np.allclose(scores, seen)
        assert all(np.array_equal(a[i], b[i]) for a, b in zip(trees, others[0]) for i in (0, 1))
    assert len(trees) == 6 and errors[-1] < errors[0]
    place = np.zeros(n, np.int64)      # the first tree's leaves by a walk
    for _ in range(4):
        place = 2 * place + 1 + (bins[trees[0][0][place], np.arange(n)] > trees[0][1][place])
    one = boost._InTask([(n, bins.tobytes(), y.tobytes(), keys.tobytes(), held.tobytes())], width, 1.0)
    boost._grown(one, boost.Shape(1, depth=4, least=20, leaves=9, l2=1.0, row_share=0.8, column_share=0.8), sizes, lambda errors: (1, False))
    assert np.allclose(one.scores, 1.0 + trees[0][2][place - 15])


def test_both_tree_families_read_the_same_blocks(parts, monkeypatch):
    made, real = [], boost.column_edges
    monkeypatch.setattr(boost, "column_edges", lambda rows, width: (made.append(width), real(rows, width))[1])
    fitted, _, _ = models.train_all(*parts, ORDER, rounds=2, families=["histgb", "xgboost"])
    alone = models.fit_family("xgboost", parts[0], ORDER, rounds=2)
    rows = parts[1].limit(50)
    assert list(fitted) == ["histgb", "xgboost"] and len(made) == 2      # once for both, once alone
    assert fitted["xgboost"].predict(rows).select("prediction").collect() == alone.predict(rows).select("prediction").collect()
