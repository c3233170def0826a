"""The three dashboard pages, put together from a prepared table."""

from parcelcast.operators import registry as reg, scenario
from parcelcast.plans import pages
from parcelcast.plans.catalog import row_hash
from parcelcast.session import ROW_ID
from parcelcast.sources.deliveries import ORDER
from tests.test_registry import PUBLISHED, raw


def test_actual_page(spark, prepared):
    validation = prepared.where("split = 'validation'")
    page = pages.actual_page(validation, reg.load_registry(raw(spark, PUBLISHED)), ORDER, "xgboost")
    kpis = page["kpis"].first()
    assert kpis["n_records"] == validation.count() and kpis["rmse"] == 5.134493670719292
    assert page["flashcards"].count() == 8 and page["evolucion_temporal"].count() == 20
    assert page["lluvia_impacto"].agg({"n": "sum"}).first()[0] == validation.count()
    for part in ("por_localidad", "por_via", "trafico_impacto"):
        assert page[part].agg({"count": "sum"}).first()[0] == validation.count()


def test_actual_page_with_filters(spark, prepared):
    filters = {"road": "Local", "max_traffic": 0.7}
    page = pages.actual_page(prepared, reg.load_registry(raw(spark, PUBLISHED)), ORDER, filters=filters)
    assert page["kpis"].first()["n_records"] == prepared.where("tipo_via = 'Local' and nivel_trafico <= 0.7").count()
    assert [r["tipo_via"] for r in page["por_via"].collect()] == ["Local"]


def test_confidence_page(spark, prepared):
    validation = prepared.where("split = 'validation'")
    page = pages.confidence_page(validation, reg.load_registry(raw(spark, PUBLISHED)), [*ORDER, ROW_ID])
    assert page["mejor_modelo"].first()["best_model"] == "linear"
    assert page["evolucion_error"].count() == 10 and page["distribucion_error"].agg({"n": "sum"}).first()[0] == validation.count()
    assert page["histograma_error"].agg({"n": "sum"}).first()[0] == validation.count()


def test_future_page(spark, prepared):
    pool = prepared.where("split = 'validation'").withColumn("row_hash", row_hash())
    page = pages.future_page(pool, reg.load_registry(raw(spark, PUBLISHED)), {"glm": scenario.formula_predictor}, "glm", "2024-02")
    assert page["kpis"].first()["mape"] == 0.0737716613873419 and page["kpis"].first()["horizon"] == "2024-02"
    assert page["riesgo_por_localidad"].count() == 6 and page["daily"].count() == 29
    nested = pages.monthly_payload(page).first()
    assert len(nested["trafico_vs_riesgo"]) == 29
