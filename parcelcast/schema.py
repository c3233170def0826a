"""Schemas, fixed values and default tables shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

TARGET = "tiempo_real_min"
ESTIMATE = "tiempo_estimado_min"
TIMESTAMP = "fecha_pedido"

MASTER = T.StructType([
    T.StructField("fecha_pedido", T.TimestampType()),
    T.StructField("localidad", T.StringType()),
    T.StructField("estrato", T.IntegerType()),
    T.StructField("tipo_via", T.StringType()),
    T.StructField("tipo_zona", T.StringType()),
    T.StructField("vehiculo", T.StringType()),
    T.StructField("distancia_km", T.DoubleType()),
    T.StructField("nivel_trafico", T.DoubleType()),
    T.StructField("lluvia_mm", T.DoubleType()),
    T.StructField("pendiente_promedio", T.DoubleType()),
    T.StructField("zona_riesgo", T.DoubleType()),
    T.StructField("cliente_ausente", T.IntegerType()),
    T.StructField("intentos_entrega", T.IntegerType()),
    T.StructField("tiempo_estimado_min", T.DoubleType()),
    T.StructField("tiempo_real_min", T.DoubleType()),
])

REGISTRY = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("MAE", T.DoubleType()),
    T.StructField("MSE", T.DoubleType()),
    T.StructField("RMSE", T.DoubleType()),
    T.StructField("MAPE", T.DoubleType()),
    T.StructField("n_train", T.LongType()),
    T.StructField("n_validation", T.LongType()),
])

# Feature lists, in matrix order.
CATEGORICAL = ["localidad", "tipo_via", "tipo_zona", "vehiculo"]
NUMERIC = [
    "estrato", "distancia_km", "nivel_trafico", "lluvia_mm", "pendiente_promedio", "zona_riesgo",
    "cliente_ausente", "intentos_entrega", "tiempo_estimado_min", "eficiencia_estimacion",
    "anio", "mes", "dia", "dia_semana",
]
FEATURES = NUMERIC + CATEGORICAL
TREE_FEATURES = [
    "localidad", "estrato", "tipo_via", "tipo_zona", "vehiculo", "distancia_km", "nivel_trafico",
    "lluvia_mm", "pendiente_promedio", "zona_riesgo", "cliente_ausente", "intentos_entrega",
    "tiempo_estimado_min", "anio", "mes", "dia", "dia_semana", "eficiencia_estimacion",
]
FAMILIES = ["linear", "glm", "histgb", "xgboost"]

# Business thresholds and sizes.
ON_TIME_MIN = 60.0
TRAIN_RATIO = 0.8
MIN_BASE_DEMAND = 40
MIN_DAY_DEMAND = 20
DAY_SAMPLE = (10, 28)
ZONE_SAMPLE = (8, 24)
DEMAND_PER_SAMPLE = 20
POOL_PER_SAMPLE = 40
TOP_ZONES = 6
TOP_ESTIMATES = 20
RAIN_ROWS = 50
ERROR_ROWS = 200
ERROR_SEGMENTS = 10
VARIABILITY_WEIGHT = 0.35
PREDICTION_FLOOR = 0.1
DEFAULT_MODEL = "linear"

# Delivery time in minutes as a function of the features, and the physical range.
BASE_MINUTES = 20.0
MINUTES_PER_KM = 2.5
ESTIMATED_MINUTES_PER_TRAFFIC = 20.0
REAL_MINUTES_PER_TRAFFIC = 30.0
MINUTES_PER_RAIN_MM = 1.8
MINUTES_PER_SLOPE = 0.7
MINUTES_RANGE = (8.0, 180.0)

# Peak hours (both ends included) and rainy months.
PEAK_HOURS = [(6, 9), (16, 20)]
RAINY_MONTHS = [4, 5, 10, 11]

# Minutes added by road type.
ROAD_MINUTES = {"Troncal": 0.0, "Arterial": 5.0, "Local": 9.0, "Destapada": 20.0}

# Zones accepted by the request form.
KNOWN_ZONES = [
    "Usaquén", "Chapinero", "Santa Fe", "San Cristóbal", "Usme", "Kennedy", "Fontibón", "Engativá",
    "Suba", "Barrios Unidos", "Teusaquillo", "Los Mártires", "Antonio Nariño", "Puente Aranda",
    "La Candelaria", "Rafael Uribe Umaña", "Ciudad Bolívar", "Sumapaz",
]

# What a prediction request may leave out.
REQUEST_DEFAULTS = {
    "estrato": 3, "distancia_km": 5.0, "nivel_trafico": 2.0, "lluvia_mm": 0.0,
    "pendiente_promedio": 0.5, "zona_riesgo": 0.0, "cliente_ausente": 0, "intentos_entrega": 1,
    "tiempo_estimado_min": 15.0, "anio": 2024, "mes": 1, "dia": 1, "dia_semana": 0,
    "localidad": "Kennedy", "tipo_via": "Calle", "tipo_zona": "Urbana", "vehiculo": "Moto",
}

# What a projected day falls back to when a feature is missing or zero.
SCENARIO_DEFAULTS = {
    "localidad": "Kennedy", "tipo_via": "Calle", "tipo_zona": "Urbana", "vehiculo": "Moto",
    "estrato": 3, "distancia_km": 5.0, "nivel_trafico": 2.0, "lluvia_mm": 0.0,
    "pendiente_promedio": 0.5, "zona_riesgo": 0, "cliente_ausente": 0, "intentos_entrega": 1,
    "tiempo_estimado_min": 45.0,
}

# Accepted ranges (field, low, low is inclusive, high, high is inclusive).
REQUEST_BOUNDS = [
    ("distancia_km", 0.1, False, 50.0, False),
    ("nivel_trafico", 1.0, True, 5.0, True, "integer"),
    ("lluvia_mm", 0.0, True, 100.0, True),
    ("estrato", 1.0, True, 6.0, True),
    ("tiempo_estimado_min", 0.0, False, 500.0, False),
]
TABLE_BOUNDS = [
    ("distancia_km", 0.5, True, 15.0, True),
    ("nivel_trafico", 0.2, True, 1.0, True),
    ("estrato", 1.0, True, 6.0, True),
    ("pendiente_promedio", 0.0, True, 15.0, True),
    ("zona_riesgo", 0.0, True, 1.0, True),
    ("tiempo_real_min", 8.0, True, 180.0, True),
]
REQUIRED_REQUEST_FIELDS = ["localidad", "distancia_km", "nivel_trafico", "tiempo_estimado_min"]

# Fragment of a registry name -> short model name, first match wins.
MODEL_NAME_FRAGMENTS = [
    ("linear", "linear"), ("glm", "glm"), ("histgradient", "histgb"), ("xgboost", "xgboost"),
]
# Registry names written by training, and the order in which models stand in for each other.
REGISTRY_NAMES = {
    "linear": "Linear Regression", "glm": "GLM (Gamma, log-link)",
    "histgb": "HistGradientBoosting", "xgboost": "XGBoost",
}
FALLBACK_ORDER = ["linear", "histgb", "xgboost", "glm"]

# Dashboard cards (label, figure, unit, trend), those of the table and those of the model.
TABLE_CARDS = [
    ("ETA Promedio", "eta_mean", "min", None), ("ETA Máximo", "eta_max", "min", None),
    ("ETA Mínimo", "eta_min", "min", None), ("Desviación Estándar", "eta_std", "min", None),
]
MODEL_CARDS = [
    ("Error Promedio (MAE)", "mae", "min", "down"), ("RMSE", "rmse", "min", "down"),
    ("Error Porcentual (MAPE)", "mape * 100", "%", "down"),
    ("Registros Validación", "cast(n_validation as double)", "registros", None),
]
# Names of the compared figures, in display order.
COMPARED = ["Demanda diaria", "ETA promedio (min)", "% Retrasos"]

# Output contracts.
KPIS_ACTUAL = [
    "model_name", "eta_mean", "eta_max", "eta_min", "eta_std", "n_records", "otif", "delays_pct",
    "mae", "rmse", "mape",
]
KPIS_FUTURE = [
    "model_name", "eta_mean", "otif", "delays_pct", "n_records", "horizon",
    "demand_month_predicted", "demand_daily_predicted_mean", "mae", "rmse", "mape",
]
KPIS_CONFIDENCE = [
    "n_models", "precision_global", "mae_global", "rmse_global", "mape_global", "best_model",
    "best_rmse", "score_confianza",
]
DAILY = [
    "day", "eta_expected", "otif_expected", "delays_expected", "demand_predicted",
    "traffic_expected", "risk_delay",
]
