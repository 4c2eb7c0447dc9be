"""Declared schemas and column names."""

from __future__ import annotations

from pyspark.sql import types as T

# The raw clinical columns, in training order.
RAW_FEATURES = [
    "male", "age", "education", "currentSmoker", "cigsPerDay", "BPMeds",
    "prevalentStroke", "prevalentHyp", "diabetes", "totChol", "sysBP",
    "diaBP", "BMI", "heartRate", "glucose",
]

# The derived columns, in training order.
DERIVED_FEATURES = [
    "pulse_pressure", "map_bp", "age_sysBP", "metabolic_risk", "age_squared",
    "hypertension_flag", "high_chol_flag", "diabetes_flag",
    "smoking_pack_years", "age_smoking", "bmi_bp", "male_age", "age_diaBP",
    "age_glucose", "sysBP_chol", "male_sysBP", "age_prevalentHyp", "age_BMI",
    "risk_factor_count", "log_glucose", "log_totChol", "log_cigsPerDay",
    "age_risk_interaction", "bmi_overweight", "bmi_obese",
]

FEATURES = RAW_FEATURES + DERIVED_FEATURES
KEY = "pid"
LABEL = "TenYearCHD"

PATIENT_SCHEMA = T.StructType(
    [T.StructField(KEY, T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in RAW_FEATURES]
    + [T.StructField(LABEL, T.IntegerType())]
)
