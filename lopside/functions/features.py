"""The clinical feature recipe: 25 derived columns as pure projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lopside.sources.tables import check_inputs

# The columns the recipe reads.
RECIPE_INPUTS = [
    "male", "age", "currentSmoker", "cigsPerDay", "BPMeds", "prevalentStroke",
    "prevalentHyp", "totChol", "sysBP", "diaBP", "BMI", "glucose",
]


def flag(condition: Column) -> Column:
    """0/1, with an unknown condition counted as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def known(name: str) -> Column:
    """The column with NaN read as missing (Spark orders NaN above all)."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def engineer_features(df: DataFrame) -> DataFrame:
    """Add the 25 derived columns. Two narrow projections, no shuffle."""
    check_inputs(df, RECIPE_INPUTS)
    c = {name: F.col(name).cast("double") for name in RECIPE_INPUTS}
    at_least = lambda name, bound: flag(known(name) >= F.lit(float(bound)))
    is_one = lambda name: flag(known(name) == F.lit(1.0))

    first = {
        "pulse_pressure": c["sysBP"] - c["diaBP"],
        "map_bp": c["diaBP"] + (c["sysBP"] - c["diaBP"]) / F.lit(3.0),
        "age_sysBP": c["age"] * c["sysBP"],
        "metabolic_risk": c["BMI"] * c["glucose"],
        "age_squared": c["age"] * c["age"],
        "hypertension_flag": at_least("sysBP", 140),
        "high_chol_flag": at_least("totChol", 240),
        "diabetes_flag": at_least("glucose", 126),
        "smoking_pack_years": c["currentSmoker"] * c["cigsPerDay"],
        "age_smoking": c["age"] * c["cigsPerDay"] / F.lit(100.0),
        "bmi_bp": c["BMI"] * c["sysBP"],
        "male_age": c["male"] * c["age"],
        "age_diaBP": c["age"] * c["diaBP"],
        "age_glucose": c["age"] * c["glucose"],
        "sysBP_chol": c["sysBP"] * c["totChol"],
        "male_sysBP": c["male"] * c["sysBP"],
        "age_prevalentHyp": c["age"] * c["prevalentHyp"],
        "age_BMI": c["age"] * c["BMI"],
        "risk_factor_count": (
            at_least("sysBP", 140) + at_least("totChol", 240)
            + at_least("glucose", 126) + at_least("BMI", 30)
            + is_one("currentSmoker") + is_one("BPMeds")
            + is_one("prevalentHyp") + is_one("prevalentStroke")
        ),
        "log_glucose": F.log1p(c["glucose"]),
        "log_totChol": F.log1p(c["totChol"]),
        "log_cigsPerDay": F.log1p(c["cigsPerDay"]),
    }
    second = {
        "age_risk_interaction": c["age"] * F.col("risk_factor_count"),
        "bmi_overweight": flag(
            (known("BMI") >= F.lit(25.0)) & (known("BMI") < F.lit(30.0))
        ),
        "bmi_obese": at_least("BMI", 30),
    }
    return df.withColumns(first).withColumns(second)
