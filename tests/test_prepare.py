import math

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lopside.functions.features import engineer_features
from lopside.operators import prepare as P
from lopside.operators.quantiles import exact_quantiles, order_statistics
from lopside.plans.prepare import fit_prepare, prepare
from lopside.schema import DERIVED_FEATURES, FEATURES, KEY, LABEL, PATIENT_SCHEMA, RAW_FEATURES
from lopside.sources.patient import patient
from lopside.sources.tables import MissingColumns, check_inputs, read_table, write_table


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v double")


def test_median_of_even_count_is_the_middle(spark):
    df = column(spark, [1.0, 2.0, 3.0, 10.0, None])
    assert P.fit_medians(df, ["v"]) == {"v": 2.5}


def test_complete_columns_get_no_median(spark):
    assert P.fit_medians(column(spark, [1.0, 2.0]), ["v"]) == {}


def test_quantiles_match_builtin(spark):
    df = spark.range(1, 5000).select(((F.col("id") * 7919) % 1237 / 3.0).alias("v"))
    fractions = [0.1, 0.25, 0.5, 0.9, 1.0]
    want = df.agg(F.percentile("v", F.array(*map(F.lit, fractions)))).first()[0]
    got = exact_quantiles(df, ["v"], fractions)["v"]
    assert got == pytest.approx(want, abs=1e-9)


def test_quantiles_of_awkward_values(spark):
    values = [0.0, -0.0, -1.5, 1e300, -1e300, 5e-324, float("inf"), 2.0, 2.0, 2.0, None]
    df = spark.createDataFrame([(v, None, 1.0) for v in values], "v double, none double, one double").repartition(3)
    known = sorted(v for v in values if v is not None)
    got = exact_quantiles(df, ["v", "none", "one"], [i / (len(known) - 1) for i in range(len(known))])
    assert got["v"] == known and set(got["none"]) == {None} and set(got["one"]) == {1.0}
    assert set(exact_quantiles(df, ["v", "one"], [0.5], only_with_nulls=True)) == {"v"}
    cuts = order_statistics(df, ["v", "none", "one"], 5)
    assert cuts["v"] == sorted({known[i * len(known) // 5] for i in range(1, 5)})
    assert cuts["none"] == [] and cuts["one"] == [1.0]


def test_scaler_uses_population_deviation(spark):
    params = P.scaler_params(P.fit_scaler(column(spark, [1.0, 2.0, 3.0, 10.0]), ["v"]))
    assert params["v"] == (4.0, pytest.approx(3.535533905932738))


def test_constant_column_keeps_scale_one(spark):
    params = P.scaler_params(P.fit_scaler(column(spark, [5.0, 5.0, 5.0]), ["v"]))
    assert P.scale(column(spark, [9.0]), params).first()["v"] == 4.0


def test_scaler_table_scales_like_its_parameters(spark):
    df = column(spark, [1.0, 3.0])
    got = [r["v"] for r in P.scale(df, P.fit_scaler(df, ["v"])).collect()]
    assert sorted(got) == [-1.0, 1.0]


def patient_row(spark, **values):
    base = dict.fromkeys(RAW_FEATURES, 1.0) | values
    return spark.createDataFrame([(1, *[base[c] for c in RAW_FEATURES], 0)], PATIENT_SCHEMA)


def test_flags_of_missing_values_are_zero(spark):
    for missing in (None, float("nan")):
        row = engineer_features(patient_row(spark, sysBP=missing)).first()
        assert row["hypertension_flag"] == 0


def test_derived_columns_follow_raw_ones(spark):
    df = engineer_features(patient_row(spark))
    assert df.columns == [KEY, *RAW_FEATURES, LABEL, *DERIVED_FEATURES]
    assert len(FEATURES) == 40


def test_formulas(spark):
    row = engineer_features(patient_row(
        spark, sysBP=150.0, diaBP=90.0, age=50.0, BMI=31.0, glucose=130.0, totChol=250.0, cigsPerDay=20.0
    )).first()
    assert row["pulse_pressure"] == 60.0 and row["map_bp"] == 110.0
    assert row["risk_factor_count"] == 8 and row["age_risk_interaction"] == 400.0
    assert row["bmi_obese"] == 1 and row["bmi_overweight"] == 0
    assert row["age_smoking"] == 10.0
    assert row["log_glucose"] == pytest.approx(math.log1p(130.0))


def test_nan_becomes_null(spark):
    df = P.nan_to_null(column(spark, [float("nan"), 1.0, None]), ["v"])
    assert df.where("v IS NULL").count() == 2


def test_drop_incomplete_counts(spark):
    seen = Observation("dropped")
    rows = P.drop_incomplete(column(spark, [1.0, None]), ["v"], seen).collect()
    assert len(rows) == 1 and seen.get == {"rows": 2, "dropped": 1}


def test_empty_median_map_drops_rows(spark):
    df = patient_row(spark, glucose=None)
    scaler = dict.fromkeys(FEATURES, (0.0, 1.0))
    assert prepare(df, {}, scaler).count() == 0
    assert prepare(df, {"glucose": 80.0}, scaler).count() == 1


def test_missing_columns_fail_before_any_job(spark):
    with pytest.raises(MissingColumns, match="sysBP"):
        check_inputs(column(spark, [1.0]), ["v", "sysBP"])
    with pytest.raises(ValueError, match="scaler"):
        prepare(patient_row(spark), {}, {})


def test_tables_round_trip(spark, sf, tmp_path):
    rows = patient(spark, sf)
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        write_table(rows, path, fmt)
        back = read_table(spark, path, PATIENT_SCHEMA, fmt)
        assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    with pytest.raises(FileNotFoundError):
        read_table(spark, str(tmp_path / "absent"), PATIENT_SCHEMA)


def test_fit_part_is_centred(parts):
    row = parts.part("train").agg(
        *[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES]
    ).first()
    for c in FEATURES:
        assert row[f"m_{c}"] == pytest.approx(0.0, abs=1e-9)
        assert row[f"s_{c}"] == pytest.approx(1.0, abs=1e-9) or row[f"s_{c}"] == 0.0


def test_held_out_rows_do_not_leak(spark, sf, parts):
    """Spoiling test and validation rows changes nothing that is fitted."""
    held = parts.table.where("split <> 'train'").select(KEY, F.lit(True).alias("held"))
    spoiled = (
        patient(spark, sf).join(held, KEY, "left")
        .withColumn("glucose", F.when(F.col("held"), F.lit(9999.0)).otherwise(F.col("glucose")))
        .drop("held")
    )
    again = fit_prepare(spoiled)
    assert again.medians == parts.medians
    for c in FEATURES:
        assert again.scaler[c] == pytest.approx(parts.scaler[c], rel=1e-12)
