"""Scan, projection, profile and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lopside.catalog import sql as S
from lopside.functions.features import engineer_features
from lopside.operators import prepare as P
from lopside.plans.prepare import class_profile, fit_prepare
from lopside.schema import DERIVED_FEATURES, FEATURES, KEY, LABEL, RAW_FEATURES
from lopside.session import small_table
from lopside.sources.patient import patient, scored_patients
from lopside.sources.tables import check_inputs, read_table

RATES = {"glucose": 80.0, "BMI": 25.0, "totChol": 230.0}


def rounded(df, columns, places=6):
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) + F.lit(0.0) for c in columns})


def param_rows(spark, values: dict[str, float], name: str, value: str):
    return small_table(spark, list(values.items()), f"{name} string, {value} double")


def scan(spark, d):
    orders = read_table(spark, f"{d}/orders.parquet")
    return check_inputs(orders, ["o_orderkey", "o_custkey", "o_totalprice"]).select(
        "o_orderkey", "o_custkey", F.round("o_totalprice", 2).alias("o_totalprice"),
        "o_orderstatus", "o_orderpriority",
    )


def patient_rows(spark, d):
    return patient(spark, d)


def features(spark, d):
    return rounded(engineer_features(patient(spark, d)), DERIVED_FEATURES).select(
        KEY, *DERIVED_FEATURES
    )


def align(spark, d):
    names = ["age", "sysBP", "pulse_pressure", "risk_factor_count", "bmi_obese"]
    return P.align_features(engineer_features(patient(spark, d)), names, keep=(KEY,))


def unlabelled(spark, d):
    rows, had_label = P.split_label(patient(spark, d), LABEL)
    return rows.withColumn("had_label", F.lit(had_label).cast("int"))


def nan_to_null(spark, d):
    # log of a negative number is NaN in the scan's own arithmetic
    spoiled = patient(spark, d).select(
        KEY,
        F.when(F.col("sysBP") >= 150, F.lit(float("nan"))).otherwise(F.col("sysBP")).alias("sysBP"),
        F.when(F.col("age") < 40, F.lit(float("nan"))).otherwise(F.col("age")).alias("age"),
    )
    return P.nan_to_null(spoiled, ["sysBP", "age"])


def impute(spark, d):
    return P.impute(patient(spark, d), RATES)


def drop_incomplete(spark, d):
    return P.drop_incomplete(patient(spark, d), RAW_FEATURES)


def attach_label(spark, d):
    rows = patient(spark, d)
    return P.attach_label(rows.select(KEY, "age", "sysBP"), rows.select(KEY, LABEL), KEY)


def missing(spark, d):
    return P.missing_profile(patient(spark, d), [*RAW_FEATURES, LABEL])


def medians(spark, d):
    fitted = P.fit_medians(patient(spark, d), RAW_FEATURES)
    return param_rows(spark, fitted, "feature", "median")


def class_counts(spark, d):
    return rounded(P.class_distribution(patient(spark, d), LABEL), ["share"])


def pos_weight(spark, d):
    return rounded(P.class_weights(patient(spark, d), LABEL), ["pos_weight", "weight_0", "weight_1"])


def scaler_fit(spark, d):
    derived = engineer_features(P.impute(patient(spark, d), P.fit_medians(patient(spark, d), RAW_FEATURES)))
    return rounded(P.fit_scaler(derived, FEATURES), ["mean", "scale"], 4)


def scale(spark, d):
    names = ["age", "sysBP", "diaBP", "heartRate"]
    rows = patient(spark, d).select(KEY, *names)
    return rounded(P.scale(rows, P.fit_scaler(rows, names)), names)


def attach_params(spark, d):
    """The same scaling with parameters attached as one broadcast row."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    scaled = P.attach_params(lines, P.fit_scaler(lines, names)).select(
        "l_orderkey", "l_linenumber",
        *[((F.col(c) - F.col("param_mean")[c]) / F.col("param_scale")[c]).alias(c) for c in names],
    )
    return rounded(scaled, names, 4)


def prepared(spark, d):
    return rounded(fit_prepare(patient(spark, d)).table, FEATURES, 5)


def prepared_profile(spark, d):
    return class_profile(fit_prepare(patient(spark, d)))


def two_tables(spark, d):
    rows = patient(spark, d)
    return rows.where(F.col(KEY) % 5 != 0), rows.where(F.col(KEY) % 5 == 0)


def prepared_tables(spark, d):
    """Training and test rows that come as two tables; every fifth key is the latter."""
    train, test = two_tables(spark, d)
    return rounded(fit_prepare(train, test=test).table, FEATURES, 5)


def prepared_smote(spark, d):
    """The same, with the train part balanced by synthetic rows."""
    train, test = two_tables(spark, d)
    return rounded(fit_prepare(train, test=test, oversample=True).table, FEATURES, 4)


def preview(spark, d):
    return P.preview(scored_patients(spark, d), 10, KEY)


def stack(spark, d):
    prepared_rows = scored_patients(spark, d).withColumn("high", F.col("p") >= 0.5)
    return P.stack(
        prepared_rows.where("high").select(KEY, "y"),
        prepared_rows.where("NOT high").select("y", KEY),
    )


QUERIES = {
    "q_scan": scan,
    "q_patient": patient_rows,
    "q_features": features,
    "q_align": align,
    "q_unlabelled": unlabelled,
    "q_nan_to_null": nan_to_null,
    "q_impute": impute,
    "q_drop_incomplete": drop_incomplete,
    "q_attach_label": attach_label,
    "q_missing": missing,
    "q_medians": medians,
    "q_class_counts": class_counts,
    "q_pos_weight": pos_weight,
    "q_scaler_fit": scaler_fit,
    "q_scale": scale,
    "q_attach_params": attach_params,
    "q_prepared": prepared,
    "q_prepared_profile": prepared_profile,
    "q_prepared_tables": prepared_tables,
    "q_prepared_smote": prepared_smote,
    "q_preview": preview,
    "q_stack": stack,
}

_label = S.q(LABEL)
_raw = ", ".join(S.q(c) for c in RAW_FEATURES)
_four = ["age", "sysBP", "diaBP", "heartRate"]
_line = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_tables = f"""{S.PATIENT}, own AS (SELECT * FROM patient WHERE pid % 5 <> 0),
{S.split_cte('own', 'marked', _label, '0.15', 42, 'train', 'val')},
tagged AS (SELECT * FROM marked UNION ALL SELECT *, 'test' AS split FROM patient WHERE pid % 5 = 0),
{S.imputed_cte()}, {S.with_features('imputed', 'derived')}, {S.scaled_cte()}"""
_apart = " + ".join(f"pow(a.{S.q(c)} - b.{S.q(c)}, 2)" for c in FEATURES)
_between = ", ".join(
    f"round(a.{S.q(c)} + u * (b.{S.q(c)} - a.{S.q(c)}), 4) + 0e0 AS {S.q(c)}" for c in FEATURES)

ORACLES = {
    "q_scan": "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice, o_orderstatus, o_orderpriority FROM orders",
    "q_patient": f"WITH {S.PATIENT} SELECT * FROM patient",
    "q_features": f"""WITH {S.PATIENT}, {S.with_features('patient', 'derived')}
SELECT pid, {S.rounded(DERIVED_FEATURES)} FROM derived""",
    "q_align": f"""WITH {S.PATIENT}, {S.with_features('patient', 'derived')}
SELECT pid, age, "sysBP", pulse_pressure, risk_factor_count, bmi_obese FROM derived""",
    "q_unlabelled": f"WITH {S.PATIENT} SELECT * EXCLUDE ({_label}), 1::INTEGER AS had_label FROM patient",
    "q_nan_to_null": f"""WITH {S.PATIENT} SELECT pid,
  CASE WHEN "sysBP" < 150 THEN "sysBP" END AS "sysBP", CASE WHEN age >= 40 THEN age END AS age FROM patient""",
    "q_impute": f"""WITH {S.PATIENT} SELECT * REPLACE (
  COALESCE(glucose, 80) AS glucose, COALESCE("BMI", 25) AS "BMI", COALESCE("totChol", 230) AS "totChol") FROM patient""",
    "q_drop_incomplete": f"WITH {S.PATIENT} SELECT * FROM patient WHERE "
    + " AND ".join(f"{S.q(c)} IS NOT NULL" for c in RAW_FEATURES),
    "q_attach_label": f"""WITH {S.PATIENT} SELECT a.pid, a.age, a."sysBP", b.{_label}
FROM patient a JOIN patient b ON a.pid = b.pid""",
    "q_missing": f"WITH {S.PATIENT} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({S.q(c)} IS NULL) AS n_missing FROM patient"
        for c in [*RAW_FEATURES, LABEL]
    )
    + " UNION ALL SELECT 'total', ("
    + " + ".join(f"count(*) FILTER ({S.q(c)} IS NULL)" for c in [*RAW_FEATURES, LABEL])
    + ") FROM patient",
    "q_medians": f"WITH {S.PATIENT} SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN count(*) > count({S.q(c)}) THEN median({S.q(c)}) END AS median FROM patient"
        for c in RAW_FEATURES
    )
    + ") WHERE median IS NOT NULL",
    "q_class_counts": f"""WITH {S.PATIENT} SELECT {_label} AS class, count(*) AS n,
  round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM patient GROUP BY 1""",
    "q_pos_weight": f"""WITH {S.PATIENT}, c AS (SELECT count(*) FILTER ({_label} = 0)::DOUBLE AS n0,
  count(*) FILTER ({_label} = 1)::DOUBLE AS n1 FROM patient)
SELECT round(n0 / n1, 6) AS pos_weight, round((n0 + n1) / (2 * n0), 6) AS weight_0,
  round((n0 + n1) / (2 * n1), 6) AS weight_1 FROM c""",
    "q_scaler_fit": f"""WITH {S.PATIENT}, {S.imputed_cte('patient', 'imputed', 'TRUE')},
{S.with_features('imputed', 'derived')} """
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {i}::INTEGER AS pos, round(avg({S.q(c)}), 4) AS mean, "
        f"round(CASE WHEN stddev_pop({S.q(c)}) = 0 THEN 1 ELSE stddev_pop({S.q(c)}) END, 4) AS scale FROM derived"
        for i, c in enumerate(FEATURES)
    ),
    "q_scale": f"""WITH {S.PATIENT}, {S.scaled_cte('patient', 'scaled', 'TRUE', _four, 'pid')}
SELECT pid, {S.rounded(_four)} FROM scaled""",
    "q_attach_params": f"""WITH {S.scaled_cte('lineitem', 'scaled', 'TRUE', _line, 'l_orderkey, l_linenumber')}
SELECT l_orderkey, l_linenumber, {S.rounded(_line, 4)} FROM scaled""",
    "q_prepared": f"WITH {S.prepared_ctes()} SELECT pid, {_label}, split, {S.rounded(FEATURES, 5)} FROM scaled",
    "q_prepared_profile": f"""WITH {S.PATIENT}, {S.three_way_cte()}
SELECT split, {_label} AS class, count(*) AS n FROM tagged GROUP BY 1, 2""",
    "q_prepared_tables": f"WITH {_tables} SELECT pid, {_label}, split, {S.rounded(FEATURES, 5)} FROM scaled",
    "q_prepared_smote": f"""WITH {_tables},
few AS MATERIALIZED (SELECT * FROM scaled WHERE split = 'train' AND {_label} = 1),
size AS (SELECT count(*) FILTER ({_label} = 1) AS n_min,
    count(*) FILTER ({_label} = 0) - count(*) FILTER ({_label} = 1) AS n_new FROM scaled WHERE split = 'train'),
near AS MATERIALIZED (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, r) AS rank FROM (
    SELECT a.pid AS q, b.pid AS r, {_apart} AS dist FROM few a JOIN few b ON a.pid <> b.pid)) WHERE rank <= 5),
planned AS (
  SELECT pid, n_new // n_min + CASE WHEN row_number() OVER (ORDER BY {S.digest(42, 'pid')}, pid) <= n_new % n_min THEN 1 ELSE 0 END AS n
  FROM few, size),
copies AS (
  SELECT pid, copy, (('0x' || substr({S.digest(42, 'pid', 'copy')}, 1, 8))::BIGINT % 5) + 1 AS rank,
    {S.uniform(S.digest(43, 'pid', 'copy'))} AS u
  FROM planned, unnest(range(1, n + 1)) AS t(copy))
SELECT c.pid || '#' || copy AS sid, 1::INTEGER AS {_label}, 'train' AS split, {_between}
FROM copies c JOIN near ON near.q = c.pid AND near.rank = c.rank JOIN few a ON a.pid = c.pid JOIN few b ON b.pid = near.r
UNION ALL SELECT pid::VARCHAR, {_label}, split, {S.rounded(FEATURES, 4)} FROM scaled""",
    "q_preview": f"WITH {S.SCORED} SELECT * FROM scored ORDER BY pid LIMIT 10",
    "q_stack": f"WITH {S.SCORED} SELECT pid, y FROM scored WHERE p >= 0.5e0 UNION ALL SELECT pid, y FROM scored WHERE p < 0.5e0",
}
