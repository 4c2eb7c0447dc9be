"""Shared pieces of the SQL twins (ANSI with DuckDB spellings)."""

from __future__ import annotations

from lopside.schema import FEATURES, LABEL, RAW_FEATURES

PATIENT = f"""
patient AS (
  SELECT ok AS pid,
    (ck % 2)::DOUBLE AS male, (32 + ck % 39)::DOUBLE AS age,
    (CASE WHEN ok % 41 <> 0 THEN 1 + ok % 4 END)::DOUBLE AS education,
    (CASE WHEN ck % 7 < 3 THEN 1 ELSE 0 END)::DOUBLE AS "currentSmoker",
    (CASE WHEN ok % 149 = 0 THEN NULL WHEN ck % 7 < 3 THEN 1 + ok % 40 ELSE 0 END)::DOUBLE AS "cigsPerDay",
    (CASE WHEN ok % 79 = 0 THEN NULL WHEN ok % 33 = 0 THEN 1 ELSE 0 END)::DOUBLE AS "BPMeds",
    (CASE WHEN ok % 167 = 0 THEN 1 ELSE 0 END)::DOUBLE AS "prevalentStroke",
    (CASE WHEN 95 + tp % 100 >= 150 THEN 1 ELSE 0 END)::DOUBLE AS "prevalentHyp",
    (CASE WHEN ok % 39 = 0 THEN 1 ELSE 0 END)::DOUBLE AS diabetes,
    (CASE WHEN ok % 83 <> 0 THEN 150 + tp % 203 END)::DOUBLE AS "totChol",
    (95 + tp % 100)::DOUBLE AS "sysBP", (60 + tp % 53)::DOUBLE AS "diaBP",
    CASE WHEN ok % 223 <> 0 THEN (180 + tp % 179)::DOUBLE / 10e0 END AS "BMI",
    (50 + tp % 61)::DOUBLE AS "heartRate",
    (CASE WHEN ok % 11 <> 0 THEN 60 + tp % 127 END)::DOUBLE AS glucose,
    (CASE WHEN 10*(ck % 39) + 4*(tp % 100) + 80*(ck % 2) + h % 400 >= 840 THEN 1 ELSE 0 END)::INTEGER AS "{LABEL}"
  FROM (
    SELECT o_orderkey AS ok, o_custkey AS ck, FLOOR(o_totalprice)::BIGINT AS tp,
      ('0x' || substr(md5('1:' || o_orderkey::VARCHAR), 1, 8))::BIGINT AS h
    FROM orders)
)"""

SCORED = f"""
scored AS (
  SELECT ok AS pid,
    (CASE WHEN sig + h % 400 >= 840 THEN 1 ELSE 0 END)::INTEGER AS y,
    round(sig::DOUBLE / 860e0, 4) AS p
  FROM (
    SELECT o_orderkey AS ok,
      10*(o_custkey % 39) + 4*(FLOOR(o_totalprice)::BIGINT % 100) + 80*(o_custkey % 2) AS sig,
      ('0x' || substr(md5('1:' || o_orderkey::VARCHAR), 1, 8))::BIGINT AS h
    FROM orders)
)"""


def q(name: str) -> str:
    return f'"{name}"'


def flag(condition: str) -> str:
    return f"COALESCE(CAST({condition} AS INTEGER), 0)"


# SQL text of each derived column.
DERIVED_SQL = {
    "pulse_pressure": '"sysBP" - "diaBP"',
    "map_bp": '"diaBP" + ("sysBP" - "diaBP") / 3e0',
    "age_sysBP": 'age * "sysBP"',
    "metabolic_risk": '"BMI" * glucose',
    "age_squared": "age * age",
    "hypertension_flag": flag('"sysBP" >= 140'),
    "high_chol_flag": flag('"totChol" >= 240'),
    "diabetes_flag": flag("glucose >= 126"),
    "smoking_pack_years": '"currentSmoker" * "cigsPerDay"',
    "age_smoking": 'age * "cigsPerDay" / 100e0',
    "bmi_bp": '"BMI" * "sysBP"',
    "male_age": "male * age",
    "age_diaBP": 'age * "diaBP"',
    "age_glucose": "age * glucose",
    "sysBP_chol": '"sysBP" * "totChol"',
    "male_sysBP": 'male * "sysBP"',
    "age_prevalentHyp": 'age * "prevalentHyp"',
    "age_BMI": 'age * "BMI"',
    "risk_factor_count": " + ".join(
        flag(c) for c in (
            '"sysBP" >= 140', '"totChol" >= 240', "glucose >= 126", '"BMI" >= 30',
            '"currentSmoker" = 1', '"BPMeds" = 1', '"prevalentHyp" = 1', '"prevalentStroke" = 1',
        )
    ),
    "log_glucose": "ln(1e0 + glucose)",
    "log_totChol": 'ln(1e0 + "totChol")',
    "log_cigsPerDay": 'ln(1e0 + "cigsPerDay")',
    "age_risk_interaction": "age * risk_factor_count",
    "bmi_overweight": flag('"BMI" >= 25 AND "BMI" < 30'),
    "bmi_obese": flag('"BMI" >= 30'),
}


def with_features(source: str, name: str) -> str:
    """A CTE adding the derived columns."""
    late = {"age_risk_interaction"}
    early = ", ".join(f"{e} AS {q(c)}" for c, e in DERIVED_SQL.items() if c not in late)
    then = ", ".join(f"{DERIVED_SQL[c]} AS {q(c)}" for c in late)
    return f"""{name} AS (
  SELECT *, {then} FROM (SELECT *, {early} FROM {source}))"""


def digest(seed, *parts: str) -> str:
    """SQL text of the seeded md5."""
    return "md5(" + " || ':' || ".join([f"'{seed}'", *[f"({p})::VARCHAR" for p in parts]]) + ")"


def uniform(d: str) -> str:
    return f"(('0x' || substr({d}, 1, 8))::BIGINT / 4294967296e0)"


def split_cte(source: str, name: str, label: str, frac: str, seed: int, first: str,
              second: str, column: str = "split", where: str = "TRUE", key: str = "pid") -> str:
    """CTEs tagging the first ceil(frac*n) rows, shared out by largest remainder."""
    return f"""{name}_counts AS (
  SELECT {label} AS c, count(*) AS cnt FROM {source} WHERE {where} GROUP BY 1),
{name}_total AS (SELECT sum(cnt)::BIGINT AS n, ceil({frac} * sum(cnt)::BIGINT)::BIGINT AS m FROM {name}_counts),
{name}_share AS (
  SELECT c, cnt, (m * cnt) // n AS base, (m * cnt) % n AS rest, m FROM {name}_counts, {name}_total),
{name}_target AS (
  SELECT c, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, c)
      <= m - sum(base) OVER () THEN 1 ELSE 0 END AS target FROM {name}_share),
{name}_rank AS (
  SELECT {key} AS k, {label} AS c, row_number() OVER (
      PARTITION BY {label} ORDER BY {digest(seed, key)}, {key}) AS rk
  FROM {source} WHERE {where}),
{name} AS (
  SELECT s.*, CASE WHEN r.rk <= t.target THEN '{second}' ELSE '{first}' END AS {column}
  FROM {source} s LEFT JOIN {name}_rank r ON r.k = s.{key} LEFT JOIN {name}_target t ON t.c = r.c)"""


def three_way_cte(source: str = "patient", seed: int = 42) -> str:
    """``tagged``: split is train, val or test."""
    label = q(LABEL)
    outer = split_cte(source, "outer_split", label, "0.2", seed, "train", "test", "outer_tag")
    inner = split_cte("outer_split", "inner_split", label, "0.15", seed + 1, "train", "val",
                      "inner_tag", "outer_tag = 'train'")
    return f"""{outer},
{inner},
tagged AS (
  SELECT * EXCLUDE (outer_tag, inner_tag),
    CASE WHEN outer_tag = 'test' THEN 'test' ELSE inner_tag END AS split FROM inner_split)"""


def imputed_cte(source: str = "tagged", name: str = "imputed", fit: str = "split = 'train'") -> str:
    medians = ", ".join(f"median({q(c)}) FILTER ({fit}) AS {q(c)}" for c in RAW_FEATURES)
    filled = ", ".join(
        f"COALESCE(s.{q(c)}, m.{q(c)}) AS {q(c)}" for c in RAW_FEATURES
    )
    others = ", ".join(["pid", q(LABEL)] + (["split"] if "split" in fit else []))
    return f"""{name}_m AS (SELECT {medians} FROM {source}),
{name} AS (SELECT {others}, {filled} FROM {source} s, {name}_m m)"""


def scaled_cte(source: str = "derived", name: str = "scaled", fit: str = "split = 'train'",
               features: list[str] = FEATURES, others: str = f'pid, "{LABEL}", split') -> str:
    stats = ", ".join(
        f"avg({q(c)}) FILTER ({fit}) AS {q(c + '_m')}, "
        f"CASE WHEN stddev_pop({q(c)}) FILTER ({fit}) = 0 THEN 1e0 "
        f"ELSE stddev_pop({q(c)}) FILTER ({fit}) END AS {q(c + '_s')}"
        for c in features
    )
    values = ", ".join(f"({q(c)} - {q(c + '_m')}) / {q(c + '_s')} AS {q(c)}" for c in features)
    return f"""{name}_p AS (SELECT {stats} FROM {source}),
{name} AS (SELECT {others}, {values} FROM {source}, {name}_p)"""


def prepared_ctes() -> str:
    """patient to scaled, all parameters fitted on the train split."""
    return ",\n".join([
        PATIENT, three_way_cte(), imputed_cte(), with_features("imputed", "derived"), scaled_cte(),
    ])


def rounded(columns: list[str], places: int = 6) -> str:
    return ", ".join(f"round({q(c)}, {places}) + 0e0 AS {q(c)}" for c in columns)


def double_list(values: list[float]) -> str:
    return "[" + ", ".join(f"{v!r}e0" if "e" not in repr(v) else repr(v) for v in values) + "]"


CELLS = """count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp,
    count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp"""


def ratio(top: str, bottom: str) -> str:
    return f"COALESCE(({top})::DOUBLE / NULLIF(({bottom})::DOUBLE, 0e0), 0e0)"


METRIC_SQL = {
    "accuracy": ratio("tp + tn", "tp + tn + fp + fn"),
    "precision": ratio("tp", "tp + fp"),
    "recall": ratio("tp", "tp + fn"),
    "f1": ratio("2 * tp", "2 * tp + fp + fn"),
    "mcc": ratio(
        "tp::DOUBLE * tn::DOUBLE - fp::DOUBLE * fn::DOUBLE",
        "sqrt((tp + fp)::DOUBLE * (tp + fn)::DOUBLE * (tn + fp)::DOUBLE * (tn + fn)::DOUBLE)",
    ),
}


def metrics_select(names=("accuracy", "precision", "recall", "f1", "mcc"), places: int = 6,
                   rename: dict | None = None) -> str:
    rename = rename or {}
    return ", ".join(f"round({METRIC_SQL[n]}, {places}) + 0e0 AS {rename.get(n, n)}" for n in names)


def auc_ctes(source: str, name: str, by: str | None = None) -> str:
    """CTE ``name``(by, auc) from ``source``(by, y, p)."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{name}_d AS (
  SELECT {g}p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
  FROM {source} GROUP BY {g}p),
{name}_r AS (
  SELECT {g}pos, neg, COALESCE(sum(neg) OVER ({part}ORDER BY p
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {name}_d),
{name} AS (
  SELECT {g}sum(pos::DOUBLE * (below::DOUBLE + 0.5e0 * neg))
      / NULLIF(sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0e0) AS auc
  FROM {name}_r {group})"""


def sweep_ctes(source: str, name: str, thresholds: list[float], by: str | None = None) -> str:
    """CTE ``name``(by, threshold, tn, fp, fn, tp) from ``source``(by, y, p)."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    groups = f"(SELECT DISTINCT {by} FROM {source})" if by else "(SELECT 1 AS one)"
    on = f"AND c.{by} = x.{by}" if by else ""
    return f"""{name}_t AS (
  SELECT i AS j, ({double_list(thresholds)})[i] AS threshold FROM range(1, {len(thresholds) + 1}) AS r(i)),
{name}_i AS (
  SELECT {g}len(list_filter({double_list(thresholds)}, lambda t: t <= p)) AS idx,
    count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
  FROM {source} GROUP BY {g}idx),
{name}_c AS (
  SELECT {'x.' + by + ', ' if by else ''}t.j, t.threshold, COALESCE(c.pos, 0) AS pos, COALESCE(c.neg, 0) AS neg
  FROM {groups} x CROSS JOIN (SELECT j, threshold FROM {name}_t UNION ALL SELECT 0, NULL) t
  LEFT JOIN {name}_i c ON c.idx = t.j {on}),
{name} AS (
  SELECT * FROM (
    SELECT {g}j, threshold, tp, fp, P - tp AS fn, N - fp AS tn FROM (
      SELECT {g}j, threshold,
        sum(pos) OVER ({part}ORDER BY j DESC)::BIGINT AS tp, sum(neg) OVER ({part}ORDER BY j DESC)::BIGINT AS fp,
        sum(pos) OVER ({part.strip()})::BIGINT AS P, sum(neg) OVER ({part.strip()})::BIGINT AS N FROM {name}_c))
  WHERE j >= 1)"""


def best_ctes(sweep: str, name: str, default: float, by: str | None = None) -> str:
    """CTE ``name``(by, threshold, f1, precision, recall): highest F1, lowest threshold."""
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""{name} AS (
  SELECT {g}CASE WHEN f1 = 0 THEN {default!r}e0 ELSE threshold END AS threshold, f1, "precision", recall
  FROM (
    SELECT *, row_number() OVER ({part}ORDER BY f1 DESC, threshold) AS rn
    FROM (SELECT {g}threshold, {METRIC_SQL['f1']} AS f1, {METRIC_SQL['precision']} AS "precision",
            {METRIC_SQL['recall']} AS recall FROM {sweep}))
  WHERE rn = 1)"""
