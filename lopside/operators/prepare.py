"""Cleaning, imputation, profiling and scaling.

``fit_*`` functions run one or two aggregates and hand back small parameters;
everything that touches rows is a narrow projection.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lopside.operators.quantiles import exact_quantiles, long_form
from lopside.sources.tables import check_inputs

def nan_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """Read NaN as missing, so that comparisons and averages behave."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def missing_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_missing) per column plus a ``total`` row; one aggregate."""
    counted = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in cols],
        F.sum(sum((F.col(c).isNull().cast("bigint") for c in cols), F.lit(0))).alias("total"),
    )
    return counted.unpivot([], [*cols, "total"], "column", "n_missing")


def fit_medians(
    df: DataFrame, cols: list[str], approx: bool = False
) -> dict[str, float]:
    """Median of each column that has a null (mean of the middle two).

    Exact by default. ``approx=True`` is the one-pass sketch for callers who
    accept its error.
    """
    if approx:
        row = df.agg(*[
            F.when(F.count(c) < F.count(F.lit(1)), F.percentile_approx(c, 0.5, 100_000)).alias(c)
            for c in cols
        ]).first()
        return {c: float(row[c]) for c in cols if row[c] is not None}
    fitted = exact_quantiles(df, cols, [0.5], only_with_nulls=True)
    return {c: v[0] for c, v in fitted.items() if v[0] is not None}


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Fill nulls of the columns in the map; other columns stay as they are."""
    present = {c: v for c, v in medians.items() if c in df.columns}
    return df.na.fill(present) if present else df


def drop_incomplete(
    df: DataFrame, cols: list[str], observation: Observation | None = None
) -> DataFrame:
    """Drop rows with any null. Counts arrive in ``observation`` for free."""
    if observation is not None:
        incomplete = ~F.lit(True)
        for c in cols:
            incomplete = incomplete | F.col(c).isNull()
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("rows"),
            F.count_if(incomplete).alias("dropped"),
        )
    return df.na.drop(subset=cols)


def impute_or_drop(df: DataFrame, cols: list[str], medians: dict[str, float]) -> DataFrame:
    """Impute with fitted medians; with none fitted, drop incomplete rows."""
    return impute(df, medians) if medians else drop_incomplete(df, cols)


def split_label(df: DataFrame, label: str) -> tuple[DataFrame, bool]:
    """Features without the label, and whether a label was there."""
    return df.drop(label), label in df.columns


def align_features(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the training columns in training order, after ``keep``."""
    check_inputs(df, names)
    return df.select(*[c for c in keep if c in df.columns], *names)


def attach_label(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Put features and label side by side by key (never by position)."""
    return features.join(labels, on=key, how="inner")


def class_distribution(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Rows and share per class."""
    by = by or []
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    if by:
        totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
        joined = counts.join(totals, by)
    else:
        joined = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    return joined.select(
        *by, F.col(label).alias("class"), "n", (F.col("n") / F.col("total")).alias("share")
    )


def class_counts(df: DataFrame, label: str) -> dict[int, int]:
    """Class sizes on the driver (one small aggregate); a null label is an error."""
    rows = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()
    missing = sum(r["n"] for r in rows if r[label] is None)
    if missing:
        raise ValueError(f"{missing} rows have no {label}")
    return {int(r[label]): r["n"] for r in rows}


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Positive weight (negatives over positives) and balanced weights."""
    neg = F.count_if(F.col(label) == 0)
    pos = F.count_if(F.col(label) == 1)
    n = F.count(F.col(label))
    ratio = lambda top, bottom: top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))
    return df.agg(
        ratio(neg, pos).alias("pos_weight"),
        ratio(n, neg * 2).alias("weight_0"),
        ratio(n, pos * 2).alias("weight_1"),
    )


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, pos, mean, scale) rows; population deviation, 1 if it is 0."""
    deviation = F.stddev_pop("v")
    names = F.array(*[F.lit(c) for c in cols])
    return (
        long_form(df, cols).groupBy("i")
        .agg(
            F.avg("v").alias("mean"),
            F.when(deviation == 0.0, F.lit(1.0)).otherwise(deviation).alias("scale"),
        )
        .select(F.get(names, F.col("i")).alias("feature"), F.col("i").alias("pos"), "mean", "scale")
    )


def scaler_params(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """The fitted scaler on the driver: one entry per feature."""
    return {
        r["feature"]: (r["mean"], r["scale"])
        for r in scaler.orderBy("pos").collect()
    }


def scaled_columns(
    params: dict[str, tuple[float, float]], names: list[str] | None = None
) -> dict[str, Column]:
    return {
        c: (F.col(c).cast("double") - F.lit(params[c][0])) / F.lit(params[c][1])
        for c in (names or params)
    }


def scale(df: DataFrame, scaler: DataFrame | dict[str, tuple[float, float]]) -> DataFrame:
    """``(x - mean) / scale`` on every fitted column.

    The parameters are literals of the plan: one entry per feature, whether
    they come as a dict or are read from a scaler table.
    """
    params = scaler if isinstance(scaler, dict) else scaler_params(scaler)
    return df.withColumns(scaled_columns(params))


def attach_params(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """Attach a fitted scaler as one row of maps (one row, so broadcast)."""
    one_row = scaler.agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "mean"))).alias("param_mean"),
        F.map_from_entries(F.collect_list(F.struct("feature", "scale"))).alias("param_scale"),
    )
    return df.crossJoin(F.broadcast(one_row))


def assemble(
    df: DataFrame, names: list[str], output: str = "features", missing: str = "error"
) -> DataFrame:
    """Columns to one vector in fixed order; a null is an error, or NaN to ``keep``."""
    check_inputs(df, names)
    return VectorAssembler(
        inputCols=names, outputCol=output, handleInvalid=missing
    ).transform(df)


def pack(df: DataFrame, names: list[str], output: str = "x") -> DataFrame:
    """Columns to one ``array<double>``, the form the block kernels read."""
    check_inputs(df, names)
    return df.withColumn(output, F.array(*[F.col(c).cast("double") for c in names]))


def preview(df: DataFrame, n: int, by: str | list[str]) -> DataFrame:
    """The first ``n`` rows by key (a table has no order of its own)."""
    keys = [by] if isinstance(by, str) else by
    return df.orderBy(*keys).limit(n)


def stack(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, matched by column name."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
