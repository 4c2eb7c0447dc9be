"""Training-side and scoring-side preparation as single lazy plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lopside.functions.features import engineer_features
from lopside.operators.prepare import (
    fit_medians,
    fit_scaler,
    impute,
    impute_or_drop,
    nan_to_null,
    pack,
    scale,
    scaler_params,
)
from lopside.operators.resample import SMOTE_K, smote
from lopside.operators.sampling import stratified_split, three_way_split
from lopside.schema import FEATURES, KEY, LABEL, RAW_FEATURES
from lopside.session import materialize
from lopside.sources.tables import check_inputs


@dataclass
class Prepared:
    """A prepared table (key, label, split, scaled features) and what was fitted."""

    table: DataFrame
    features: list[str]
    medians: dict[str, float]
    scaler: dict[str, tuple[float, float]]
    key: str = KEY
    label: str = LABEL
    counts: dict = field(default_factory=dict)

    def part(self, *names: str) -> DataFrame:
        """Rows of one or more splits."""
        return self.table.where(F.col("split").isin(*names))


def fit_prepare(
    df: DataFrame, test_frac: float = 0.2, val_frac: float = 0.15, seed: int = 42,
    key: str = KEY, label: str = LABEL, raw: list[str] = RAW_FEATURES,
    features: list[str] = FEATURES, derive=engineer_features,
    medians_on: str = "fit", approx_medians: bool = False, keep: bool = False,
    test: DataFrame | None = None, oversample: bool = False, smote_k: int = SMOTE_K,
) -> Prepared:
    """Split, fit medians and scaler, derive, scale.

    With ``test``, a table of its own with the same columns, ``df`` is split into
    train and val only and ``test_frac`` does not count. ``oversample`` adds
    synthetic minority rows to the scaled train part, up to balance; the key is
    then the text column ``sid`` (the key, or ``key#copy`` for a new row).

    ``medians_on="fit"`` uses the fit part alone; ``"all_train"`` also uses
    validation rows. ``keep=True`` writes the result once to the checkpoint
    folder, for searches that read it many times.
    """
    if medians_on not in ("fit", "all_train"):
        raise ValueError("medians_on is 'fit' or 'all_train'")
    check_inputs(df, [key, label, *raw])
    clean = nan_to_null(df.select(key, *raw, label), raw)
    if test is None:
        tagged = three_way_split(clean, label, test_frac, val_frac, seed, key)
    else:
        check_inputs(test, [key, label, *raw])
        held = nan_to_null(test.select(key, *raw, label), raw).withColumn("split", F.lit("test"))
        tagged = stratified_split(clean, label, val_frac, seed, key, ("train", "val")).unionByName(held)
    fit_part = F.col("split") == "train"
    median_part = fit_part if medians_on == "fit" else F.col("split") != "test"
    medians = fit_medians(tagged.where(median_part), raw, approx_medians)
    derived = derive(impute(tagged, medians))
    scaler = scaler_params(fit_scaler(derived.where(fit_part), features))
    table = scale(derived, scaler).select(key, label, "split", *features)
    if oversample:
        table, key = _oversampled(table, features, label, key, seed, smote_k), "sid"
    if keep:
        table = materialize(table)
    return Prepared(table, list(features), medians, scaler, key, label)


def _oversampled(table: DataFrame, features: list[str], label: str, key: str, seed: int, k: int) -> DataFrame:
    """The table with its train part balanced by synthetic rows, keyed by ``sid``."""
    table = materialize(table)  # read by the neighbour join and again for its rows
    train = pack(table.where("split = 'train'"), features).select(key, label, "x")
    grown = smote(train, label, seed, key, k=k).select(
        "sid", label, F.lit("train").alias("split"), *[F.col("x")[i].alias(c) for i, c in enumerate(features)])
    rest = table.where("split <> 'train'").select(
        F.col(key).cast("string").alias("sid"), F.col(label).cast("int").alias(label), "split",
        *[F.col(c).cast("double").alias(c) for c in features])
    return grown.unionByName(rest)


def class_profile(prepared: Prepared) -> DataFrame:
    """Rows per (split, class)."""
    return prepared.table.groupBy("split", F.col(prepared.label).alias("class")).agg(
        F.count(F.lit(1)).alias("n")
    )


def prepare(
    df: DataFrame, medians: dict[str, float], scaler: dict[str, tuple[float, float]],
    features: list[str] = FEATURES, key: str = KEY, label: str = LABEL,
    raw: list[str] = RAW_FEATURES, derive=engineer_features,
) -> DataFrame:
    """Scoring side: the fitted values on new rows. The label may be absent."""
    if not scaler:
        raise ValueError("a fitted scaler is required")
    if not features:
        raise ValueError("the training feature names are required")
    check_inputs(df, [key, *raw])
    label_part = [label] if label in df.columns else []
    clean = nan_to_null(df.select(key, *raw, *label_part), raw)
    whole = impute_or_drop(clean, [*raw, *label_part], medians)
    return scale(derive(whole), {c: scaler[c] for c in features}).select(
        key, *label_part, *features
    )
