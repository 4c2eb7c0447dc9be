"""Scoring a table with a saved pipeline, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lopside.functions.features import engineer_features
from lopside.learners.neighbors import NeighborModel
from lopside.operators.metrics import apply_threshold
from lopside.plans.prepare import prepare
from lopside.schema import KEY, LABEL, RAW_FEATURES
from lopside.sources.bundle import Bundle


def score(
    df: DataFrame, bundle: Bundle, key: str = KEY, label: str = LABEL,
    raw: list[str] = RAW_FEATURES, derive=engineer_features,
) -> DataFrame:
    """(key, [label], features, p, pred). Lazy; narrow for every model but neighbours."""
    ready = prepare(df, bundle.medians, bundle.scaler, bundle.features, key, label, raw, derive)
    if isinstance(bundle.model, NeighborModel):
        scored = bundle.model.predict_proba(ready, key=key)
    else:
        scored = bundle.model.predict_proba(ready)
    return apply_threshold(scored, bundle.threshold)
