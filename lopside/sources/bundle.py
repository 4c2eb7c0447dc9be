"""A fitted pipeline as one directory of Parquet tables and Spark ML models."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import classification
from pyspark.sql import DataFrame, SparkSession

from lopside.learners import gnb, logit
from lopside.learners.bagging import ModelBags
from lopside.learners.gnb import GaussianNB
from lopside.learners.grow import TreeEnsemble
from lopside.learners.logit import BaggedLogit
from lopside.learners.neighbors import NeighborModel
from lopside.operators.reduce import Projection
from lopside.session import small_table
from lopside.sources.tables import check_path


@dataclass
class Bundle:
    """Everything scoring needs: model, feature order, fitted values, threshold."""

    model: object
    features: list[str]
    medians: dict[str, float]
    scaler: dict[str, tuple[float, float]]
    threshold: float = 0.5
    metadata: dict[str, str] = field(default_factory=dict)


def save_bundle(bundle: Bundle, spark: SparkSession, path: str, mode: str = "error") -> None:
    """Write the bundle; the description goes last, so a partial one is not readable."""
    model = bundle.model
    values = [(c, i, *bundle.scaler[c]) for i, c in enumerate(bundle.features)]
    small_table(spark, values, "feature string, pos int, mean double, scale double").coalesce(
        1
    ).write.mode(mode).parquet(f"{path}/scaler")
    medians = small_table(spark, list(bundle.medians.items()), "feature string, median double")
    medians.coalesce(1).write.mode(mode).parquet(f"{path}/medians")
    about = {"kind": type(model).__name__} | _save_model(model, spark, f"{path}/model", mode)
    row = [(bundle.threshold, json.dumps(about), json.dumps(bundle.metadata))]
    small_table(spark, row, "threshold double, about string, metadata string").coalesce(
        1
    ).write.mode(mode).json(f"{path}/description")


def _save_model(model, spark: SparkSession, path: str, mode: str) -> dict:
    if isinstance(model, (GaussianNB, BaggedLogit)):
        model.to_table(spark).write.mode(mode).parquet(path)
        return {}
    if isinstance(model, ModelBags):
        return {"features": model.features, "models": _save_ml(model.models, path, mode)}
    if isinstance(model, TreeEnsemble):
        model.to_table(spark).write.mode(mode).parquet(path)
        return {"features": model.features, "link": model.link}
    if isinstance(model, NeighborModel):
        model.ref.write.mode(mode).parquet(path)
        plain = ("features", "k", "weighting", "p", "n_bags")
        about = {name: getattr(model, name) for name in plain}
        if model.loadings is not None:
            about["loadings"] = model.loadings.loadings.tolist()
            about["explained"] = model.loadings.explained
        if model.bag_loadings is not None:
            about["bag_loadings"] = model.bag_loadings.tolist()
        return about
    raise TypeError(f"cannot save a {type(model).__name__}")


def _save_ml(models: list, path: str, mode: str) -> list[str]:
    for i, model in enumerate(models):
        writer = model.write()
        (writer.overwrite() if mode == "overwrite" else writer).save(f"{path}/bag={i}")
    return [type(m).__name__ for m in models]


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """Read a bundle back; a missing one is an error."""
    check_path(spark, f"{path}/description")
    row = spark.read.schema("threshold double, about string, metadata string").json(
        f"{path}/description"
    ).first()
    about = json.loads(row["about"])
    scaler = spark.read.parquet(f"{path}/scaler").orderBy("pos").collect()
    medians = spark.read.parquet(f"{path}/medians").collect()
    return Bundle(
        model=_load_model(about, spark, f"{path}/model"),
        features=[r["feature"] for r in scaler],
        medians={r["feature"]: r["median"] for r in medians},
        scaler={r["feature"]: (r["mean"], r["scale"]) for r in scaler},
        threshold=row["threshold"], metadata=json.loads(row["metadata"]),
    )


def _load_model(about: dict, spark: SparkSession, path: str):
    kind = about["kind"]
    if kind == "GaussianNB":
        table = spark.read.parquet(path)
        return gnb.from_statistics(table, table.first()["smoothing"])
    if kind == "BaggedLogit":
        return logit.from_table(spark.read.parquet(path))
    if kind == "ModelBags":
        return ModelBags(about["features"], _load_ml(about["models"], path))
    if kind == "TreeEnsemble":
        return TreeEnsemble.from_table(spark.read.parquet(path), about["features"], about["link"])
    if kind == "NeighborModel":
        plain = {name: about[name] for name in ("features", "k", "weighting", "p", "n_bags")}
        if "loadings" in about:
            plain["loadings"] = Projection(np.array(about["loadings"]), about["explained"])
        if "bag_loadings" in about:
            plain["bag_loadings"] = np.array(about["bag_loadings"])
        return NeighborModel(ref=spark.read.parquet(path), **plain)
    raise TypeError(f"unknown model kind {kind}")


def _load_ml(kinds: list[str], path: str) -> list:
    return [getattr(classification, kind).load(f"{path}/bag={i}") for i, kind in enumerate(kinds)]
