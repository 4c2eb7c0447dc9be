"""Learner, ensemble and end-to-end queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lopside.catalog import sql as S
from lopside.catalog.sampling import SEED, bag_ctes
from lopside.catalog.tabular import rounded
from lopside.functions.thresholds import family_default, family_grid
from lopside.learners import adaboost, boost, gnb, logit, neighbors, tree
from lopside.operators import metrics as M
from lopside.operators.sampling import balanced_bags
from lopside.plans import families
from lopside.plans.prepare import fit_prepare, prepare
from lopside.plans.score import score as score_bundle
from lopside.schema import FEATURES, KEY, LABEL
from lopside.session import ensure_checkpoint_dir, materialize
from lopside.sources.bundle import Bundle, load_bundle, save_bundle
from lopside.sources.patient import patient, patient_rows
from lopside.streaming.score import read_stream
from lopside.streaming.score import score_stream as stream_scores

N_BAGS = 3
NEIGHBOR_BAGS = 30  # of the reduced neighbour query, as the published neighbour winner has
NB_FEATURES = FEATURES
SMOOTHING = 1e-9
BOOST_RATE = 0.5


def prepared(spark, d, keep=True):
    return fit_prepare(patient(spark, d), keep=keep)


def scores(model, rows):
    """(pid, y, p) of a fitted model."""
    return model.predict_proba(rows).select(KEY, F.col(LABEL).alias("y"), "p")


def quality(model, parts):
    """One row about a fit on the test rows: rows scored, positives, lowest and
    highest probability, and the area under the curve. SQL cannot fit these
    models, so they have no twin; ``catalog.trees`` checks their parts."""
    scored = materialize(scores(model, parts.part("test")))
    counts = scored.agg(
        F.count("p").alias("n"), F.sum("y").cast("bigint").alias("n_pos"),
        F.min("p").alias("p_min"), F.max("p").alias("p_max"),
    )
    return counts.crossJoin(M.roc_auc(scored))  # one row each


def gnb_fit(spark, d):
    train = prepared(spark, d).part("train")
    return rounded(gnb.gnb_statistics(train, NB_FEATURES, LABEL), ["mu", "var"], 5)


def gnb_score(spark, d):
    parts = prepared(spark, d)
    model = gnb.fit_gnb(parts.part("train"), NB_FEATURES, LABEL, smoothing=SMOOTHING)
    return rounded(scores(model, parts.part("test")), ["p"], 5)


def bagged_train(parts, n_bags):
    return materialize(balanced_bags(parts.part("train"), LABEL, n_bags, SEED, KEY))


def bag_gnb(spark, d):
    parts = prepared(spark, d)
    model = gnb.fit_gnb(bagged_train(parts, N_BAGS), NB_FEATURES, LABEL, "bag_w", SMOOTHING)
    return rounded(scores(model, parts.part("test")), ["p"], 5)


def bag_average(spark, d):
    """Bag probabilities averaged per row, from a tall (pid, bag, p) table."""
    from lopside.learners.bagging import bag_average as average

    rows = patient(spark, d).select(KEY, "age", "sysBP", "male")
    slopes = F.array(*[F.lit(float(b + 1)) for b in range(5)])
    tall = rows.select(KEY, "age", "sysBP", F.posexplode(slopes).alias("bag", "b"))
    share = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("age") - 50.0) / 10.0 - (F.col("sysBP") - 140.0) / (20.0 * F.col("b"))))
    return rounded(average(tall.withColumn("p", share), KEY), ["p"], 5)


def score(spark, d):
    """Raw rows to probability and prediction with fitted values (no label used)."""
    parts = prepared(spark, d)
    model = gnb.fit_gnb(parts.part("train"), NB_FEATURES, LABEL, smoothing=SMOOTHING)
    fresh = prepare(patient(spark, d).drop(LABEL), parts.medians, parts.scaler, FEATURES)
    scored = M.apply_threshold(model.predict_proba(fresh), 0.5)
    return rounded(scored.select(KEY, "p", "pred"), ["p"], 5)


def score_stream(spark, d):
    """The same scoring over a stream of files, drained to a table and read back."""
    parts = prepared(spark, d)
    model = gnb.fit_gnb(parts.part("train"), NB_FEATURES, LABEL, smoothing=SMOOTHING)
    bundle = Bundle(model, FEATURES, parts.medians, parts.scaler, 0.5)
    schema = spark.read.parquet(f"{d}/orders.parquet").schema
    orders = read_stream(spark, d, schema, names="orders.parquet")
    home = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    drained = stream_scores(
        patient_rows(orders).drop(LABEL), bundle, f"{home}/out", f"{home}/state"
    )
    drained.awaitTermination()
    return rounded(spark.read.parquet(f"{home}/out"), ["p"], 5)


def bundle_score(spark, d):
    """Scoring with a bundle that went through storage."""
    parts = prepared(spark, d)
    model = gnb.fit_gnb(parts.part("train"), NB_FEATURES, LABEL, smoothing=SMOOTHING)
    home = f"{ensure_checkpoint_dir(spark)}/bundle-{uuid.uuid4().hex}"
    save_bundle(Bundle(model, FEATURES, parts.medians, parts.scaler, 0.5), spark, home)
    scored = score_bundle(patient(spark, d).drop(LABEL), load_bundle(spark, home))
    return rounded(scored.select(KEY, "p", "pred"), ["p"], 5)


# Small grids for the registered searches; the full ones are families.FULL_GRIDS.
SMALL_GRIDS = {
    "lr": [("BalancedBagging", {"penalty": ["l1", "l2"], "C": [0.05, 0.1, 0.5], "n": [10]})],
    "dt": [
        ("BalancedBagging", {"depth": [5, 6, None], "leaf": [10], "features": ["0.7"], "n": [10, 20]}),
        ("EasyEnsemble", {"n": [2, 5], "rounds": [5]}),
        ("RUSBoost", {"n": [3, 6], "lr": [0.5, 1.0], "depth": [1, 2]}),
    ],
    "knn": [("BalancedBagging", {"k": [7, 11], "weighting": ["uniform", "distance"], "p": [2], "n": [2, 3]})],
    "nb": [("BalancedBagging", {"smoothing": [1e-9, 1e-3, 1e-1], "n": [3, 5]})],
    "rf": [("BalancedBagging", {"depth": [8, 20], "leaf": [3], "n": [10, 20]})],
    "xgb": [
        ("Weighted", {"rate": [0.1], "depth": [3], "min_child": [1, 3], "gamma": [0.0, 0.1], "rounds": [12]}),
        ("BalancedBagging", {"n": [5, 10], "rounds": [6], "depth": [3], "rate": [0.1], "min_child": [1]}),
    ],
}
RESULT_ROUNDED = ["threshold", "val_f1", "val_prec", "val_rec", "val_auc"]


def nb_search(spark, d):
    """The whole naive Bayes grid, 33 configurations, from one set of statistics."""
    results = families.search("nb", prepared(spark, d))
    return rounded(results.drop("params"), RESULT_ROUNDED)


def knn_search(spark, d):
    """All 28 configurations over synthetic minority rows, from one pass per metric."""
    grids = {"knn": families.FULL_GRIDS["knn"][:1]}
    configs = families.family_configs("knn", grids)
    results = families.search("knn", prepared(spark, d), configs)
    return rounded(results.drop("params"), RESULT_ROUNDED)


def refit(spark, d):
    configs = families.family_configs("nb", SMALL_GRIDS)
    return families.train_family("nb", prepared(spark, d), configs).metrics


def train_all(spark, d):
    board, _, errors = families.train_all(prepared(spark, d), SMALL_GRIDS)
    if errors:
        raise RuntimeError(str(errors))
    return board


def boost_weights(spark, d):
    """One boosting round on a fixed rule: who is missed weighs more."""
    rows = patient(spark, d)
    n = rows.count()
    judged = rows.select(
        KEY, LABEL, ((F.col("sysBP") >= 160) & (F.col("age") >= 50)).cast("int").alias("prediction"),
        F.lit(1.0 / n).alias("w"),
    )
    moved, _ = adaboost.boost_round(judged, LABEL, BOOST_RATE)
    return moved.withColumn("w", F.round(F.col("w") * n, 6)).select(KEY, LABEL, "prediction", "w")


# The fitted queries run the published winners at their sizes; the forest has
# 100 of its 200 bags.
def lr(spark, d):
    parts = prepared(spark, d)
    train = bagged_train(parts, logit.N_BAGS)
    return quality(logit.fit_logit(train, FEATURES, LABEL, 0.1, "l1", logit.N_BAGS), parts)


def dt(spark, d):
    parts = prepared(spark, d)
    train = bagged_train(parts, 100)
    return quality(tree.fit_trees(train, FEATURES, LABEL, 6, 10, "0.7", 100), parts)


def balanced_rf(spark, d):
    parts = prepared(spark, d)
    train = bagged_train(parts, 100)
    return quality(tree.fit_balanced_forest(train, FEATURES, LABEL, 20, 3, 100), parts)


def gbt(spark, d):
    parts = prepared(spark, d)
    params = boost.BoostParams(0.1, 3, 50)
    return quality(boost.fit_boosted(parts.part("train"), FEATURES, LABEL, params), parts)


def gbt_early(spark, d):
    """At most 500 rounds; stops when 30 rounds bring no lower validation loss."""
    parts = prepared(spark, d)
    params = boost.BoostParams(0.1, 3, boost.MAX_ROUNDS)
    model, rounds = boost.fit_boosted_early(
        parts.part("train"), parts.part("val"), FEATURES, LABEL, params
    )
    return quality(model, parts).withColumn("rounds", F.lit(rounds))


def gbt_bags(spark, d):
    parts = prepared(spark, d)
    train = bagged_train(parts, 50)
    params = boost.BoostParams(0.05, 5, 30, 3.0)
    return quality(boost.fit_boosted_bags(train, FEATURES, LABEL, params, 50), parts)


def easy_ensemble(spark, d):
    parts = prepared(spark, d)
    return quality(adaboost.fit_easy_ensemble(parts.part("train"), FEATURES, LABEL, 10), parts)


def rusboost(spark, d):
    parts = prepared(spark, d)
    return quality(adaboost.fit_rusboost(parts.part("train"), FEATURES, LABEL, 50, 0.5, 2), parts)


def bag_pca_knn(spark, d):
    parts = prepared(spark, d)
    train = bagged_train(parts, NEIGHBOR_BAGS)
    model = neighbors.fit_bagged_neighbors(
        train, FEATURES, LABEL, NEIGHBOR_BAGS, n_components=10, k=11
    )
    return quality(model, parts)


def reduce_clean_knn(spark, d):
    parts = prepared(spark, d)
    model = neighbors.fit_neighbors(
        parts.part("train"), FEATURES, LABEL, resampler="smoteenn", n_components=8, k=11
    )
    return quality(model, parts)


def select_clean_knn(spark, d):
    parts = prepared(spark, d)
    model = neighbors.fit_neighbors(
        parts.part("train"), FEATURES, LABEL, resampler="smotetomek", n_selected=8, k=11,
        weighting="distance",
    )
    return quality(model, parts)


def flagship(spark, d, n_bags=10):
    """Raw rows to one row of test metrics: bagged naive Bayes, tuned on validation."""
    parts = prepared(spark, d)
    model = gnb.fit_gnb(bagged_train(parts, n_bags), FEATURES, LABEL, "bag_w", SMOOTHING)
    tuned = M.best_threshold(
        M.threshold_sweep(scores(model, parts.part("val")), family_grid("nb")), family_default("nb")
    ).first()
    return M.evaluate(scores(model, parts.part("test")), tuned["threshold"])


def gnb_pipeline(spark, d):
    """The flagship at three bags, small enough to write out in SQL."""
    return rounded(flagship(spark, d, N_BAGS), ["accuracy", "precision", "recall", "f1", "mcc", "auc", "threshold"], 4)


QUERIES = {
    "q_gnb_fit": gnb_fit,
    "q_gnb_score": gnb_score,
    "q_bag_gnb": bag_gnb,
    "q_bag_average": bag_average,
    "q_score": score,
    "q_score_stream": score_stream,
    "q_bundle_score": bundle_score,
    "q_boost_weights": boost_weights,
    "q_gnb_pipeline": gnb_pipeline,
    "q_lr": lr,
    "q_dt": dt,
    "q_balanced_rf": balanced_rf,
    "q_gbt": gbt,
    "q_gbt_early": gbt_early,
    "q_gbt_bags": gbt_bags,
    "q_easy_ensemble": easy_ensemble,
    "q_rusboost": rusboost,
    "q_bag_pca_knn": bag_pca_knn,
    "q_reduce_clean_knn": reduce_clean_knn,
    "q_select_clean_knn": select_clean_knn,
    "q_nb_search": nb_search,
    "q_knn_search": knn_search,
    "q_refit": refit,
    "q_train_all": train_all,
}

_label = S.q(LABEL)


def gnb_ctes(rows: str, queries: str, features: list[str], smoothing: float, name: str = "nb") -> str:
    """CTE ``name``(pid, y, p): naive Bayes from ``rows``(bag, c, features), bags averaged."""
    values = ", ".join(f"{S.q(c)}::DOUBLE AS {S.q(c)}" for c in features)
    names = ", ".join(S.q(c) for c in features)
    return f"""{name}_long AS (
  UNPIVOT (SELECT bag, c, {values} FROM {rows}) ON {names} INTO NAME feature VALUE v),
{name}_stat AS (
  SELECT bag, c, feature, count(*)::DOUBLE AS n, avg(v) AS mu, var_pop(v) AS var FROM {name}_long GROUP BY 1, 2, 3),
{name}_top AS (
  SELECT bag, max(spread) AS top FROM (SELECT bag, feature, var_pop(v) AS spread FROM {name}_long GROUP BY 1, 2) GROUP BY 1),
{name}_par AS (
  SELECT s.bag, c, feature, mu, var + {smoothing!r} * top AS var, n / sum(n) OVER (PARTITION BY s.bag, feature) AS prior
  FROM {name}_stat s JOIN {name}_top t ON t.bag = s.bag),
{name}_q AS (
  UNPIVOT (SELECT pid, {_label} AS y, {values} FROM {queries}) ON {names} INTO NAME feature VALUE v),
{name}_ll AS (
  SELECT pid, y, bag, c, ln(min(prior)) - 0.5e0 * sum(ln(2e0 * pi() * var) + (v - mu) * (v - mu) / var) AS ll
  FROM {name}_q JOIN {name}_par USING (feature) GROUP BY 1, 2, 3, 4),
{name} AS (
  SELECT pid, y, avg(p) AS p FROM (
    SELECT a.pid, a.y, a.bag, 1e0 / (1e0 + exp(a.ll - b.ll)) AS p
    FROM {name}_ll a JOIN {name}_ll b ON a.pid = b.pid AND a.bag = b.bag AND a.c = 0 AND b.c = 1)
  GROUP BY pid, y)"""


_prep = f"""{S.prepared_ctes()},
train AS (SELECT * FROM scaled WHERE split = 'train'), test AS (SELECT * FROM scaled WHERE split = 'test'),
val AS (SELECT * FROM scaled WHERE split = 'val')"""
_one = f"one AS (SELECT *, 0 AS bag, {_label} AS c FROM train)"
_bagged = f"""{bag_ctes('train', N_BAGS, SEED)},
bagged AS (SELECT t.*, b.bag, b.c FROM bags b JOIN train t ON t.pid = b.pid, unnest(range(0, b.w)) AS u(copy))"""
_half = f"{BOOST_RATE}e0"

_scored_all = f"""WITH {_prep}, {_one}, {gnb_ctes('one', 'scaled', NB_FEATURES, SMOOTHING)}
SELECT pid, round(p, 5) AS p, (p >= 0.5e0)::INTEGER AS pred FROM nb"""

ORACLES = {
    "q_gnb_fit": f"WITH {_prep} " + " UNION ALL ".join(
        f"SELECT 0::INTEGER AS bag, {_label} AS class, count(*) AS n, {i}::INTEGER AS pos, '{c}' AS feature, "
        f"round(avg({S.q(c)}), 5) + 0e0 AS mu, round(var_pop({S.q(c)}), 5) + 0e0 AS var FROM train GROUP BY {_label}"
        for i, c in enumerate(NB_FEATURES)
    ),
    "q_gnb_score": f"WITH {_prep}, {_one}, {gnb_ctes('one', 'test', NB_FEATURES, SMOOTHING)} SELECT pid, y, round(p, 5) AS p FROM nb",
    "q_bag_gnb": f"WITH {_prep}, {_bagged}, {gnb_ctes('bagged', 'test', NB_FEATURES, SMOOTHING)} SELECT pid, y, round(p, 5) AS p FROM nb",
    "q_bag_average": f"""WITH {S.PATIENT} SELECT pid, round(avg(
  1e0 / (1e0 + exp(-(age - 50e0) / 10e0 - ("sysBP" - 140e0) / (20e0 * b)))), 5) AS p
FROM patient, range(1, 6) AS r(b) GROUP BY pid""",
    "q_score": _scored_all,
    "q_score_stream": _scored_all,
    "q_bundle_score": _scored_all,
    "q_boost_weights": f"""WITH {S.PATIENT}, judged AS (
  SELECT pid, {_label}, ("sysBP" >= 160 AND age >= 50)::INTEGER AS prediction FROM patient),
total AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (prediction <> {_label})::DOUBLE AS missed FROM judged),
say AS (SELECT n, missed, {_half} * ln((n - missed) / missed) AS alpha FROM total)
SELECT pid, {_label}, prediction, round(n * (exp(CASE WHEN prediction <> {_label} THEN alpha ELSE 0 END) / n)
  / ((n - missed + missed * exp(alpha)) / n), 6) AS w FROM judged, say""",
    "q_gnb_pipeline": f"""WITH {_prep}, {_bagged},
{gnb_ctes('bagged', 'val', FEATURES, SMOOTHING, 'on_val')}, {gnb_ctes('bagged', 'test', FEATURES, SMOOTHING, 'on_test')},
{S.sweep_ctes('on_val', 'sw', family_grid('nb'))}, {S.best_ctes('sw', 'best', family_default('nb'))},
{S.auc_ctes('on_test', 'area')},
cells AS (SELECT {S.CELLS} FROM (SELECT y, (p >= threshold)::INTEGER AS pred FROM on_test, best))
SELECT tn, fp, fn, tp, {S.metrics_select(places=4)}, round(auc, 4) AS auc, round(threshold, 4) AS threshold
FROM cells, area, best""",
}
