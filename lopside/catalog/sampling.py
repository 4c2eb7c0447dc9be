"""Split and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lopside.catalog import sql as S
from lopside.operators import sampling as R
from lopside.schema import KEY, LABEL
from lopside.sources.patient import patient

N_BAGS = 5
SEED = 42


def split(spark, d):
    rows = R.three_way_split(patient(spark, d), LABEL, 0.2, 0.15, SEED, KEY)
    return rows.select(KEY, LABEL, "split")


def split_counts(spark, d):
    return split(spark, d).groupBy("split", LABEL).agg(F.count(F.lit(1)).alias("n"))


def split_plain(spark, d):
    """No label column to stratify by."""
    rows = patient(spark, d).drop(LABEL)
    return R.stratified_split(rows, LABEL, 0.2, SEED, KEY).select(KEY, "split")


def split_cover(spark, d):
    """Both sides together are the whole, and share nothing."""
    rows = R.stratified_split(patient(spark, d), LABEL, 0.2, SEED, KEY)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.sum(F.when(F.col("split") == "test", F.col(KEY)).otherwise(0)).alias("test_key_sum"),
    )


def bootstrap(spark, d):
    rows = R.bootstrap(patient(spark, d), N_BAGS, SEED, KEY)
    return rows.select(KEY, *[F.col("draws")[b].alias(f"b{b}") for b in range(N_BAGS)])


def undersample(spark, d):
    return R.undersample(patient(spark, d), LABEL, SEED, KEY).select(KEY, LABEL)


def bags(spark, d):
    rows = R.balanced_bags(patient(spark, d), LABEL, N_BAGS, SEED, KEY)
    return rows.select(KEY, LABEL, *[F.col("bag_w")[b].alias(f"b{b}") for b in range(N_BAGS)])


def bag_counts(spark, d):
    return R.bag_sizes(R.balanced_bags(patient(spark, d), LABEL, N_BAGS, SEED, KEY), LABEL)


QUERIES = {
    "q_split": split,
    "q_split_counts": split_counts,
    "q_split_plain": split_plain,
    "q_split_cover": split_cover,
    "q_bootstrap": bootstrap,
    "q_undersample": undersample,
    "q_bags": bags,
    "q_bag_counts": bag_counts,
}

_label = S.q(LABEL)


def poisson_sql(u: str) -> str:
    bounds = "".join(
        f" WHEN {u} < {bound!r}e0 THEN {count}" for count, bound in enumerate(R.POISSON_CDF)
    )
    return f"CASE{bounds} ELSE {len(R.POISSON_CDF)} END"


def bag_ctes(source: str = "patient", n_bags: int = N_BAGS, seed: int = SEED,
             where: str = "TRUE") -> str:
    """CTE ``bags``(pid, c, bag, w): copies kept per row and bag, 0 included."""
    return f"""bag_draws AS (
  SELECT pid, {_label} AS c, bag, {poisson_sql(S.uniform(S.digest(seed, 'bag', 'pid')))} AS draws
  FROM {source}, range({n_bags}) AS r(bag) WHERE {where}),
bag_min AS (SELECT bag, sum(draws)::BIGINT AS n FROM bag_draws WHERE c = 1 GROUP BY bag),
bag_copies AS (
  SELECT pid, bag, copy, row_number() OVER (
      PARTITION BY bag ORDER BY {S.digest(seed, 'bag', 'pid', 'copy')}, pid) AS rk
  FROM bag_draws, unnest(range(1, draws + 1)) AS u(copy) WHERE c = 0),
bag_kept AS (
  SELECT pid, k.bag, count(*) AS w FROM bag_copies k JOIN bag_min m ON m.bag = k.bag
  WHERE k.rk <= m.n GROUP BY pid, k.bag),
bags AS (
  SELECT b.pid, b.c, b.bag, (CASE WHEN b.c = 1 THEN b.draws ELSE COALESCE(k.w, 0) END)::INTEGER AS w
  FROM bag_draws b LEFT JOIN bag_kept k ON k.pid = b.pid AND k.bag = b.bag)"""


_split_counts = f"""WITH {S.PATIENT}, {S.three_way_cte()}
SELECT split, {_label}, count(*) AS n FROM tagged GROUP BY 1, 2"""
_wide = ", ".join(f"max(w) FILTER (bag = {b})::INTEGER AS b{b}" for b in range(N_BAGS))
_draws = S.uniform(S.digest(SEED, "bag", "pid"))

ORACLES = {
    "q_split": f"WITH {S.PATIENT}, {S.three_way_cte()} SELECT pid, {_label}, split FROM tagged",
    "q_split_counts": _split_counts,
    "q_split_plain": f"""WITH {S.PATIENT}, bare AS (SELECT pid, 0 AS one FROM patient),
{S.split_cte('bare', 'tagged', 'one', '0.2', SEED, 'train', 'test')} SELECT pid, split FROM tagged""",
    "q_split_cover": f"""WITH {S.PATIENT}, {S.split_cte('patient', 'tagged', _label, '0.2', SEED, 'train', 'test')}
SELECT count(*) AS n, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test,
  COALESCE(sum(pid) FILTER (split = 'test'), 0)::BIGINT AS test_key_sum FROM tagged""",
    "q_bootstrap": f"""WITH {S.PATIENT}, drawn AS (
  SELECT pid, bag, {poisson_sql(_draws)} AS w FROM patient, range({N_BAGS}) AS r(bag))
SELECT pid, {_wide} FROM drawn GROUP BY pid""",
    "q_undersample": f"""WITH {S.PATIENT}, ranked AS (
  SELECT pid, {_label}, row_number() OVER (PARTITION BY {_label} ORDER BY {S.digest(SEED, 'pid')}, pid) AS rk FROM patient)
SELECT pid, {_label} FROM ranked WHERE {_label} = 1 OR rk <= (SELECT count(*) FROM patient WHERE {_label} = 1)""",
    "q_bags": f"WITH {S.PATIENT}, {bag_ctes()} SELECT pid, c AS {_label}, {_wide} FROM bags GROUP BY pid, c",
    "q_bag_counts": f"WITH {S.PATIENT}, {bag_ctes()} SELECT bag::INTEGER AS bag, c AS {_label}, sum(w)::BIGINT AS n FROM bags WHERE w > 0 GROUP BY 1, 2",
}
