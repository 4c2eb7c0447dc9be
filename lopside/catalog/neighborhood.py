"""Neighbour join, voting, over-sampling, cleaning and reduction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lopside.catalog import sql as S
from lopside.catalog.sampling import SEED, bag_ctes
from lopside.catalog.tabular import rounded
from lopside.functions.features import engineer_features
from lopside.operators import reduce as D
from lopside.operators import resample as R
from lopside.operators.approximate import knn_approximate, recall
from lopside.operators.neighbors import knn_join, vote_shares
from lopside.operators.prepare import fit_medians, impute, pack
from lopside.operators.sampling import balanced_bags, three_way_split
from lopside.schema import FEATURES, KEY, LABEL, RAW_FEATURES
from lopside.session import materialize
from lopside.sources.patient import patient

# Whole-number columns: distances between them are exact in both engines.
VECTOR = ["age", "sysBP", "diaBP", "heartRate"]
KS = [3, 5, 7, 9, 11, 15, 21]
WEIGHTINGS = ["uniform", "distance"]
N_BAGS = 3
DIM = 64


def embedded(spark, d):
    """Embedding rows with class 3 as the rare label."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    return rows.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"),
        (F.col("label") == 3).cast("int").alias("y"),
    )


def patient_vectors(spark, d):
    return pack(patient(spark, d).select(KEY, LABEL, *VECTOR), VECTOR).select(KEY, LABEL, "x")


def split_vectors(spark, d):
    return three_way_split(patient_vectors(spark, d), LABEL, 0.2, 0.15, SEED, KEY)


def nearest(spark, d, p, **layout):
    rows = embedded(spark, d)
    found = knn_join(rows, rows, 5, p, "vec_id", label="y", exclude_self=True, **layout)
    return rounded(found.select("q", "r", "dist", "y", "rank"), ["dist"])


def knn_l1(spark, d):
    return nearest(spark, d, 1)


def knn_l2(spark, d):
    return nearest(spark, d, 2)


def knn_blocks_l1(spark, d):
    """Many small blocks and chunks, as a large reference has."""
    return nearest(spark, d, 1, block_rows=32, chunk_rows=64)


def knn_blocks_l2(spark, d):
    return nearest(spark, d, 2, block_rows=32, chunk_rows=64)


def votes(spark, d, weighting):
    rows = split_vectors(spark, d)
    near = knn_join(
        rows.where("split = 'val'"), rows.where("split = 'train'"), max(KS), 2, KEY, label=LABEL
    )
    return rounded(vote_shares(near, KS, [weighting]).select("q", "k", "p"), ["p"])


def knn_vote(spark, d):
    return votes(spark, d, "uniform")


def knn_weighted(spark, d):
    return votes(spark, d, "distance")


def bag_knn(spark, d):
    rows = split_vectors(spark, d)
    train = balanced_bags(rows.where("split = 'train'"), LABEL, N_BAGS, SEED, KEY)
    near = knn_join(
        rows.where("split = 'val'"), train, 11, 2, KEY, label=LABEL, weights="bag_w", n_bags=N_BAGS
    )
    return rounded(vote_shares(near, [5, 11], ["uniform"]).select("q", "k", "p"), ["p"])


def smote(spark, d):
    new = R.smote_rows(patient_vectors(spark, d), LABEL, SEED, KEY)
    return rounded(
        new.select("base", "copy", "neighbor", *[F.col("x")[i].alias(c) for i, c in enumerate(VECTOR)]),
        VECTOR,
    )


def smote_counts(spark, d):
    whole = R.smote(patient_vectors(spark, d), LABEL, SEED, KEY)
    return whole.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))


def enn(spark, d):
    return R.enn(embedded(spark, d), "y", key="vec_id").select("vec_id", "y")


def tomek(spark, d):
    return R.tomek_links(embedded(spark, d), "y", key="vec_id").select("vec_id", "y")


def tomek_found(spark, d):
    return R.tomek_pairs(embedded(spark, d), "y", key="vec_id")


def smoteenn(spark, d):
    return R.smoteenn(embedded(spark, d), "y", SEED, "vec_id").select("sid", "y")


def smotetomek(spark, d):
    return R.smotetomek(embedded(spark, d), "y", SEED, "vec_id").select("sid", "y")


def pca(spark, d):
    rows = embedded(spark, d)
    fitted = D.fit_pca(rows, 8)
    return D.project(rows.select("vec_id", "x"), fitted).select(
        "vec_id", *[F.round(F.col("x")[i], 6).alias(f"c{i}") for i in range(8)]
    )


def whole_features(spark, d):
    rows = patient(spark, d)
    return engineer_features(impute(rows, fit_medians(rows, RAW_FEATURES)))


def mutual_info(spark, d):
    return rounded(D.mutual_information(whole_features(spark, d), FEATURES, LABEL), ["mi"])


def knn_lsh(spark, d):
    """How many of the five exact neighbours of every vector the approximate join
    finds, and the recall over all of them."""
    rows = materialize(embedded(spark, d))
    found = knn_approximate(rows, rows, 5, "vec_id", label="y", exclude_self=True)
    exact = knn_join(rows, rows, 5, 2, "vec_id", label="y", exclude_self=True)
    hits = materialize(recall(found, exact, 5))
    total = hits.agg((F.sum("hits") / F.sum("wanted")).alias("recall"))
    return hits.crossJoin(F.broadcast(total))  # one row


def neighbor_info(spark, d):
    found = D.neighbor_information(whole_features(spark, d), FEATURES, LABEL)
    return rounded(found, ["mi"], 4)


def select_k(spark, d):
    return D.select_k_best(mutual_info(spark, d), 10)


QUERIES = {
    "q_knn_l1": knn_l1,
    "q_knn_l2": knn_l2,
    "q_knn_blocks_l1": knn_blocks_l1,
    "q_knn_blocks_l2": knn_blocks_l2,
    "q_knn_vote": knn_vote,
    "q_knn_weighted": knn_weighted,
    "q_bag_knn": bag_knn,
    "q_smote": smote,
    "q_smote_counts": smote_counts,
    "q_enn": enn,
    "q_tomek": tomek,
    "q_tomek_pairs": tomek_found,
    "q_smoteenn": smoteenn,
    "q_smotetomek": smotetomek,
    "q_pca": pca,
    "q_mutual_info": mutual_info,
    "q_neighbor_info": neighbor_info,
    "q_knn_lsh": knn_lsh,
    "q_select_k": select_k,
}

EMBEDDED = 'vecs AS (SELECT vec_id, embedding AS e, (label = 3)::INTEGER AS y FROM embeddings)'


def _gap(i):
    return f"(a.e[{i}]::DOUBLE - b.e[{i}]::DOUBLE)"


_L1 = " + ".join(f"abs({_gap(i)})" for i in range(1, DIM + 1))
_L2 = "sqrt(" + " + ".join(f"{_gap(i)} * {_gap(i)}" for i in range(1, DIM + 1)) + ")"


def near_embedded(distance: str, k: int) -> str:
    return f"""{EMBEDDED}, near AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, r) AS rank FROM (
      SELECT a.vec_id AS q, b.vec_id AS r, a.y AS yq, b.y AS y, {distance} AS dist
      FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id))
  WHERE rank <= {k})"""


_label = S.q(LABEL)
_space = " + ".join(f"(a.{S.q(c)} - b.{S.q(c)}) * (a.{S.q(c)} - b.{S.q(c)})" for c in VECTOR)


def near_patient(left: str, right: str, k: int, where: str = "TRUE", name: str = "near") -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, r) AS rank FROM (
      SELECT a.pid AS q, b.pid AS r, b.{_label} AS y, sqrt({_space}) AS dist
      FROM {left} a JOIN {right} b ON {where}))
  WHERE rank <= {k})"""


_parts = f"""{S.PATIENT}, {S.three_way_cte()},
val AS (SELECT * FROM tagged WHERE split = 'val'), train AS (SELECT * FROM tagged WHERE split = 'train')"""
_ks = f"ks AS (SELECT unnest({KS})::INTEGER AS k)"
_taken = f"""{_parts}, {near_patient('val', 'train', max(KS))}, {_ks},
taken AS (SELECT near.q, ks.k, near.y, near.dist, min(near.dist) OVER (PARTITION BY near.q, ks.k) AS closest
  FROM near JOIN ks ON near.rank <= ks.k)"""

_minority = f"""{S.PATIENT}, few AS (SELECT * FROM patient WHERE {_label} = 1),
size AS (SELECT count(*) FILTER ({_label} = 1) AS n_min, count(*) FILTER ({_label} = 0) - count(*) FILTER ({_label} = 1) AS n_new FROM patient),
{near_patient('few', 'few', R.SMOTE_K, 'a.pid <> b.pid')},
planned AS (
  SELECT pid, n_new // n_min + CASE WHEN row_number() OVER (ORDER BY {S.digest(SEED, 'pid')}, pid) <= n_new % n_min THEN 1 ELSE 0 END AS n
  FROM few, size),
copies AS (
  SELECT pid, copy, (('0x' || substr({S.digest(SEED, 'pid', 'copy')}, 1, 8))::BIGINT % {R.SMOTE_K}) + 1 AS rank,
    {S.uniform(S.digest(SEED + 1, 'pid', 'copy'))} AS u
  FROM planned, unnest(range(1, n + 1)) AS t(copy))"""
_mixed = ", ".join(
    f"round(a.{S.q(c)} + u * (b.{S.q(c)} - a.{S.q(c)}), 6) + 0e0 AS {S.q(c)}" for c in VECTOR
)

_whole = f"{S.PATIENT}, {S.imputed_cte('patient', 'imputed', 'TRUE')}, {S.with_features('imputed', 'derived')}"
_fractions = "[" + ", ".join(f"{i / 10!r}" for i in range(1, 10)) + "]"
_mutual = f"""{_whole},
long AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {S.q(c)}::DOUBLE AS v, {_label} AS y FROM derived" for c in FEATURES
) + f"""),
cuts AS (SELECT feature, list_distinct(quantile_cont(v, {_fractions})) AS c FROM long GROUP BY 1),
counts AS (
  SELECT long.feature, len(list_filter(c, lambda t: t <= v)) AS bin, y, count(*)::DOUBLE AS n
  FROM long JOIN cuts ON cuts.feature = long.feature GROUP BY 1, 2, 3),
info AS (
  SELECT feature, round(sum(n / t * ln(n * t / (nb * ny))), 6) + 0e0 AS mi FROM (
    SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS nb,
      sum(n) OVER (PARTITION BY feature, y) AS ny FROM counts)
  GROUP BY feature)"""

def _psi(x: str) -> str:
    z = f"({x}::DOUBLE + 6e0)"
    back = "".join(f" - 1e0 / ({x}::DOUBLE + {i}e0)" for i in range(6))
    return (f"(ln({z}) - 0.5e0 / {z} - (1e0 / ({z} * {z})) * (1e0 / 12e0 - (1e0 / ({z} * {z})) * "
            f"(1e0 / 120e0 - (1e0 / ({z} * {z})) * (1e0 / 252e0))){back})")


_neighbor_info = f"""{_whole},
long AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {S.q(c)}::DOUBLE AS v, {_label} AS y FROM derived" for c in FEATURES
) + f"""),
cells AS (SELECT feature, y, v, count(*) AS n FROM long GROUP BY ALL),
points AS (SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY feature, y)::BIGINT AS size FROM cells) WHERE size > 1),
around AS (
  SELECT *, least({D.NEIGHBORS}, size - 1) AS k, list({{'w': v, 'c': n}}) OVER (PARTITION BY feature, y ORDER BY v
    ROWS BETWEEN {D.NEIGHBORS} PRECEDING AND {D.NEIGHBORS} FOLLOWING) AS near FROM points),
others AS (
  SELECT feature, y, v, k, abs(o.w - v) AS d, o.c - CASE WHEN o.w = v THEN 1 ELSE 0 END AS c
  FROM (SELECT feature, y, v, k, unnest(near) AS o FROM around)),
reached AS (
  SELECT feature, y, v, min(d) AS r FROM (
    SELECT *, sum(c) OVER (PARTITION BY feature, y, v ORDER BY d, c ROWS UNBOUNDED PRECEDING) AS seen FROM others WHERE c > 0)
  WHERE seen >= k GROUP BY feature, y, v),
asked AS (SELECT a.feature, a.y, a.v, a.n, a.k, a.size, r, v - r AS lo, v + r AS hi FROM around a JOIN reached USING (feature, y, v)),
upto AS (SELECT feature, v AS at, sum(sum(n)) OVER (PARTITION BY feature ORDER BY v) AS c, sum(n) AS own FROM points GROUP BY feature, v),
high AS (SELECT q.*, u.c AS c_hi FROM asked q ASOF LEFT JOIN upto u ON u.feature = q.feature AND q.hi > u.at),
low AS (SELECT q.*, u.c AS c_lo FROM high q ASOF LEFT JOIN upto u ON u.feature = q.feature AND q.lo >= u.at),
counted AS (
  SELECT q.*, CASE WHEN r > 0 THEN coalesce(c_hi, 0) - coalesce(c_lo, 0) ELSE own END AS m
  FROM low q JOIN upto u ON u.feature = q.feature AND u.at = q.v),
information AS (
  SELECT feature, greatest(0e0, {_psi('sum(n)')} + sum(n * {_psi('k')}) / sum(n) - sum(n * {_psi('size')}) / sum(n)
    - sum(n * {_psi('m')}) / sum(n)) AS mi FROM counted GROUP BY feature)"""

ORACLES = {
    "q_knn_l1": f"WITH {near_embedded(_L1, 5)} SELECT q, r, round(dist, 6) AS dist, y, rank::INTEGER AS rank FROM near",
    "q_knn_l2": f"WITH {near_embedded(_L2, 5)} SELECT q, r, round(dist, 6) AS dist, y, rank::INTEGER AS rank FROM near",
    "q_knn_blocks_l1": f"WITH {near_embedded(_L1, 5)} SELECT q, r, round(dist, 6) AS dist, y, rank::INTEGER AS rank FROM near",
    "q_knn_blocks_l2": f"WITH {near_embedded(_L2, 5)} SELECT q, r, round(dist, 6) AS dist, y, rank::INTEGER AS rank FROM near",
    "q_knn_vote": f"WITH {_taken} SELECT q, k, round(avg(y), 6) AS p FROM taken GROUP BY q, k",
    "q_knn_weighted": f"""WITH {_taken} SELECT q, k, round(CASE WHEN min(closest) = 0
  THEN sum(y) FILTER (dist = 0)::DOUBLE / count(*) FILTER (dist = 0)
  ELSE sum(y / dist) FILTER (dist > 0) / sum(1 / dist) FILTER (dist > 0) END, 6) AS p FROM taken GROUP BY q, k""",
    "q_bag_knn": f"""WITH {_parts}, {bag_ctes('train', N_BAGS, SEED)},
pairs AS (SELECT a.pid AS q, b.pid AS r, b.{_label} AS y, sqrt({_space}) AS dist FROM val a JOIN train b ON TRUE),
running AS (
  SELECT q, bags.bag, y, w, sum(w) OVER (PARTITION BY q, bags.bag ORDER BY dist, r
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w AS before
  FROM pairs JOIN bags ON bags.pid = r AND bags.w > 0),
shares AS (
  SELECT q, bag, k, sum(least(w, k - before) * y)::DOUBLE / sum(least(w, k - before)) AS p
  FROM running JOIN (VALUES (5), (11)) AS ks(k) ON before < k GROUP BY 1, 2, 3)
SELECT q, k::INTEGER AS k, round(avg(p), 6) AS p FROM shares GROUP BY q, k""",
    "q_smote": f"""WITH {_minority}
SELECT copies.pid AS base, copy::INTEGER AS copy, near.r AS neighbor, {_mixed}
FROM copies JOIN near ON near.q = copies.pid AND near.rank = copies.rank
JOIN few a ON a.pid = copies.pid JOIN few b ON b.pid = near.r""",
    "q_smote_counts": f"""WITH {_minority} SELECT {_label}, count(*) AS n FROM (
  SELECT {_label} FROM patient UNION ALL
  SELECT 1 FROM copies JOIN near ON near.q = copies.pid AND near.rank = copies.rank) GROUP BY 1""",
    "q_enn": f"""WITH {near_embedded(_L2, R.ENN_K)} SELECT q AS vec_id, min(yq) AS y FROM near
GROUP BY q HAVING min(y) = min(yq) AND max(y) = min(yq)""",
    "q_tomek": f"""WITH {near_embedded(_L2, 1)} SELECT a.q AS vec_id, a.yq AS y FROM near a
LEFT JOIN near b ON b.q = a.r AND b.r = a.q AND b.yq <> a.yq WHERE b.q IS NULL""",
    "q_tomek_pairs": f"""WITH {near_embedded(_L2, 1)} SELECT a.q AS a, a.r AS b FROM near a
JOIN near b ON b.q = a.r AND b.r = a.q AND b.yq <> a.yq WHERE a.q < a.r""",
    "q_mutual_info": f"WITH {_mutual} SELECT * FROM info",
    "q_neighbor_info": f"WITH {_neighbor_info} SELECT feature, round(mi, 4) + 0e0 AS mi FROM information",
    "q_select_k": f"WITH {_mutual} SELECT * FROM info ORDER BY mi DESC, feature LIMIT 10",
}
