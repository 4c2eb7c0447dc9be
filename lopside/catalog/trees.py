"""What trees look like, checked split by split in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lopside.catalog import sql as S
from lopside.catalog.learning import prepared
from lopside.catalog.tabular import rounded
from lopside.learners import adaboost, boost, tree
from lopside.learners.grow import BINS, Rule, node_rows, quantise
from lopside.operators import metrics as M
from lopside.operators.prepare import stack
from lopside.schema import FEATURES, KEY, LABEL
from lopside.session import small_table

DEPTH, LEAF = 2, 10
BOOST = boost.BoostParams(0.3, DEPTH, 2, 1.0, rows=1.0, columns=1.0)
RUS = adaboost.Booster(3, 0.5, 1, 42)


def tree_splits(spark, d):
    """Every node of one tree on the training rows: its split and class counts."""
    train = prepared(spark, d).part("train").withColumn("bag_w", F.array(F.lit(1)))
    data = quantise(train, FEATURES, LABEL, KEY, carry=["bag_w"]).kept()
    rule = Rule(DEPTH, float(LEAF), float(tree.MIN_SPLIT))
    rows = node_rows(tree.grow_bags(data, [rule])[0], data.cuts, FEATURES)
    rows = [(path, f, cut, int(a), int(b)) for path, f, cut, a, b in rows]
    return rounded(small_table(spark, rows, "path string, feature string, cut double, n0 long, n1 long"), ["cut"], 5)


def boost_splits(spark, d):
    """Every node of the first two boosted trees: its split and its value."""
    train = prepared(spark, d).part("train")
    data = quantise(train, FEATURES, LABEL, KEY)
    member = boost.Member(BOOST, positive=boost.positive_weight(train, LABEL))
    boost.boost_members(data, [member])
    rows = [(i, path, f, cut, -a / (b + BOOST.l2) * BOOST.rate) for i, t in enumerate(member.trees)
            for path, f, cut, a, b in node_rows(t, data.cuts, FEATURES)]
    table = small_table(spark, rows, "tree int, path string, feature string, cut double, value double")
    return rounded(table, ["cut", "value"], 5)


def rus_weights(spark, d):
    """Row weights after three rounds of boosting on balanced draws."""
    booster = adaboost.Booster(RUS.rounds, RUS.rate, RUS.depth, RUS.seed)
    return rounded(adaboost.rusboost_weights(prepared(spark, d).part("train"), FEATURES, LABEL, booster), ["w"], 6)


def feature_auc(spark, d):
    """Area under the curve of each feature as a score, on the test rows."""
    test = prepared(spark, d).part("test")
    tall = stack(*[
        test.select(F.lit(c).alias("feature"), F.col(LABEL).alias("y"), F.col(c).cast("double").alias("p"))
        for c in FEATURES])
    return rounded(M.roc_auc(tall, by=["feature"]), ["auc"], 4)


QUERIES = {
    "q_tree_splits": tree_splits,
    "q_boost_splits": boost_splits,
    "q_rus_weights": rus_weights,
    "q_feature_auc": feature_auc,
}

_label = S.q(LABEL)
_values = ", ".join(f"{S.q(c)}::DOUBLE AS {S.q(c)}" for c in FEATURES)
_names = ", ".join(S.q(c) for c in FEATURES)
_positions = ", ".join(f"('{c}', {i})" for i, c in enumerate(FEATURES))

# Long rows of the training part, and the cut points of every feature.
_base = f"""{S.prepared_ctes()},
train AS (SELECT * FROM scaled WHERE split = 'train'),
names(feature, pos) AS (VALUES {_positions}),
long AS MATERIALIZED (UNPIVOT (SELECT pid, {_values} FROM train) ON {_names} INTO NAME feature VALUE v),
placed AS (
  SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS r,
    count(*) OVER (PARTITION BY feature) AS n FROM long),
cuts AS MATERIALIZED (SELECT DISTINCT feature, v AS cut FROM placed, range(1, {BINS}) AS t(j) WHERE r = (j * n) // {BINS})"""


def split_ctes(name: str, rows: str, second_order: bool) -> str:
    """CTEs ``name``_t(path, ta, tb) and ``name``(path, feature, cut, la, lb, ra, rb):
    sums of each node of ``rows``(pid, path, a, b), and its best split."""
    if second_order:
        part = lambda a, b: f"{a} * {a} / ({b} + 1e0)"
        fine, least = "lb >= 1 AND tb - lb >= 1 AND lb > 0 AND tb - lb > 0", "1e-6"
    else:
        part = lambda a, b: f"({a} * {a} + {b} * {b}) / ({a} + {b})"
        fine, least = "la + lb > 0 AND (ta - la) + (tb - lb) > 0", "1e-9 * (ta + tb)"
    gain = f"{part('la', 'lb')} + {part('(ta - la)', '(tb - lb)')} - {part('ta', 'tb')}"
    return f"""{name}_t AS MATERIALIZED (SELECT path, sum(a)::DOUBLE AS ta, sum(b)::DOUBLE AS tb FROM {rows} GROUP BY path),
{name}_c AS (
  SELECT path, feature, cut, sum(a)::DOUBLE AS la, sum(b)::DOUBLE AS lb
  FROM {rows} JOIN long USING (pid) JOIN cuts USING (feature) WHERE v < cut GROUP BY ALL),
{name}_g AS (
  SELECT path, feature, pos, cut, la, lb, ta - la AS ra, tb - lb AS rb, ta, tb, ({gain})::FLOAT AS gain
  FROM {name}_c JOIN {name}_t USING (path) JOIN names USING (feature) WHERE {fine}{{extra}}),
{name} AS MATERIALIZED (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY gain DESC, pos, cut) AS k FROM {name}_g)
  WHERE k = 1 AND gain > {least})"""


def next_rows(name: str, rows: str, splits: str) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT r.pid, r.path || CASE WHEN v < s.cut THEN 'L' ELSE 'R' END AS path, a, b
  FROM {rows} r JOIN {splits} s USING (path) JOIN long l ON l.pid = r.pid AND l.feature = s.feature)"""


_leaf = f" AND least(la + lb, (ta - la) + (tb - lb)) >= {LEAF} AND ta > 0 AND tb > 0 AND ta + tb >= {2 * LEAF}"
_gini = lambda name, rows: split_ctes(name, rows, False).format(extra=_leaf)
_newton = lambda name, rows: split_ctes(name, rows, True).format(extra=" AND tb >= 2")


def two_levels(tag: str, start: str, splits) -> str:
    """A tree of depth 2: all nodes as ``tag``(path, feature, cut, ta, tb), and the
    rows' last nodes as ``tag``_end(pid, path)."""
    return f"""{splits(tag + '_0', start)},
{next_rows(tag + '_r1', start, tag + '_0')}, {splits(tag + '_1', tag + '_r1')},
{next_rows(tag + '_r2', tag + '_r1', tag + '_1')},
{tag}_2_t AS (SELECT path, sum(a)::DOUBLE AS ta, sum(b)::DOUBLE AS tb FROM {tag}_r2 GROUP BY path),
{tag} AS MATERIALIZED (
  SELECT t.path, feature, cut, t.ta, t.tb FROM {tag}_0_t t LEFT JOIN {tag}_0 USING (path)
  UNION ALL SELECT t.path, feature, cut, t.ta, t.tb FROM {tag}_1_t t LEFT JOIN {tag}_1 USING (path)
  UNION ALL SELECT path, NULL, NULL, ta, tb FROM {tag}_2_t),
{tag}_end AS MATERIALIZED (
  SELECT pid, max_by(path, length(path)) AS path FROM (
    SELECT pid, path FROM {start} UNION ALL SELECT pid, path FROM {tag}_r1 UNION ALL SELECT pid, path FROM {tag}_r2)
  GROUP BY pid)"""


_value = f"(-ta / (tb + {BOOST.l2!r}) * {BOOST.rate!r}e0)"
_boosted = f"""spw AS (SELECT count(*) FILTER ({_label} = 0) / count(*) FILTER ({_label} = 1)::DOUBLE AS spw FROM train),
g0 AS MATERIALIZED (SELECT pid, '' AS path,
    CASE WHEN {_label} = 1 THEN spw * (0.5e0 - 1) ELSE 0.5e0 END AS a,
    CASE WHEN {_label} = 1 THEN spw ELSE 1e0 END * 0.5e0 * 0.5e0 AS b FROM train, spw),
{two_levels('t0', 'g0', _newton)},
m1 AS (SELECT e.pid, {_label} AS y, spw, 1e0 / (1e0 + exp(-{_value})) AS p
  FROM t0_end e JOIN t0 USING (path) JOIN train t ON t.pid = e.pid, spw),
g1 AS MATERIALIZED (SELECT pid, '' AS path, CASE WHEN y = 1 THEN spw * (p - 1) ELSE p END AS a,
    CASE WHEN y = 1 THEN spw ELSE 1e0 END * p * (1 - p) AS b FROM m1),
{two_levels('t1', 'g1', _newton)}"""


def rus_round(i: int) -> str:
    """CTE w{i + 1}(pid, y, w) from w{i}: draw, stump, error on all rows, update."""
    return f"""d{i} AS (
  SELECT pid, row_number() OVER (PARTITION BY y ORDER BY {S.digest(RUS.seed + i, 'pid')}, pid) AS rk, y FROM w{i}),
r{i} AS MATERIALIZED (
  SELECT w.pid, '' AS path, CASE WHEN w.y = 1 THEN 0e0 ELSE w END AS a, CASE WHEN w.y = 1 THEN w ELSE 0e0 END AS b
  FROM w{i} w JOIN d{i} d ON d.pid = w.pid
  WHERE d.y = 1 OR rk <= (SELECT count(*) FROM w{i} WHERE y = 1)),
{split_ctes(f's{i}', f'r{i}', False).format(extra='')},
j{i} AS MATERIALIZED (
  SELECT w.pid, w.y, w.w, (CASE WHEN v < cut THEN lb > la ELSE rb > ra END)::INTEGER <> w.y AS missed
  FROM w{i} w JOIN long USING (pid) JOIN s{i} USING (feature)),
e{i} AS (SELECT sum(w) FILTER (missed) / sum(w) AS error FROM j{i}),
w{i + 1} AS MATERIALIZED (
  SELECT pid, y, w * CASE WHEN missed THEN exp({RUS.rate!r}e0 * ln((1e0 - error) / error)) ELSE 1e0 END AS w FROM j{i}, e{i})"""


ORACLES = {
    "q_tree_splits": f"""WITH {_base},
start AS MATERIALIZED (SELECT pid, '' AS path, 1 - {_label} AS a, {_label} AS b FROM train),
{two_levels('t', 'start', _gini)}
SELECT path, feature, round(cut, 5) + 0e0 AS cut, ta::BIGINT AS n0, tb::BIGINT AS n1 FROM t""",
    "q_boost_splits": f"""WITH {_base}, {_boosted}
SELECT 0::INTEGER AS tree, path, feature, round(cut, 5) + 0e0 AS cut, round({_value}, 5) + 0e0 AS value FROM t0
UNION ALL SELECT 1, path, feature, round(cut, 5) + 0e0, round({_value}, 5) + 0e0 FROM t1""",
    "q_rus_weights": f"""WITH {_base},
w0 AS MATERIALIZED (SELECT pid, {_label}::INTEGER AS y, 1e0 AS w FROM train),
{", ".join(rus_round(i) for i in range(RUS.rounds))}
SELECT pid, y, round(w * (SELECT count(*) FROM w{RUS.rounds}) / (SELECT sum(w) FROM w{RUS.rounds}), 6) AS w FROM w{RUS.rounds}""",
    "q_feature_auc": f"""WITH {S.prepared_ctes()},
tall AS (UNPIVOT (SELECT {_label} AS y, {_values} FROM scaled WHERE split = 'test') ON {_names} INTO NAME feature VALUE p),
{S.auc_ctes('tall', 'area', 'feature')}
SELECT feature, round(auc, 4) AS auc FROM area""",
}
