"""Exact classification metrics over score tables.

Each function takes a table with a label column of 0/1 and a prediction or a
score, optionally grouped, and returns a table. Counts are taken once with
map-side combine; everything after works on the small counted table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lopside.operators.running import running_sums

METRICS = ["accuracy", "precision", "recall", "f1", "mcc"]


def apply_threshold(df: DataFrame, t: float | Column, score: str = "p", output: str = "pred") -> DataFrame:
    """``p >= t`` as 0/1; a missing score (null or NaN) predicts nothing."""
    bound = t if isinstance(t, Column) else F.lit(float(t))
    return df.withColumn(output, (known_score(F.col(score)) >= bound).cast("int"))


def known_score(score: Column) -> Column:
    """The score, or null where it is NaN (which Spark holds to be the largest)."""
    return F.when(~F.isnan(score), score)


def risk_label(df: DataFrame, features: list[str], pred: str = "pred", score: str = "p") -> DataFrame:
    """Risk word, confidence, then the features."""
    keep = [c for c in features if c in df.columns]
    return df.select(
        F.when(F.col(pred) == 1, "High Risk").otherwise("Low Risk").alias("predicted_risk"),
        F.col(score).alias("confidence"),
        *keep,
    )


def confusion(
    df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None
) -> DataFrame:
    """tn, fp, fn, tp (BIGINT; absent cells are 0)."""
    cell = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    cells = [
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
        cell(1, 0).alias("fn"), cell(1, 1).alias("tp"),
    ]
    return df.groupBy(*(by or [])).agg(*cells)


def confusion_cells(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """(cell, n, share): the matrix as rows."""
    cells = confusion(df, y, pred).unpivot([], ["tn", "fp", "fn", "tp"], "cell", "n")
    total = F.sum("n").over(Window.partitionBy())  # four rows
    return cells.withColumn("share", zero_if_undefined(F.col("n"), total))


def confusion_labels(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """(cell, label): each cell of the matrix as text, its name, its count and
    its share in percent with one decimal, a line each. Without rows the share is 0."""
    percent = F.format_string("(%.1f%%)", F.col("share") * 100.0)
    return confusion_cells(df, y, pred).select(
        "cell", F.concat_ws("\n", F.upper("cell"), F.col("n").cast("string"), percent).alias("label"))


def zero_if_undefined(top: Column, bottom: Column) -> Column:
    """A ratio that is 0 where the denominator is 0."""
    return F.coalesce(
        F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0)
    )


def metric_columns() -> dict[str, Column]:
    """Closed forms over tn, fp, fn, tp, in doubles (the MCC product overflows BIGINT)."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    two = F.lit(2.0)
    return {
        "accuracy": zero_if_undefined(tp + tn, tp + tn + fp + fn),
        "precision": zero_if_undefined(tp, tp + fp),
        "recall": zero_if_undefined(tp, tp + fn),
        "f1": zero_if_undefined(two * tp, two * tp + fp + fn),
        "mcc": zero_if_undefined(
            tp * tn - fp * fn,
            F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)),
        ),
    }


def binary_metrics(
    df: DataFrame, y: str = "y", pred: str = "pred", by: list[str] | None = None
) -> DataFrame:
    """Five metrics per group, with the counts they come from."""
    return confusion(df, y, pred, by).withColumns(metric_columns())


def metrics_long(df: DataFrame, names: list[str], ids: list[str] | None = None) -> DataFrame:
    """Metric columns as (metric, value) rows."""
    return df.unpivot(ids or [], names, "metric", "value")


def roc_auc(
    df: DataFrame, y: str = "y", score: str = "p", by: list[str] | None = None
) -> DataFrame:
    """Exact area under the ROC curve per group; ties count half.

    Rows collapse to distinct scores first, and the negatives below each score
    are a running sum over parts of bounded size, so no group or score region
    lands in one task whole.
    """
    by = by or []
    scores = (
        df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
        .groupBy(*by, F.col(score).alias("s"))
        .agg(
            F.count_if(F.col(y) == 1).alias("pos"),
            F.count_if(F.col(y) == 0).alias("neg"),
        )
    )
    below = F.col("neg_upto") - F.lit(0.5) * F.col("neg")
    total = running_sums(scores, by, ["s"], ["neg"]).groupBy(*by).agg(
        F.sum(F.col("pos") * below).alias("o"), F.sum("pos").alias("pn"), F.sum("neg").alias("nn"))
    area = F.try_divide(
        F.col("o"), F.col("pn").cast("double") * F.col("nn").cast("double")
    )
    return total.select(*by, area.alias("auc"))


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per-class rows, accuracy, macro and weighted averages."""
    counts = confusion(df, y, pred)
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    two = F.lit(2.0)

    def per_class(hit, false_hit, miss):
        return (
            zero_if_undefined(hit, hit + false_hit),
            zero_if_undefined(hit, hit + miss),
            zero_if_undefined(two * hit, two * hit + false_hit + miss),
            hit + miss,
        )

    p0, r0, f0, s0 = per_class(tn, fn, fp)
    p1, r1, f1, s1 = per_class(tp, fp, fn)
    n = s0 + s1
    accuracy = zero_if_undefined(tp + tn, n)
    macro = lambda a, b: (a + b) / two
    weighted = lambda a, b: zero_if_undefined(a * s0 + b * s1, n)
    row = lambda name, p, r, f, s: F.struct(
        F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
        f.alias("f1"), s.cast("bigint").alias("support"),
    )
    rows = F.array(
        row("0", p0, r0, f0, s0),
        row("1", p1, r1, f1, s1),
        row("accuracy", accuracy, accuracy, accuracy, n),
        row("macro avg", macro(p0, p1), macro(r0, r1), macro(f0, f1), n),
        row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), n),
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def threshold_sweep(
    df: DataFrame, thresholds: list[float], y: str = "y", score: str = "p",
    by: list[str] | None = None,
) -> DataFrame:
    """F1, precision and recall at every threshold, in one pass over the rows.

    Each row finds how many thresholds it reaches; rows collapse to at most
    ``len(thresholds) + 1`` counts per group, and a suffix sum over those
    counts gives the confusion matrix at every threshold.
    """
    by = by or []
    n = len(thresholds)
    table = F.array(*[F.lit(float(t)) for t in thresholds])
    counted = (
        df.where(F.col(score).isNotNull() & F.col(y).isNotNull())
        .withColumn("idx", _thresholds_reached(F.col(score), thresholds))
        .groupBy(*by, "idx")
        .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    )
    # Every threshold appears, also those no row stops at.
    groups = counted.groupBy(*by).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.map_from_entries(F.collect_list(F.struct("idx", F.struct("pos", "neg")))).alias("cells"),
    )
    steps = groups.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n))))
    cell = F.try_element_at(F.col("cells"), F.col("j"))
    w = Window.partitionBy(*by).orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("bigint")
    swept = (
        steps.select(
            *by, "P", "N", "j",
            F.coalesce(cell["pos"], zero).alias("pos"), F.coalesce(cell["neg"], zero).alias("neg"),
        )
        .withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w)})
        .where("j >= 1")
        .withColumns({"fn": F.col("P") - F.col("tp"), "tn": F.col("N") - F.col("fp")})
    )
    closed = metric_columns()
    return swept.select(
        *by, F.element_at(table, F.col("j")).alias("threshold"),
        "tn", "fp", "fn", "tp",
        *[closed[m].alias(m) for m in ("f1", "precision", "recall")],
    )


def _thresholds_reached(p: Column, thresholds: list[float]) -> Column:
    """Number of thresholds <= p. Guess from the spacing, then settle by comparing.

    The comparison is with the literal values, so an edge falls on the right
    side whatever the rounding of the guess. Unevenly spaced thresholds are
    searched by halves.
    """
    n = len(thresholds)
    table = F.array(*[F.lit(float(t)) for t in thresholds])
    step = (thresholds[-1] - thresholds[0]) / (n - 1) if n > 1 else 1.0
    even = all(
        abs(t - (thresholds[0] + i * step)) < step / 4 for i, t in enumerate(thresholds)
    )
    if not even:
        ordered = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
        halves = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
        return F.aggregate(halves, F.lit(0), lambda reached, half: reached + F.when(
            F.get(ordered, reached + half - 1) <= p, half).otherwise(0))
    guess = F.greatest(
        F.lit(0), F.least(F.lit(n), F.floor((p - F.lit(thresholds[0])) / F.lit(step)).cast("int") + 1)
    )
    at = lambda j: F.get(table, j)  # zero-based; null outside
    return (
        F.when((guess > 0) & (at(guess - 1) > p), guess - 1)
        .when((guess < n) & (at(guess) <= p), guess + 1)
        .otherwise(guess)
    )


def best_threshold(
    sweep: DataFrame, default: float, by: list[str] | None = None
) -> DataFrame:
    """Threshold of the highest F1, lowest on ties; the default if all are 0."""
    order = F.struct(F.col("f1"), -F.col("threshold"))
    picked = sweep.groupBy(*(by or [])).agg(
        F.max_by(F.struct("threshold", "f1", "precision", "recall"), order).alias("b")
    )
    none_right = F.col("b.f1") == 0.0
    return picked.select(
        *(by or []),
        F.when(none_right, F.lit(float(default))).otherwise(F.col("b.threshold")).alias("threshold"),
        F.col("b.f1").alias("f1"), F.col("b.precision").alias("precision"),
        F.col("b.recall").alias("recall"),
    )


def best_possible_threshold(
    df: DataFrame, thresholds: list[float], default: float, y: str = "y", score: str = "p"
) -> DataFrame:
    """The F1 a threshold chosen on these very rows would reach (for information)."""
    return best_threshold(threshold_sweep(df, thresholds, y, score), default).select(
        "threshold", "f1"
    )


def evaluate(
    df: DataFrame, t: float, y: str = "y", score: str = "p", by: list[str] | None = None
) -> DataFrame:
    """Test-side evaluation: the five metrics, the AUC and the threshold, one row."""
    by = by or []
    metrics = binary_metrics(apply_threshold(df, t, score), y, "pred", by)
    auc = roc_auc(df, y, score, by)
    joined = metrics.join(auc, by) if by else metrics.crossJoin(auc)  # one row each
    return joined.withColumn("threshold", F.lit(float(t)))
