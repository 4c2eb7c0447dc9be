"""The training report as nested rows, one JSON line per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build_report(
    board: DataFrame, timestamp: str, notes: list[str], errors: dict[str, str] | None = None
) -> DataFrame:
    """One row: timestamp, notes, models by family, errors, comparison rows.

    ``board`` has one row per model, so gathering it into one row is bounded.
    """
    model = F.struct(
        "strategy", "threshold", "accuracy", "precision", "recall", "f1", "auc"
    )
    compared = F.struct(
        "pos", "family", "strategy", "threshold", "accuracy", "precision", "recall", "f1", "auc"
    )
    failures = F.create_map(
        *[F.lit(v) for pair in (errors or {}).items() for v in pair]
    ) if errors else F.create_map().cast("map<string,string>")
    return board.agg(
        F.map_from_entries(F.collect_list(F.struct("family", model))).alias("models"),
        F.array_sort(F.collect_list(compared)).alias("comparison"),
    ).select(
        F.lit(timestamp).alias("training_timestamp"),
        F.array(*[F.lit(n) for n in notes]).cast("array<string>").alias("notes"),
        "models", failures.alias("errors"), "comparison",
    )


def report_rows(report: DataFrame) -> DataFrame:
    """The comparison of a report, flat again."""
    return report.select("training_timestamp", F.explode("comparison").alias("c")).select(
        "training_timestamp", "c.*"
    )


def write_report(report: DataFrame, path: str, mode: str = "error") -> None:
    report.write.mode(mode).json(path)
