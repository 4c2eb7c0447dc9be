"""Threshold grids per learner family."""

from __future__ import annotations

import math

# Fixed values: (low, high, step, default) per family. High is open.
GRIDS = {
    "lr": (0.05, 0.95, 0.005, 0.37),
    "dt": (0.05, 0.95, 0.005, 0.5),
    "knn": (0.05, 0.50, 0.005, 0.35),
    "nb": (0.10, 0.70, 0.005, 0.35),
    "rf": (0.30, 0.70, 0.005, 0.50),
    "xgb": (0.20, 0.55 + 0.005, 0.005, 0.45),
    "xgb_best_possible": (0.10, 0.80, 0.005, 0.50),
}

# Fixed value: the threshold of the logistic family when it is not tuned.
LR_FIXED_THRESHOLD = 0.37


def threshold_grid(low: float, high: float, step: float = 0.005) -> list[float]:
    """Evenly spaced thresholds in [low, high).

    The increment is the rounded difference ``(low + step) - low``, not
    ``step``: published thresholds such as 0.5649999999999998 need it.
    """
    count = max(0, math.ceil((high - low) / step))
    increment = (low + step) - low
    return [low + i * increment for i in range(count)]


def family_grid(family: str) -> list[float]:
    low, high, step, _ = GRIDS[family]
    return threshold_grid(low, high, step)


def family_default(family: str) -> float:
    return GRIDS[family][3]
