"""How close two mapped values are, given the pair's correlation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def _relative(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(F.abs(a - b), F.greatest(a, b))


def closeness_1(a: Column, b: Column, corr: Column) -> Column:
    return _relative(a, b)


def closeness_2(a: Column, b: Column, corr: Column) -> Column:
    ratio = b / (a + TINY)
    return F.when(ratio > 1, 1 / ratio).otherwise(ratio)


def closeness_3(a: Column, b: Column, corr: Column) -> Column:
    """Under a negative correlation the second value counts from the other end."""
    return _relative(a, F.when(corr >= 0, b).otherwise(1 - b))


def closeness_4(a: Column, b: Column, corr: Column) -> Column:
    return 1 - F.abs(corr * a + 0.5 - corr / 2 - b)


REGISTRY = {f.__name__: f for f in (closeness_1, closeness_2, closeness_3, closeness_4)}


def _relative_array(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - np.abs(a - b) / np.maximum(a, b)


def _ratio_array(a: np.ndarray, b: np.ndarray, corr: np.ndarray) -> np.ndarray:
    ratio = b / (a + TINY)
    with np.errstate(divide="ignore"):
        return np.where(ratio > 1, 1 / ratio, ratio)


#: The same for arrays of pairs in a batch; a value that isn't a number is no evidence.
NUMPY = {
    "closeness_1": lambda a, b, corr: _relative_array(a, b),
    "closeness_2": _ratio_array,
    "closeness_3": lambda a, b, corr: _relative_array(a, np.where(corr >= 0, b, 1 - b)),
    "closeness_4": lambda a, b, corr: 1 - np.abs(corr * a + 0.5 - corr / 2 - b),
}
