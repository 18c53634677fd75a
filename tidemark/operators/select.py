"""Feature selection."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.base import Fitted, Learnable, Operator, as_double, param, register

KIND = "feature_selection"


def resolve(df: DataFrame, columns: tuple[str | int, ...] | None) -> list[int]:
    """Indices of columns given by name or by index; all for None."""
    if columns is None:
        return list(range(len(df.columns)))
    if len({type(c) for c in columns}) > 1:
        raise ValueError("give all columns by name or all by index")
    out = []
    for c in columns:
        if isinstance(c, str):
            if c not in df.columns:
                raise ValueError(f"column {c!r} not found")
            out.append(df.columns.index(c))
        elif not 0 <= c < len(df.columns):
            raise ValueError(f"column index {c} is out of range")
        else:
            out.append(c)
    return out


@dataclass(frozen=True)
class Selector(Operator):
    """Base of selectors: the result has the selected columns only."""


@dataclass(frozen=True)
class Unsupervised(Learnable):
    """Base of selectors that learn from the features alone."""


@dataclass(frozen=True)
class Supervised(Learnable):
    """Base of selectors that learn from features and a target."""


@register("column_selector", KIND)
@dataclass(frozen=True)
class Columns(Selector):
    """Keeps the named columns (or indices), in the given order."""

    input_columns: tuple[str | int, ...] = ()

    def selected(self, df: DataFrame) -> list[int]:
        return resolve(df, self.input_columns)

    def run(self, df: DataFrame) -> DataFrame:
        return df.select(*[df.columns[i] for i in self.selected(df)])


@register("variance_threshold_selector", KIND)
@dataclass(frozen=True)
class VarianceThreshold(Unsupervised):
    """Keeps columns whose population variance exceeds the threshold; the state tells indices and variances."""

    input_columns: tuple[str | int, ...] | None = None
    threshold: float = param(0.0, ge=0)

    def fit(self, df: DataFrame) -> Fitted:
        at = resolve(df, self.input_columns)
        row = df.agg(*[F.var_pop(as_double(df.columns[i])).alias(f"v{i}") for i in at]).first()
        kept = [i for i in at if row[f"v{i}"] is not None and row[f"v{i}"] > self.threshold]
        return Fitted(self, {"columns": [df.columns[i] for i in kept], "selected_indices": kept, "variances": [row[f"v{i}"] for i in at]})

    def apply(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        return df.select(*state["columns"])
