"""Operator specs, the registry, and the order contract.

An operator is a small validated spec. A plain one maps a DataFrame to a DataFrame; a
learnable one first fits a model, a small driver-side object that compiles to literal
expressions. Nothing runs before an action but the aggregates that a fit needs.
"""

from __future__ import annotations

import dataclasses
import json
import types
import typing
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.window import WindowSpec


@dataclass(frozen=True)
class TimeKey:
    """Explicit row order: Spark tables have none. ``order_by`` must be unique within ``partition_by``."""

    order_by: tuple[str, ...]
    partition_by: tuple[str, ...] = ()

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.partition_by).orderBy(*self.order_by)

    def reversed(self) -> WindowSpec:
        return Window.partitionBy(*self.partition_by).orderBy(*[F.col(c).desc() for c in self.order_by])

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.partition_by)


class NotFitted(RuntimeError):
    pass


@dataclass(frozen=True)
class Operator:
    """Base of all specs; subclasses are frozen dataclasses whose fields are the configuration."""

    kind: ClassVar[str] = ""
    op_name: ClassVar[str] = ""
    version: ClassVar[tuple[int, ...]] = (1, 0, 0)

    def __post_init__(self) -> None:
        columns = getattr(self, "input_columns", None)
        if columns is not None:
            object.__setattr__(self, "input_columns", tuple(columns))
            if not columns:
                raise ValueError("input_columns must name a column")
            if len(set(columns)) != len(columns):
                raise ValueError("input_columns has duplicates")
        for f in dataclasses.fields(self):
            self._check(f, getattr(self, f.name))

    @staticmethod
    def _check(f: dataclasses.Field, value: Any) -> None:
        m = f.metadata
        if value is None:
            return
        if "choices" in m and value not in m["choices"]:
            raise ValueError(f"{f.name}: {value!r} is none of {m['choices']}")
        for key, bad in (("ge", lambda v, b: v < b), ("gt", lambda v, b: v <= b), ("le", lambda v, b: v > b), ("lt", lambda v, b: v >= b)):
            if key in m and bad(value, m[key]):
                raise ValueError(f"{f.name}: {value!r} is out of bounds ({key} {m[key]})")

    def require(self, df: DataFrame, columns: typing.Iterable[str]) -> None:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns not found: {missing}; there are {df.columns}")

    def run(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def config(self) -> dict[str, Any]:
        return dataclasses.asdict(self)


def param(default: Any, **limits: Any) -> Any:
    """A configuration field with bounds (ge, gt, le, lt, choices, log, step), which also span its search space."""
    if isinstance(default, list):
        return dataclasses.field(default_factory=lambda: list(default), metadata=limits)
    return dataclasses.field(default=default, metadata=limits)


@dataclass(frozen=True)
class Learnable(Operator):
    """fit(df) returns a fitted model with run(df); running the spec itself is an error."""

    def fit(self, df: DataFrame) -> Fitted:
        raise NotImplementedError

    def run(self, df: DataFrame) -> DataFrame:
        raise NotFitted(f"{self.op_name} has to be fitted before it runs")


@dataclass(frozen=True)
class Fitted:
    """A spec with its state: plain numbers, strings and lists, so that it saves as JSON."""

    spec: Learnable
    state: dict[str, Any]

    def run(self, df: DataFrame) -> DataFrame:
        return self.spec.apply(df, self.state)  # type: ignore[attr-defined]

    def save(self, spark: Any, path: str) -> None:
        row = {"name": self.spec.op_name, "version": list(self.spec.version), "config": self.spec.config(), "state": self.state}
        spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: Any, path: str) -> Fitted:
    row = json.loads(spark.read.text(path, wholetext=True).first()[0])
    spec = create(row["name"], row["config"])
    if tuple(row["version"]) != spec.version:
        warnings.warn(f"{row['name']} was saved by version {row['version']}, this is {spec.version}", stacklevel=2)
    return Fitted(spec, row["state"])


REGISTRY: dict[str, type[Operator]] = {}


def register(name: str, kind: str) -> Callable[[type], type]:
    """Class decorator: the higher version of a name wins, an equal one of another class is an error."""

    def add(cls: type) -> type:
        cls.op_name, cls.kind = name, kind
        old = REGISTRY.get(name)
        if old is not None and old.version == cls.version and old.__qualname__ != cls.__qualname__:
            raise ValueError(f"{name} is registered already, by {old.__qualname__}")
        if old is None or cls.version >= old.version:
            REGISTRY[name] = cls
        else:
            warnings.warn(f"{name}: a lower version than the registered one is left out", stacklevel=2)
        return cls

    return add


def create(name: str, config: dict[str, Any] | None = None) -> Operator:
    """{name, config} to a validated operator; unknown configuration keys are ignored with a warning."""
    if name not in REGISTRY:
        raise KeyError(f"no operator {name!r}; there are {sorted(REGISTRY)}")
    cls = REGISTRY[name]
    known = {f.name for f in dataclasses.fields(cls)}
    extra = set(config or {}) - known
    if extra:
        warnings.warn(f"{name}: unknown settings {sorted(extra)}", stacklevel=2)
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in (config or {}).items() if k in known}
    hints = typing.get_type_hints(cls)
    for k, v in values.items():
        if isinstance(v, dict) and dataclasses.is_dataclass(hints.get(k)):
            values[k] = hints[k](**{a: tuple(b) if isinstance(b, list) else b for a, b in v.items()})
        elif isinstance(v, dict) and isinstance(hints.get(k), types.UnionType):
            inner = next(t for t in typing.get_args(hints[k]) if dataclasses.is_dataclass(t))
            values[k] = inner(**{a: tuple(b) if isinstance(b, list) else b for a, b in v.items()})
    return cls(**values)


def help_text(name: str | None = None, kind: str | None = None) -> str:
    """Markdown: the list of operators, or one operator's settings."""
    if name is None:
        rows = [f"- `{n}` ({c.kind}): {(c.__doc__ or '').strip().splitlines()[0]}" for n, c in sorted(REGISTRY.items()) if kind in (None, c.kind)]
        return "\n".join(rows)
    if name not in REGISTRY:
        raise KeyError(f"no operator {name!r}; there are {sorted(REGISTRY)}")
    cls = REGISTRY[name]
    lines = [f"# {name}", "", (cls.__doc__ or "").strip(), "", f"learnable: {issubclass(cls, Learnable)}", "", "| setting | default | bounds |", "|---|---|---|"]
    for f in dataclasses.fields(cls):
        default = "required" if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING else f.default if f.default is not dataclasses.MISSING else f.default_factory()
        lines.append(f"| {f.name} | {default} | {dict(f.metadata) or ''} |")
    return "\n".join(lines)


def as_double(c: str | Column) -> Column:
    """A numeric input: null counts as NaN, as in numpy."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("double"), F.lit(float("nan")))
