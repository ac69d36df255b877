"""Derived columns: declarative specifications turned into Column expressions.

A specification names its outputs and gives either Spark SQL text, an operator sign, or a callable
over Columns (a pandas UDF is one).  Text is parsed by Spark and never evaluated as Python.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS: dict[str, Callable] = {
    ">=": operator.ge, ">": operator.gt, "==": operator.eq, "<": operator.lt, "<=": operator.le, "!=": operator.ne,
    "+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "%": operator.mod,
    "&": operator.and_, "|": operator.or_,
}


def column(df: DataFrame, name: str | int) -> Column:
    """A column by name, or by position if ``name`` is an integer that names no column."""
    if name in df.columns:
        return F.col(f"`{name}`")
    if isinstance(name, int) and 0 <= name < len(df.columns):
        return F.col(f"`{df.columns[name]}`")
    raise KeyError(f"no column {name!r} in {df.columns}")


@dataclass
class ColumnSpec:
    """``outputs``: one name, or several for a struct of as many fields.

    ``func``: SQL text, an operator sign, a callable, or any other value as a constant.  Arguments
    are, in this order: the file name if ``filename_as_arg``, the columns ``cols``, then ``args``.
    On a clash of keyword arguments the plain ones win over the columns.
    """

    outputs: str | Sequence[str]
    func: Any = None
    cols: Sequence[str | int] = ()
    args: Sequence[Any] = ()
    col_kwargs: dict[str, str] = field(default_factory=dict)
    kwargs: dict[str, Any] = field(default_factory=dict)
    filename_as_arg: bool = False
    allowed: Sequence[Any] | None = None

    def value(self, df: DataFrame) -> Column:
        inputs = [column(df, c) for c in self.cols]
        if self.filename_as_arg:
            inputs.insert(0, F.element_at(F.split(F.input_file_name(), "/"), -1))
        if self.allowed is not None and self.func not in self.allowed:
            raise ValueError(f"{self.func!r} is not one of {list(self.allowed)}")
        if isinstance(self.func, str) and self.func in OPERATORS:
            rest = [*inputs, *map(F.lit, self.args)]
            return reduce(OPERATORS[self.func], rest)
        if callable(self.func):
            named = {k: column(df, c) for k, c in self.col_kwargs.items()} | self.kwargs
            out = self.func(*inputs, *self.args, **named)
            return out if isinstance(out, Column) else F.lit(out)
        if isinstance(self.func, str) and self.allowed is None:
            return F.expr(self.func)
        return F.lit(self.func)


def add_columns(df: DataFrame, specs: Sequence[ColumnSpec]) -> DataFrame:
    """Add or replace columns one after another: later specifications see earlier outputs."""
    for spec in specs:
        value = spec.value(df)
        if isinstance(spec.outputs, str):
            df = df.withColumn(spec.outputs, value)
            continue
        names = list(spec.outputs)
        kind = df.select(value.alias("v")).schema["v"].dataType
        fields = getattr(kind, "names", None)
        if fields is None or len(fields) != len(names):
            raise ValueError(f"{names}: the function gives {kind.simpleString()}")
        df = df.withColumn("_spec", value).withColumns({n: F.col(f"_spec.`{f}`") for n, f in zip(names, fields, strict=True)}).drop("_spec")
    return df


def select_columns(df: DataFrame, names: Sequence[str | int] | None) -> DataFrame:
    """Project, after checking that every column is there; None keeps all."""
    return df if names is None else df.select(*[column(df, n) for n in names])


def rename_all(df: DataFrame, names: Sequence[str] | None) -> DataFrame:
    if names is None:
        return df
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def repeat_for_values(df: DataFrame, values: dict[str, Any]) -> DataFrame:
    """Repeat the table once per value of each key; several keys multiply, a scalar is one value."""
    for name, vs in values.items():
        vs = vs if isinstance(vs, (list, tuple)) else [vs]
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in vs])))
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in the data this engine reads: make it NULL at the scan."""
    return df.withColumns({n: F.nanvl(F.col(f"`{n}`"), F.lit(None).cast(t)) for n, t in df.dtypes if t in ("double", "float")})
