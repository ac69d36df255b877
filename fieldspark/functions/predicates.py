"""Row selection from declarative predicates.

A predicate is a dict with ``col``, ``comp`` and ``val`` (a list with ``==`` means membership), or a
dict with a ``func`` of ColumnSpec form that gives a boolean.  ``negate`` flips it; rows where it is
unknown count as false before the flip, so a negated predicate keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.columns import OPERATORS, ColumnSpec, column, select_columns

COMPARISONS = (">=", ">", "==", "<", "<=", "!=")


def literal(df: DataFrame, name: str, value: Any) -> Column:
    """A constant of the column's type, so that text compares with dates and times as such."""
    kind = df.schema[name].dataType
    return F.lit(value).cast(kind) if isinstance(value, str) and isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.lit(value)


def predicate(df: DataFrame, rule: dict[str, Any]) -> Column:
    if "func" in rule:
        keys = {k: v for k, v in rule.items() if k in ("func", "cols", "args", "col_kwargs", "kwargs", "filename_as_arg")}
        cond = ColumnSpec("_cond", **keys).value(df)
        if df.select(cond.alias("c")).schema["c"].dataType != T.BooleanType():
            raise TypeError(f"{rule['func']!r} does not give a boolean")
    else:
        name, comp, value = rule["col"], rule["comp"], rule["val"]
        if comp not in COMPARISONS:
            raise ValueError(f"comparison {comp!r} is not one of {COMPARISONS}")
        if isinstance(value, (list, tuple, set)):
            if comp != "==":
                raise ValueError("a list of values goes with == only")
            cond = column(df, name).isin([literal(df, name, v) for v in value])
        else:
            cond = OPERATORS[comp](column(df, name), literal(df, name, value))
    return ~F.coalesce(cond, F.lit(False)) if rule.get("negate") else cond


def combined(df: DataFrame, rules: Sequence[dict[str, Any]] | dict[str, Any] | None, combine: str = "AND") -> Column | None:
    """All rules joined by AND or OR; None for no rule (keep all)."""
    rules = [rules] if isinstance(rules, dict) else list(rules or [])
    if combine not in ("AND", "OR"):
        raise ValueError(f"combine must be AND or OR, not {combine!r}")
    conds = [predicate(df, r) for r in rules]
    return reduce((lambda a, b: a & b) if combine == "AND" else (lambda a, b: a | b), conds) if conds else None


def select_rows(df: DataFrame, where: Sequence[dict[str, Any]] | dict[str, Any] | None = None, combine: str = "AND", columns: Sequence[str] | None = None) -> DataFrame:
    cond = combined(df, where, combine)
    return select_columns(df if cond is None else df.where(cond), columns)


def interval_rules(col: str, values: Sequence[Any]) -> list[list[dict[str, Any]]]:
    """Half-open intervals between consecutive values, as pairs of predicates."""
    return [[{"col": col, "comp": ">=", "val": a}, {"col": col, "comp": "<", "val": b}] for a, b in zip(values[:-1], values[1:], strict=True)]


def global_select(static_or_dynamic: Sequence[dict[str, Any]], local_select: Sequence[dict[str, Any]] = (), reference: dict[str, Any] | None = None) -> list[dict[str, Any]]:
    """Predicates on the whole source for one expert location.

    Static entries pass through.  A dynamic entry {loc_col, src_col, func} becomes one predicate for
    each local entry on ``loc_col``: src_col comp func(reference[loc_col], val).
    """
    out: list[dict[str, Any]] = []
    for rule in static_or_dynamic:
        if {"col", "comp", "val"} <= set(rule):
            out.append({k: rule[k] for k in ("col", "comp", "val")})
            continue
        if not {"loc_col", "src_col", "func"} <= set(rule):
            raise ValueError(f"neither static nor dynamic: {sorted(rule)}")
        if reference is None or rule["loc_col"] not in reference:
            raise ValueError(f"no reference value of {rule['loc_col']!r}")
        own = [ls for ls in local_select if ls["col"] == rule["loc_col"]]
        if not own:
            raise ValueError(f"no local selection on {rule['loc_col']!r}")
        func: Callable = rule["func"]
        out += [{"col": rule["src_col"], "comp": ls["comp"], "val": func(reference[rule["loc_col"]], ls["val"])} for ls in own]
    return out


def run_bounds(locations: DataFrame, windows: dict[str, tuple[float, float]]) -> list[dict[str, Any]]:
    """Bounds that hold for every location: one small aggregate, then literal filters on the scan.

    ``windows`` gives (below, above) around each coordinate.
    """
    aggs = [f(c).alias(f"{n}_{c}") for c in windows for n, f in (("lo", F.min), ("hi", F.max))]
    row = locations.agg(*aggs).first()
    return [
        {"col": c, "comp": comp, "val": row[f"{n}_{c}"] + shift}
        for c, (below, above) in windows.items()
        for n, comp, shift in (("lo", ">=", -below), ("hi", "<=", above))
        if row[f"{n}_{c}"] is not None
    ]
