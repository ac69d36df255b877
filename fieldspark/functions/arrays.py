"""Arrays and long tables: one row per element with its indices ``_dim_0``, ``_dim_1``, ..."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def n_dims(df: DataFrame, col: str) -> int:
    kind, n = df.schema[col].dataType, 0
    while isinstance(kind, T.ArrayType):
        kind, n = kind.elementType, n + 1
    return n


def array_to_rows(df: DataFrame, col: str, keys: Sequence[str] = (), prefix: str = "_dim_") -> DataFrame:
    """Nested arrays to rows; a scalar is one row with index 0."""
    n = n_dims(df, col)
    out = df.select(*keys, F.col(col).alias("_a"))
    dims = [f"{prefix}{i}" for i in range(max(n, 1))]
    if not n:
        out = out.withColumn(dims[0], F.lit(0))
    for i in range(n):
        out = out.select(*keys, *dims[:i], F.posexplode("_a").alias(dims[i], "_a"))
    return out.select(*keys, *dims, F.col("_a").alias(col))


def rows_to_array(df: DataFrame, val_col: str, idx_cols: Sequence[str], keys: Sequence[str] = (), dropna: bool = False, fill: Any = None, check: bool = True) -> DataFrame:
    """Rows to nested arrays, holes filled.  Indices must be integers from 0 without a gap."""
    missing = [c for c in (val_col, *idx_cols, *keys) if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    bad = [c for c in idx_cols if not isinstance(df.schema[c].dataType, (T.IntegerType, T.LongType, T.ShortType))]
    if bad:
        raise TypeError(f"indices {bad} are not integers")
    df = df.where(F.col(val_col).isNotNull()) if dropna else df
    if check:
        for c in idx_cols:
            r = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count_distinct(c).alias("n")).first()
            if r["lo"] != 0 or r["n"] != r["hi"] + 1:
                raise ValueError(f"{c} does not run from 0 without a gap")
    sizes = df.groupBy(*keys).agg(*[F.max(c).alias(f"_n{i}") for i, c in enumerate(idx_cols)])
    lattice = sizes
    for i, c in enumerate(idx_cols):
        lattice = lattice.withColumn(c, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_n{i}").cast("long"))))
    cells = df.select(*keys, *[F.col(c).cast("long").alias(c) for c in idx_cols], val_col)
    full = lattice.select(*keys, *idx_cols).join(cells, [*keys, *idx_cols], "left")
    if fill is not None:
        full = full.withColumn(val_col, F.coalesce(val_col, F.lit(fill)))
    for i in range(len(idx_cols) - 1, -1, -1):
        item = F.array_sort(F.collect_list(F.struct(idx_cols[i], val_col)))
        full = full.groupBy(*keys, *idx_cols[:i]).agg(F.transform(item, lambda s: s[val_col]).alias(val_col))
    return full


def arrays_to_tables(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), concat: bool = False) -> dict[Any, DataFrame]:
    """Each array as rows; with ``concat`` arrays of the same number of dimensions side by side."""
    tables = {c: array_to_rows(df, c, keys) for c in cols}
    if not concat:
        return tables
    out: dict[Any, DataFrame] = {}
    by_dims = lambda c: max(n_dims(df, c), 1)
    for n, group in itertools.groupby(sorted(cols, key=by_dims), key=by_dims):
        on = [*keys, *[f"_dim_{i}" for i in range(n)]]
        out[n] = reduce(lambda a, b, on=on: a.join(b, on, "full"), [tables[c] for c in group])
    return out


def with_coordinates(df: DataFrame, coords: dict[str, Any]) -> DataFrame:
    """Prefix rows with an expert's coordinates as constant columns."""
    return df.select(*[F.lit(v).alias(k) for k, v in coords.items()], *df.columns)


def sorted_array(df: DataFrame, by: Sequence[str], dim: str, val: str) -> DataFrame:
    """Long rows to one array per group, by ascending index."""
    item = F.array_sort(F.collect_list(F.struct(dim, val)))
    return df.groupBy(*by).agg(F.transform(item, lambda s: s[val]).alias(val))


def expand_by_values(config: dict[str, Any], keys: Sequence[str]) -> Iterator[dict[str, Any]]:
    """One dict per combination of the list-valued entries ``keys``."""
    for values in itertools.product(*[config[k] if isinstance(config[k], (list, tuple)) else [config[k]] for k in keys]):
        yield {**config, **dict(zip(keys, values, strict=True))}


def one_row(df: DataFrame) -> dict[str, Any]:
    """The only row as a dict; any other number of rows is an error."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} rows or more where one is needed")
    return rows[0].asDict()
