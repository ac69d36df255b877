"""Binning of points to regular grids, by group, as one grouped aggregation.

Edges are spread evenly from the range's low to its high end, ``int((high - low) / res) + 1`` of
them, so the true bin width is ``(high - low) / (edges - 1)``.  Bins are half-open, the last is
closed; points outside the range are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fieldspark.functions.columns import ColumnSpec, add_columns
from fieldspark.functions.predicates import select_rows
from fieldspark.operators.stats import statistics, steady_mean
from fieldspark.sources.store import Store

DEFAULT_RANGE = (-4_500_000.0, 4_500_000.0)
STATISTICS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "median": F.median, "count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop,
}


@dataclass
class Axis:
    low: float
    high: float
    res: float

    @property
    def n(self) -> int:
        """Bins of the axis."""
        return int((self.high - self.low) / self.res)

    @property
    def width(self) -> float:
        return (self.high - self.low) / self.n

    def check(self) -> Axis:
        if self.res is None or self.res <= 0:
            raise ValueError("a positive grid_res is needed")
        if not self.low < self.high or self.n < 1:
            raise ValueError(f"no bins between {self.low} and {self.high}")
        return self

    def index(self, c: Column) -> Column:
        """Bin of a value, NULL outside."""
        at = F.least(F.floor((c - self.low) / self.width), F.lit(self.n - 1))
        return F.when((c >= self.low) & (c <= self.high), at.cast("int"))

    def centre(self, index: Column) -> Column:
        return self.low + (index + 0.5) * self.width


def _statistic(name: Any, value: Column, position: int, doubles: bool) -> tuple[str, Column]:
    if isinstance(name, str):
        if name not in STATISTICS:
            raise ValueError(f"unknown statistic {name!r}")
        return name, steady_mean(value) if doubles and name == "mean" else STATISTICS[name](value)
    return getattr(name, "__name__", None) or str(position), name(value)


def bin_by(
    df: DataFrame,
    val_col: str,
    by: Sequence[str] = (),
    x_col: str = "x",
    y_col: str | None = "y",
    grid_res: float | None = None,
    x_range: Sequence[float] = DEFAULT_RANGE,
    y_range: Sequence[float] = DEFAULT_RANGE,
    statistic: Any = "mean",
    dense: bool = False,
    limit: int | None = None,
    keep_index: bool = False,
) -> DataFrame:
    """The statistic(s) of ``val_col`` per group and bin, at bin centres.

    One statistic keeps the value's name; a list gives ``<value>_<statistic>``.  ``y_col=None`` bins
    along x alone.  ``dense`` adds the empty bins of every group that occurs: count and sum are 0
    there, others NULL.  ``limit`` refuses that many groups or more.
    """
    missing = [c for c in (val_col, x_col, *([y_col] if y_col else []), *by) if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    axes = [("ix", x_col, Axis(*x_range, grid_res).check())]
    if y_col:
        axes.append(("iy", y_col, Axis(*y_range, grid_res).check()))
    if limit is not None and by and df.select(*by).distinct().limit(limit).count() >= limit:
        raise ValueError(f"{limit} combinations of {list(by)} or more")
    indexed = df.select(*by, F.col(val_col).alias("_v"), *[axis.index(F.col(c)).alias(i) for i, c, axis in axes])
    for i, _, _ in axes:
        indexed = indexed.where(F.col(i).isNotNull())
    names = list(statistic) if isinstance(statistic, (list, tuple)) else [statistic]
    doubles = isinstance(df.schema[val_col].dataType, DoubleType)
    stats = [_statistic(s, F.col("_v"), k, doubles) for k, s in enumerate(names)]
    single = not isinstance(statistic, (list, tuple))
    outs = {(val_col if single else f"{val_col}_{n}"): (n, c) for n, c in stats}
    keys = [*by, *[i for i, _, _ in axes]]
    cells = indexed.where(F.col("_v").isNotNull()).groupBy(*keys).agg(*[c.alias(o) for o, (_, c) in outs.items()])
    if dense:
        lattice = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
        for i, _, axis in axes:
            lattice = lattice.withColumn(i, F.explode(F.sequence(F.lit(0), F.lit(axis.n - 1))))
        cells = lattice.join(cells, keys, "left").withColumns({o: F.coalesce(F.col(o), F.lit(0)) for o, (n, _) in outs.items() if n in ("count", "sum")})
    centres = [axis.centre(F.col(i)).alias(c) for i, c, axis in axes]
    return cells.select(*by, *([i for i, _, _ in axes] if keep_index else []), *centres, *outs)


@dataclass
class BinConfig:
    """A binning run: trimming, statistics of the trimmed values, bins, derived columns."""

    val_col: str
    grid_res: float
    by: Sequence[str] = ()
    x_col: str = "x"
    y_col: str | None = "y"
    x_range: Sequence[float] = DEFAULT_RANGE
    y_range: Sequence[float] = DEFAULT_RANGE
    statistic: Any = "mean"
    row_select: Any = None
    load_by: Sequence[str] = ()
    col_funcs: Sequence[ColumnSpec] = ()
    add_output_cols: Sequence[ColumnSpec] = field(default_factory=list)


def run_binning(df: DataFrame, c: BinConfig) -> tuple[DataFrame, DataFrame]:
    """(bins, statistics per batch): one job each, whatever the number of batches."""
    rows = select_rows(add_columns(df, c.col_funcs), c.row_select)
    bins = bin_by(rows, c.val_col, [*dict.fromkeys([*c.load_by, *c.by])], c.x_col, c.y_col, c.grid_res, c.x_range, c.y_range, c.statistic)
    bins = add_columns(bins.na.drop("any"), c.add_output_cols)
    return bins, statistics(rows, c.val_col, c.load_by)


def store_binning(store: Store, df: DataFrame, c: BinConfig, table: str = "data", raw_config: Any = None) -> None:
    """Run a binning and keep its bins as ``table`` and its statistics as ``<table>_statistics``, with two attributes:
    ``config``, that of the bins, and ``raw_data_config``, that of what was binned."""
    bins, stats = run_binning(df, c)
    store.write(bins, table, config=c, run_info=True)
    store.write(stats, f"{table}_statistics", config=c)
    for t in (table, f"{table}_statistics"):
        store.add_attribute(t, "raw_data_config", raw_config)


def bin_days(df: DataFrame, val_col: str, date_col: str, grid_res_km: float = 50.0, x_col: str = "x", y_col: str = "y", all_dates: bool = True, **options: Any) -> DataFrame:
    """Daily grids; with ``all_dates`` gap days in the data's range appear with NULL values."""
    bins = bin_by(df, val_col, [date_col], x_col, y_col, grid_res_km * 1000, dense=all_dates, **options)
    if not all_dates:
        return bins
    days = df.agg(F.min(date_col).alias("a"), F.max(date_col).alias("b")).select(F.explode(F.sequence("a", "b")).alias(date_col))
    cells = bins.select(x_col, y_col).distinct()
    full = days.crossJoin(cells)  # the requested output itself: every day times every cell
    return full.join(bins, [date_col, x_col, y_col], "left")
