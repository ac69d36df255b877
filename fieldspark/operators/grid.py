"""Lattices: generating them, masking locations, and arranging scattered cells on them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspark.functions.columns import ColumnSpec, add_columns, select_columns
from fieldspark.functions.predicates import select_rows
from fieldspark.operators.tracks import minimum_spacing_all
from fieldspark.sources.scan import load


def edges(low: float, high: float, grid_res: float | None = None, step_size: float | None = None, num_step: int | None = None) -> tuple[float, float, int]:
    """(first edge, spacing, number of edges); grid_res comes before step_size, and that before num_step."""
    if grid_res is not None:
        n = int((high - low) / grid_res) + 1
        return low, (high - low) / (n - 1), n
    if step_size is not None:
        n = -int(-(high - low) // step_size) + 1  # a last step may run beyond the end
        return low, step_size, n
    if num_step is not None:
        return low, (high - low) / (num_step - 1), num_step
    raise ValueError("one of grid_res, step_size, num_step is needed")


def grid_2d(spark: SparkSession, x_range: Sequence[float], y_range: Sequence[float], center: bool = True, **spacing: Any) -> DataFrame:
    """Centres (or edges) of the lattice, x fastest: id, x, y."""
    (x0, dx, nx), (y0, dy, ny) = edges(*x_range, **spacing), edges(*y_range, **spacing)
    if center:
        x0, y0, nx, ny = x0 + dx / 2, y0 + dy / 2, nx - 1, ny - 1
    ids = spark.range(nx * ny)
    return ids.select("id", (x0 + (F.col("id") % nx) * dx).alias("x"), (y0 + F.floor(F.col("id") / nx) * dy).alias("y"))


def thin_lattice(df: DataFrame, index_cols: Sequence[str], every: int, offset: int = 0) -> DataFrame:
    """Every ``every``-th index in all dimensions."""
    for c in index_cols:
        df = df.where(F.col(c) % every == offset)
    return df


def had_observation(df: DataFrame, coords: Sequence[str], obs_col: str) -> DataFrame:
    """Locations that ever had an observation."""
    return df.groupBy(*coords).agg(F.max(F.col(obs_col).isNotNull()).alias("_any")).where("_any").drop("_any")


def masked(df: DataFrame, masks: Sequence[DataFrame], coords: Sequence[str]) -> DataFrame:
    """Rows whose coordinates all masks hold."""
    for m in masks:
        df = df.join(m.select(*coords).distinct(), list(coords), "left_semi")
    return df


def expert_locations(
    spark: SparkSession,
    loc_dims: dict[str, Sequence[Any] | tuple[DataFrame, str]],
    masks: Sequence[tuple[DataFrame, Sequence[str]]] = (),
    col_funcs: Sequence[ColumnSpec] = (),
    row_select: Any = None,
    keep_cols: Sequence[str] | None = None,
    sort_by: Sequence[str] = (),
) -> DataFrame:
    """Product of coordinate lists (values, or the distinct values of a column), then masks,
    derived columns, selection and projection; ``expert_id`` follows from the coordinates."""
    out = None
    for name, values in loc_dims.items():
        if isinstance(values, tuple) and len(values) == 2 and isinstance(values[0], DataFrame):
            side = values[0].select(F.col(values[1]).alias(name)).where(F.col(name).isNotNull()).distinct()
        else:
            side = spark.createDataFrame([(v,) for v in values], [name])
        out = side if out is None else out.crossJoin(side)  # the product is what is asked for
    for mask, coords in masks:
        out = masked(out, [mask], coords)
    out = select_rows(add_columns(out, col_funcs), row_select)
    out = out.withColumn("expert_id", F.xxhash64(*loc_dims))
    if keep_cols is not None:
        out = select_columns(out, ["expert_id", *keep_cols])
    return out.orderBy(*sort_by) if sort_by else out


def given_locations(spark: SparkSession, source: str | DataFrame | dict[str, Sequence], coords: Sequence[str], masks: Sequence[tuple[DataFrame, Sequence[str]]] = (), **options: Any) -> DataFrame:
    """Expert locations from a table, a file or a dict of columns, in one call: distinct coordinates and their ``expert_id``.

    ``options`` are those of ``sources.scan.load``; rows without one of the coordinates are left out.
    """
    out = load(spark, source, **options).dropna("any", subset=list(coords)).dropDuplicates(list(coords))
    for mask, cols in masks:
        out = masked(out, [mask], cols)
    return out.withColumn("expert_id", F.xxhash64(*coords))


def lattice_values(df: DataFrame, x_col: str, y_col: str, val_col: str, decimals: int = 1, fill: Any = None) -> DataFrame:
    """Scattered cells on a regular lattice, empty ones filled: ix, iy, x, y, value.

    The step of each axis is its least spacing after rounding; a cell given twice is an error.
    """
    missing = [c for c in (x_col, y_col, val_col) if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    rows = df.select(F.round(x_col, decimals).alias("x"), F.round(y_col, decimals).alias("y"), F.col(val_col).alias("v"))
    if rows.groupBy("x", "y").count().where("count > 1").limit(1).count():
        raise ValueError("a location occurs twice")
    dims = {}
    for c in ("x", "y"):
        r = rows.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
        step = minimum_spacing_all(rows.select(c).distinct(), c).first()["spacing"]
        dims[c] = (r["lo"], step or 1.0, int(round((r["hi"] - r["lo"]) / (step or 1.0))) + 1)
    (x0, dx, nx), (y0, dy, ny) = dims["x"], dims["y"]
    cells = rows.select(F.round((F.col("x") - x0) / dx).cast("int").alias("ix"), F.round((F.col("y") - y0) / dy).cast("int").alias("iy"), "v")
    ids = df.sparkSession.range(nx * ny).select((F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy"))
    full = ids.join(cells, ["ix", "iy"], "left")
    value = F.col("v") if fill is None else F.coalesce("v", F.lit(fill))
    return full.select("ix", "iy", (x0 + F.col("ix") * dx).alias("x"), (y0 + F.col("iy") * dy).alias("y"), value.alias(val_col))


def lattice_rows(lattice: DataFrame, val_col: str) -> DataFrame:
    """One array per lattice row, from the lowest y up."""
    item = F.array_sort(F.collect_list(F.struct("ix", val_col)))
    return lattice.groupBy("iy").agg(F.transform(item, lambda s: s[val_col]).alias(val_col))


def value_at_nearest_cell(points: DataFrame, raster: DataFrame, x_col: str, y_col: str, val_col: str, res: float, out: str) -> DataFrame:
    """Value of the raster cell that holds each point: an equi-join on the cell's index."""
    cell = lambda c: F.round(F.col(c) / res).cast("long")
    side = raster.select(cell(x_col).alias("_cx"), cell(y_col).alias("_cy"), F.col(val_col).alias(out))
    return points.withColumns({"_cx": cell(x_col), "_cy": cell(y_col)}).join(side, ["_cx", "_cy"], "left").drop("_cx", "_cy")


def running_number(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "n") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
