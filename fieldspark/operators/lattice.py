"""Values on regular lattices: Gaussian smoothing with holes, and interpolation between four cells."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.sources.scratch import written


def filled_lattice(df: DataFrame, values: Sequence[str], by: Sequence[str] = (), ix: str = "ix", iy: str = "iy") -> DataFrame:
    """One row for every cell of the box around each group's cells; NULL where there was no row."""
    box = df.groupBy(*by).agg(F.min(ix).alias("_x0"), F.max(ix).alias("_x1"), F.min(iy).alias("_y0"), F.max(iy).alias("_y1")).where(F.col("_x0").isNotNull() & F.col("_y0").isNotNull())
    cells = box.withColumn(iy, F.explode(F.sequence("_y0", "_y1"))).withColumn(ix, F.explode(F.sequence("_x0", "_x1"))).select(*by, ix, iy)
    own = df.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col(ix).alias("_ix"), F.col(iy).alias("_iy"), *values)
    same = (F.col(ix) == F.col("_ix")) & (F.col(iy) == F.col("_iy"))
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return cells.join(own, same, "left").select(*by, ix, iy, *values)


def _pass(weighted: str, total: str, along: str, group: Sequence[str], std: float, radius: int) -> tuple[Column, Column]:
    """Both sums of one pass: over the cells at most ``radius`` away along one axis, weighted by distance."""
    frame = Window.partitionBy(*group).orderBy(along).rangeBetween(-radius, radius)
    near = F.collect_list(F.struct(F.col(along).alias("at"), F.col(weighted).alias("s"), F.col(total).alias("n"))).over(frame)
    here = F.col(along)

    def total_of(part: str) -> Column:
        # a range frame already sorts by place, so sums are taken in one order everywhere
        weight = lambda c: F.exp(-0.5 * F.pow((c["at"] - here) / std, 2))
        return F.aggregate("_near", F.lit(0.0), lambda acc, c: acc + weight(c) * c[part])

    return near.alias("_near"), F.struct(total_of("s").alias("s"), total_of("n").alias("n")).alias("_sums")


def smooth_lattice(df: DataFrame, value: str, std: float, by: Sequence[str] = (), ix: str = "ix", iy: str = "iy", radius: int | None = None, keep_holes: bool = True) -> DataFrame:
    """Gaussian convolution of each group's lattice, in cells: a pass along ix, then one along iy.

    The kernel is a product, so two passes of (2 radius + 1) terms do for one of (2 radius + 1) squared.  Cells
    without a value (NULL, NaN or no row, and all beyond the lattice) count for nothing: the weights of the
    others are normalised to one.  ``radius`` is 4 std, rounded, by default; it is also the memory of a row.  ``keep_holes``
    gives NULL again where there was no value, else holes are filled from around.
    """
    radius = max(1, math.ceil(4 * std - 0.5)) if radius is None else radius
    v = F.col(value).cast("double")
    known = v.isNotNull() & ~F.isnan(v)
    cells = filled_lattice(df, [value], by, ix, iy)
    rows = cells.select(*by, ix, iy, known.alias("_known"), F.when(known, v).otherwise(0.0).alias("s"), F.when(known, 1.0).otherwise(0.0).alias("n"))
    for along, across in ((ix, iy), (iy, ix)):
        near, sums = _pass("s", "n", along, [*by, across], std, radius)
        rows = rows.withColumn("_near", near).select(*by, ix, iy, "_known", sums).select(*by, ix, iy, "_known", "_sums.s", "_sums.n")
    shown = (F.col("n") > 0) & F.col("_known") if keep_holes else F.col("n") > 0
    return rows.select(*by, ix, iy, F.when(shown, F.col("s") / F.col("n")).alias(value))


def bilinear_value(points: DataFrame, raster: DataFrame, x_col: str, y_col: str, val_col: str, res: float | Sequence[float], out: str, origin: Sequence[float] = (0.0, 0.0)) -> DataFrame:
    """Each point's value between the four raster cells around it, weighted by nearness on both axes.

    Cell centres lie at ``origin`` plus whole steps of ``res`` (one for both axes, or two).  Corners that are missing, NULL or
    NaN are left out and the other weights normalised; with none left, or a point without whole coordinates,
    the value is NULL.  Points keep their rows and columns.  Of several raster rows in one cell the mean counts.

    Each square between cells holds its four corners in one row, so a point meets one row by an equi-join on its square.  A small raster
    goes to the points, which then stay where they are.
    """
    steps = [float(r) for r in (res if isinstance(res, Sequence) else (res, res))]
    place = lambda c, k: (F.col(c).cast("double") - origin[k]) / steps[k]
    r = F.col(val_col).cast("double")
    cells = raster.where(r.isNotNull() & ~F.isnan(r)).groupBy(F.round(place(x_col, 0)).cast("long").alias("_cx"), F.round(place(y_col, 1)).cast("long").alias("_cy")).agg(F.avg(r).alias("_v"))
    corners = [(i, j) for i in (0, 1) for j in (0, 1)]
    at = lambda i, j: F.struct((F.col("_cx") - i).alias("_cx"), (F.col("_cy") - j).alias("_cy"), F.lit(2 * i + j).alias("_k"))
    squares = cells.select(F.explode(F.array(*[at(i, j) for i, j in corners])).alias("c"), "_v").groupBy("c._cx", "c._cy")
    # its size, once written, tells whether it can be sent to the points
    squares = written(squares.agg(*[F.max(F.when(F.col("c._k") == 2 * i + j, F.col("_v"))).alias(f"_v{i}{j}") for i, j in corners]), "raster-squares")
    u, w = place(x_col, 0), place(y_col, 1)
    # NaN compares above all numbers
    whole = lambda c: F.when(F.abs(c) < float(1 << 62), F.floor(c).cast("long"))
    near = points.withColumns({"_cx": whole(u), "_cy": whole(w)}).join(squares, ["_cx", "_cy"], "left")
    fx, fy = u - F.floor(u), w - F.floor(w)
    share = {(i, j): (fx if i else 1 - fx) * (fy if j else 1 - fy) for i, j in corners}
    used = {k: F.col(f"_v{k[0]}{k[1]}").isNotNull() & (share[k] > 0) for k in corners}
    total, part = (reduce(lambda a, b: a + b, [F.when(used[k], x[k]).otherwise(0.0) for k in corners]) for x in ({k: share[k] * F.col(f"_v{k[0]}{k[1]}") for k in corners}, share))
    return near.select(*[F.col(f"`{c}`") for c in points.columns], F.when(part > 0, total / part).alias(out))
