"""Blending overlapping predictions and smoothing parameters: weighted means by location.

NULL values are left out of both sums; where all weights vanish the result is NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.functions.mathfun import gaussian
from fieldspark.operators.nearby import Near, near_join
from fieldspark.operators.tracks import minimum_spacing_all

PREDICTIONS = ("f_star", "f_var", "y_var")


def weighted_mean(value: str, weight: Column) -> Column:
    w = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value)), weight)
    total = F.sum(w)
    return F.when(total > 0, F.sum(w * F.col(value)) / total)


def glue(preds: DataFrame, pairs: Sequence[tuple[str, str]], scale: Column | float, values: Sequence[str] = PREDICTIONS, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of predictions at each location, apart for each value of ``by``.

    ``pairs`` are (location column, expert column); the weight is a product of normal densities of
    their differences with the given scale.
    """
    weight = reduce(lambda a, b: a * b, [gaussian(F.col(p), F.col(e), scale) for p, e in pairs])
    weighted = preds.withColumn("_w", weight)
    return weighted.groupBy(*by, *[p for p, _ in pairs]).agg(*[weighted_mean(v, F.col("_w")).alias(v) for v in values])


def glue_local_predictions(preds: DataFrame, inference_radius: float, r: float = 3.0, x: str = "x", y: str = "y", values: Sequence[str] = PREDICTIONS) -> DataFrame:
    return glue(preds, [(f"pred_loc_{x}", x), (f"pred_loc_{y}", y)], inference_radius / r, values)


def glue_1d(preds: DataFrame, radius: float | DataFrame, r: float = 3.0, pred_loc: str = "pred_loc_x", expert_loc: str = "x", values: Sequence[str] = PREDICTIONS) -> DataFrame:
    """One pair of columns; the radius is a number or a table (expert column, radius), one row per expert."""
    if isinstance(radius, DataFrame):
        if radius.count() != preds.select(expert_loc).distinct().count():
            raise ValueError("one radius per expert is needed")
        preds, scale = preds.join(radius, expert_loc), F.col("radius") / r
    else:
        scale = radius / r
    return glue(preds, [(pred_loc, expert_loc)], scale, values)


def glue_by_spacing(preds: DataFrame, sigma_factor: float, x: str = "x", y: str = "y", values: Sequence[str] = ("f_star",)) -> DataFrame:
    """Scales from the spacing of the experts along each axis."""
    scales = {c: (minimum_spacing_all(preds.select(c).distinct(), c).first()["spacing"] or 1.0) / sigma_factor for c in (x, y)}
    weight = gaussian(F.col(f"pred_loc_{x}"), F.col(x), scales[x]) * gaussian(F.col(f"pred_loc_{y}"), F.col(y), scales[y])
    return preds.withColumn("_w", weight).groupBy(f"pred_loc_{x}", f"pred_loc_{y}").agg(*[weighted_mean(v, F.col("_w")).alias(v) for v in values])


def weighted_values(df: DataFrame, ref_col: str, dist_to_col: str, val_cols: Sequence[str], lengthscale: float | None = None, weight_function: str = "gaussian") -> DataFrame:
    """Mean by ``ref_col``, weighted by exp(-d**2 / 2 l**2) of the difference of the two columns."""
    if weight_function != "gaussian":
        raise ValueError(f"unknown weight function {weight_function!r}")
    if lengthscale is None:
        raise ValueError("the gaussian weight needs a lengthscale")
    w = F.exp(-0.5 * F.pow((F.col(ref_col) - F.col(dist_to_col)) / lengthscale, 2))
    return df.withColumn("_w", w).groupBy(ref_col).agg(F.sum("_w").alias("weight"), *[weighted_mean(v, F.col("_w")).alias(v) for v in val_cols])


def mean_by_location(preds: DataFrame, coords: Sequence[str], values: Sequence[str]) -> DataFrame:
    return preds.groupBy(*coords).agg(*[F.avg(v).alias(v) for v in values])


@dataclass
class SmoothingConfig:
    l_x: float = 1.0
    l_y: float = 1.0
    max: float | None = None
    min: float | None = None


def kernel_smooth(df: DataFrame, value: str, l_x: float, l_y: float, x: str = "x", y: str = "y", by: Sequence[str] = (), cutoff: float | None = None, error: float | None = None) -> DataFrame:
    """Each point's kernel-weighted mean over the points of its group; groups are told apart null-safely.

    By default all pairs of a group count, which is exact and quadratic in the group.  A group's rows are dealt over
    all tasks, and its points meet each share; so one large group is as much parallel work as many small ones.  A ``cutoff``
    leaves out points farther than so many scaled lengths (a bucket join).  ``error`` chooses the cutoff: a point with
    a value weighs 1 in its own mean, so leaving out weights of at most ``error`` in all moves the mean by
    at most 2 ``error`` times the range of the group's values.  Points without a value have no such weight of
    their own and meet all points.  Points without whole coordinates have no mean: NULL, or no row with a cutoff.
    """
    if error is not None:
        own = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], F.lit(True))
        known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
        largest = known.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
        near = kernel_smooth(known, value, l_x, l_y, x, y, by, math.sqrt(2 * math.log(max(2.0, largest / error))))
        done = known.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col(x).alias("_gx"), F.col(y).alias("_gy")).distinct()
        alone = df.join(done, own & (F.col(x) == F.col("_gx")) & (F.col(y) == F.col("_gy")), "left_anti").select(*by, x, y)
        return near.unionByName(_smooth_pairs(_all_pairs(alone, known, value, x, y, by), value, l_x, l_y, x, y, by))
    a = df.select(*by, F.col(x).alias(f"e_{x}"), F.col(y).alias(f"e_{y}")).distinct()
    b = df.select(*by, x, y, value).where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    if cutoff is None:
        pairs = _all_pairs(df, b, value, x, y, by)
    else:
        group = {f"g_{c}": F.col(c) for c in by}
        # groups are kept apart by their own column; cells are one cutoff wide in scaled units
        left = a.select(*[v.alias(k) for k, v in group.items()], (F.col(f"e_{x}") / l_x).alias("_u"), (F.col(f"e_{y}") / l_y).alias("_v"), f"e_{x}", f"e_{y}")
        right = b.withColumns({"_u": F.col(x) / l_x, "_v": F.col(y) / l_y})
        pairs = near_join(left, right, [Near(["_u", "_v"], "<=", cutoff)], loc_prefix="l_", keep=[*by, x, y, value], loc_keep=[*group, f"e_{x}", f"e_{y}"])
        pairs = pairs.withColumnsRenamed({f"l_e_{x}": f"e_{x}", f"l_e_{y}": f"e_{y}"})
        for c in by:
            pairs = pairs.where(F.col(f"l_g_{c}").eqNullSafe(F.col(c)))
    return _smooth_pairs(pairs, value, l_x, l_y, x, y, by)


def _all_pairs(points: DataFrame, rows: DataFrame, value: str, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Every point (as e_x, e_y) with every row of its group, dealt by shares of the rows."""
    shares = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = points.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col(x).alias(f"e_{x}"), F.col(y).alias(f"e_{y}")).distinct()
    a = a.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    b = rows.select(*by, x, y, value, F.pmod(F.xxhash64(x, y, value), F.lit(shares)).cast("int").alias("_of"))
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], F.col("_share") == F.col("_of"))
    return a.join(b, same)


def _smooth_pairs(pairs: DataFrame, value: str, l_x: float, l_y: float, x: str, y: str, by: Sequence[str]) -> DataFrame:
    sx, sy = (F.col(x) - F.col(f"e_{x}")) / l_x, (F.col(y) - F.col(f"e_{y}")) / l_y
    weighted = pairs.withColumn("_w", F.exp(-0.5 * (sx * sx + sy * sy)))
    out = weighted.groupBy(*by, f"e_{x}", f"e_{y}").agg(weighted_mean(value, F.col("_w")).alias(value))
    return out.withColumnsRenamed({f"e_{x}": x, f"e_{y}": y})


def smooth_parameters(params: DataFrame, config: dict[str, SmoothingConfig], coords: Sequence[str], xy: tuple[str, str] = ("x", "y"), cutoff: float | None = None, error: float | None = None) -> DataFrame:
    """Long parameter table (coords, param, dim, value): chosen parameters clamped and smoothed over
    xy within equal other coordinates and dimensions; the others stay as they are."""
    by = [c for c in coords if c not in xy]
    names = [*coords, "param", "dim", "value"]
    out = params.where(~F.col("param").isin(list(config))).select(*names)
    for name, c in config.items():
        v = F.col("value")
        v = v if c.max is None else F.least(v, F.lit(float(c.max)))
        v = v if c.min is None else F.greatest(v, F.lit(float(c.min)))
        own = params.where(F.col("param") == name).withColumn("value", v)
        smooth = kernel_smooth(own, "value", c.l_x, c.l_y, *xy, by=[*by, "dim"], cutoff=cutoff, error=error).where(F.col("value").isNotNull())
        out = out.unionByName(smooth.withColumn("param", F.lit(name)).select(*names))
    return out


def rerun_config(config: dict, suffix: str) -> dict:
    """The run that predicts with the smoothed parameters: same settings, loaded and not optimised."""
    return {**config, "optimise": False, "load_params": {"table_suffix": suffix}, "table_suffix": suffix}
