"""Kernel smoothing of dense groups through a tree of cells, within a stated limit of the error.

Coordinates are scaled by the lengths, so the kernel is exp(-d**2 / 2).  The tree's cells halve from level to level; the
largest are as wide as the distance beyond which a weight is negligible, so only neighbouring ones meet.  A pair of
cells, one of points and one of rows, is settled in one of four ways:

* beyond that distance it is left out;
* where the kernel is smooth enough over both, the rows stand as their number, their sum and their first moments about the
  cell's centre, and each point takes the kernel's linear expansion there;
* a pair of few points and rows is summed exactly, row by row;
* any other pair goes on to the next level as pairs of its cells' children.

The expansion is off by at most r**2 / 2 times the largest second derivative, r being half the rows' cell's diagonal.  A pair
is smooth enough where that is at most a share ``error`` / 4 of its least weight, or negligible: a share ``error`` / 4 of
the row's part of one whole weight.  A point that has a value weighs 1 in its own mean, so all weights together are off by
at most ``error`` / 2 of their sum, and the mean by at most ``error`` times the range of the group's values (for an ``error`` up to 1).

The descent works on cells, and its joins are keyed by cells, so one hot group is spread over tasks.  Each level's tables
are deleted when the next has been written.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.operators.glue import _all_pairs, _smooth_pairs
from fieldspark.sources.scratch import dropped, written

#: Pairs of at most so many points and rows are summed one by one.
EXACT_PAIRS = 64
_SUMS = ("n", "sv", "nu", "nv", "svu", "svv")


def _usable(*names: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c)) for c in names])


def _named(df: DataFrame, prefix: str, names: Sequence[str]) -> DataFrame:
    return df.select("g", *[F.col(c).alias(f"{prefix}{c}") for c in names])


def _cells(points: DataFrame, size: float) -> DataFrame:
    """g, cu, cv, m (distinct points), and the sums and first moments of their rows about the cell's centre."""
    cell = points.withColumns({"cu": F.floor(F.col("u") / size).cast("long"), "cv": F.floor(F.col("v") / size).cast("long")})
    du, dv = F.col("u") - (F.col("cu") + 0.5) * size, F.col("v") - (F.col("cv") + 0.5) * size
    sums = {"n": F.col("n"), "sv": F.col("sv"), "nu": F.col("n") * du, "nv": F.col("n") * dv, "svu": F.col("sv") * du, "svv": F.col("sv") * dv}
    return cell.groupBy("g", "cu", "cv").agg(F.count("*").alias("m"), *[F.sum(e).alias(c) for c, e in sums.items()])


def _settled(pairs: DataFrame, size: float, share: float, tiny: float) -> DataFrame:
    """``how`` each pair of cells is settled: far ones are gone, the others expand, exact or split."""
    gap = [F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in ("cu", "cv")]
    near = reduce(lambda p, q: p + q, [F.pow(F.greatest(g - 1, F.lit(0)) * size, 2) for g in gap])
    far = reduce(lambda p, q: p + q, [F.pow((g + 1) * size, 2) for g in gap])
    most, least = F.exp(-0.5 * near), F.exp(-0.5 * far)
    off = size * size / 4 * F.greatest(F.lit(1.0), far - 1) * most
    how = F.when(F.col("a_m") * F.col("b_m") <= EXACT_PAIRS, "exact").when(off <= share * least + tiny, "expand").otherwise("split")
    return pairs.where(most > tiny).withColumn("how", how)


def _expanded(pairs: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """Each point's weight and weighted sum over cells of rows, by the linear expansion about their centres."""
    both = points.join(pairs.where("how = 'expand'"), ["g", "a_cu", "a_cv"])
    zu, zv = F.col("u") - (F.col("b_cu") + 0.5) * size, F.col("v") - (F.col("b_cv") + 0.5) * size
    k = F.exp(-0.5 * (zu * zu + zv * zv))
    total = lambda n, mu, mv: F.sum(k * (F.col(f"b_{n}") + zu * F.col(f"b_{mu}") + zv * F.col(f"b_{mv}")))
    return both.groupBy("g", "px", "py").agg(total("n", "nu", "nv").alias("w"), total("sv", "svu", "svv").alias("wv"))


def _exact(pairs: DataFrame, points: DataFrame, rows: DataFrame) -> DataFrame:
    """Each point's weight and weighted sum over the single rows of cells."""
    both = points.join(pairs.where("how = 'exact'").select("g", "a_cu", "a_cv", "b_cu", "b_cv"), ["g", "a_cu", "a_cv"]).join(rows, ["g", "b_cu", "b_cv"])
    du, dv = F.col("u") - F.col("b_u"), F.col("v") - F.col("b_v")
    k = F.exp(-0.5 * (du * du + dv * dv))
    return both.groupBy("g", "px", "py").agg(F.sum(k * F.col("b_n")).alias("w"), F.sum(k * F.col("b_sv")).alias("wv"))


def _sums(points: DataFrame, reach: float, share: float, tiny: float) -> list[DataFrame]:
    """Written tables of g, px, py, w and wv, one a level, whose sums are those of each point."""
    size, cells = reach, written(_cells(points, reach), "tree-cells")
    names = ["cu", "cv", "m", *_SUMS]
    around = F.array([F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asking = _named(cells, "a_", ["cu", "cv", "m"]).withColumn("to", F.explode(around))
    asking = asking.withColumns({"b_cu": F.col("a_cu") + F.col("to.i"), "b_cv": F.col("a_cv") + F.col("to.j")}).drop("to")
    pairs = written(_settled(asking.join(_named(cells, "b_", names), ["g", "b_cu", "b_cv"]), size, share, tiny), "tree-pairs")
    out = []
    while True:
        placed = points.withColumns({c: F.floor(F.col(x) / size).cast("long") for c, x in (("cu", "u"), ("cv", "v"))})
        asked = placed.select("g", "px", "py", "u", "v", F.col("cu").alias("a_cu"), F.col("cv").alias("a_cv"))
        rows = _named(placed, "b_", ["cu", "cv", "u", "v", "n", "sv"])
        out.append(written(_expanded(pairs, asked, size).unionByName(_exact(pairs, asked, rows)), "tree-sums"))
        split = pairs.where("how = 'split'").select("g", *[F.col(f"{s}_{c}").alias(f"{s}_p{c}") for s in "ab" for c in ("cu", "cv")])
        if split.isEmpty():
            dropped(cells, pairs)
            return out
        size, above = size / 2, (cells, pairs)
        cells = written(_cells(points, size), "tree-cells")
        parent = {f"p{c}": F.shiftright(c, 1) for c in ("cu", "cv")}
        children = cells.withColumns(parent)
        below = split.join(_named(children, "a_", ["cu", "cv", "m", *parent]), ["g", "a_pcu", "a_pcv"]).join(_named(children, "b_", [*names, *parent]), ["g", "b_pcu", "b_pcv"])
        pairs = written(_settled(below.drop(*[f"{s}_{p}" for s in "ab" for p in parent]), size, share, tiny), "tree-pairs")
        dropped(*above)


def tree_smooth(df: DataFrame, value: str, l_x: float, l_y: float, x: str = "x", y: str = "y", by: Sequence[str] = (), error: float = 0.01) -> DataFrame:
    """Each point's kernel-weighted mean over the points of its group, within ``error`` times the range of its values.

    The result has the rows and columns of ``glue.kernel_smooth``; groups are told apart null-safely.  Points without a
    value have no weight of their own, and so no such limit: they meet all rows of their group, exactly.  Points without whole coordinates
    get NULL and count in no mean.
    """
    if not 0 < error <= 1:
        raise ValueError("error must lie above 0 and be at most 1")
    valued = df.where(_usable(value))
    known = valued.where(_usable(x, y))
    group = F.struct(F.lit(0).alias("_0"), *[F.col(c) for c in by])
    points = known.groupBy(group.alias("g"), F.col(x).alias("px"), F.col(y).alias("py")).agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("sv"))
    points = written(points.withColumns({"u": F.col("px") / l_x, "v": F.col("py") / l_y}), "tree-points")
    largest = points.groupBy("g").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 1
    share = error / 4
    tiny = share / largest
    parts = _sums(points, math.sqrt(2 * math.log(1 / tiny)), share, tiny)
    means = reduce(DataFrame.unionByName, parts).groupBy("g", "px", "py").agg((F.sum("wv") / F.sum("w")).alias(value))
    near = written(means.select(*[F.col("g")[c].alias(c) for c in by], F.col("px").alias(x), F.col("py").alias(y), value), "tree-means")
    dropped(*parts, points)
    done = near.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col(x).alias("_gx"), F.col(y).alias("_gy"))
    own = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)], (F.col(x) == F.col("_gx")) & (F.col(y) == F.col("_gy")))
    alone = df.join(done, own, "left_anti").select(*by, x, y)
    whole = alone.where(_usable(x, y))
    rest = alone.where(~_usable(x, y)).distinct().withColumn(value, F.lit(None).cast("double"))
    return near.unionByName(_smooth_pairs(_all_pairs(whole, known, value, x, y, by), value, l_x, l_y, x, y, by)).unionByName(rest)
