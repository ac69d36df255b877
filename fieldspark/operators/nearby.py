"""Spatio-temporal range joins by grid buckets.

Observations sit in one cell of side ``radius`` each; a location is copied to the ``3**d`` cells
around it and meets observations by an equi-join on the cell.  Exact distances and the remaining
predicates follow.  Each pair is found once, and no side is broadcast or crossed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.functions.columns import OPERATORS
from fieldspark.sources.scratch import dropped, written


@dataclass
class Near:
    """``cols`` one name: col comp reference + val.  Several: Euclidean distance comp val."""

    cols: str | Sequence[str]
    comp: str
    val: float

    @property
    def names(self) -> list[str]:
        return [self.cols] if isinstance(self.cols, str) else list(self.cols)


def _windows(terms: Sequence[Near]) -> dict[str, tuple[float, float]]:
    """Coordinates bounded on both sides: (below, above) around the reference."""
    out: dict[str, list[float | None]] = {}
    for t in terms:
        if len(t.names) > 1:
            if t.comp not in ("<", "<="):
                raise ValueError("a distance is bounded from above")
            for c in t.names:
                out.setdefault(c, [None, None])
                out[c] = [t.val if v is None else min(v, t.val) for v in out[c]]
        else:
            lo, hi = out.setdefault(t.names[0], [None, None])
            if t.comp in (">", ">="):
                lo = -t.val if lo is None else min(lo, -t.val)
            elif t.comp in ("<", "<="):
                hi = t.val if hi is None else min(hi, t.val)
            else:
                lo, hi = -t.val, t.val
            out[t.names[0]] = [lo, hi]
    return {c: (lo, hi) for c, (lo, hi) in out.items() if lo is not None and hi is not None and lo + hi >= 0}


def near_join(locations: DataFrame, rows: DataFrame, terms: Sequence[Near], loc_prefix: str = "e_", keep: Sequence[str] | None = None, loc_keep: Sequence[str] | None = None, same: Sequence[str] = ()) -> DataFrame:
    """Pairs of a location and a row within all terms, and of equal ``same`` columns.

    Columns of the location get ``loc_prefix``.  Only ``keep`` and ``loc_keep`` are carried through
    the shuffle, with the coordinates.  Rows and locations with a NULL coordinate match nothing.
    """
    coords = list(dict.fromkeys(c for t in terms for c in t.names))
    widths = _windows(terms)
    if not widths:
        raise ValueError("no coordinate is bounded on both sides")
    loc_cols = list(dict.fromkeys([*(loc_keep if loc_keep is not None else locations.columns), *coords]))
    row_cols = list(dict.fromkeys([*(keep if keep is not None else rows.columns), *coords]))
    left = locations.select(*[F.col(c).alias(f"{loc_prefix}{c}") for c in loc_cols], *same)
    right = rows.select(*row_cols, *same)
    keys = []
    for k, (c, (below, above)) in enumerate(widths.items()):
        size = max((below + above) / 2, 1e-12)
        right = right.withColumn(f"_k{k}", F.floor(F.col(c) / size).cast("long"))
        e = F.col(f"{loc_prefix}{c}")
        lo, hi = F.floor((e - below) / size).cast("long"), F.floor((e + above) / size).cast("long")
        left = left.where(e.isNotNull()).withColumn(f"_k{k}", F.explode(F.sequence(lo, hi)))
        keys.append(f"_k{k}")
    exact = []
    for t in terms:
        if len(t.names) == 1:
            exact.append(OPERATORS[t.comp](F.col(t.names[0]), F.col(f"{loc_prefix}{t.names[0]}") + t.val))
        else:
            exact.append(OPERATORS[t.comp](distance(t.names, loc_prefix), F.lit(float(t.val))))
    return left.join(right, [*keys, *same]).where(reduce(lambda a, b: a & b, exact)).drop(*keys)


def distance(cols: Sequence[str], loc_prefix: str = "e_") -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.col(f"{loc_prefix}{c}"), 2) for c in cols]))


def prediction_locations(experts: DataFrame, locations: DataFrame, max_dist: float, dist_cols: Sequence[str], coords: Sequence[str], local_select: Sequence[Near] = ()) -> DataFrame:
    """Locations nearer than ``max_dist`` (strictly) to each expert: expert_id and pred_loc_<c>.

    A coordinate that the locations lack is taken from the expert.
    """
    one = dist_cols[0]
    ball = [Near(list(dist_cols), "<", max_dist)] if len(dist_cols) > 1 else [Near(one, "<", max_dist), Near(one, ">", -max_dist)]
    pairs = near_join(experts, locations.distinct(), [*ball, *local_select], keep=[c for c in coords if c in locations.columns], loc_keep=["expert_id", *coords])
    value = lambda c: F.col(c) if c in locations.columns else F.col(f"e_{c}")
    return pairs.select(F.col("e_expert_id").alias("expert_id"), *[value(c).alias(f"pred_loc_{c}") for c in coords])


def shifted_locations(experts: DataFrame, offsets: dict[str, Sequence[float]], coords: Sequence[str]) -> DataFrame:
    """Every expert plus every combination of offsets; a coordinate without offsets stays."""
    out = experts.select("expert_id", *coords)
    for c, vs in offsets.items():
        out = out.withColumn(c, F.explode(F.array(*[F.col(c) + F.lit(float(v)) for v in vs])))
    return out.select("expert_id", *[F.col(c).alias(f"pred_loc_{c}") for c in coords])


def expert_as_location(experts: DataFrame, coords: Sequence[str]) -> DataFrame:
    return experts.select("expert_id", *[F.col(c).alias(f"pred_loc_{c}") for c in coords])


def nearest(points: DataFrame, truth: DataFrame, cols: Sequence[str], id_col: str, truth_id: str, values: Sequence[str], radius: float) -> DataFrame:
    """The nearest truth row of each point, ties to the smaller truth id.

    Places count once on both sides: of truth rows at one place the smallest id can be nearest, and points at one place
    have the same row.  One pass looks within ``radius``, or less where that many rows lie around the points, by cells of
    that size.  Points without a hit go down a tree of cells: at each level they keep the cells that may hold their
    nearest row, by bounds on the distance to the rows in a cell, and at the end meet the rows of these alone.  So lone
    points cost a few cells a level, wherever the rows lie, and every point with whole coordinates finds its truth row.
    Points or truth rows with a missing coordinate take no part; such points come back with NULLs.
    """
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols])
    keep = [truth_id, *values]
    left = written(points.where(whole).select(*cols).distinct(), "nearest-points")
    first = F.min(F.struct(*keep)).alias("_b")
    truth = written(truth.where(whole).groupBy(*cols).agg(first).select(*cols, "_b.*"), "nearest-truth")
    radius = _fitting(left, truth, cols, radius)
    pairs = near_join(left, truth, [Near(list(cols), "<=", radius)], keep=keep)
    best = F.min(F.struct(distance(cols).alias("distance"), *[F.col(c) for c in keep])).alias("_b")
    found = written(pairs.groupBy(*[F.col(f"e_{c}").alias(c) for c in cols]).agg(best).select(*cols, "_b.*"), "nearest")
    rest = written(left.join(found, list(cols), "left_anti"), "nearest-left")
    if not rest.isEmpty():
        found = found.unionByName(nearest_by_cells(rest, truth, cols, keep, radius))
    dropped(rest, left, truth)
    return points.join(found, list(cols), "left").select(*points.columns, "distance", *keep)


#: The first pass meets at most so many truth rows a point, on average.
ROWS_A_POINT = 64
#: Cells at the foot of the tree are cut further while one has more rows, down to this level.
ROWS_A_CELL, LOWEST = 256, -16


def _cells(cols: Sequence[str], size: float) -> list[Column]:
    return [F.floor(F.col(c).cast("double") / size).cast("long").alias(f"_k{i}") for i, c in enumerate(cols)]


def _fitting(points: DataFrame, truth: DataFrame, cols: Sequence[str], radius: float) -> float:
    """``radius``, or a smaller one within whose cells the points meet few enough rows."""
    n, keys = points.count(), [f"_k{i}" for i in range(len(cols))]
    for _ in range(40):
        own = points.groupBy(*_cells(cols, radius)).agg(F.count("*").alias("_n"))
        for k in keys:
            own = own.withColumn(k, F.explode(F.sequence(F.col(k) - 1, F.col(k) + 1)))
        pairs = own.join(truth.groupBy(*_cells(cols, radius)).agg(F.count("*").alias("_m")), keys).agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0
        if pairs <= ROWS_A_POINT * n:
            break
        radius *= max(1 / 8, min(3 / 4, (ROWS_A_POINT * n / pairs) ** (1 / len(cols))))
    return radius


#: Each level's cells are so many times as wide as those of the level below; a power of two keeps cells inside each other.
WIDER = 8


def nearest_by_cells(points: DataFrame, truth: DataFrame, cols: Sequence[str], keep: Sequence[str], size: float) -> DataFrame:
    """The coordinates of each place, distance and ``keep`` of its nearest truth row, by going down levels of cells; written."""
    dims = range(len(cols))
    key = lambda level: _cells(cols, size * float(WIDER) ** level)
    span = truth.agg(*[(F.max(c) - F.min(c)).cast("double").alias(f"s{i}") for i, c in enumerate(cols)]).first()
    if span[0] is None:  # no truth at all
        return written(points.limit(0).select(*cols, F.lit(0.0).alias("distance"), *[F.lit(None).cast(truth.schema[c].dataType).alias(c) for c in keep]), "nearest")
    top = 0
    while size * WIDER**top < max(span):
        top += 1
    foot = 0
    while foot > LOWEST and truth.groupBy(*key(foot)).count().agg(F.max("count")).first()[0] > ROWS_A_CELL:
        foot -= 1

    def cells(level: int) -> DataFrame:
        """The cells that hold a row, with the box around their rows."""
        edges = [f(c).cast("double").alias(f"_{side}{i}") for i, c in enumerate(cols) for f, side in ((F.min, "lo"), (F.max, "hi"))]
        return truth.groupBy(*key(level)).agg(*edges)

    def possible(met: DataFrame) -> DataFrame:
        x = [F.col(c).cast("double") for c in cols]
        total = lambda parts: reduce(lambda a, b: a + b, [p * p for p in parts])
        least = total([F.greatest(F.lit(0.0), F.col(f"_lo{i}") - x[i], x[i] - F.col(f"_hi{i}")) for i in dims])
        most = total([F.greatest(F.abs(x[i] - F.col(f"_lo{i}")), F.abs(x[i] - F.col(f"_hi{i}"))) for i in dims])
        bound = F.min(most).over(Window.partitionBy(*cols))
        return met.withColumn("_far", bound).where(least <= F.col("_far") * (1 + 1e-9)).select(*cols, *[F.col(f"_k{i}").alias(f"_p{i}") for i in dims])

    first = cells(top).collect()  # the box spans at most two cells an axis
    structs = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in r.asDict()]) for r in first])
    held = written(possible(points.withColumn("_c", F.explode(structs)).select(*cols, "_c.*")), "nearest-cells")
    for level in range(top - 1, foot - 1, -1):
        below = cells(level).select("*", *[F.floor(F.col(f"_k{i}") / WIDER).cast("long").alias(f"_p{i}") for i in dims])
        new = written(possible(held.join(below, [f"_p{i}" for i in dims])), "nearest-cells")
        dropped(held)
        held = new
    rows = truth.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(cols)], *keep, *[k.alias(f"_p{i}") for i, k in enumerate(key(foot))])
    met = held.join(rows, [f"_p{i}" for i in dims])
    away = F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(f"_t{i}") - F.col(c), 2) for i, c in enumerate(cols)]))
    best = F.min(F.struct(away.alias("distance"), *[F.col(c) for c in keep])).alias("_b")
    out = written(met.groupBy(*cols).agg(best).select(*cols, "_b.*"), "nearest")
    dropped(held)
    return out


def sample_truth(points: DataFrame, truth: DataFrame, cols: Sequence[str], id_col: str, truth_id: str, value: str, radius: float, noise: float = 0.0, seed: int = 0, demean: bool = True) -> DataFrame:
    """Synthetic observations: nearest truth, minus the mean, plus Gaussian noise."""
    out = nearest(points, truth, cols, id_col, truth_id, [value], radius)
    mean = out.agg(F.avg(value)).first()[0] if demean else 0.0
    return out.withColumns({"mean": F.lit(mean), "obs": F.col(value) - mean + (F.randn(seed) * noise if noise else F.lit(0.0))})


def band_terms(col: str, days: float) -> list[Near]:
    return [Near(col, "<=", days), Near(col, ">=", -days)]


def local_select(experts: DataFrame, obs: DataFrame, terms: Sequence[Near], obs_cols: Sequence[str], coords: Sequence[str]) -> DataFrame:
    """expert_id and the observations of each expert, with the expert's coordinates as e_<c>."""
    out = near_join(experts, obs, terms, keep=[*obs_cols], loc_keep=["expert_id", *coords])
    return out.withColumnRenamed("e_expert_id", "expert_id")


def latest_per(df: DataFrame, by: Sequence[str], order: Sequence[Any], out: str = "_rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) == 1).drop(out)
