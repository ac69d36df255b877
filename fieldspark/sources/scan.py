"""Reading tables: one universal scan, and many flat files at once.

Every reader makes NaN NULL, then adds columns, filters and projects, in that order and lazily, so
Spark prunes columns and pushes filters into the source.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldspark.functions.columns import ColumnSpec, add_columns, nan_to_null, rename_all, repeat_for_values, select_columns
from fieldspark.functions.predicates import select_rows

SUFFIX_FORMAT = {"csv": "csv", "tsv": "csv", "parquet": "parquet", "json": "json", "orc": "orc", "txt": "text"}


def source_format(path: str) -> str:
    """The Spark format of a path, by its suffix; a path without one is a Parquet directory."""
    suffix = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2] if "." in path.rsplit("/", 1)[-1] else "parquet"
    if suffix not in SUFFIX_FORMAT:
        raise ValueError(f"no format known for .{suffix}")
    return SUFFIX_FORMAT[suffix]


def load(
    spark: SparkSession,
    source: str | DataFrame | dict[str, Sequence],
    where: Any = None,
    engine: str | None = None,
    schema: T.StructType | str | None = None,
    source_options: dict[str, Any] | None = None,
    col_funcs: Sequence[ColumnSpec] = (),
    row_select: Any = None,
    col_select: Sequence[str] | None = None,
    add_data_to_col: dict[str, Any] | None = None,
    combine_row_select: str = "AND",
) -> DataFrame:
    """Open, filter by ``where``, then repeat for constants, add columns, filter rows and project."""
    if isinstance(source, DataFrame):
        df = source
    elif isinstance(source, dict):
        names = list(source)
        df = spark.createDataFrame(list(zip(*source.values(), strict=True)), schema or names)
    else:
        options = dict(source_options or {})
        fmt = engine or source_format(source)
        if fmt == "csv":
            options.setdefault("header", True)
            if source.endswith(".tsv"):
                options.setdefault("sep", "\t")
            if schema is None:
                options.setdefault("inferSchema", True)
        reader = spark.read.format(fmt).options(**options)
        df = (reader.schema(schema) if schema is not None else reader).load(source)
    df = select_rows(nan_to_null(df), where)
    if add_data_to_col:
        df = repeat_for_values(df, add_data_to_col)
    return select_columns(select_rows(add_columns(df, col_funcs), row_select, combine_row_select), col_select)


def matching_files(dirs: Sequence[str] | str, regex: str, sub_dirs: Sequence[str] | str | None = None, strict: bool = True, walk: bool = False) -> list[str]:
    """Files whose base name holds a match of ``regex``, on any file system that Spark reads.

    ``sub_dirs`` is joined to every directory; with ``walk`` all directories below count.
    """
    return sorted(path for path, _ in listed_files(dirs, regex, sub_dirs, strict, walk))


def listed_files(dirs: Sequence[str] | str, regex: str, sub_dirs: Sequence[str] | str | None = None, strict: bool = True, walk: bool = False) -> list[tuple[str, str]]:
    """The files of ``matching_files``, each with the name under which a scan knows it (see ``scan_name``)."""
    dirs = [dirs] if isinstance(dirs, str) else list(dirs)
    subs = [None] if sub_dirs is None else [sub_dirs] if isinstance(sub_dirs, str) else list(sub_dirs)
    found: list[tuple[str, str]] = []
    spark = SparkSession.builder.getOrCreate()
    for top in (f"{d.rstrip('/')}/{s}" if s else d.rstrip("/") for d in dirs for s in subs):
        place = spark._jvm.org.apache.hadoop.fs.Path(top)
        fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(place) or not fs.getFileStatus(place).isDirectory():
            if strict:
                raise FileNotFoundError(top)
            warnings.warn(f"no directory {top}", stacklevel=2)
            continue
        root = fs.makeQualified(place).toString().rstrip("/")
        listing = fs.listFiles(place, walk)
        while listing.hasNext():
            path = listing.next().getPath()
            if re.search(regex, path.getName()):
                found.append((top + path.toString().removeprefix(root), re.sub(r"^(\w+):/+", r"\1:/", path.toUri().toString())))
    return found


def scan_name() -> Column:
    """The URI of a row's file, with one slash behind its scheme, however it was written."""
    return F.regexp_replace(F.input_file_name(), r"^(\w+):/+", "$1:/")


def read_files(
    spark: SparkSession,
    paths: Sequence[str],
    schema: T.StructType | str | None = None,
    engine: str | None = None,
    source_options: dict[str, Any] | None = None,
    col_funcs: Sequence[ColumnSpec] = (),
    row_select: Any = None,
    col_select: Sequence[str] | None = None,
    new_column_names: Sequence[str] | None = None,
    file_col: str | None = None,
) -> DataFrame:
    """One scan over all files: add columns, filter, project, rename.

    Column functions may ask for the file name.  A declared schema avoids a pass to infer it.  ``file_col`` adds
    each row's ``scan_name`` as one more column, the last one.
    """
    if not paths:
        raise FileNotFoundError("no file matches")
    options = {"header": True} | dict(source_options or {})
    fmt = engine or source_format(paths[0])
    if fmt == "csv" and schema is None:
        options.setdefault("inferSchema", True)
    reader = spark.read.format(fmt).options(**options)
    df = nan_to_null((reader.schema(schema) if schema is not None else reader).load(list(paths)))
    if file_col:
        df = df.withColumn(file_col, scan_name())
        col_select = [*col_select, file_col] if col_select is not None else None
        new_column_names = [*new_column_names, file_col] if new_column_names is not None else None
    out = select_columns(select_rows(add_columns(df, col_funcs), row_select), col_select)
    if file_col:
        out = out.select(*[c for c in out.columns if c != file_col], file_col)
    return rename_all(out, new_column_names)


def read_from_directories(spark: SparkSession, dirs: Sequence[str] | str, regex: str, sub_dirs: Sequence[str] | str | None = None, strict: bool = True, walk: bool = False, **options: Any) -> DataFrame:
    return read_files(spark, matching_files(dirs, regex, sub_dirs, strict, walk), **options)


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts; a column that a part lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def long_from_arrays(df: DataFrame, key_cols: Sequence[str], array_col: str, value_name: str = "obs", index_prefix: str = "_dim_") -> DataFrame:
    """Two-dimensional arrays to rows (keys, first index, second index, value), NULLs dropped."""
    i, j = f"{index_prefix}0", f"{index_prefix}1"
    rows = df.select(*key_cols, F.posexplode(array_col).alias(i, "_row"))
    return rows.select(*key_cols, i, F.posexplode("_row").alias(j, value_name)).where(F.col(value_name).isNotNull())
