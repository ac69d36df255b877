"""A result store: one Parquet directory per table under a root, with metadata and a config registry."""

from __future__ import annotations

import functools
import hashlib
import json
import types
from collections.abc import Sequence
from dataclasses import asdict, fields, is_dataclass
from datetime import datetime, timezone
from typing import Any, get_args, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions.columns import ColumnSpec, add_columns
from fieldspark.functions.predicates import select_rows

META = "_meta"
CONFIGS = "configs"
META_SCHEMA = "table string, attribute string, value string, created_at timestamp"
CONFIG_SCHEMA = "config_id int, config_hash string, config string, created_at timestamp"


def json_text(value: Any) -> str:
    """Canonical JSON of a configuration, the same in every process.

    Dataclasses become dicts, sets sorted lists, functions their name with a hash of what they do (code, defaults and
    captured values), and other objects the name of their class with their attributes.
    """

    def plain(x: Any) -> Any:
        if is_dataclass(x) and not isinstance(x, type):
            return plain(asdict(x))
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (set, frozenset)):
            return sorted((plain(v) for v in x), key=lambda v: json.dumps(v, sort_keys=True))
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        if hasattr(x, "tolist"):
            return x.tolist()
        if isinstance(x, (str, int, float, bool, type(None))):
            return x
        if isinstance(x, functools.partial):
            return {"partial": plain(x.func), "args": plain(x.args), "keywords": plain(x.keywords)}
        if isinstance(x, types.MethodType):
            return {"method": plain(x.__func__), "of": plain(x.__self__)}
        if isinstance(x, types.FunctionType):
            captured = [plain(c.cell_contents) for c in x.__closure__ or ()]
            return {"function": f"{x.__module__}.{x.__qualname__}", "hash": digest([code_text(x.__code__), plain(x.__defaults__), plain(x.__kwdefaults__), captured])}
        if isinstance(x, (type, types.BuiltinFunctionType, types.ModuleType)):
            return f"{getattr(x, '__module__', None) or ''}.{getattr(x, '__qualname__', x.__name__)}"
        if type(x).__repr__ is object.__repr__:
            return {"object": plain(type(x)), "attributes": plain(vars(x)) if hasattr(x, "__dict__") else []}
        return str(x)

    return json.dumps(plain(value), sort_keys=True)


def from_dict(kind: type, values: dict[str, Any]) -> Any:
    """A dataclass from the dict that ``asdict`` or a stored configuration gives; dataclasses inside it as well.

    Names that it does not have are an error; lists of dicts become lists of the dataclass that the field's type names.
    """
    hints, known = get_type_hints(kind), {f.name for f in fields(kind)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"{kind.__name__} has no {unknown}")

    def built(hint: Any, v: Any) -> Any:
        inside = [h for h in (hint, *get_args(hint)) if is_dataclass(h)]
        if inside and isinstance(v, dict):
            return from_dict(inside[0], v)
        if inside and isinstance(v, (list, tuple)):
            return type(v)(built(inside[0], x) for x in v)
        return v

    return kind(**{k: built(hints[k], v) for k, v in values.items()})


def digest(x: Any) -> str:
    return hashlib.sha256(json.dumps(x, sort_keys=True).encode()).hexdigest()[:16]


def code_text(code: types.CodeType) -> list:
    """What a function does, without where it stands in its file."""
    constants = [code_text(c) if isinstance(c, types.CodeType) else sorted(map(repr, c)) if isinstance(c, frozenset) else repr(c) for c in code.co_consts]
    return [code.co_code.hex(), constants, list(code.co_names), list(code.co_varnames)]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, table: str) -> bool:
        return bool(self._fs.exists(self._path(f"{self.root}/{table}")))

    def tables(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory()]
        return sorted(n for n in names if not n.startswith("_"))

    def read(self, table: str, where: Any = None, columns: Sequence[str] | None = None) -> DataFrame:
        return select_rows(self.spark.read.parquet(f"{self.root}/{table}"), where, columns=columns)

    def write(self, df: DataFrame, table: str, append: bool = False, config: Any = None, run_info: bool = False, partition_by: Sequence[str] = (), replace_partitions: bool = False) -> None:
        """Write or append a table; metadata rows are appended, and replaced by an overwrite.

        With ``replace_partitions`` an append takes the place of the partitions that it has rows for.
        """
        writer = df.write.mode("append" if append and not replace_partitions else "overwrite")
        if append and replace_partitions:
            writer = writer.option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{self.root}/{table}")
        rows = [(table, "config", json_text(config))] if config is not None else []
        if run_info:
            rows.append((table, "run_info", json_text(self.run_info(config))))
        self._add_meta(rows, replace=None if append else table)

    def run_info(self, config: Any = None) -> dict[str, Any]:
        sc = self.spark.sparkContext
        return {"time": datetime.now(timezone.utc).isoformat(), "spark": sc.version, "app_id": sc.applicationId, "config_hash": hashlib.sha256(json_text(config).encode()).hexdigest()}

    def add_attribute(self, table: str, name: str, value: Any) -> None:
        self._add_meta([(table, name, json_text(value))], replace=None)

    def _add_meta(self, rows: list[tuple], replace: str | None) -> None:
        at = datetime.now(timezone.utc).replace(tzinfo=None)
        if replace is not None:
            rows = [(replace, "_overwritten", ""), *rows]
        if rows:
            stamped = [(*r, at) for r in rows]
            self.spark.createDataFrame(stamped, META_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/{META}")

    def attribute(self, table: str, name: str) -> list[Any]:
        """Values of an attribute since the table was last overwritten, oldest first."""
        if not self.exists(META):
            return []
        meta = self.spark.read.parquet(f"{self.root}/{META}").where(F.col("table") == table)
        since = meta.where("attribute = '_overwritten'").agg(F.max("created_at")).first()[0]
        meta = meta.where(F.col("attribute") == name)
        meta = meta if since is None else meta.where(F.col("created_at") >= F.lit(since))
        return [json.loads(r["value"]) for r in meta.orderBy("created_at").collect()]

    def config_id(self, config: Any) -> int:
        """The id of a configuration: the old one if it is registered, else the next."""
        text = json_text(config)
        digest = hashlib.sha256(text.encode()).hexdigest()
        if self.exists(CONFIGS):
            known = self.spark.read.parquet(f"{self.root}/{CONFIGS}")
            row = known.agg(F.max("config_id").alias("top"), F.min(F.when(F.col("config_hash") == digest, F.col("config_id"))).alias("own")).first()
            if row["own"] is not None:
                return row["own"]
            new = row["top"] + 1
        else:
            new = 1
        # runs at the same time may see the same top: the file of an id can be made by one of them only
        while not self._fs.createNewFile(self._path(f"{self.root}/_ids/{new}")):
            new += 1
        at = datetime.now(timezone.utc).replace(tzinfo=None)
        self.spark.createDataFrame([(new, digest, text, at)], CONFIG_SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.root}/{CONFIGS}")
        return new

    def check_compatible(self, config: dict[str, Any], skip: Sequence[str] = ()) -> None:
        """Raise if a registered configuration differs in a key that is not skipped."""
        if not self.exists(CONFIGS):
            return
        own = json.loads(json_text(config))
        for r in self.spark.read.parquet(f"{self.root}/{CONFIGS}").toLocalIterator():
            old = json.loads(r["config"])
            bad = [k for k in sorted(set(own) | set(old)) if k not in skip and own.get(k) != old.get(k)]
            if bad:
                raise ValueError(f"config {r['config_id']} differs in {bad}")

    def export_csv(self, table: str, path: str) -> None:
        self.read(table).write.mode("overwrite").option("header", True).csv(path)


def collect_results(store: Store, suffix: str = "", tables: Sequence[str] | None = None, locations: str | None = "expert_locs", coords: Sequence[str] = (), col_funcs: dict[str, Sequence[ColumnSpec]] | Sequence[ColumnSpec] | None = None) -> dict[str, DataFrame]:
    """All result tables with a suffix; with ``coords`` the location columns are joined to each.

    ``col_funcs`` names columns to add by table, without the suffix; a plain list is added to every table that has the
    columns which it asks for, in order.
    """
    names = [t for t in store.tables() if t.endswith(suffix) and (tables is None or t.removesuffix(suffix) in tables)]
    out = {t: store.read(t) for t in names}
    places = f"{locations}{suffix}" if locations else None
    if coords and places in out:
        for t in names:
            if t not in (places, f"{CONFIGS}{suffix}") and set(coords) <= set(out[t].columns):
                out[t] = attach_locations(out[t], out[places], coords)
    if isinstance(col_funcs, dict):
        for t, specs in col_funcs.items():
            out[f"{t}{suffix}"] = add_columns(out[f"{t}{suffix}"], specs)
        return out
    for t in out:
        for spec in col_funcs or ():
            if {*spec.cols, *spec.col_kwargs.values()} <= set(out[t].columns):
                out[t] = add_columns(out[t], [spec])
    return out


def attach_locations(df: DataFrame, locations: DataFrame, coords: Sequence[str]) -> DataFrame:
    """Left join on the coordinates; clashing names of the locations get a suffix."""
    clash = [c for c in locations.columns if c in df.columns and c not in coords]
    return df.join(locations.withColumnsRenamed({c: f"{c}_expert_location" for c in clash}), list(coords), "left")
