"""Versions of a workspace as a Spark data source: ``spark.read.format("runledger")``, read only.

Options: ``root``, ``workspace``, ``source`` and, unless the newest is meant, ``version``. A schema given to
the reader prunes: only its columns are read. Comparisons with numbers, texts, dates and booleans
are pushed to the Parquet files and skip row groups; Spark evaluates all others. Tasks read one
file each, in Arrow batches. Inside Spark jobs of this library versions are read by Spark's own
Parquet reader; this is for those who know a version by name only.
"""

from __future__ import annotations

import datetime
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

FORMAT = "runledger"
_COMPARED = {
    EqualTo: lambda c, v: c == v,
    GreaterThan: lambda c, v: c > v,
    GreaterThanOrEqual: lambda c, v: c >= v,
    LessThan: lambda c, v: c < v,
    LessThanOrEqual: lambda c, v: c <= v,
}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub("^file:", "", path)


def _files(folder: str) -> list[str]:
    system, path = _opened(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet"))


def _folders(path: str) -> list[str]:
    """The folders of a version, which may name several batches in braces."""
    several = re.fullmatch(r"(.*)\{([0-9,]+)\}(.*)", path)
    return [several[1] + n + several[3] for n in several[2].split(",")] if several else [path]


def _version(options: dict[str, str]) -> dict:
    """The row of the version asked for, or of the newest."""
    missing = {"root", "workspace", "source"} - set(options)
    if missing:
        raise ValueError(f"Options are missing: {sorted(missing)}")
    folder = f"{options['root']}/tables/versions/workspace_id={options['workspace']}/source={options['source']}"
    if "version" in options:
        folder += f"/version_id={options['version']}"
    system, _ = _opened(folder)
    rows = []
    for file in _files(folder):
        rows += ds.dataset(file, filesystem=system).to_table(columns=["path", "schema_json", "created_at", "seq", "digest"]).to_pylist()
    if not rows:
        raise ValueError(f"No such version of {options['source']}")
    # Of two writers of one content the earlier counts; of all contents the newest.
    first: dict[str, dict] = {}
    for row in sorted(rows, key=lambda r: r["seq"]):
        first.setdefault(row["digest"], row)
    return max(first.values(), key=lambda r: (r["created_at"], r["seq"]))


def _arrow(kind) -> pa.DataType | None:
    """The Arrow type of a type that filters may compare, else None."""
    return {
        "byte": pa.int8(), "short": pa.int16(), "integer": pa.int32(), "long": pa.int64(), "float": pa.float32(),
        "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "date": pa.date32(),
    }.get(kind.typeName())


class LedgerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(_version(self.options)["schema_json"]))

    def reader(self, schema: StructType) -> LedgerReader:
        return LedgerReader(dict(self.options), schema)


class LedgerReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema = options, schema
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for one in filters:
            if self._expression(one) is not None:
                self.pushed.append(one)
            else:
                yield one

    def _expression(self, one: Filter) -> ds.Expression | None:
        """A filter for Parquet; None if Spark has to evaluate it."""
        path = getattr(one, "attribute", ())
        kind = _arrow(self.schema[path[0]].dataType) if len(path) == 1 and path[0] in self.schema.names else None
        if kind is None:
            return None
        column = ds.field(path[0])
        if isinstance(one, IsNull):
            return column.is_null()
        if isinstance(one, IsNotNull):
            return column.is_valid()
        plain = (bool, int, float, str, datetime.date)
        values = list(one.value) if isinstance(one, In) else [getattr(one, "value", None)]
        # To Spark a NaN is equal to itself and the greatest number, to Parquet readers it is not.
        if pa.types.is_floating(kind) or any(not isinstance(v, plain) or isinstance(v, datetime.datetime) for v in values):
            return None
        if isinstance(one, In):
            return column.isin(pa.array(values, kind))
        compare = _COMPARED.get(type(one))
        return None if compare is None else compare(column, pa.scalar(values[0], kind))

    def partitions(self) -> list[InputPartition]:
        files = [f for folder in _folders(_version(self.options)["path"]) for f in _files(folder)]
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.options["root"])
        wanted = None
        for one in self.pushed:
            expression = self._expression(one)
            wanted = expression if wanted is None else wanted & expression
        names = self.schema.names
        for batch in ds.dataset(partition.value, format="parquet", filesystem=system).to_batches(columns=names, filter=wanted):
            columns = []
            for name in names:
                column = batch.column(name)
                if pa.types.is_timestamp(column.type):
                    # Written as nanoseconds of UTC; a column without zone stays without.
                    zone = None if self.schema[name].dataType.typeName() == "timestamp_ntz" else "UTC"
                    column = column.cast(pa.timestamp("us", zone), safe=False)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, names)


def register_format(spark: SparkSession) -> None:
    """Make the format known to a session. Workers get its code with each query, and need no install."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LedgerSource)
