"""A Spark data source for folders of raw perturbation results: `*_raw.pickle` files of a dictionary each.

A file maps (keys, what was measured) to the values of all cells. Every file is a partition of its own, read by the task
that needs it; nothing but plain containers, numbers and text is unpickled.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SUFFIX = "_raw.pickle"
#: Fixed value: what is measured where a score belongs to the whole cell.
CELL = "cell_emb"
#: Results of a batch: so many values at least, but for a file's last one.
ROWS = 10_000

_SCHEMA = "file string, keys array<bigint>, measured string, at int, shifts array<double>"


class Plain(pickle.Unpickler):
    """Refuses every class but the dictionary that makes missing lists."""

    def find_class(self, module: str, name: str) -> type:
        if (module, name) == ("collections", "defaultdict"):
            from collections import defaultdict

            return defaultdict
        if (module, name) == ("builtins", "list"):
            return list
        raise pickle.UnpicklingError(f"a raw file may not hold {module}.{name}")


def keys_of(key: object) -> list[int]:
    return [int(k) for k in key] if isinstance(key, (tuple, list)) else [int(key)]


class RawFile(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class RawReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options.get("path", "")
        self.kind = options.get("measured", "")
        self.anchor = int(options["anchor"]) if options.get("anchor") else None

    def partitions(self) -> Sequence[InputPartition]:
        store, path = fs.FileSystem.from_uri(self.folder)
        # in order of names, so that the rows' order does not depend on the listing
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and f.path.endswith(SUFFIX))
        if not found:
            raise FileNotFoundError(f"no file ending in {SUFFIX} in {self.folder}")
        return [RawFile(p) for p in found]

    def wanted(self, key: tuple) -> bool:
        if self.kind == "cell":
            return CELL in key[1:]
        return self.anchor is None or keys_of(key[0]) == [self.anchor]

    def read(self, partition: RawFile) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(partition.path) as stream:
            told = Plain(stream).load()
        name, held, size = partition.path.rsplit("/", 1)[-1], [], 0
        for key, values in told.items():
            if not values or not self.wanted(key):
                continue
            measured = CELL if CELL in key[1:] else str(key[1])
            for at, v in enumerate(values):
                held.append((name, keys_of(key[0]), measured, at, [float(x) for x in (v if isinstance(v, (tuple, list)) else (v,))]))
            if len(held) >= ROWS:
                yield self.batch(held)
                held = []
        if held:
            yield self.batch(held)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.list_(pa.int64()), pa.string(), pa.int32(), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "keys", "measured", "at", "shifts"])


class RawShifts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_shifts"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return RawReader(self.options)


def read_raw(spark: SparkSession, folder: str, measured: str = "cell", anchor: int | None = None) -> DataFrame:
    """(file, keys, measured, at, shifts) of every value in a folder's raw files.

    measured "cell" keeps scores of whole cells; "gene" those whose keys are the anchor alone (all, without one). The choice is made while
    a file is read, before rows are made. shifts has one value, or one for each state compared; at is a value's place
    in its list. Empty lists give no rows; a folder without a raw file is an error, and so is a file that holds
    anything but plain values. folder: a path, or an address of a store that Arrow opens.
    """
    if measured not in ("cell", "gene"):
        raise ValueError("measured is 'cell' or 'gene'")
    spark.dataSource.register(RawShifts)
    reader = spark.read.format("raw_shifts").option("measured", measured)
    return (reader.option("anchor", str(anchor)) if anchor is not None else reader).load(folder)
