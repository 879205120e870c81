"""Array files (.npy) as a Spark source and sink.

    spark.dataSource.register(ArrayFiles)
    spark.read.format("npy").option("path", folder_or_file).load()
    df.write.format("npy").mode("overwrite").option("path", folder).save()

A file of n numbers or texts, or n rows of k numbers, becomes rows of (file, at, value), value an array in the second case. Files are
read by slices of rows, each its own task, straight from its place in the file; a slice is at most `sliceBytes` (64 MB unless
stated). Each task that writes makes one file; the files of a write appear when all tasks are done, and go if one fails.
Paths are those of any file system that pyarrow knows. Text files are of fixed width; pickled objects aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SLICE_BYTES = 64 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _files(path: str) -> list[str]:
    system, where = _open(path)
    found = system.get_file_info(where)
    if found.type == fs.FileType.File:
        return [where]
    inside = system.get_file_info(fs.FileSelector(where, recursive=True))
    return sorted(f.path for f in inside if f.type == fs.FileType.File and f.path.endswith(".npy") and not any(p.startswith(("_", ".")) for p in f.path[len(where) :].strip("/").split("/")))


def _header(stream) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and where the numbers begin; only the header is read."""
    major, _ = np.lib.format.read_magic(stream)
    shape, by_columns, kind = (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(stream)
    if kind.hasobject or len(shape) not in (1, 2) or (by_columns and len(shape) == 2):
        raise ValueError(f"arrays of one dimension, or of two by rows, without objects can be read, not {shape} of {kind}")
    return shape, kind, stream.tell()


@dataclass
class _Slice(InputPartition):
    file: str
    start: int
    rows: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, slice_bytes: int):
        self.path, self.slice_bytes = path, slice_bytes

    def partitions(self):
        system, out = _open(self.path)[0], []
        for file in _files(self.path):
            with system.open_input_file(file) as stream:
                shape, kind, _ = _header(stream)
            step = max(1, self.slice_bytes // max(kind.itemsize * (shape[1] if len(shape) == 2 else 1), 1))
            out += [_Slice(file, at, min(step, shape[0] - at)) for at in range(0, shape[0], step)]
        return out

    def read(self, partition: _Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        with _open(self.path)[0].open_input_file(partition.file) as stream:
            shape, kind, begin = _header(stream)
            width = kind.itemsize * (shape[1] if len(shape) == 2 else 1)
            stream.seek(begin + partition.start * width)
            step = max(1, (4 << 20) // max(width, 1))
            for at in range(0, partition.rows, step):
                n = min(step, partition.rows - at)
                x = np.frombuffer(stream.read(n * width), kind).reshape(n, *shape[1:])
                x = x.astype(kind.newbyteorder("=")) if kind.kind != "U" else x
                if x.ndim == 2:
                    value = pa.ListArray.from_arrays(np.arange(0, x.size + 1, shape[1], dtype=np.int32), pa.array(x.ravel()))
                else:
                    value = pa.array(x.tolist() if kind.kind == "U" else x)
                where = np.arange(partition.start + at, partition.start + at + n)
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * n), pa.array(where, pa.int64()), value], ["file", "at", "value"])


@dataclass
class _Written(WriterCommitMessage):
    temporary: str | None
    final: str | None


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool):
        self.path, self.names, self.kind, self.overwrite = path, schema.fieldNames(), schema["value"].dataType, overwrite

    def write(self, iterator) -> _Written:
        rows = [r["value"] for r in iterator]
        if not rows:
            return _Written(None, None)
        kinds = {T.LongType: np.int64, T.IntegerType: np.int32, T.DoubleType: np.float64, T.FloatType: np.float32, T.BooleanType: np.bool_}
        element = self.kind.elementType if isinstance(self.kind, T.ArrayType) else self.kind
        data = np.array(rows) if isinstance(element, T.StringType) else np.array(rows, kinds[type(element)])
        system, where = _open(self.path)
        name = f"part-{uuid.uuid4().hex}.npy"
        system.create_dir(f"{where}/_temporary", recursive=True)
        with system.open_output_stream(f"{where}/_temporary/{name}") as out:
            np.lib.format.write_array(out, np.ascontiguousarray(data), allow_pickle=False)
        return _Written(f"{where}/_temporary/{name}", f"{where}/{name}")

    def commit(self, messages) -> None:
        system, where = _open(self.path)
        system.create_dir(where, recursive=True)
        if self.overwrite:
            for old in _files(self.path):
                system.delete_file(old)
        for m in messages:
            if m is not None and m.temporary:
                system.move(m.temporary, m.final)
        self._clear(system, where)

    def abort(self, messages) -> None:
        self._clear(*_open(self.path))

    @staticmethod
    def _clear(system: fs.FileSystem, where: str) -> None:
        if system.get_file_info(f"{where}/_temporary").type == fs.FileType.Directory:
            system.delete_dir(f"{where}/_temporary")


class ArrayFiles(DataSource):
    """The format 'npy'."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> T.StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no .npy files at {self.options['path']}")
        with _open(self.options["path"])[0].open_input_file(files[0]) as stream:
            shape, kind, _ = _header(stream)
        of = {"i": T.LongType() if kind.itemsize > 4 else T.IntegerType(), "f": T.DoubleType() if kind.itemsize > 4 else T.FloatType(), "b": T.BooleanType(), "U": T.StringType()}[kind.kind]
        value = T.ArrayType(of) if len(shape) == 2 else of
        return T.StructType([T.StructField("file", T.StringType()), T.StructField("at", T.LongType()), T.StructField("value", value)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("sliceBytes", SLICE_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, overwrite)
