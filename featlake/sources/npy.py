"""A Python data source for folders of NPY matrices, in any store that Arrow reads: one partition a slice of rows, read by its range."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as store
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def located(path: str) -> tuple[store.FileSystem, str]:
    """The store of a path or URI, and the path there."""
    return store.FileSystem.from_uri(path)


def header(stream) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and first byte of a matrix that lies row by row."""
    version = np.lib.format.read_magic(stream)
    shape, by_column, kind = np.lib.format.read_array_header_1_0(stream) if version == (1, 0) else np.lib.format.read_array_header_2_0(stream)
    if by_column or len(shape) != 2:
        raise ValueError("an NPY shard is not a matrix that lies row by row")
    return shape, kind, stream.tell()


class Slice(InputPartition):
    def __init__(self, path: str, first: int, last: int, base: int):
        self.path, self.first, self.last, self.base = path, first, last, base


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]
        self.rows = int(options.get("rows", 8192))

    def partitions(self) -> list[Slice]:
        at, folder = located(self.uri)
        files = sorted(f.path for f in at.get_file_info(store.FileSelector(folder, recursive=True)) if f.is_file and f.path.endswith(".npy"))
        out, base = [], 0
        for f in files:
            with at.open_input_file(f) as stream:
                n = header(stream)[0][0]
            out += [Slice(f, s, min(n, s + self.rows), base) for s in range(0, n, self.rows)]
            base += n
        return out

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        with located(self.uri)[0].open_input_file(part.path) as stream:
            (_, dim), kind, start = header(stream)
            stream.seek(start + part.first * dim * kind.itemsize)
            x = np.frombuffer(stream.read((part.last - part.first) * dim * kind.itemsize), kind).reshape(-1, dim).astype(np.float32)
        n = len(x)
        ids = np.arange(part.first, part.last) + part.base
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([posixpath.basename(part.path)] * n), pa.array(ids), vectors], ["shard", "global_row", "embedding"])


#: Rows of a shard that write() makes.
SHARD = 1 << 16


def write(vectors: DataFrame, order: str, vector: str, folder: str) -> None:
    """Write a column of vectors as shards whose names sort in the rows' order; each task writes those of its rows.

    A shard is written under another name and then moved, so that it shows whole; a task that runs again writes the
    same rows to the same names.
    """
    at, path = located(folder)
    at.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, held, n = TaskContext.get().partitionId(), 0, [], 0
        at, path = located(folder)

        def flush() -> None:
            nonlocal shard, held, n
            if held:
                name = f"{path}/shard-{part:06d}-{shard:06d}.npy"
                part_name = f"{name}.{TaskContext.get().taskAttemptId()}"
                with at.open_output_stream(part_name) as f:
                    np.save(f, np.concatenate(held))
                at.move(part_name, name)
                shard, held, n = shard + 1, [], 0

        for b in batches:
            if b.num_rows:
                v = b.column(0)
                held.append(v.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(b.num_rows, -1))
                n += b.num_rows
            if n >= SHARD:
                flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64())], ["shards"])

    vectors.orderBy(order).select(vector).mapInArrow(run, "shards long").collect()  # one number a partition


class Npy(DataSource):
    """spark.read.format("npy").load(folder): shard, global_row (running over the sorted shards), embedding."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "shard string, global_row long, embedding array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Npy)
