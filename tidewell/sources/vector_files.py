"""Vector files as Spark data sources: ``f32bin`` and ``fvecs``, read and written in parallel.

f32bin: little-endian uint64 n and d, then n * d float32. fvecs: per row an int32 d and d float32. A path is a file
or a folder of them; rows are numbered in the order of file names. A reader splits files into row ranges; a writer
makes files for each partition, so a sorted table keeps its order. Paths may be in any file system that Arrow opens, and
must be the same for all machines.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Limits of the formats.
MAX_DIM, MAX_ROWS = 4096, 5_000_000
#: Rows of one read task, and bytes of one file of a writer, which it holds until they are there.
RANGE, FILE = 65_536, 64 << 20
SCHEMA = "step long, vec array<float>"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, as Arrow knows it (mounted folders, and stores such as S3, GCS and HDFS), and the path in it."""
    try:
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
    except pa.ArrowInvalid as e:
        raise ValueError(f"{path}: no file system for vector files: {e}") from e


def shape(path: str, kind: str) -> tuple[int, int]:
    """(rows, dimension) of one file, from its header and size; ValueError if they don't fit together."""
    where, name = store(path)
    with where.open_input_file(name) as f:
        size = f.size()
        if kind == "f32bin":
            head = f.read(16)
            if len(head) < 16:
                raise ValueError(f"{path}: too short for a header")
            n, d = struct.unpack("<QQ", head)
            if not (0 < d <= MAX_DIM and 0 < n <= MAX_ROWS) or size < 16 + 4 * n * d:
                raise ValueError(f"{path}: {n} rows of {d} do not fit {size} bytes")
            return n, d
        head = f.read(4)
        d = struct.unpack("<i", head)[0] if len(head) == 4 else 0
        if not 0 < d <= MAX_DIM or size % (4 + 4 * d):
            raise ValueError(f"{path}: records of dimension {d} do not fit {size} bytes")
        return size // (4 + 4 * d), d


@dataclass
class Rows(InputPartition):
    path: str
    kind: str
    dim: int
    first: int
    count: int
    step: int


class Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self) -> list[Rows]:
        where, name = store(self.path)
        files = [self.path]
        if where.get_file_info(name).type == fs.FileType.Directory:
            found = (f.base_name for f in where.get_file_info(fs.FileSelector(name)) if f.is_file)
            files = [f"{self.path.rstrip('/')}/{f}" for f in sorted(found) if f.endswith(f".{self.kind}") and f[0] not in "._"]
        out, step = [], 0
        for f in files:
            n, d = shape(f, self.kind)
            out += [Rows(f, self.kind, d, at, min(RANGE, n - at), step + at) for at in range(0, n, RANGE)]
            step += n
        return out or [Rows("", self.kind, 0, 0, 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        p = partition
        if not p.count:
            return
        where, name = store(p.path)
        with where.open_input_file(name) as f:
            if p.kind == "f32bin":
                raw = f.read_at(4 * p.dim * p.count, 16 + 4 * p.dim * p.first)
                x = np.frombuffer(raw, "<f4").reshape(-1, p.dim)
            else:
                raw = f.read_at((4 + 4 * p.dim) * p.count, (4 + 4 * p.dim) * p.first)
                rows = np.frombuffer(raw, "<i4").reshape(-1, p.dim + 1)
                if (rows[:, 0] != p.dim).any():
                    raise ValueError(f"{p.path}: records of differing dimension")
                x = np.ascontiguousarray(rows[:, 1:]).view("<f4")
        offsets = pa.array(np.arange(len(x) + 1) * p.dim, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.step, p.step + len(x))), pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1)))], names=["step", "vec"])


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written under hidden names, and the names they are to get."""

    files: list[tuple[str, str]]


class Writer(DataSourceWriter):
    def __init__(self, path: str, kind: str, column: int):
        self.path, self.kind, self.column = path, kind, column

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        where, folder = store(self.path)
        where.create_dir(folder, recursive=True)
        task, held, dim, done = TaskContext.get(), [], 0, []

        def flush() -> None:
            name = f"part-{task.partitionId():06d}-{len(done):06d}.{self.kind}"
            hidden = f"{folder}/.{name}.{task.taskAttemptId()}"
            x = np.stack(held)
            with where.open_output_stream(hidden) as out:
                if self.kind == "f32bin":
                    out.write(struct.pack("<QQ", *x.shape))
                    out.write(x.tobytes())
                else:
                    out.write(np.concatenate([np.full((len(x), 1), dim, "<i4"), x.view("<i4")], axis=1).tobytes())
            done.append((hidden, f"{folder}/{name}"))
            held.clear()

        for r in iterator:
            vec = np.asarray(r[self.column], "<f4")
            if dim and len(vec) != dim:
                raise ValueError(f"a vector of dimension {len(vec)} among those of {dim}")
            dim = len(vec)
            held.append(vec)
            if 4 * dim * len(held) >= FILE:
                flush()
        if held:
            flush()
        return Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files get their names when all tasks have ended well."""
        where, _ = store(self.path)
        for hidden, name in (f for m in messages if m is not None for f in m.files):
            where.move(hidden, name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, _ = store(self.path)
        for hidden, _ in (f for m in messages if m is not None for f in m.files):
            where.delete_file(hidden)


class F32Bin(DataSource):
    KIND = "f32bin"

    @classmethod
    def name(cls) -> str:
        return cls.KIND

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], self.KIND)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"], self.KIND, schema.names.index("vec"))


class Fvecs(F32Bin):
    KIND = "fvecs"


def read_vectors(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(step, vec) of a file or folder of ``kind`` f32bin or fvecs."""
    spark.dataSource.register({"f32bin": F32Bin, "fvecs": Fvecs}[kind])
    return spark.read.format(kind).load(path)


def write_vectors(df: DataFrame, path: str, kind: str) -> None:
    """Write ``vec`` of a table (step, vec) in the order of ``step``."""
    df.sparkSession.dataSource.register({"f32bin": F32Bin, "fvecs": Fvecs}[kind])
    df.select("step", "vec").repartitionByRange("step").sortWithinPartitions("step").write.format(kind).mode("append").save(path)
