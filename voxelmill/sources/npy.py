"""Arrays in ``.npy`` files as a Python data source: a row for each element, with its file and its place on each axis.

Reading takes the schema from the first file's header and splits files by byte ranges; each task reads the headers of its
own files. Writing streams each file from rows in the order of its elements, so a task holds a stretch of a file and
never a whole array, and files appear under their names when the whole job commits. Paths are URIs of any file system
that Arrow knows, or plain paths that all machines share.
"""

from __future__ import annotations

import ast
import math
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

MAGIC = b"\x93NUMPY"
#: Elements of numpy's kinds as Spark's types; unsigned ones take the next wider type.
KINDS: dict[str, DataType] = {
    "b1": BooleanType(), "i1": ByteType(), "u1": ShortType(), "i2": ShortType(), "u2": IntegerType(), "i4": IntegerType(), "u4": LongType(), "i8": LongType(), "f4": FloatType(), "f8": DoubleType(),
}
ARROW = {BooleanType(): pa.bool_(), ByteType(): pa.int8(), ShortType(): pa.int16(), IntegerType(): pa.int32(), LongType(): pa.int64(), FloatType(): pa.float32(), DoubleType(): pa.float64()}
#: Bytes a task reads, and elements it turns into rows or writes at once.
SPLIT_BYTES, STRETCH = 64 << 20, 1 << 18


@dataclass
class Header:
    kind: np.dtype
    by_column: bool
    shape: tuple[int, ...]
    size: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:")) if path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)


def read_header(file) -> Header:
    """Reads a header, version 1 to 3, from the beginning of a file."""
    start = file.read(8)
    if start[:6] != MAGIC:
        raise ValueError("this is no .npy file")
    width = 2 if start[6] == 1 else 4
    (length,) = struct.unpack("<H" if width == 2 else "<I", file.read(width))
    fields = ast.literal_eval(file.read(length).decode("utf-8"))
    kind = np.dtype(fields["descr"])
    if kind.str[1:] not in KINDS:
        raise ValueError(f"elements of kind {kind} can't be read")
    return Header(kind, fields["fortran_order"], tuple(fields["shape"]), 8 + width + length)


def written_header(kind: np.dtype, shape: tuple[int, ...]) -> bytes:
    text = f"{{'descr': {kind.str!r}, 'fortran_order': False, 'shape': {tuple(shape)!r}, }}".encode()
    pad = -(len(text) + 11) % 64
    return MAGIC + b"\x01\x00" + struct.pack("<H", len(text) + pad + 1) + text + b" " * pad + b"\n"


def found_files(path: str) -> list[fs.FileInfo]:
    """The .npy files under a folder in the order of their paths, or the one file."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [info]
    hidden = lambda p: any(part.startswith(("_", ".")) for part in p[len(inner) :].split("/"))
    files = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return sorted((f for f in files if f.type == fs.FileType.File and f.path.endswith(".npy") and not hidden(f.path)), key=lambda f: f.path)


@dataclass
class Ranges(InputPartition):
    """(path, first byte, byte after the last) of the files of a task."""

    parts: list[tuple[str, int, int]]


class NpyReader(DataSourceReader):
    def __init__(self, path: str, axes: list[str], schema: StructType, nonzero: bool, split: int):
        self.path, self.axes, self.schema, self.nonzero, self.split = path, axes, schema, nonzero, split

    def partitions(self) -> list[Ranges]:
        """Byte ranges of about ``split``: long files are cut, short ones put together."""
        made, held, size = [], [], 0
        for info in found_files(self.path):
            for at in range(0, max(1, info.size), self.split):
                part = (info.path, at, min(info.size, at + self.split))
                if held and size + part[2] - at > self.split:
                    made.append(Ranges(held))
                    held, size = [], 0
                held.append(part)
                size += part[2] - at
        return [*made, Ranges(held)] if held or not made else made

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        arrow = pa.schema([("file", pa.string()), *((a, pa.int32()) for a in self.axes), ("value", ARROW[self.schema["value"].dataType])])
        for path, begin, end in partition.parts:
            with system.open_input_file(path) as file:
                header = read_header(file)
                if len(header.shape) != len(self.axes) or KINDS[header.kind.str[1:]] != self.schema["value"].dataType:
                    raise ValueError(f"{path} has other axes or elements than the first file")
                total, width = math.prod(header.shape), header.kind.itemsize
                # an element belongs to the range that its first byte lies in
                first, last = (min(total, max(0, -(-(at - header.size) // width))) for at in (begin, end))
                for lo in range(first, last, STRETCH):
                    hi = min(last, lo + STRETCH)
                    values = np.frombuffer(file.read_at((hi - lo) * width, header.size + lo * width), header.kind)
                    values = values.astype(header.kind.newbyteorder("="))
                    at = np.flatnonzero(values) if self.nonzero else np.arange(hi - lo)
                    places = np.unravel_index(at + lo, header.shape, order="F" if header.by_column else "C") if header.shape else ()
                    name = pa.DictionaryArray.from_arrays(np.zeros(len(at), np.int8), [path]).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([name, *(pa.array(p.astype(np.int32)) for p in places), pa.array(values[at]).cast(arrow.field("value").type)], schema=arrow)


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has written: (temporary name, name)."""

    files: list[tuple[str, str]]


class NpyWriter(DataSourceArrowWriter):
    """Rows (file, shape, place on each axis, value) in the order of files and places; places without a row are zero."""

    def __init__(self, path: str, schema: StructType, kind: str, overwrite: bool):
        self.path, self.axes, self.kind, self.overwrite = path, [f.name for f in schema if f.name not in ("file", "shape", "value")], np.dtype(kind), overwrite
        self.attempts = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        folder = f"{root.rstrip('/')}/{self.attempts}"
        system.create_dir(folder, recursive=True)
        made: list[tuple[str, str]] = []
        stream = name = shape = None
        after = 0  # the place after the last one written

        def fill(to: int) -> None:
            nonlocal after
            while after < to:
                step = min(STRETCH, to - after)
                stream.write(bytes(step * self.kind.itemsize))
                after += step

        def close() -> None:
            if stream is not None:
                fill(math.prod(shape))
                stream.close()

        try:
            for batch in iterator:
                files, shapes = batch.column("file").to_pylist(), batch.column("shape")
                values = batch.column("value").to_numpy(zero_copy_only=False).astype(self.kind)
                places = [batch.column(a).to_numpy(zero_copy_only=False) for a in self.axes]
                cuts = [0, *(i for i in range(1, len(files)) if files[i] != files[i - 1]), len(files)] if files else [0]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if files[lo] != name:
                        close()
                        name, shape, after = files[lo], tuple(shapes[lo].as_py()), 0
                        made.append((f"{folder}/{uuid.uuid4().hex}.npy", f"{root.rstrip('/')}/{name}"))
                        stream = system.open_output_stream(made[-1][0])
                        stream.write(written_header(self.kind, shape))
                    flat = np.ravel_multi_index([p[lo:hi] for p in places], shape)
                    if flat[0] < after or (np.diff(flat) <= 0).any():
                        raise ValueError(f"rows of {name} repeat a place or aren't in the order of places")
                    for a in range(0, hi - lo, STRETCH):
                        part, given = flat[a : a + STRETCH], values[lo + a : min(hi, lo + a + STRETCH)]
                        if part[-1] - after < 4 * STRETCH:
                            dense = np.zeros(int(part[-1]) + 1 - after, self.kind)
                            dense[part - after] = given
                            stream.write(dense.tobytes())
                            after = int(part[-1]) + 1
                        else:  # far apart: zeros in stretches between them
                            for p, v in zip(part.tolist(), given, strict=True):
                                fill(p)
                                stream.write(v.tobytes())
                                after = p + 1
            close()
            stream = None
        finally:
            if stream is not None and not stream.closed:
                stream.close()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        """Moves what the successful tasks have written to its names, and drops all else. Other files of the folder stay."""
        system, root = opened(self.path)
        files = [pair for m in messages if m is not None for pair in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one file came to several tasks")
        if not self.overwrite and any(i.type != fs.FileType.NotFound for i in system.get_file_info(names)):
            self.abort(messages)
            raise ValueError(f"{self.path} has some of the files already")
        for temporary, name in files:
            if "/" in name[len(root.rstrip("/")) + 1 :]:
                system.create_dir(name.rsplit("/", 1)[0], recursive=True)
            system.move(temporary, name)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = opened(self.path)
        folder = f"{root.rstrip('/')}/{self.attempts}"
        if system.get_file_info(folder).type != fs.FileType.NotFound:
            system.delete_dir(folder)


class NpyDataSource(DataSource):
    """Options: ``path``; ``axes``, names for the places (i0, i1 and so on); ``nonzero``, to read no zeros; ``splitBytes``; ``kind``, numpy's code of the elements written."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> StructType:
        files = found_files(self.options["path"])
        if not files:
            raise ValueError(f"{self.options['path']} has no .npy files")
        with opened(self.options["path"])[0].open_input_file(files[0].path) as file:
            header = read_header(file)
        return StructType([StructField("file", StringType()), *(StructField(a, IntegerType()) for a in self.axes(len(header.shape))), StructField("value", KINDS[header.kind.str[1:]])])

    def axes(self, n: int) -> list[str]:
        named = [a.strip() for a in self.options.get("axes", "").split(",") if a.strip()]
        if named and len(named) != n:
            raise ValueError(f"the files have {n} axes, not {len(named)}")
        return named or [f"i{k}" for k in range(n)]

    def reader(self, schema: StructType) -> NpyReader:
        axes = [f.name for f in schema if f.name not in ("file", "value")]
        return NpyReader(self.options["path"], axes, schema, self.options.get("nonzero", "false").lower() == "true", int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], schema, self.options.get("kind", "u1"), overwrite)


def read_arrays(spark: SparkSession, path: str, axes: list[str] | None = None, nonzero: bool = False) -> DataFrame:
    """(file, axes, value): the elements of all .npy files under ``path``, or those that aren't zero. All must have as many axes and one kind."""
    spark.dataSource.register(NpyDataSource)
    return spark.read.format("npy").option("axes", ",".join(axes or [])).option("nonzero", str(nonzero).lower()).load(path)


def write_arrays(rows: DataFrame, path: str, axes: list[str], kind: str = "u1") -> None:
    """Writes rows (file, shape, axes, value) as .npy files; a file that exists is replaced, others stay.

    ``file`` is a name under ``path``, ``shape`` an array of ints, equal for all rows of a file. Places without a row are
    zero, of repeated places the largest value counts, rows with nulls among these columns are left out. A file is
    written by one task in stretches.
    """
    rows.sparkSession.dataSource.register(NpyDataSource)
    whole = rows.select("file", "shape", *[F.col(a).cast("int").alias(a) for a in axes], "value").dropna()
    single = whole.groupBy("file", "shape", *axes).agg(F.max("value").alias("value"))
    placed = single.repartition("file").sortWithinPartitions("file", *axes)
    placed.write.format("npy").mode("overwrite").option("kind", kind).option("path", path).save()
