"""Dense matrix files as a data source: ``.npy`` shards and raw memory dumps.

``spark.read.format("matrix")`` splits every file into row ranges, so a large
file is read by many tasks and no task loads a whole one: a task reads the bytes of its
range. Files are reached by URI through ``pyarrow.fs`` (``s3://``, ``gs://``, ``hdfs://``,
``file:`` or a plain path), by the driver and by executors alike. Options:

``path``       a file or a folder that all executors reach
``kind``       ``npy`` (default) or ``raw``
``dtype, dim`` element type and width of a raw file
``glob``       file name pattern, ``*.npy`` by default (``*`` for raw)
``recursive``  ``true`` to search sub-folders
``rowsPerPartition``  rows of one read task, 65536 by default
``as``         ``float`` (default) or ``smallint`` elements
``columns``    the columns to read, ``shard,row_index,embedding`` by default; without the
               last no vector is read

Each row is ``shard`` (file name without its last extension, or the path below
the folder in a recursive read), ``row_index`` and ``embedding``. Conditions on ``shard`` and
``row_index`` are pushed down: files of other shards aren't opened, other rows aren't read.

Writing gives one ``.npy`` file per task and a manifest: a table of the files with their rows,
width and bytes. A folder with a manifest is read by it, without opening headers; files
that don't agree with it are an error.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import time
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

BATCH_ROWS = 8192
#: Headers that are opened at the same time.
HEADERS = 32
MANIFEST = "_manifest.json"
_COLUMNS = ("shard", "row_index", "embedding")


def _lowered(options: dict[str, str]) -> dict[str, str]:
    """Option names are not case-sensitive."""
    return {k.lower(): v for k, v in options.items()}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


@dataclass(frozen=True)
class MatrixFile:
    """Where the rows of a file lie: what its header or the manifest says."""

    name: str  # below the folder
    rows: int
    dim: int
    dtype: str
    offset: int
    by_column: bool
    size: int

    @property
    def shard(self) -> str:
        return posixpath.splitext(self.name)[0]


def _described(files: pafs.FileSystem, path: str, name: str, size: int, options: dict[str, str]) -> MatrixFile:
    if options.get("kind", "npy") != "npy":
        dtype, dim = np.dtype(options["dtype"]), int(options["dim"])
        if size % (dtype.itemsize * dim):
            raise ValueError(f"{path} isn't a whole number of rows of {dim} {dtype}")
        return MatrixFile(name, size // (dtype.itemsize * dim), dim, dtype.str, 0, False, size)
    with files.open_input_file(path) as stream:
        version = np.lib.format.read_magic(stream)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, dtype = read(stream)
        offset = stream.tell()
    if dtype.hasobject:
        raise ValueError(f"{path} holds objects, which would need allow_pickle")
    if len(shape) != 2:
        raise ValueError(f"{path} has {len(shape)} dimensions, not 2")
    if size < offset + shape[0] * shape[1] * dtype.itemsize:
        raise ValueError(f"{path} is shorter than its header says")
    return MatrixFile(name, *shape, dtype.str, offset, by_column, size)


def read_rows(file: MatrixFile, root: str, start: int, end: int) -> np.ndarray:
    """The rows ``start .. end`` of a file; only their bytes are read."""
    files, folder = file_system(root)
    path = posixpath.join(folder, file.name) if file.name else folder
    dtype = np.dtype(file.dtype)

    def piece(stream, first: int, count: int) -> np.ndarray:
        stream.seek(file.offset + first * dtype.itemsize)
        raw = stream.read(count * dtype.itemsize)
        if len(raw) != count * dtype.itemsize:
            raise ValueError(f"{path} ended before row {end}")
        return np.frombuffer(raw, dtype)

    with files.open_input_file(path) as stream:
        if not file.by_column:
            return piece(stream, start * file.dim, (end - start) * file.dim).reshape(-1, file.dim)
        return np.stack([piece(stream, c * file.rows + start, end - start) for c in range(file.dim)], 1)


@dataclass
class RowRange(InputPartition):
    file: MatrixFile
    shard: str
    start: int
    end: int


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.columns = [c.strip() for c in options.get("columns", ",".join(_COLUMNS)).split(",")]
        self.shards: set[str] | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _COLUMNS[:2] and isinstance(f, IsNotNull):
                continue  # neither is ever null
            if name == "shard" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.shards = wanted if self.shards is None else self.shards & wanted
            elif name == "row_index" and isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo):
                    self._below(f.value + 1)
            elif name == "row_index" and isinstance(f, (LessThan, LessThanOrEqual)):
                self._below(f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def _below(self, end: int) -> None:
        self.high = end if self.high is None else min(self.high, end)

    def files(self) -> list[MatrixFile]:
        """The files of the wanted shards in the order of their names."""
        files, root = file_system(self.options["path"])
        if files.get_file_info(root).type == pafs.FileType.File:
            folder, name = posixpath.split(root)
            if self.shards is not None and posixpath.splitext(name)[0] not in self.shards:
                return []
            return [_described(files, root, name, files.get_file_info(root).size, self.options)]
        kind = self.options.get("kind", "npy")
        pattern = self.options.get("glob", "*.npy" if kind == "npy" else "*")
        deep = self.options.get("recursive", "false").lower() == "true"
        found = {}
        for info in files.get_file_info(pafs.FileSelector(root, recursive=deep, allow_not_found=True)):
            name = posixpath.relpath(info.path, root.rstrip("/") or "/")
            base = posixpath.basename(name)
            if info.type == pafs.FileType.File and fnmatch.fnmatch(base, pattern) and base[0] not in "_.":
                found[name] = info.size
        if not found:
            raise FileNotFoundError(f"no {pattern} under {root}")
        listed = read_manifest(self.options["path"])
        if listed is not None:
            stale = {f.name: f.size for f in listed} != found
            if stale and not deep and "glob" not in self.options:
                raise ValueError(f"the manifest of {root} doesn't agree with its files")
            if not stale:
                return [f for f in listed if self.shards is None or f.shard in self.shards]
        names = sorted(n for n in found if self.shards is None or posixpath.splitext(n)[0] in self.shards)
        with ThreadPoolExecutor(HEADERS) as pool:
            return list(pool.map(lambda n: _described(
                files, posixpath.join(root, n), n, found[n], self.options), names))

    def partitions(self) -> list[RowRange]:
        step = int(self.options.get("rowsperpartition", "65536"))
        ranges, width = [], None
        for file in self.files():
            if width is not None and file.dim != width:
                raise ValueError(f"{file.name} is {file.dim} wide, the files before are {width}")
            width = file.dim
            end = file.rows if self.high is None else min(file.rows, self.high)
            ranges += [RowRange(file, file.shard, a, min(a + step, end)) for a in range(self.low, end, step)]
        # Spark asks for a partition at least.
        return ranges or [RowRange(MatrixFile("", 0, 0, "<f4", 0, False, 0), "", 0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        target, kind = ((np.int16, pa.int16()) if self.options.get("as") == "smallint"
                        else (np.float32, pa.float32()))
        files, root = file_system(self.options["path"])
        folder = self.options["path"]
        if partition.file.name and files.get_file_info(root).type == pafs.FileType.File:
            folder = folder.rsplit("/", 1)[0] if "/" in folder else "."
        for a in range(partition.start, partition.end, BATCH_ROWS):
            b = min(a + BATCH_ROWS, partition.end)
            made = {"shard": pa.array([partition.shard] * (b - a)), "row_index": pa.array(np.arange(a, b))}
            if "embedding" in self.columns:
                part = read_rows(partition.file, folder, a, b)
                cast = part.astype(target)
                if target is np.int16 and not np.array_equal(cast, part):
                    raise ValueError(f"{partition.file.name} holds values that aren't 16-bit integers")
                offsets = np.arange(b - a + 1, dtype=np.int32) * partition.file.dim
                made["embedding"] = pa.ListArray.from_arrays(offsets, pa.array(cast.ravel(), type=kind))
            yield pa.RecordBatch.from_arrays([made[c] for c in self.columns], names=self.columns)


def read_manifest(path: str) -> list[MatrixFile] | None:
    """The files that a folder's manifest lists, by name; None without one."""
    files, folder = file_system(path)
    name = posixpath.join(folder, MANIFEST)
    if files.get_file_info(name).type != pafs.FileType.File:
        return None
    with files.open_input_file(name) as stream:
        return [MatrixFile(**row) for row in json.loads(stream.read())]


def manifest(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``shard``, rows, dim, dtype, size and offset (rows of the files before) of each file.

    From the manifest where the folder has one, else from the headers; no row is read.
    """
    found = MatrixReader(_lowered({"path": path, **options})).files()
    rows = np.array([f.rows for f in found], np.int64)
    before = np.cumsum(rows) - rows
    table = pa.table({
        "shard": pa.array([f.shard for f in found], pa.string()), "rows": pa.array(rows),
        "dim": pa.array([f.dim for f in found], pa.int64()),
        "dtype": pa.array([f.dtype for f in found], pa.string()),
        "size": pa.array([f.size for f in found], pa.int64()), "offset": pa.array(before)})
    return spark.createDataFrame(table)


def with_position(vectors: DataFrame, files: DataFrame, name: str = "position") -> DataFrame:
    """Vectors numbered over all files in the order of the shards, from the manifest alone.

    ``row_index`` is the place in the file and ``files`` says how many rows come before, so
    nothing is sorted, counted or shuffled (the manifest is a small side of the join).
    """
    return vectors.join(files.select("shard", "offset"), "shard").select(
        *vectors.columns, (F.col("offset") + F.col("row_index")).alias(name))


@dataclass
class Written(WriterCommitMessage):
    staged: str | None
    file: MatrixFile | None


class MatrixWriter(DataSourceArrowWriter):
    """Writes under temporary names; files get their final names and the manifest on commit."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.dtype = np.dtype(options.get("dtype", "float32"))
        self.run = uuid.uuid4().hex
        # Later runs sort after earlier ones, so an append adds rows at the end.
        self.stamp = f"{time.time_ns():020d}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        files, folder = file_system(self.path)
        files.create_dir(folder, recursive=True)
        staged = posixpath.join(folder, f"_{self.run}-{uuid.uuid4().hex}")
        rows, width = 0, None
        body = staged + ".body"
        with files.open_output_stream(body) as out:
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                column = batch.column("embedding")
                widths = column.value_lengths().to_numpy(zero_copy_only=False)
                width = int(widths[0]) if width is None else width
                if column.null_count or (widths != width).any():
                    raise ValueError("vectors of one file must have one width")
                flat = column.flatten().to_numpy(zero_copy_only=False)
                out.write(np.ascontiguousarray(flat, dtype=self.dtype).tobytes())
                rows += batch.num_rows
        if rows == 0:
            files.delete_file(body)
            return Written(None, None)
        # The row count is known only now, so the header goes in front at the end.
        with files.open_output_stream(staged) as out, files.open_input_stream(body) as data:
            head = pa.BufferOutputStream()
            np.lib.format.write_array_header_1_0(head, {
                "descr": np.lib.format.dtype_to_descr(self.dtype), "fortran_order": False,
                "shape": (rows, width)})
            head = head.getvalue().to_pybytes()
            out.write(head)
            while piece := data.read(1 << 24):
                out.write(piece)
        files.delete_file(body)
        name = f"part_{self.stamp}_{part:05d}.npy"
        size = len(head) + rows * width * self.dtype.itemsize
        return Written(staged, MatrixFile(name, rows, width, self.dtype.str, len(head), False, size))

    def _own(self, files: pafs.FileSystem, folder: str) -> list[str]:
        infos = files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        return [posixpath.basename(i.path) for i in infos if i.type == pafs.FileType.File]

    def commit(self, messages: list[Written | None]) -> None:
        files, folder = file_system(self.path)
        files.create_dir(folder, recursive=True)
        names = self._own(files, folder)
        plain = {n for n in names if n[0] not in "_."}
        listed = [] if self.overwrite else read_manifest(self.path)
        made = [m.file for m in messages if m and m.file]
        # Rows of files written by others aren't known: such a folder gets no manifest.
        known = listed is not None and {f.name for f in listed} == plain or not plain or self.overwrite
        # New files first, so that a failure in between loses nothing; a manifest that a
        # failure leaves behind is stale, and reading says so.
        for m in messages:
            if m and m.staged:
                files.move(m.staged, posixpath.join(folder, m.file.name))
        old = [n for n in plain if self.overwrite and fnmatch.fnmatch(n, "part_*.npy")]
        for name in [*old, *(n for n in names if n.startswith(f"_{self.run}") and n not in {
                posixpath.basename(m.staged) for m in messages if m and m.staged})]:
            files.delete_file(posixpath.join(folder, name))
        rest = plain - set(old)
        target = posixpath.join(folder, MANIFEST)
        if known and rest == {f.name for f in listed or []}:
            rows = sorted([*(listed or []), *made], key=lambda f: f.name)
            with files.open_output_stream(target) as out:
                out.write(json.dumps([asdict(f) for f in rows]).encode())
        elif MANIFEST in names:
            files.delete_file(target)

    def abort(self, messages: list[Written | None]) -> None:
        files, folder = file_system(self.path)
        for name in self._own(files, folder):
            if name.startswith(f"_{self.run}"):
                files.delete_file(posixpath.join(folder, name))


class MatrixDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        kind = "smallint" if _lowered(self.options).get("as") == "smallint" else "float"
        kinds = {"shard": "string", "row_index": "bigint", "embedding": f"array<{kind}>"}
        columns = _lowered(self.options).get("columns", ",".join(_COLUMNS)).split(",")
        return ", ".join(f"{c.strip()} {kinds[c.strip()]}" for c in columns)

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(_lowered(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(_lowered(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the source known; it needs Spark to offer it the filters of a query."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MatrixDataSource)


def read_vectors(spark: SparkSession, path: str, kind: str = "npy", dtype: str | None = None,
                 dim: int | None = None, **options: str) -> DataFrame:
    """Vectors of a file or folder as ``shard, row_index, embedding``."""
    register(spark)
    reader = spark.read.format("matrix").option("kind", kind)
    if kind == "raw":
        if dtype is None or dim is None:
            raise ValueError("a raw file needs dtype and dim")
        reader = reader.option("dtype", dtype).option("dim", str(dim))
    return reader.options(**options).load(path)


def write_vectors(df: DataFrame, path: str, vector: str = "embedding", dtype: str = "float32",
                  order_by: str | None = None, files: int | None = None) -> None:
    """One ``.npy`` file per task; with ``order_by`` the files hold consecutive ranges."""
    register(df.sparkSession)
    if order_by is not None:
        ranged = df.repartitionByRange(files, order_by) if files else df.repartitionByRange(order_by)
        df = ranged.sortWithinPartitions(order_by)
    elif files:
        df = df.repartition(files)
    df.select(df[vector].alias("embedding")).write.format("matrix").option(
        "dtype", dtype).mode("overwrite").save(path)
