"""NumPy files (.npy, .npz) as a Spark data source.

Planning reads headers only. An array's rows lie end to end in its file, so a partition is a range of rows, and a task reads the bytes of that
range of the columns asked for. Files are opened by URI (file, hdfs, s3, gs), so they need not be local to anyone. Compressed members,
Fortran-ordered and pickled arrays have no such ranges: their files are one partition each.
"""

from __future__ import annotations

import ast
import io
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20

_KINDS: dict[str, DataType] = {"f8": DoubleType(), "f4": FloatType(), "i8": LongType(), "i4": IntegerType(), "i2": ShortType(), "i1": ByteType(), "u1": ShortType(), "u2": IntegerType(), "u4": LongType(), "b1": BooleanType(), "f2": FloatType()}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The .npy and .npz files at a path, a file or a folder, in byte order, as URIs of the path's kind."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [at] if info.is_file else [f.path for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.is_file and f.path.endswith((".npy", ".npz")) and not f.base_name.startswith(("_", "."))]
    head = path[: len(path) - len(at)] if path.endswith(at) else path.split("://")[0] + "://" if "://" in path else ""
    return [head + f for f in sorted(found)]


@dataclass(frozen=True)
class Header:
    """An array in a file: where its data begin (None: not in plain rows), its type and shape; member: its name in an .npz."""

    member: str
    dtype: str
    shape: tuple[int, ...]
    offset: int | None

    @property
    def row_bytes(self) -> int:
        return np.dtype(self.dtype).itemsize * int(np.prod(self.shape[1:], dtype=np.int64))


def _npy_header(stream) -> tuple[str, tuple[int, ...], bool, int]:
    """(type, shape, Fortran order, bytes of the header)."""
    magic = stream.read(8)
    if magic[:6] != b"\x93NUMPY":
        raise ValueError("no NumPy array")
    size = 2 if magic[6] == 1 else 4
    n = int.from_bytes(stream.read(size), "little")
    found = ast.literal_eval(stream.read(n).decode("utf-8" if magic[6] >= 3 else "latin1"))
    return found["descr"], tuple(found["shape"]), found["fortran_order"], 8 + size + n


def headers(path: str) -> list[Header]:
    """The arrays of a file; their data aren't read."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        if not at.endswith(".npz"):
            kind, shape, fortran, n = _npy_header(f)
            return [Header("value", kind, shape, None if fortran or "O" in kind else n)]
        out = []
        with zipfile.ZipFile(f) as z:
            for member in z.infolist():
                with z.open(member) as s:
                    kind, shape, fortran, n = _npy_header(s)
                plain = member.compress_type == zipfile.ZIP_STORED and not fortran and "O" not in kind
                begin = None
                if plain:
                    f.seek(member.header_offset + 26)
                    name, extra = struct.unpack("<HH", f.read(4))
                    begin = member.header_offset + 30 + name + extra + n
                out.append(Header(member.filename.removesuffix(".npy"), kind, shape, begin))
        return out


def _column_type(h: Header) -> DataType:
    kind = np.dtype(h.dtype)
    if kind.kind == "O":
        return ArrayType(ArrayType(DoubleType()))  # rows of different lengths
    if kind.kind in "US":
        out: DataType = StringType()
    else:
        out = _KINDS.get(kind.str[1:])
        if out is None:
            raise ValueError(f"{h.member}: no column type for {kind}")
    for _ in h.shape[1:]:
        out = ArrayType(out)
    return out


def _column(values: np.ndarray) -> pa.Array:
    """Rows as an Arrow column, nested as deep as they have dimensions."""
    if values.dtype.kind == "O":
        return pa.array([None if v is None else np.atleast_2d(np.asarray(v, float)).tolist() for v in values], pa.list_(pa.list_(pa.float64())))
    if values.dtype.kind in "US":
        return pa.array(values.astype(str).tolist(), pa.string())
    flat = values.astype(values.dtype.newbyteorder("=")).reshape(-1)
    if flat.dtype == np.float16:
        flat = flat.astype(np.float32)
    elif flat.dtype.kind == "u":
        flat = flat.astype({1: np.int16, 2: np.int32}.get(flat.dtype.itemsize, np.int64))
    out = pa.array(flat)
    for size in values.shape[:0:-1]:
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, size) if size else np.zeros(len(values) + 1), pa.int32()), out)
    return out


@dataclass
class Rows(InputPartition):
    """A range of rows of one file."""

    path: str
    arrays: list[Header]
    low: int
    high: int


class ArrayReader(DataSourceReader):
    """options by lower-case names, as Spark compares them."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.limit = int(options.get("partitionbytes", PARTITION_BYTES))
        self.pickles = options.get("allowpickle", "false").lower() == "true"

    def partitions(self):
        wanted = [f.name for f in self.schema if f.name not in ("path", "row")]
        out = []
        for path in listed(self.path):
            known = {h.member: h for h in headers(path)}
            lacking = [c for c in wanted if c not in known]
            if lacking:
                raise ValueError(f"{path} has no array {', '.join(lacking)}")
            arrays = [known[c] for c in wanted]
            lengths = {h.shape[0] for h in (arrays or [h for h in known.values() if h.shape])}
            if len(lengths) != 1:
                raise ValueError(f"{path}: arrays of {sorted(lengths)} rows are no columns of one table")
            n = lengths.pop()
            if any(np.dtype(h.dtype).kind == "O" for h in arrays) and not self.pickles:
                raise ValueError(f"{path} holds pickled objects; allowPickle reads them, from sources that are trusted")
            step = n if any(h.offset is None for h in arrays) else max(1, self.limit // max(1, sum(h.row_bytes for h in arrays)))
            out += [Rows(path, arrays, low, min(n, low + step)) for low in range(0, n, max(1, step))]
        return out or [Rows("", [], 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.low == p.high:
            return
        system, at = opened(p.path)
        width = sum(h.row_bytes for h in p.arrays if h.offset is not None)
        step = max(1, BATCH_BYTES // max(1, width))
        whole = {}
        with system.open_input_file(at) as f:
            for h in p.arrays:
                if h.offset is None:
                    if at.endswith(".npz"):
                        with zipfile.ZipFile(f) as z, z.open(f"{h.member}.npy") as s:
                            whole[h.member] = np.load(io.BytesIO(s.read()), allow_pickle=self.pickles)
                    else:
                        f.seek(0)
                        whole[h.member] = np.load(io.BytesIO(f.read()), allow_pickle=self.pickles)
            for low in range(p.low, p.high, step):
                high = min(p.high, low + step)
                columns = {"path": pa.array([p.path] * (high - low), pa.string()), "row": pa.array(np.arange(low, high))}
                for h in p.arrays:
                    if h.offset is None:
                        columns[h.member] = _column(whole[h.member][low:high])
                    else:
                        f.seek(h.offset + low * h.row_bytes)
                        raw = f.read((high - low) * h.row_bytes)
                        columns[h.member] = _column(np.frombuffer(raw, h.dtype).reshape(high - low, *h.shape[1:]))
                yield pa.RecordBatch.from_arrays([columns[x.name] for x in self.schema], names=[x.name for x in self.schema])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArrayWriter(DataSourceArrowWriter):
    """One uncompressed .npz a batch of about PARTITION_BYTES, under a hidden name until the job commits."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.limit = int(options.get("partitionbytes", PARTITION_BYTES))
        self.token = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        held, size, files = [], 0, []

        def put():
            name = f"{at}/.{self.token}-{uuid.uuid4().hex}.npz"
            table = pa.Table.from_batches(held)
            with system.open_output_stream(name) as f:
                buffer = io.BytesIO()
                np.savez(buffer, **{c: _rows_of(table[c].combine_chunks()) for c in table.column_names})
                f.write(buffer.getvalue())
            files.append(name)

        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= self.limit:
                put()
                held, size = [], 0
        if held and sum(b.num_rows for b in held):
            put()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = opened(self.path)
        files = [f for m in messages if m for f in m.files]
        old = [f.path for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.is_file and not f.base_name.startswith(".")] if self.overwrite else []
        for f in files:
            system.move(f, f"{at}/part-{f.rsplit('/.', 1)[1]}")
        for f in old:
            system.delete_file(f)

    def abort(self, messages: list[Written | None]) -> None:
        system, at = opened(self.path)
        for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith(f".{self.token}-"):
                system.delete_file(f.path)


def _rows_of(column: pa.Array) -> np.ndarray:
    """An Arrow column as an array; lists must be of one length. A null is an error, as the file format has none."""
    if column.null_count:
        raise ValueError("an array file has no nulls")
    shape = [len(column)]
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        sizes = np.diff(column.offsets.to_numpy())
        if len(sizes) and sizes.min() != sizes.max():
            raise ValueError("lists of different lengths make no array")
        shape.append(int(sizes[0]) if len(sizes) else 0)
        column = column.flatten()
        if column.null_count:
            raise ValueError("an array file has no nulls")
    values = np.array(column.to_pylist(), str) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)
    return values.reshape(shape)


class ArraySource(DataSource):
    """format("arrays"): option path, a file or folder; columns, names by comma; partitionBytes; allowPickle for arrays of objects.

    Columns: path, row (its number in the file) and the arrays, `value` for an .npy. Of a given schema only its columns are read.
    """

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> StructType:
        files = listed(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no array files at {self.options['path']}")
        known = {h.member: h for h in headers(files[0]) if h.shape}
        names = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else list(known)
        lacking = [c for c in names if c not in known]
        if lacking:
            raise ValueError(f"{files[0]} has no array {', '.join(lacking)}")
        return StructType([StructField("path", StringType()), StructField("row", LongType()), *[StructField(c, _column_type(known[c])) for c in names]])

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(schema, {k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """The arrays at path as a table; only the named columns' bytes are read."""
    spark.dataSource.register(ArraySource)
    more = {"columns": ",".join(columns)} if columns else {}
    return spark.read.format("arrays").options(path=path, **more, **options).load()


def write(df: DataFrame, path: str, overwrite: bool = True, **options) -> None:
    """df's columns as .npz files, which appear when all are written."""
    df.sparkSession.dataSource.register(ArraySource)
    df.write.format("arrays").mode("overwrite" if overwrite else "append").options(path=path, **options).save()


#: Name of the dataset's array of beats: what it is a dataset of.
BEAT_ARRAYS = {"sa_wingbeats": "sa", "single_wing_wingbeats": "single_wing"}


def read_beats(spark: SparkSession, path: str, more: list[str] | None = None) -> tuple[DataFrame, str]:
    """(rows with the column `beat`, representation) of a dataset of fixed-length beats; which array it has tells the representation."""
    names = {h.member for f in listed(path)[:1] for h in headers(f)}
    found = [k for k in BEAT_ARRAYS if k in names]
    if len(found) != 1:
        raise ValueError(f"{path} has {len(found)} of the arrays {', '.join(BEAT_ARRAYS)}")
    return read(spark, path, [found[0], *(more or [])]).withColumnRenamed(found[0], "beat"), BEAT_ARRAYS[found[0]]
