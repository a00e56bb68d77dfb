"""Row-numbered matrices: ``.npy`` files as a Spark format.

The matrix files have no ids: row i belongs to row i of an id table. The format
``npy`` reads a file, or a folder of files that follow each other by name, in
ranges of rows planned from the files' headers, as (row, embedding); each task
seeks to its range. Values of 2, 4 or 8 bytes become floats.

The writer takes rows sorted by number within each partition (``write_matrix``
sorts them by range) in any float type, cuts them into parts of bounded size,
and at the commit requires the rows 0 to n - 1, each once: a gap or a repeated
number fails the job, and nothing appears.

``read_matrix`` joins an id table by row number; lengths that differ are an
error, as a shifted matrix gives every entry another's vector.

    register(spark)
    spark.read.format("npy").load(path)                       # (row, embedding)
    write_matrix(df, path, dtype="float16")                   # df: (row, embedding)
    read_matrix(spark, path, ids)                             # ids: (EntryID, row)
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from protea.session import ship
from protea.sources.files import Staging, Written, data_files, filesystem

SCHEMA = "row BIGINT, embedding ARRAY<FLOAT>"
RANGE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
DTYPES = ("float16", "float32", "float64")


@dataclass
class Rows(InputPartition):
    """A range of one file's rows."""
    path: str
    offset: int
    first: int
    count: int
    width: int
    dtype: str


def file_header(f) -> tuple[int, int, np.dtype, int]:
    """(rows, width, type, offset of the first row) of an open matrix file."""
    version = np.lib.format.read_magic(f)
    if version == (1, 0):
        shape, fortran, dtype = np.lib.format.read_array_header_1_0(f)
    elif version == (2, 0):
        shape, fortran, dtype = np.lib.format.read_array_header_2_0(f)
    else:
        raise ValueError(f"npy version {version} is not known")
    if len(shape) != 2 or fortran or dtype.kind != "f":
        raise ValueError(f"a matrix of floats by rows is needed, found {dtype} {shape}{' by columns' * fortran}")
    return shape[0], shape[1], dtype, f.tell()


def matrix_files(path: str) -> list[Rows]:
    """Each file as one range, numbered on from the one before."""
    fs, _ = filesystem(path)
    out, first = [], 0
    for p, size in data_files(path):
        with fs.open_input_file(p) as f:
            rows, width, dtype, offset = file_header(f)
        if size != offset + rows * width * dtype.itemsize:
            raise ValueError(f"{p}: {size} bytes do not hold {rows} rows of {width}")
        if rows and out and width != out[-1].width:
            raise ValueError(f"{p}: rows of {width} values after rows of {out[-1].width}")
        if rows:
            out.append(Rows(p, offset, first, rows, width, dtype.str))
        first += rows
    return out


def matrix_rows(path: str) -> int:
    """Number of rows, from the headers alone."""
    return sum(p.count for p in matrix_files(path))


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Rows]:
        out = []
        for p in matrix_files(self.path):
            size = p.width * np.dtype(p.dtype).itemsize
            step = max(1, self.range_bytes // max(1, size))
            out += [Rows(p.path, p.offset + at * size, p.first + at, min(step, p.count - at), p.width, p.dtype)
                    for at in range(0, p.count, step)]
        return out

    def read(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no rows, so no partitions
            return
        dtype = np.dtype(part.dtype)
        size = part.width * dtype.itemsize
        step = max(1, BATCH_BYTES // max(1, size))
        fs, _ = filesystem(self.path)
        with fs.open_input_file(part.path) as f:
            for at in range(0, part.count, step):
                n = min(step, part.count - at)
                data = f.read_at(n * size, part.offset + at * size)
                if len(data) != n * size:
                    raise EOFError(f"{part.path} ends within row {part.first + at + len(data) // size}")
                values = np.frombuffer(data, dtype).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * part.width, pa.int32()), pa.array(values))
                rows = pa.array(np.arange(part.first + at, part.first + at + n))
                yield pa.RecordBatch.from_arrays([rows, vectors], ["row", "embedding"])


class MatrixWriter(DataSourceArrowWriter):
    def __init__(self, path: str, dtype: str, overwrite: bool, part_bytes: int):
        if dtype not in DTYPES:
            raise ValueError(f"dtype is one of {DTYPES}, not {dtype}")
        self.staging, self.dtype, self.part_bytes = Staging(path, overwrite), np.dtype(dtype), part_bytes
        self.staging.start()

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        parts: list[tuple[str, int, int]] = []
        held: list[np.ndarray] = []
        first = following = None

        def close():
            nonlocal held, first
            if held:
                block = np.concatenate(held)
                name, f = self.staging.create(".npy")
                with f:
                    head = io.BytesIO()
                    np.lib.format.write_array_header_1_0(
                        head, {"descr": self.dtype.str, "fortran_order": False, "shape": block.shape})
                    f.write(head.getvalue())
                    f.write(block.tobytes())
                parts.append((name, first, len(block)))
            held, first = [], None

        for batch in batches:
            rows, vectors = batch.column("row"), batch.column("embedding")
            values = vectors.flatten()
            if not len(rows):
                continue
            if rows.null_count or vectors.null_count or values.null_count:
                raise ValueError("a matrix has no place for null rows, vectors or values")
            widths = np.unique(vectors.value_lengths().to_numpy())
            if len(widths) > 1:
                raise ValueError(f"rows of {widths[0]} and of {widths[-1]} values in one matrix")
            numbers = rows.to_numpy()
            block = values.to_numpy().reshape(len(rows), int(widths[0])).astype(self.dtype)
            if (np.diff(numbers) != 1).any() or (following is not None and numbers[0] != following):
                raise ValueError(f"rows about {numbers[0]} do not follow each other; sort them by number")
            if held and held[0].shape[1] != block.shape[1]:
                raise ValueError(f"rows of {held[0].shape[1]} and of {block.shape[1]} values in one matrix")
            first = int(numbers[0]) if first is None else first
            following = int(numbers[-1]) + 1
            held.append(block)
            if sum(b.nbytes for b in held) >= self.part_bytes:
                close()
        close()
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((p for m in messages if m is not None for p in m.parts), key=lambda p: p[1])
        row = 0
        for _, first, rows in parts:
            if first != row:
                self.staging.drop()
                raise ValueError(f"row {row} is missing" if first > row else f"row {first} is there twice")
            row += rows
        self.staging.publish([p[0] for p in parts], ".npy")

    def abort(self, messages: list[Written | None]) -> None:
        self.staging.drop()


class MatrixSource(DataSource):
    """Options: ``dtype`` (writer), ``range_bytes`` (reader), ``part_bytes`` (writer)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options["path"], self.options.get("dtype", "float32"), overwrite,
                            int(self.options.get("part_bytes", RANGE_BYTES)))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(MatrixSource)


def write_matrix(df: DataFrame, path: str, dtype: str = "float32", row: str = "row",
                 vector: str = "embedding") -> None:
    """``row`` numbers 0 to n - 1 and their vectors, as a folder of ``.npy`` files."""
    register(df.sparkSession)
    (df.select(F.col(row).cast("long").alias("row"), F.col(vector).cast("array<float>").alias("embedding"))
     .repartitionByRange("row").sortWithinPartitions("row")
     .write.format("npy").option("dtype", dtype).mode("overwrite").save(path))


def read_matrix(spark: SparkSession, path: str, ids: DataFrame, row: str = "row") -> DataFrame:
    """``ids`` (row numbers 0 to n - 1 in ``row``) with the ``embedding`` of each."""
    register(spark)
    have = ids.agg(F.count(row).alias("n"), F.count_distinct(row).alias("d"),
                   F.min(row).alias("lo"), F.max(row).alias("hi")).first()
    n = matrix_rows(path)
    if (have.n, have.d) != (n, n) or (n and (have.lo, have.hi) != (0, n - 1)):
        raise ValueError(f"{path} has {n} rows, the ids have {have.n} ({have.d} numbers from {have.lo} to {have.hi})")
    m = spark.read.format("npy").load(path).select(F.col("row").alias("_matrix_row"), "embedding")
    return ids.join(m, ids[row] == m["_matrix_row"]).drop("_matrix_row")
