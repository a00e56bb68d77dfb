"""FASTA as a Spark format, with planned byte ranges.

``spark.read.format("fasta").load(path)`` gives the records that
``fasta.read_fasta`` gives. A record belongs to the range that holds the line
end before its ``>`` (the first one to the file's first range), so ranges need
nothing of each other, and a task reads on into the next until its last record
ends. Files in block gzip are ranged as well: a task finds the first block of
its range by the block's header and check sum. A plain gzip file, of one member
or many, is one range, read as a stream.

A schema with fewer columns (``.schema("EntryID string")``) is pruned in the
tasks: sequences that nobody asks for are not built.

The writer wraps lines and writes one file a task, plain, ``gzip`` or ``bgzf``
(option ``compression``); files appear when the job commits.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from protea.session import ship
from protea.sources.fasta import LINE_WIDTH
from protea.sources.files import Staging, Written, data_files, filesystem

COLUMNS = ("EntryID", "seq", "description")
RANGE_BYTES = 64 << 20
PIECE = 1 << 20
SPACE = b" \t\n\x0b\f\r"
FIRST_WORD = re.compile(rb"[ \t\n\x0b\f\r]*([^ \t\n\x0b\f\r]+)")
# fixed values of block gzip: magic, largest block, the empty block that ends a file
BLOCK_MAGIC = b"\x1f\x8b\x08\x04"
BLOCK_MOST = 1 << 16
BLOCK_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


@dataclass
class Range(InputPartition):
    path: str
    size: int
    lo: int
    hi: int
    kind: str  # plain, bgzf, gzip


# ------------------------------------------------------------ bytes of a range

def block_size(head: bytes) -> int | None:
    """Whole size of the gzip block at the start of ``head``, if it is one."""
    if len(head) < 18 or head[:4] != BLOCK_MAGIC:
        return None
    extra = head[12:12 + struct.unpack_from("<H", head, 10)[0]]
    while len(extra) >= 4:
        n = struct.unpack_from("<H", extra, 2)[0]
        if extra[:2] == b"BC" and n == 2 and len(extra) >= 6:
            return struct.unpack_from("<H", extra, 4)[0] + 1
        extra = extra[4 + n:]
    return None


def first_block(f, size: int, lo: int) -> int:
    """Offset of the first block at or after ``lo``: its header and check sum fit."""
    data = f.read_at(min(size - lo, 2 * BLOCK_MOST), lo)
    at = data.find(BLOCK_MAGIC)
    while at >= 0:
        n = block_size(data[at:])
        if n and at + n <= len(data):
            try:
                zlib.decompress(data[at:at + n], 31)
                return lo + at
            except zlib.error:
                pass
        at = data.find(BLOCK_MAGIC, at + 1)
    return size


def pieces(f, part: Range) -> Iterator[tuple[bytes, bool]]:
    """Text from the range's start to the file's end, and whether it is the
    range's own; the caller stops when it has its last record."""
    if part.kind == "plain":
        at = part.lo
        while at < part.size:
            n = min(PIECE, (part.hi if at < part.hi else part.size) - at)
            yield f.read_at(n, at), at < part.hi
            at += n
    elif part.kind == "bgzf":
        at = part.lo if part.lo == 0 else first_block(f, part.size, part.lo)
        while at < part.size:
            data = f.read_at(min(BLOCK_MOST, part.size - at), at)
            n = block_size(data)
            if n is None or n > len(data):
                raise ValueError(f"{part.path}: no whole block at byte {at}")
            yield zlib.decompress(data[:n], 31), at < part.hi
            at += n
    else:
        unpack = zlib.decompressobj(31)
        at, inside = 0, False
        while at < part.size:
            data = f.read_at(min(PIECE, part.size - at), at)
            at += len(data)
            while data:
                yield unpack.decompress(data, PIECE), True
                data, inside = unpack.unconsumed_tail, not unpack.eof
                if unpack.eof:  # the next member
                    data = unpack.unused_data
                    unpack = zlib.decompressobj(31)
        if inside:
            raise ValueError(f"{part.path} ends within a member")


def records(text: Iterator[tuple[bytes, bool]], first: bool) -> Iterator[bytes]:
    """The range's records, whole, without their ``>``."""
    mine: list[bytes] | None = [] if first else None
    held, held_own = b"", False  # a line end that the next piece may go on from
    for data, own in text:
        if not data:
            continue
        had, data = bool(held), held + data
        at = 0
        while (mark := data.find(b"\n>", at)) >= 0:
            if mine is not None:
                mine.append(data[at:mark])
                yield b"".join(mine)
            mine = [] if (held_own if had and mark == 0 else own) else None
            if mine is None:
                return
            at = mark + 2
        if mine is None and not own:
            return
        held, held_own = (b"\n", own) if data.endswith(b"\n") and at < len(data) else (b"", own)
        if mine is not None:
            mine.append(data[at:len(data) - len(held)])
    if mine is not None:
        yield b"".join(mine) + held


def fields(record: bytes, has_metadata: bool, strict: bool, names: list[str]) -> list[str | None]:
    """The asked-for columns of one record."""
    header, _, body = record.partition(b"\n")
    if header.endswith(b"\r"):
        header = header[:-1]
    word = FIRST_WORD.match(header)
    out: list[str | None] = []
    for name in names:
        if name == "EntryID":
            key: bytes | None = word.group(1) if word else b""
            if has_metadata:
                split = key.split(b"|")
                if len(split) < 2 and strict:
                    raise ValueError(f"header without a second field: {header.decode(errors='replace')}")
                key = split[1] if len(split) > 1 else None
            out.append(None if key is None else key.decode("utf-8", "replace"))
        elif name == "seq":
            out.append(body.translate(None, SPACE).decode("utf-8", "replace"))
        else:
            out.append((header[word.end():] if word else b"").strip(SPACE).decode("utf-8", "replace"))
    return out


# ------------------------------------------------------------ source

class FastaReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, has_metadata: bool, strict: bool, range_bytes: int):
        unknown = set(schema.names) - set(COLUMNS)
        if unknown or any(f.dataType != T.StringType() for f in schema):
            raise ValueError(f"columns are strings among {COLUMNS}, not {schema.simpleString()}")
        self.path, self.names = path, schema.names
        self.has_metadata, self.strict, self.range_bytes = has_metadata, strict, max(1, range_bytes)

    def partitions(self) -> list[Range]:
        fs, _ = filesystem(self.path)
        out = []
        for path, size in data_files(self.path):
            kind = "plain"
            if path.endswith((".gz", ".bgz")):
                with fs.open_input_file(path) as f:
                    kind = "gzip" if block_size(f.read(512)) is None else "bgzf"
            step = max(1, size) if kind == "gzip" else self.range_bytes
            out += [Range(path, size, lo, min(size, lo + step), kind) for lo in range(0, size, step)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        fs, _ = filesystem(self.path)
        schema = pa.schema([(n, pa.string()) for n in self.names])
        rows, weight = [], 0
        with fs.open_input_file(part.path) as f:
            for i, record in enumerate(records(pieces(f, part), part.lo == 0)):
                if not record.strip(b" "):
                    continue
                if i == 0 and part.lo == 0 and record.startswith(b">"):
                    record = record[1:]
                rows.append(fields(record, self.has_metadata, self.strict, self.names))
                weight += len(record)
                if weight > 8 * PIECE or len(rows) == 10_000:
                    yield self._batch(rows, schema)
                    rows, weight = [], 0
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[list[str | None]], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)


def _packed(text: bytes) -> bytes:
    """One gzip block with its size in the header; it starts another member."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(text) + z.flush()
    size = 18 + len(body) + 8
    return (BLOCK_END[:16] + struct.pack("<H", size - 1) + body
            + struct.pack("<II", zlib.crc32(text), len(text)))


class FastaWriter(DataSourceArrowWriter):
    SUFFIX = {"none": ".fasta", "gzip": ".fasta.gz", "bgzf": ".fasta.gz"}

    def __init__(self, path: str, schema: T.StructType, overwrite: bool, width: int, compression: str):
        if compression not in self.SUFFIX:
            raise ValueError(f"compression is one of {sorted(self.SUFFIX)}, not {compression}")
        if not {"EntryID", "seq"} <= set(schema.names):
            raise ValueError(f"EntryID and seq are needed, found {schema.names}")
        self.staging, self.width, self.compression = Staging(path, overwrite), width, compression
        self.described = "description" in schema.names
        self.staging.start()

    def _text(self, batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            ids = batch.column("EntryID").cast(pa.string()).to_pylist()
            seqs = batch.column("seq").cast(pa.string()).to_pylist()
            notes = batch.column("description").to_pylist() if self.described else [None] * len(ids)
            for key, seq, note in zip(ids, seqs, notes):
                if key is None or re.search(r"\s", key):
                    raise ValueError(f"an id is one word, not {key!r}")
                head = f">{key} {note}" if note else f">{key}"
                if "\n" in head or "\r" in head:
                    raise ValueError(f"a description is one line: {head!r}")
                seq = seq or ""
                lines = [seq[i:i + self.width] for i in range(0, len(seq), self.width)] or [""]
                yield ("\n".join([head, *lines]) + "\n").encode()

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext
        name, f = self.staging.create(self.SUFFIX[self.compression])
        rows, held = 0, bytearray()
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        most = 0xFF00 if self.compression == "bgzf" else PIECE

        def put(block: bytes) -> None:
            f.write(_packed(block) if self.compression == "bgzf"
                    else z.compress(block) if self.compression == "gzip" else block)
        with f:
            for record in self._text(batches):
                rows += 1
                held += record
                if len(held) >= most:
                    cut = len(held) // most * most
                    for at in range(0, cut, most):
                        put(bytes(held[at:at + most]))
                    del held[:cut]
            if held:
                put(bytes(held))
            if self.compression != "none":
                f.write(BLOCK_END if self.compression == "bgzf" else z.flush())
        return Written([(name, TaskContext.get().partitionId(), rows)])

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((p for m in messages if m is not None for p in m.parts if p[2]), key=lambda p: p[1])
        self.staging.publish([p[0] for p in parts], self.SUFFIX[self.compression])

    def abort(self, messages: list[Written | None]) -> None:
        self.staging.drop()


class FastaSource(DataSource):
    """Options: ``has_metadata``, ``strict`` (as ``fasta.read_fasta``),
    ``range_bytes``; for the writer ``width`` and ``compression``."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return ", ".join(f"{c} STRING" for c in COLUMNS)

    def _flag(self, name: str, default: str) -> bool:
        return str(self.options.get(name, default)).lower() == "true"

    def reader(self, schema: T.StructType) -> FastaReader:
        return FastaReader(self.options["path"], schema, self._flag("has_metadata", "false"),
                           self._flag("strict", "true"), int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> FastaWriter:
        return FastaWriter(self.options["path"], schema, overwrite, int(self.options.get("width", LINE_WIDTH)),
                           self.options.get("compression", "none"))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FastaSource)
