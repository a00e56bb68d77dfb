"""SentencePiece encoding and decoding through a table of distinct chunks.

Where two characters stand side by side in no piece of the model, no piece can
cross their boundary: texts are cut there (in front of white space markers
above all), and each chunk is segmented on its own. Three steps:

1. One pass over the texts cuts them. A block (some megabytes of texts) numbers
   its distinct chunks; each text becomes the row of its chunks' numbers. Both
   kinds of rows go to one table in the shared folder, bucketed by block.
2. The distinct chunks of the blocks meet by chunk (one shuffle, of a row per
   block and chunk). Each is segmented once, by the library, and its ids go
   back to the blocks that have it.
3. Each block joins them to its rows of numbers by position, and what the ids
   decode to likewise. The texts' side is bucketed and is not shuffled.

A frequent chunk has a row per block at most, never one per occurrence. The
largest group is a block.

Models that are not BPE over plain text with a marker in front (other
normalisation, other algorithms) are not cut: there a chunk is a whole text.

Cases: a null or empty text has no ids but the end id; a literal marker
(U+2581) counts as the space it stands for, as in the library; repeated rows
and null ids stay, each row on its own; an empty table gives an empty result.
The result has the columns of this operator only, so others cannot clash.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from protea.llm.bpe import _slices, tokenizer_path
from protea.llm.common import scratch_path, ship, text_of

MODEL = "piece_bpe_32k.model"
MARKER = "▁"
BLOCK_CHARS = 32 << 20


class Pieces:
    """A model, where texts may be cut for it, and its segmentation."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        with open(tokenizer_path(model), "rb") as f:
            data = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(data)
        n = spec.normalizer_spec
        plain = {1, 2, 3, 6}  # kinds of pieces: ordinary, unknown, control, byte
        self.cuts = (spec.trainer_spec.model_type == 2 and not n.precompiled_charsmap and n.add_dummy_prefix
                     and n.escape_whitespaces and not n.remove_extra_whitespaces
                     and not spec.trainer_spec.treat_whitespace_as_suffix and {p.type for p in spec.pieces} <= plain)
        long = [p.piece for p in spec.pieces if p.type == 1 and len(p.piece) > 1]
        letters = sorted(set("".join(long)))
        # a character that is in no longer piece stands before each chunk, so
        # that the marker that the library puts in front does not touch it
        self.guard = next(c for c in map(chr, range(10, 0x3000)) if c not in letters)
        self.guard_ids = len(self.library.encode(self.guard))
        self.wide = "<u2" if self.library.get_piece_size() <= 1 << 16 else "<u4"
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        k = len(letters) + 1
        self.joined = np.zeros((k, k), bool)
        for p in long:
            at = self.number[[ord(c) for c in p]]
            self.joined[at[:-1], at[1:]] = True

    def chunks(self, text: str) -> list[str]:
        """The text with its markers, cut."""
        if not text:
            return []
        if not self.cuts:
            return [text]
        text = MARKER + text.replace(" ", MARKER)
        at = self.number[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        ends = (np.flatnonzero(~self.joined[at[:-1], at[1:]]) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]

    def segment(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk, as numbers of ``self.wide``."""
        g, skip = (self.guard, self.guard_ids) if self.cuts else ("", 0)
        return [np.array(x[skip:], self.wide).tobytes() for x in self.library.encode([g + c for c in chunks], num_threads=1)]

    def texts(self, ids: list[bytes]) -> tuple[list[str], list[str]]:
        """Ids of each chunk as text, and what they decode to."""
        lists = [np.frombuffer(x, self.wide).tolist() for x in ids]
        g = self.guard if self.cuts else ""
        before = self.library.encode(g)
        decoded = self.library.decode([before + x for x in lists], num_threads=1) if lists else []
        if any(not d.startswith(g) for d in decoded):
            raise ValueError("a chunk does not decode after its guard")
        return [" ".join(map(str, x)) for x in lists], [d[len(g):] for d in decoded]

    def whole(self, decoded: str) -> str:
        """A text joined from its chunks, without the space in front."""
        return decoded[1:] if self.cuts else decoded


_PIECES: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    """One per Python worker."""
    if model not in _PIECES:
        _PIECES.clear()
        _PIECES[model] = Pieces(model)
    return _PIECES[model]


def pack(numbers: np.ndarray) -> bytes:
    """Numbers in groups of seven bits, low ones first; the last has no high bit."""
    groups = [numbers >> np.uint32(7 * k) for k in range(5)]
    some = np.stack([groups[0] >= 0, *(g > 0 for g in groups[1:])], 1)
    parts = np.stack(groups, 1) & 127
    parts[:, :-1] |= some[:, 1:].astype(parts.dtype) << 7
    return parts[some].astype(np.uint8).tobytes()


def unpack(data: bytes) -> np.ndarray:
    groups = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(groups < 128)
    first = np.append(0, last[:-1] + 1)[:len(last)]
    out = np.zeros(len(last), np.uint32)
    for k in range(5):
        some = np.flatnonzero(first + k <= last)
        out[some] |= (groups[first[some] + k] & np.uint32(127)) << np.uint32(7 * k)
    return out


def _cut(model: str, names: list[str], key_type: pa.DataType, block_chars: int):
    """Texts to rows of numbers and the chunks that these stand for, a block
    after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        blocks = count(TaskContext.get().partitionId() << 32)
        block, book, size = next(blocks), defaultdict(count().__next__), 0

        def chunk_rows() -> Iterator[pa.RecordBatch]:
            chunks = list(book)
            for a in range(0, len(chunks), 50_000):
                some = chunks[a:a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(some), pa.int64()), pa.nulls(len(some), key_type), pa.nulls(len(some), pa.binary()),
                     pa.array(range(a, a + len(some)), pa.int64()), pa.array(some, pa.string())], names)
        for batch in batches:
            for part in _slices(batch, 1):
                texts = part.column(1).to_pylist()
                packed = []
                for t in texts:
                    chunks = p.chunks(t)
                    packed.append(pack(np.fromiter(map(book.__getitem__, chunks), np.uint32, len(chunks))))
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), part.column(0), pa.array(packed, pa.binary()),
                     pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names)
                size += sum(map(len, texts))
                if size >= block_chars:
                    yield from chunk_rows()
                    block, book, size = next(blocks), defaultdict(count().__next__), 0
        yield from chunk_rows()
    return run


def _segment(model: str):
    """Rows sorted by chunk: each distinct chunk is segmented once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        before: tuple[str, bytes] | None = None
        for batch in batches:
            chunks = batch.column(2).to_pylist()
            new = [c for c in dict.fromkeys(chunks) if before is None or c != before[0]]
            known = dict(zip(new, p.segment(new)))
            if before is not None:
                known.setdefault(*before)
            if chunks:
                before = (chunks[-1], known[chunks[-1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(known.__getitem__, chunks), pa.binary())],
                                             ["block", "no", "ids"])
    return run


def _join(model: str, ends: list[str]):
    """A block's rows of numbers and its chunks, joined by position."""
    def run(rows: pa.Table, chunks: pa.Table) -> pa.Table:
        p = pieces(model)
        n = chunks.num_rows
        order = np.argsort(chunks.column("no").to_numpy())
        if rows.num_rows and (n != 0) and int(chunks.column("no").to_numpy().max()) != n - 1:
            raise ValueError("chunks of a block are missing")
        ids, decoded = p.texts(chunks.column("ids").take(pa.array(order)).to_pylist())
        all_ids, texts = [], []
        for packed in rows.column("numbers").to_pylist():
            at = unpack(packed).tolist()
            all_ids.append(" ".join([*map(ids.__getitem__, at), *ends]))
            texts.append(p.whole("".join(map(decoded.__getitem__, at))))
        return pa.table([rows.column("id"), pa.array(all_ids, pa.string()), pa.array(texts, pa.string())],
                        ["id", "ids", "decoded"])
    return run


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text",
           end: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id, ids (decimal, joined by one space) and decoded text of every row;
    ``end`` adds the model's end id. ``block_chars`` bounds what a task holds
    at once (a block, or one longer text); it changes no result."""
    spark = docs.sparkSession
    ship(spark)
    library = Pieces(model).library
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    key = dict(rows.dtypes)["id"]
    schema = f"block long, id {key}, numbers binary, no long, chunk string"
    names = ["block", "id", "numbers", "no", "chunk"]
    key_type = to_arrow_type(rows.schema["id"].dataType)
    # bucketed by block, so that only the chunks' side of the last join moves
    path, name = scratch_path(spark, "chunks"), f"chunks_{uuid.uuid4().hex}"
    (rows.mapInArrow(_cut(model, names, key_type, block_chars), schema).write.format("parquet").option("path", path)
     .option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name; the files stay for this result
    chunks = (table.where("chunk is not null").select("block", "no", "chunk")
              .repartition("chunk").sortWithinPartitions("chunk")
              .mapInArrow(_segment(model), "block long, no long, ids binary"))
    texts = table.where("chunk is null").select("block", "id", "numbers")
    ends = [str(library.eos_id())] if end else []
    return (texts.groupBy("block").cogroup(chunks.groupBy("block"))
            .applyInArrow(_join(model, ends), f"id {key}, ids string, decoded string").withColumnRenamed("id", id_col))


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id") -> DataFrame:
    """id and text of rows of ids (decimal, joined by a space) from elsewhere."""
    rows = encoded.select(encoded[id_col].alias("id"), F.coalesce(encoded["ids"], F.lit("")).alias("ids"))
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = pieces(model).library
        for batch in batches:
            for part in _slices(batch, 1):
                ids = [list(map(int, x.split())) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([library.decode(x) for x in ids], pa.string())],
                                                 ["id", "decoded"])
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, decoded string").withColumnRenamed("id", id_col)


def report(docs: DataFrame, model: str = MODEL) -> DataFrame:
    return encode(docs, model).select(
        "doc_id", F.when(F.col("ids") == "", 0).otherwise(F.regexp_count("ids", F.lit(" ")) + 1).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
