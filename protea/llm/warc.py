"""WARC archives: writing, and reading by verified boundary chains.

Writing is a Spark text job: a record is a text, and the line separator is the
blank line pair that ends a record. Of pages with equal payloads the one with
the largest page_id is the response and the others revisit it.

Reading does not trust the magic string, which may stand inside a payload.
Tasks search byte ranges of the archives and emit a candidate with the offset
of its successor for each place that reads like a record head, and with the
place where its chain leaves the range, which the task finds itself. Pointer
jumping from the start of each file over these places (a few per range) then
finds where the true chain enters each range: round k doubles the known part,
so a file of n ranges takes log2(n) rounds of joins over few offsets. From the
entry, one walk over a range's sorted candidates keeps what is reachable. Only
these records are opened, and digests are those of the bytes that are read.

The archives' folder must be one that all executors share and that pyarrow can
open (a file system path, hdfs, s3 or gs).

Cases: a null or empty html is an empty payload; repeated rows are written each
on its own, with those of the largest page_id as responses; rows without a
page_id are revisits where their payload has a response, responses otherwise;
a null url has no target line; an empty table writes archives without records;
a file that is cut off gives the records before the cut, and one that goes on
after a record with anything but a record is an error; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protea.llm.common import saved, scratch_path, ship

CRLF = "\r\n"
END = CRLF * 2
RANGE = 16 << 20
HEAD = 1 << 16  # read beyond a range at first, and doubled for a head that is longer
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2000-01-01T00:00:00Z"

CANDIDATE = "path string, off long, nxt long, kind string, id string, refers string, digest string, block long, size long, leaves long"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32(hexed: Column) -> Column:
    """Base 32 of a hexadecimal text of a multiple of 5 digits: 4 letters for
    every 20 bits."""
    def letter(i: Column) -> Column:
        twenty = F.conv(F.substring(hexed, F.floor(i / 4).cast("int") * 5 + 1, F.lit(5)), 16, 10).cast("int")
        place = F.pmod(F.floor(twenty / F.element_at(F.array(*[F.lit(32 ** k) for k in (3, 2, 1, 0)]), i % 4 + 1)), F.lit(32))
        return F.substring(F.lit(ALPHABET), place.cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def record_id(page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page_id.cast("string"), F.concat(F.lit("none-"), digest)), F.lit(">"))


def write(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write a record for every row of ``pages`` (page_id, url, html)."""
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", html.alias("html"),
                     F.sha2(html.cast("binary"), 256).alias("content"))
    # contents that occur more than once, with their response; saved, so that
    # its size is known when the join below is planned
    same = saved(p.groupBy("content").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
                 .where("n > 1 and keeper is not null").select("content", "keeper"), "warc-same")
    p = p.join(same, "content", "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    digest = base32(F.sha1(F.col("html").cast("binary")))
    p = p.select("page_id", "url", "html", "keeper", revisit.alias("revisit"), digest.alias("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.octet_length("html").cast("string"), F.lit(END))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]+", "%20")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.when(F.col("revisit"), record_id(F.col("keeper"), F.col("digest")))),
        line("WARC-Profile", F.when(F.col("revisit"), F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")), F.lit(CRLF))
    p.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value")) \
        .write.option("lineSep", END).text(path)


def open_file(path: str):
    from pyarrow import fs
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/+", "/", path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def head_fields(data: bytes, at: int, end: int) -> dict[bytes, bytes] | None:
    """The fields of a record head at ``at`` that ends at ``end``."""
    fields = {}
    at = data.find(b"\r\n", at, end) + 2
    while 2 <= at < end:
        stop = data.find(b"\r\n", at, end)
        name, colon, value = data[at:stop if stop >= 0 else end].partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
        at = stop + 2
    return fields if fields.get(b"content-length", b"").isdigit() else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4, *[pa.int64()] * 3]
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out: list[list] = [[] for _ in names]
            with open_file(path) as f:
                f.seek(start)
                data, ahead, end = f.read(RANGE + HEAD), HEAD, -1
                for at in [m.start() for m in MAGIC.finditer(data, 0, RANGE + 10) if m.start() < RANGE]:
                    if end < at:  # else the blank line found last is the next one here too
                        end = data.find(b"\r\n\r\n", at)
                    while end < 0 and (more := f.read(ahead)):
                        seen, data, ahead = max(at, len(data) - 3), data + more, 2 * ahead
                        end = data.find(b"\r\n\r\n", seen)
                    if end < 0:
                        break  # the file ends within the head
                    fields = head_fields(data, at, end)
                    if fields is None:
                        continue
                    block, size = end + len(END), int(fields[b"content-length"])
                    if size >= 1 << 62:
                        continue
                    text = [fields[k].decode("utf-8", "replace") if k in fields else None for k in
                            (b"warc-type", b"warc-record-id", b"warc-refers-to", b"warc-payload-digest")]
                    row = [path, start + at, start + block + size + len(END), *text, start + block, size]
                    for c, v in zip(out, row):
                        c.append(v)
            # where each chain leaves the range; null where it breaks off in it
            leaves: dict[int, int | None] = {}
            for at, after in zip(reversed(out[1]), reversed(out[2])):
                leaves[at] = leaves.get(after) if after < start + RANGE else after
            out[-1] = [leaves[at] for at in out[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)


def candidates(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """Path and length of the archives, every place of them that reads like a
    record head, and the number of byte ranges."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(RANGE).cast("long"))).alias("start"))
    n = max(1, ranges.count())
    return files, ranges.repartition(n).mapInArrow(_candidates, CANDIDATE), n


def reachable(steps: DataFrame) -> DataFrame:
    """path, off of the places on the chain from their file's start, of steps
    (path, off, nxt)."""
    known = steps.select("path", "off")
    jump = saved(steps.select("path", "off", "nxt").join(known.withColumnRenamed("off", "nxt"), ["path", "nxt"], "left_semi")
                 .select("path", "off", "nxt"), "warc-jump")
    reach = saved(known.where("off = 0"), "warc-reach")
    while True:
        # reach: the first 2^k places of each chain; jump: 2^k places ahead
        ahead = saved(reach.join(jump, ["path", "off"]).select("path", F.col("nxt").alias("off")), "warc-reach")
        if ahead.isEmpty():
            return reach
        reach = reach.unionByName(ahead)
        then = jump.select("path", F.col("off").alias("nxt"), F.col("nxt").alias("far"))
        jump = saved(jump.join(then, ["path", "nxt"]).select("path", "off", F.col("far").alias("nxt")), "warc-jump")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of candidates sorted by path, range and offset, with the entry of the
    true chain into their range: those on the chain."""
    at, path, entry = -1, None, None
    for batch in batches:
        keep = []
        for p, off, nxt, e in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "off", "nxt", "entry"))):
            if (p, e) != (path, entry):
                path, entry, at = p, e, e
            keep.append(off == at)
            if off == at:
                at = nxt
        yield batch.filter(pa.array(keep, pa.bool_())).drop_columns(["entry", "range"])


def on_chain(cands: DataFrame, ranges: int) -> DataFrame:
    """The candidates on the chain from their file's start, sorted within
    partitions of whole ranges."""
    places = (cands.where("leaves is not null").select("path", F.col("leaves").alias("off")).distinct()
              .unionByName(cands.where("off = 0").select("path", "off")).distinct())
    steps = saved(cands.join(places, ["path", "off"], "left_semi").select("path", "off", F.col("leaves").alias("nxt")), "warc-steps")
    byte_range = F.floor(F.col("off") / RANGE).alias("range")
    entries = reachable(steps).select("path", byte_range, F.col("off").alias("entry"))
    return (cands.withColumn("range", byte_range).join(entries, ["path", "range"]).repartition(ranges, "path", "range")
            .sortWithinPartitions("path", "range", "off").select(*cands.columns, "range", "entry").mapInArrow(_walk, cands.schema))


def _broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bad = []
        for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            with open_file(path) as f:
                f.seek(at)
                tail = f.read(HEAD)
                cut = any(m.startswith(tail[:len(m)]) for m in (b"WARC/1.0\r\n", b"WARC/1.1\r\n"))
                while cut and tail:  # a head without its blank line is where the file was cut off
                    cut = b"\r\n\r\n" not in tail
                    more = f.read(RANGE)
                    tail = more and tail[-3:] + more
            bad.append(not cut)
        yield batch.filter(pa.array(bad, pa.bool_()))


def verify_ends(files: DataFrame, true: DataFrame) -> None:
    """An error where a chain ends before its file for another reason than
    that the file is cut off."""
    ends = true.groupBy("path").agg(F.max("nxt").alias("last"))
    short = files.join(ends, "path", "left").withColumn("last", F.coalesce("last", F.lit(0).cast("long"))) \
                 .where("last < length").select("path", "last")
    bad = short.mapInArrow(_broken, "path string, last long").first()
    if bad:
        raise ValueError(f"{bad['path']}: no WARC record at byte {bad['last']}, where one must begin")


def page_number(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:x-page:(-?[0-9]+)>", uri or "")
    return int(m[1]) if m else None


def _records(with_payload: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        out: list[list] = [[] for _ in names]
        held = 0

        def emit() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
            for c in out:
                c.clear()
            return made
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != opened:
                    if f is not None:
                        f.close()
                    opened, f = r["path"], open_file(r["path"])
                f.seek(r["block"])
                block = f.read(r["size"])
                if len(block) < r["size"]:
                    continue  # the file ends within the record
                cut = block.find(b"\r\n\r\n") + 4
                payload = block[cut:]
                if r["kind"] == "revisit":
                    length = re.search(rb"(?i)\r\ncontent-length:\s*([0-9]+)", block[:cut])
                    size, digest = int(length[1]) if length else None, (r["digest"] or "").rpartition(":")[2]
                    payload = None
                else:
                    size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                row = (page_number(r["id"]), r["kind"], page_number(r["refers"]), size, digest,
                       payload if with_payload else None)
                for c, v in zip(out, row):
                    c.append(v)
                held += len(payload or b"") if with_payload else 0
                if held >= RANGE:  # a batch holds no more payloads than a range
                    yield emit()
                    held = 0
            yield emit()
            held = 0
        if f is not None:
            f.close()
    return run


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the archives under ``path``: page_id, record_type,
    refers_to, payload_bytes, payload_digest and payload (null for revisits)."""
    ship(spark)
    files, cands, n = candidates(spark, path)
    cands = saved(cands, "warc-candidates")
    true = saved(on_chain(cands, n), "warc-records")
    verify_ends(files, true)
    dealt = true.repartition(n, "path", F.floor(F.col("off") / RANGE)).sortWithinPartitions("path", "off")
    return dealt.mapInArrow(_records(with_payload), RECORD)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` and read them back."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(pages, path)
    return read(spark, path, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper
  FROM pages),
letters AS (
  SELECT page_id, keeper, html, i, CAST('0x' || substring(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) // CAST(power(32, 3 - i % 4) AS BIGINT) % 32 AS v
  FROM p, range(32) AS r(i)),
digest AS (
  SELECT page_id, string_agg(substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v + 1 AS BIGINT), 1), '' ORDER BY i) AS payload_digest
  FROM letters GROUP BY page_id)
SELECT p.page_id, strlen(html) AS payload_bytes, payload_digest,
       CASE WHEN p.page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM p JOIN digest ON digest.page_id = p.page_id
"""
