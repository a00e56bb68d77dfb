"""The Python data sources: row-numbered matrices and FASTA ranges."""

import glob
import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from protea.operators import align
from protea.operators.common import dense_index
from protea.sources import driver, fasta, fasta_format, matrix


def _saved(path, *blocks):
    os.makedirs(path)
    for i, b in enumerate(blocks):
        np.save(f"{path}/x{i}.npy", b)
    return path


@pytest.fixture(scope="module")
def formats(spark):
    matrix.register(spark)
    fasta_format.register(spark)
    return spark


# ------------------------------------------------------------ matrices

@pytest.mark.parametrize("range_bytes,tasks", [(1 << 30, 1), (7 * 24, 15), (24, 100)])
def test_one_file_is_read_in_any_number_of_ranges(formats, tmpdir_path, range_bytes, tasks):
    x = np.random.default_rng(0).normal(size=(100, 6)).astype(np.float32)
    np.save(f"{tmpdir_path}/x.npy", x)
    df = formats.read.format("npy").option("range_bytes", range_bytes).load(f"{tmpdir_path}/x.npy")
    assert df.rdd.getNumPartitions() == tasks
    got = sorted(df.collect())
    assert [r.row for r in got] == list(range(100))
    assert (np.array([r.embedding for r in got], np.float32) == x).all()


@pytest.mark.parametrize("dtype", ["<f2", "<f4", "<f8", ">f4"])
def test_files_of_a_folder_follow_each_other(formats, tmpdir_path, dtype):
    a, b = np.arange(12).reshape(4, 3).astype(dtype), np.arange(12, 18).reshape(2, 3).astype(dtype)
    path = _saved(f"{tmpdir_path}/m", a, np.empty((0, 3), dtype), b)
    got = sorted(formats.read.format("npy").load(path).collect())
    assert [r.row for r in got] == list(range(6))
    assert [r.embedding for r in got] == np.concatenate([a, b]).tolist()


def test_a_matrix_without_rows(formats, tmpdir_path):
    path = _saved(f"{tmpdir_path}/m", np.empty((0, 3), np.float32))
    assert formats.read.format("npy").load(path).collect() == []
    assert matrix.matrix_rows(path) == 0


def test_files_that_are_no_matrix(tmpdir_path):
    for i, x in enumerate([np.arange(6.0), np.arange(6).reshape(2, 3), np.asfortranarray(np.ones((2, 3)))]):
        with pytest.raises(ValueError, match="matrix of floats"):
            matrix.matrix_files(_saved(f"{tmpdir_path}/m{i}", x))
    with pytest.raises(ValueError, match="rows of"):
        matrix.matrix_files(_saved(f"{tmpdir_path}/w", np.ones((2, 3)), np.ones((2, 4))))
    cut = _saved(f"{tmpdir_path}/c", np.ones((5, 3)))
    with open(f"{cut}/x0.npy", "r+b") as f:
        f.truncate(150)
    with pytest.raises(ValueError, match="do not hold"):
        matrix.matrix_files(cut)


@pytest.mark.parametrize("dtype", matrix.DTYPES)
def test_what_is_written_is_what_numpy_reads(formats, tmpdir_path, dtype):
    x = np.random.default_rng(1).normal(size=(500, 8)).astype(np.float32)
    df = formats.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row int, embedding array<float>")
    path = f"{tmpdir_path}/m"
    matrix.write_matrix(df.repartition(13, F.xxhash64("row")), path, dtype)
    files = sorted(glob.glob(f"{path}/*"))
    assert [os.path.basename(f) for f in files] == [f"part-{i:06d}.npy" for i in range(len(files))]
    back = np.concatenate([np.load(f) for f in files])
    assert back.dtype == dtype and (back == x.astype(dtype)).all()
    assert glob.glob(f"{path}._staged*") == []


def test_a_task_cuts_its_rows_into_parts(formats, tmpdir_path):
    df = formats.range(1000).select(F.col("id").alias("row"), F.array_repeat(F.col("id").cast("float"), 4).alias("embedding"))
    path = f"{tmpdir_path}/m"
    formats.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        df.coalesce(1).sortWithinPartitions("row").write.format("npy").option("part_bytes", 100 * 16).mode("overwrite").save(path)
    finally:
        formats.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [p.count for p in matrix.matrix_files(path)] == [100] * 10


@pytest.mark.parametrize("numbers", [[0, 1, 3], [0, 1, 1], [1, 2], [0, None]])
def test_gaps_and_repeats_fail_and_leave_nothing(formats, tmpdir_path, numbers):
    df = formats.createDataFrame([(n, [1.0]) for n in numbers], "row int, embedding array<float>")
    with pytest.raises(Exception, match="missing|twice|follow|null"):
        matrix.write_matrix(df, f"{tmpdir_path}/m")
    assert os.listdir(tmpdir_path) == []


def test_uneven_rows_fail(formats, tmpdir_path):
    df = formats.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "row int, embedding array<float>")
    with pytest.raises(Exception, match="values in one matrix"):
        matrix.write_matrix(df, f"{tmpdir_path}/m")


def test_overwriting_replaces_all_parts(formats, tmpdir_path):
    path = f"{tmpdir_path}/m"
    for n in (300, 2):
        matrix.write_matrix(formats.range(n).select(F.col("id").alias("row"), F.array(F.lit(1.0)).alias("embedding")), path)
        assert matrix.matrix_rows(path) == n
    with pytest.raises(Exception, match="has files"):
        formats.range(1).select(F.col("id").alias("row"), F.array(F.lit(1.0).cast("float")).alias("embedding")) \
            .write.format("npy").mode("append").save(path)
    assert matrix.matrix_rows(path) == 2


def test_a_matrix_joined_by_row_number_is_the_keyed_table(formats, tmpdir_path):
    keyed = driver.table(formats, SF_SMALL, "embeddings").select(F.col("vec_id").alias("EntryID"), "embedding")
    ids = dense_index(keyed.select("EntryID"), [F.col("EntryID")], "row", 0)
    path = f"{tmpdir_path}/m"
    matrix.write_matrix(keyed.join(ids, "EntryID"), path)
    back = matrix.read_matrix(formats, path, ids).select("EntryID", "embedding")
    assert back.exceptAll(keyed).isEmpty() and keyed.exceptAll(back).isEmpty()
    with pytest.raises(ValueError, match="the ids have"):
        matrix.read_matrix(formats, path, ids.where("row > 0"))
    assert align.key_report(back, keyed) is not None


# ------------------------------------------------------------ FASTA

TEXT = (">sp|A1|x  first one\nMKV\nLL\n\n>sp|B2|y\r\nMK VL\r\n>\n>sp|C3|z >not a record\nAAA>BBB\n"
        "  \n>sp|D4|w\n" + "\n".join("ACDEFGHIKL" * 6 for _ in range(40)) + "\n>sp|E5|last\nMM")


def _text_files(path, kind, text):
    os.makedirs(path)
    data = text.encode()
    if kind == "plain":
        open(f"{path}/a.fasta", "wb").write(data)
    elif kind == "gzip":  # two members, cut within a record
        open(f"{path}/a.fasta.gz", "wb").write(gzip.compress(data[:30]) + gzip.compress(data[30:]))
    else:
        blocks = [fasta_format._packed(data[i:i + 37]) for i in range(0, len(data), 37)]
        open(f"{path}/a.fasta.gz", "wb").write(b"".join(blocks) + fasta_format.BLOCK_END)
    return path


@pytest.mark.parametrize("kind", ["plain", "gzip", "bgzf"])
@pytest.mark.parametrize("range_bytes", [5, 61, 1 << 20])
def test_any_range_gives_the_same_records(formats, tmpdir_path, kind, range_bytes):
    plain = _text_files(f"{tmpdir_path}/p", "plain", TEXT)
    path = _text_files(f"{tmpdir_path}/x", kind, TEXT)
    want = sorted(map(tuple, fasta.read_fasta(formats, plain, strict=False).collect()))
    reader = fasta_format.FastaReader(path, _schema("EntryID", "seq"), False, True, range_bytes)
    parts = reader.partitions()
    assert len(parts) > 10 or range_bytes > 61 or kind == "gzip"
    got = [r for p in parts for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(got) == want and len(want) == 5


def _schema(*names):
    from pyspark.sql import types as T
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


@pytest.mark.parametrize("files", [1, 7, 64])
@pytest.mark.parametrize("compression", ["none", "gzip", "bgzf"])
def test_written_and_read_back(formats, tmpdir_path, files, compression):
    s = driver.seqs(formats, SF_SMALL).select(F.col("EntryID").cast("string").alias("EntryID"), "seq")
    path = f"{tmpdir_path}/f"
    s.repartition(files).write.format("fasta").option("compression", compression).mode("overwrite").save(path)
    back = formats.read.format("fasta").option("range_bytes", 50_000).load(path).select("EntryID", "seq")
    assert back.exceptAll(s).isEmpty() and s.exceptAll(back).isEmpty()
    if compression != "none":  # any gzip reader reads them
        whole = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{path}/*")))
        assert whole.count(b">") == s.count()


def test_columns_metadata_and_descriptions(formats, tmpdir_path):
    path = _text_files(f"{tmpdir_path}/p", "plain", TEXT.replace(">\n", ""))
    got = formats.read.format("fasta").schema("description string, EntryID string") \
        .option("has_metadata", "true").load(path)
    assert got.columns == ["description", "EntryID"]
    assert sorted(map(tuple, got.collect())) == [("", "B2"), ("", "D4"), ("", "E5"), (">not a record", "C3"), ("first one", "A1")]
    with pytest.raises(Exception, match="columns are strings"):
        formats.read.format("fasta").schema("EntryID long").load(path).collect()
    bad = _text_files(f"{tmpdir_path}/b", "plain", ">plain\nMK\n")
    with pytest.raises(Exception, match="second field"):
        formats.read.format("fasta").option("has_metadata", "true").load(bad).collect()
    loose = formats.read.format("fasta").option("has_metadata", "true").option("strict", "false").load(bad)
    assert [tuple(r) for r in loose.collect()] == [(None, "MK", "")]


def test_empty_tables_null_sequences_and_bad_ids(formats, tmpdir_path):
    df = formats.createDataFrame([("a", None, "x y"), ("b", "", None)], "EntryID string, seq string, description string")
    df.write.format("fasta").mode("overwrite").save(f"{tmpdir_path}/f")
    assert sorted(map(tuple, formats.read.format("fasta").load(f"{tmpdir_path}/f").collect())) == [("a", "", "x y"), ("b", "", "")]
    df.where("false").write.format("fasta").mode("overwrite").save(f"{tmpdir_path}/e")
    assert formats.read.format("fasta").load(f"{tmpdir_path}/e").collect() == []
    for key in (None, "two words"):
        bad = formats.createDataFrame([(key, "MK")], "EntryID string, seq string")
        with pytest.raises(Exception, match="one word"):
            bad.write.format("fasta").mode("overwrite").save(f"{tmpdir_path}/b")
    assert sorted(os.listdir(tmpdir_path)) == ["e", "f"]


def test_a_cut_block_is_an_error(tmpdir_path):
    path = _text_files(f"{tmpdir_path}/x", "bgzf", TEXT)
    name = f"{path}/a.fasta.gz"
    data = open(name, "rb").read()
    open(name, "wb").write(data[:-40])
    reader = fasta_format.FastaReader(path, _schema("seq"), False, True, 1 << 20)
    with pytest.raises(ValueError, match="no whole block"):
        [b for p in reader.partitions() for b in reader.read(p)]


def test_a_cut_member_is_an_error(tmpdir_path):
    path = _text_files(f"{tmpdir_path}/x", "gzip", TEXT)
    name = f"{path}/a.fasta.gz"
    data = open(name, "rb").read()
    open(name, "wb").write(data[:-20])
    reader = fasta_format.FastaReader(path, _schema("seq"), False, True, 1 << 20)
    with pytest.raises(ValueError, match="within a member"):
        [b for p in reader.partitions() for b in reader.read(p)]
