"""Periodic runs, sentencepiece and the prefix trie against brute force or the
library, on the whole sf0.001 tables and on odd rows."""

import random
import time

import brute_sequences as brute
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import types as T

from protea.llm import pieces, prefix_trie, runs
from protea.llm.bpe import tokenizer_path

SF = "/root/testdata/sf0.001"
NAMES = ["id", "text", "ids", "runs", "block", "no", "chunk", "numbers", "decoded", "collapsed", "best", "head"]
DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                    *(T.StructField(n, T.StringType()) for n in NAMES if n != "text")])
ODD = [None, "", " ", "   ", "\n\n \t", "a", "a " * 6, "a " * 5, "ab ab ab ab ab ab", " x  y   z ", "▁ ▁▁ a▁b", "日本語のテキスト" * 40,
       "é🙂 ՘'s <s></s><unk> <0x41>", "one two " * 30 + "three", "same text here", "same text here",
       "w " + " ".join(f"p{i}" for i in range(50)) * 9, "long " * 30_000, "x" * 100_000, "\x00\x01 ﻿　 z"]


def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, "a"), (None, "a a a a a a a b"), (None, None)]
    extra = ("x",) * (len(NAMES) - 1)
    return spark.createDataFrame([(*r, *extra) for r in rows], DOC), rows


def table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    return d, [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]


def listed(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


RUN_COLS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


@pytest.mark.parametrize("make", [table, odd], ids=["table", "odd"])
def test_runs(spark, make):
    df, rows = make(spark)
    got = listed(runs.report(df), RUN_COLS)
    assert got == sorted((brute.runs(i, t) for i, t in rows), key=repr)
    assert any(r[1] for r in got) and not all(r[1] for r in got)


def test_runs_of_random_words():
    rng = random.Random(4)
    for _ in range(3000):
        k = rng.choice([1, 2, 2, 3, 6])
        w = [b"%d" % rng.randrange(k) for _ in range(rng.randrange(70))]
        if w and rng.random() < 0.6:
            a, p = rng.randrange(len(w)), rng.randrange(1, 9)
            w = [w[i] if i < a else w[min(a + (i - a) % p, len(w) - 1)] for i in range(len(w))]
        got = runs.runs_of(w)
        assert [tuple(r) for r in got.tolist()] == brute.repeats(w)
        # what is left out before the trees never holds a run
        all_runs = runs.runs_between([*(int(x) for x in w), 99]) if w else np.zeros((0, 3))
        assert sorted(map(tuple, all_runs.tolist())) == sorted(brute.repeats(w))


def test_common_prefixes():
    rng = random.Random(5)
    for _ in range(200):
        s = [rng.randrange(3) for _ in range(rng.randrange(1, 40))] + [7]
        lcp = runs.CommonPrefixes(s)
        suffixes = sorted(range(len(s)), key=lambda i: s[i:])
        assert lcp.rank[suffixes].tolist() == list(range(len(s)))
        pairs = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]
        got = lcp.of(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
        for (i, j), n in zip(pairs, got.tolist()):
            assert n == next(k for k in range(len(s)) if s[i + k] != s[j + k])


def test_long_runs_are_linear():
    began = time.time()
    for w in ([b"%d" % i for i in range(20_000)] * 5, [b"a"] * 100_000):
        assert len(runs.runs_of(w)) == 1
    assert time.time() - began < 30


def test_general_runs(spark):
    df = spark.createDataFrame([("k", "x a b a b a b a b y")], "key string, body string")
    row = runs.find_runs(df, "key", "body").first()
    assert row.key == "k" and [tuple(r) for r in row.runs] == [(1, 8, 2)] and row.collapsed == "x a b y"


# pieces

@pytest.mark.parametrize("make", [table, odd], ids=["table", "odd"])
def test_pieces(spark, make):
    df, rows = make(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces.MODEL))
    got = listed(pieces.report(df), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    assert got == sorted(((i, *brute.pieces(library, t)) for i, t in rows), key=repr)


def test_pieces_in_small_blocks(spark):
    # chunks meet across many blocks
    df, rows = table(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces.MODEL))
    got = {r.doc_id: (r.ids, r.decoded) for r in pieces.encode(df, end=False, block_chars=2000).collect()}
    assert got == {i: (" ".join(map(str, x)), library.decode(x)) for i, x in ((i, library.encode(t or "")) for i, t in rows)}


def test_chunks_and_the_library():
    p, rng = pieces.Pieces(pieces.MODEL), random.Random(6)
    vocabulary = [p.library.id_to_piece(i) for i in range(300, 32000)]
    odd_parts = ["</s>", "<s>", "<unk>", "\n", "\t\r\n", "<0x41>", "ſ", "ﬁ", "é", "日本", "﻿", "�", "\x00", "▁"]
    for _ in range(3000):
        parts = []
        for _ in range(rng.randrange(25)):
            r = rng.random()
            parts.append(rng.choice(vocabulary).replace("▁", " ") if r < 0.5 else " " * rng.randrange(1, 20) if r < 0.7 else
                         rng.choice(odd_parts) if r < 0.85 else chr(rng.choice([rng.randrange(128), rng.randrange(0xE000, 0x110000)])))
        text = "".join(parts)
        ids, decoded = p.texts(p.segment(p.chunks(text)))
        whole = p.library.encode(text)
        assert [int(x) for c in ids for x in c.split()] == whole
        assert p.whole("".join(decoded)) == p.library.decode(whole)


def test_packed_numbers():
    for x in ([], [0], [127, 128, 16383, 16384, 2**21, 2**28, 2**32 - 1, 0, 5]):
        x = np.array(x, np.uint32)
        assert pieces.unpack(pieces.pack(x)).tolist() == x.tolist()


def test_each_chunk_is_segmented_once(monkeypatch):
    import pyarrow as pa
    seen = []
    p = pieces.Pieces(pieces.MODEL)
    monkeypatch.setitem(pieces._PIECES, "counted", p)
    segment = p.segment
    p.segment = lambda chunks: seen.extend(chunks) or segment(chunks)
    chunks = ["▁a"] * 5 + ["▁b"] * 3 + ["▁c"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(c))), pa.array(range(len(c))), pa.array(c)], ["block", "no", "chunk"])
               for c in (chunks[:3], chunks[3:6], chunks[6:])]
    out = [b for b in pieces._segment("counted")(iter(batches))]
    assert seen == ["▁a", "▁b", "▁c"]
    assert p.texts([x for b in out for x in b.column(2).to_pylist()])[1] == [c.replace("▁", " ") for c in chunks]


def test_decode_other_ids(spark):
    df = spark.createDataFrame([(1, "263 931 2"), (2, ""), (None, None)], "doc_id long, ids string")
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(pieces.MODEL))
    assert {r.doc_id: r.decoded for r in pieces.decode(df).collect()} == {1: library.decode([263, 931, 2]), 2: "", None: ""}


# prefix trie

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CONV = "conv_id long, turn long, role string, text string, head string, path string, first long, turns string, h int"


def trie_rows(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in NODE) for r in df.collect())


@pytest.mark.parametrize("capacity", [4096, 40, 1])
def test_trie_of_the_table(spark, capacity):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(prefix_trie.report(df, capacity)) == brute.trie(brute.conversations(rows))


def hot_rows():
    rng = random.Random(8)
    rows = []
    for c in range(400):
        turns = [("user", "hello there friend")] if c % 3 else []
        turns += [rng.choice([("user", "a b"), ("bot", "a b"), (None, "c"), ("bot", None), ("", "")]) for _ in range(rng.randrange(5))]
        if c % 7 == 0:  # copies of one long conversation, and beginnings of it
            turns = [("user", f"step {i} of many") for i in range(60 if c % 14 else rng.randrange(1, 60))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(1000, None, "user", "x"), (1000, None, "user", "x"), (1000, 0, "bot", "y"), (1001, 5, None, None), (None, 0, "user", "no id")]
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
@pytest.mark.parametrize("capacity", [4096, 30])
def test_trie_of_odd_and_hot_rows(spark, rebuild, capacity):
    rows = hot_rows()
    df = spark.createDataFrame([(*r, "x", "y", 1, "z", 2) for r in rows], CONV).repartition(5)
    assert trie_rows(prefix_trie.nodes(df, capacity, rebuild)) == brute.trie(brute.conversations(rows, rebuild))


def test_trie_of_nothing(spark):
    assert prefix_trie.report(spark.createDataFrame([], CONV)).count() == 0
    assert runs.report(spark.createDataFrame([], DOC)).count() == 0
    assert pieces.report(spark.createDataFrame([], DOC)).count() == 0
