"""Hand-computed cases (edge semantics of each operator)."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from protea.functions import seq as S
from protea.operators import align, embed, labels, metrics, seqops, split, vote
from protea.sources import fasta, tables


def _hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, subject_id string, evalue double, bitscore double")


def _terms(spark, rows):
    return spark.createDataFrame(rows, "EntryID string, term string")


def _d(df, k="term", v="score"):
    return {r[k]: r[v] for r in df.collect()}


def test_vote_unannotated_subject_and_duplicate_terms(spark):
    h = _hits(spark, [("q1", "s1", 1e-5, 60.0), ("q1", "s2", 1e-5, 40.0)])
    t = _terms(spark, [("s1", "t1"), ("s1", "t1"), ("s1", "t2")])
    got = _d(vote.weighted_vote(h, t, by=()))
    assert got == pytest.approx({"t1": 1.2, "t2": 0.6})


def test_vote_strict_threshold_and_nan(spark):
    h = _hits(spark, [("q", "a", 0.001, 1.0), ("q", "b", 0.00099, 2.0), ("q", "c", float("nan"), 4.0)])
    kept = vote.filter_hits(h, 1e-3).collect()
    assert [r["subject_id"] for r in kept] == ["b"]


def test_vote_empty_cases(spark):
    none_pass = _hits(spark, [("q", "a", 0.5, 1.0)])
    no_terms = _hits(spark, [("q", "zz", 1e-9, 1.0)])
    t = _terms(spark, [("a", "t1")])
    assert vote.weighted_vote(none_pass, t, by=()).count() == 0
    assert vote.weighted_vote(no_terms, t, by=()).count() == 0


def test_vote_zero_total_is_null(spark):
    h = _hits(spark, [("q", "a", 1e-9, 0.0)])
    r = vote.weighted_vote(h, _terms(spark, [("a", "t")]), by=()).first()
    assert r["score"] is None


def test_max_merge(spark):
    v = spark.createDataFrame([("A", "q", "t", 0.2), ("N", "q", "t", 0.7), ("A", "q", "u", float("nan"))],
                              "source string, query_id string, term string, score double")
    got = {(r["query_id"], r["term"]): r["score"] for r in vote.max_merge(v).collect()}
    assert got == {("q", "t"): 0.7}


def test_clean_space_prefix(spark):
    df = spark.createDataFrame([(None,), ("",), ("MUZOBk",), ("X",), ("AXY",)], "s string")
    out = df.select(S.clean("s").alias("c"), S.spaced("s").alias("sp"), S.prefixed("s").alias("p")).collect()
    assert [r["c"] for r in out] == ["X", "X", "MXXXXk", "X", "AXY"]
    assert out[4]["sp"] == "A X Y" and out[3]["sp"] == "X"
    assert out[0]["p"] == "[NLU]X"


@pytest.mark.parametrize("n,chunks", [(1, 1), (2047, 1), (2048, 1), (2049, 2), (4096, 2), (4097, 3)])
def test_chunk_counts(spark, n, chunks):
    df = spark.createDataFrame([("e", "A" * n)], "EntryID string, seq string")
    c = seqops.explode_chunks(df, "seq", 2048).collect()
    assert len(c) == chunks
    assert "".join(r["chunk"] for r in sorted(c, key=lambda r: r["chunk_idx"])) == "A" * n


def test_chunk_mean_unweighted(spark):
    df = spark.createDataFrame([("e", 0, [1.0, 0.0]), ("e", 1, [0.0, 1.0])], "EntryID string, j int, v array<double>")
    r = embed.mean_vectors(df, "EntryID", "v").first()
    assert list(r["embedding"]) == [0.5, 0.5]


def test_truncate(spark):
    df = spark.createDataFrame([("A" * 3000,)], "s string")
    assert len(df.select(S.truncate("s", 1024, 2).alias("t")).first()["t"]) == 1022


def test_fmax_float32_edge(spark):
    c = spark.createDataFrame([("e", "t", 0.29, True)], "EntryID string, term string, score float, y boolean")
    r = metrics.fmax(c).first()
    assert r["fmax"] == 1.0 and r["tau"] == 0.01
    curve = {x["tau_idx"]: x["tp"] for x in metrics.threshold_curve(c).collect()}
    assert curve[29] == 1.0 and curve[30] == 0.0  # 0.29f counts as predicted at 0.29


def test_fmax_no_positives(spark):
    c = spark.createDataFrame([("e", "t", 0.9, False)], "EntryID string, term string, score float, y boolean")
    r = metrics.fmax(c).first()
    assert (r["fmax"], r["precision"], r["recall"], r["tau"]) == (0.0, 0.0, 0.0, None)


def test_fmax_matches_brute_force(spark):
    import random
    rnd = random.Random(3)
    rows = [(f"e{i}", f"t{i % 7}", float(rnd.random()), rnd.random() < 0.3) for i in range(400)]
    c = spark.createDataFrame(rows, "EntryID string, term string, score float, y boolean")
    import numpy as np
    s = np.array([r[2] for r in rows], dtype=np.float32)
    y = np.array([r[3] for r in rows])
    best = (0.0, 0.0, 0.0)
    for t in range(1, 100):
        p = s >= (t / 100.0)
        tp, fp, fn = (p & y).sum(), (p & ~y).sum(), (~p & y).sum()
        pr = tp / (tp + fp) if tp + fp else 0
        rc = tp / (tp + fn) if tp + fn else 0
        if pr + rc > 0:
            f = 2 * pr * rc / (pr + rc)
            if f > best[0]:
                best = (f, pr, rc)
    r = metrics.fmax(c).first()
    assert (r["fmax"], r["precision"], r["recall"]) == pytest.approx(best)


def test_fmax_tp_plus_fn_is_positives(spark):
    c = spark.createDataFrame([("a", "t", 0.5, True), ("b", "t", 0.05, True), ("c", "t", 0.7, False)],
                              "EntryID string, term string, score float, y boolean")
    for r in metrics.threshold_curve(c).collect():
        assert r["tp"] + r["fn"] == 2


def test_cells_from_counts_missing_prediction_as_fn(spark):
    pred = spark.createDataFrame([("a", "t", 0.9)], "EntryID string, term string, score float")
    truth = spark.createDataFrame([("a", "t"), ("b", "t")], "EntryID string, term string")
    r = metrics.micro_f1(metrics.cells_from(pred, truth)).first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 0, 1)


def test_class_weights_limits(spark):
    ents = spark.createDataFrame([(f"e{i}",) for i in range(100)], "EntryID string")
    pos = spark.createDataFrame([(f"e{i}", "t") for i in range(5)], "EntryID string, term string")
    vocab = spark.createDataFrame([("t", 11)], "term string, rank int")
    inv = labels.class_weights(pos, ents, vocab, "inverse_freq").first()
    bal = labels.class_weights(pos, ents, vocab, "balanced").first()
    assert inv["w_pos"] == pytest.approx(0.2) and inv["w_neg"] == pytest.approx(0.1)
    assert bal["w_pos"] == pytest.approx(10.0) and bal["w_neg"] == pytest.approx(100 / 190)
    vocab1 = spark.createDataFrame([("t", 1)], "term string, rank int")
    assert labels.class_weights(pos, ents, vocab1).first()["w_pos"] == 1.0
    with pytest.raises(ValueError):
        labels.class_weights(pos, ents, vocab, "other")


def test_taxonomy_vocab_and_unseen(spark):
    a = spark.createDataFrame([("x", 9606), ("y", -1), ("z", 10090), ("w", 9606)], "EntryID string, taxonomyID long")
    v = {r["taxonomyID"]: r["taxonomy_idx"] for r in align.taxonomy_vocab(a).collect()}
    assert v == {9606: 1, 10090: 2}
    test = spark.createDataFrame([("p", 10090), ("q", 42), ("r", -1)], "EntryID string, taxonomyID long")
    got = {r["EntryID"]: r["taxonomy_idx"] for r in align.index_taxonomy(test, align.taxonomy_vocab(a)).collect()}
    assert got == {"p": 2, "q": 0, "r": 0}


def test_ia_missing_defaults_and_duplicates(spark):
    vocab = spark.createDataFrame([("a",), ("b",)], "term string")
    ia = spark.createDataFrame([("a", 2.5)], "term string, score double")
    assert _d(align.ia_weights(vocab, ia), v="weight") == {"a": 2.5, "b": 1.0}
    dup = spark.createDataFrame([("a", 2.5), ("a", 3.0)], "term string, score double")
    with pytest.raises(Exception):
        align.ia_weights(vocab, dup).collect()
    assert _d(align.ia_weights(vocab, dup, on_duplicate="max"), v="weight")["a"] == 3.0


def test_key_report(spark):
    l_ = spark.createDataFrame([("a",), ("a",), ("b",)], "EntryID string")
    r_ = spark.createDataFrame([("b",), ("c",)], "EntryID string")
    r = align.key_report(l_, r_).first()
    assert (r["dup_left"], r["left_only"], r["right_only"]) == (1, 1, 1)
    with pytest.raises(ValueError):
        align.assert_aligned(l_, r_)


def test_splits_partition_input(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "EntryID")
    f = split.assign_folds(df, "EntryID", 5).groupBy("fold").count().collect()
    assert sum(r["count"] for r in f) == 2000 and len(f) == 5
    tr, va = split.train_val(df, key="EntryID")
    assert tr.count() + va.count() == 2000
    assert 300 < va.count() < 500
    # independent of partitioning
    a = {r["EntryID"] for r in split.train_val(df.repartition(7), key="EntryID")[1].collect()}
    b = {r["EntryID"] for r in va.collect()}
    assert a == b


def test_kmer_composition_counts():
    c, n = embed.kmer_counts("ABAB", 2)
    assert n == 3 and c[0 * 26 + 1] == 2 and c[1 * 26 + 0] == 1
    c, n = embed.kmer_counts("A-B", 2)
    assert n == 0


def test_fasta_round_trip_edge_cases(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "in.fa")
    with open(p, "w", newline="") as f:
        f.write(">sp|P1|NAME desc with > sign\r\nACDE\r\nFGH\r\n>id2\n\n>id3 x\nAAAA\nCC")
    got = {r["EntryID"]: r["seq"] for r in fasta.read_fasta(spark, p).collect()}
    assert got == {"sp|P1|NAME": "ACDEFGH", "id2": "", "id3": "AAAACC"}
    meta = fasta.read_fasta(spark, p, has_metadata=True, strict=False).collect()
    assert {r["EntryID"] for r in meta} == {"P1", None}
    out = os.path.join(tmpdir_path, "out")
    src = spark.createDataFrame([("a", "M" * 130), ("b", "")], "EntryID string, seq string")
    fasta.write_fasta(src, out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part"))
    assert "M" * 60 + "\n" + "M" * 60 + "\n" + "M" * 10 + "\n" in text
    back = {r["EntryID"]: r["seq"] for r in fasta.read_fasta(spark, out).collect()}
    assert back == {"a": "M" * 130, "b": ""}


def test_fasta_split_sizes_do_not_change_records(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "many")
    src = spark.createDataFrame([(f"id{i}", "ACDEFGHIKLMNPQRSTVWY" * (i % 37 + 1)) for i in range(500)],
                                "EntryID string, seq string")
    fasta.write_fasta(src.coalesce(1), out)
    ref = sorted((r["EntryID"], r["seq"]) for r in src.collect())
    for size in ("1k", "7k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = sorted((r["EntryID"], r["seq"]) for r in fasta.read_fasta(spark, out).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == ref


def test_tsv_readers(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "hits.tsv")
    with open(p, "w") as f:
        f.write("q1\ts1\t99.5\t100\t1\t0\t1\t100\t1\t100\t1e-30\t200.5\n")
    r = tables.read_hits(spark, p).first()
    assert r["query_id"] == "q1" and r["evalue"] == 1e-30 and r["aln_len"] == 100
    p3 = os.path.join(tmpdir_path, "s3.tsv")
    with open(p3, "w") as f:
        f.write("id\tsequence\tx\nA\tMK\tz\nNA\tQQ\tz\n")
    got = {r["EntryID"]: r["seq"] for r in tables.read_strict_tsv3(spark, p3).collect()}
    assert got == {"A": "MK", "NA": "QQ"}  # 'NA' stays an identifier
    bad = os.path.join(tmpdir_path, "bad.tsv")
    with open(bad, "w") as f:
        f.write("id\tsequence\tx\nA\tMK\t\n")
    with pytest.raises(Exception):
        tables.read_strict_tsv3(spark, bad).collect()
    ia = os.path.join(tmpdir_path, "ia.csv")
    with open(ia, "w") as f:
        f.write("go,val\nGO:1,2.5\n")
    assert tables.read_ia(spark, ia).first().asDict() == {"term": "GO:1", "score": 2.5}


def test_score_format_rounds_binary_value(spark):
    df = spark.createDataFrame([("q", "t", 5e-7), ("q", "u", 0.1234565), ("q", "v", 2.5e-6)],
                               "query_id string, term string, score double")
    got = {r["GO_term"]: r["score"] for r in tables.format_scores(df).collect()}
    assert got == {"t": "%.6f" % 5e-7, "u": "%.6f" % 0.1234565, "v": "%.6f" % 2.5e-6}


def test_top_k_labels_ties_by_term(spark):
    pos = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "z")], "EntryID string, term string")
    got = [(r["term"], r["rank"]) for r in labels.top_k_labels(pos, 2).orderBy("rank").collect()]
    assert got == [("z", 1), ("x", 2)]


def test_melt_wide_excludes_meta_columns(spark):
    w = spark.createDataFrame([("e", 1, 0, "SEQ")], "EntryID string, GO1 int, GO2 int, seq string")
    got = sorted((r["term"], r["value"]) for r in labels.melt_wide(w).collect())
    assert got == [("GO1", 1), ("GO2", 0)]


def test_focal_reduces_to_bce_at_gamma0(spark):
    c = spark.createDataFrame([("e", "t", 0.3, 1.0), ("e", "u", -2.0, 0.0)], "EntryID string, term string, logit double, y double")
    a = metrics.bce_loss(c).first()["loss"]
    b = metrics.focal_loss(c, gamma=0.0).first()["loss"]
    assert a == pytest.approx(b)
    exp = (math.log1p(math.exp(-0.3)) + math.log1p(math.exp(-2.0))) / 2
    assert a == pytest.approx(exp)


def test_id_column_autodetect(spark):
    assert align.id_column(spark.createDataFrame([("a", 1)], "x string, EntryID int")) == "EntryID"
    assert align.id_column(spark.createDataFrame([("a", 1)], "x string, id int")) == "id"
    assert align.id_column(spark.createDataFrame([("a", 1)], "x string, y int")) == "x"


def test_search_exact_runs_and_masking(spark):
    from protea.operators import simsearch
    q = spark.createDataFrame([("q", "ABCDEFGHIJKLMNOP")], "EntryID string, seq string")
    refs = spark.createDataFrame([("s1", "ZZABCDEFGHIJKLMNZZ"), ("s2", "ABCDEFGHIJKQQQQQ"), ("s3", "QQQQQQQ")],
                                 "EntryID string, seq string")
    h = {r["subject_id"]: r for r in simsearch.search(q, refs, K=4, max_targets=16).collect()}
    assert set(h) == {"s1", "s2"}
    assert (h["s1"]["aln_len"], h["s1"]["qstart"], h["s1"]["sstart"]) == (14, 1, 3)
    assert (h["s2"]["aln_len"], h["s2"]["qstart"], h["s2"]["sstart"]) == (11, 1, 1)
    assert h["s1"]["bitscore"] > h["s2"]["bitscore"] and h["s1"]["evalue"] < h["s2"]["evalue"]
    # masking is an option: off by default, counted over distinct sequences
    many = spark.createDataFrame([(f"r{i}", "ABCDXYZW" + chr(65 + i) * 4) for i in range(6)], "EntryID string, seq string")
    assert simsearch.search(q, many, K=4).count() == 6
    assert simsearch.search(q, many, K=4, max_freq=5).count() == 0
    assert simsearch.search(q, many, K=4, max_freq=6).count() == 6
    # no query k-mer at all
    short = spark.createDataFrame([("q", "AB")], "EntryID string, seq string")
    assert simsearch.search(short, refs, K=4).count() == 0


@pytest.mark.parametrize("copies", [64, 65, 1000])
def test_search_keeps_hits_in_large_families(spark, copies):
    import random
    from protea.operators import simsearch
    rng = random.Random(1)
    text = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(300))
    q = spark.createDataFrame([("q1", text), ("q2", text)], "EntryID string, seq string")
    refs = spark.createDataFrame([(i, text) for i in range(copies)], "EntryID int, seq string")
    got = simsearch.search(q, refs).collect()
    assert sorted((r["query_id"], r["subject_id"]) for r in got) == [(x, i) for x in ("q1", "q2") for i in range(16)]
    assert {(r["aln_len"], r["qstart"], r["sstart"]) for r in got} == {(300, 1, 1)}


def test_search_low_complexity_finds_itself(spark):
    from protea.operators import simsearch
    a = spark.createDataFrame([("a", "A" * 100)], "EntryID string, seq string")
    r = simsearch.search(a, a).first()
    assert (r["subject_id"], r["aln_len"], r["qstart"], r["sstart"]) == ("a", 100, 1, 1)


def _longest_runs(queries, refs, K):
    """(query, subject) -> (length, start, start), every pair and diagonal looked at."""
    out = {}
    for qi, q in queries:
        for si, s in refs:
            best = None
            for d in range(-len(s) + 1, len(q)):
                i, j, n = max(d, 0), max(-d, 0), 0
                while i <= len(q) and j <= len(s):
                    if i < len(q) and j < len(s) and q[i] == s[j] and "A" <= q[i] <= "Z":
                        n += 1
                    else:
                        if n >= K:
                            best = max(best or (0, 0, 0), (n, -(i - n), -(j - n)))
                        n = 0
                    i, j = i + 1, j + 1
            if best:
                out[qi, si] = (best[0], 1 - best[1], 1 - best[2])
    return out


@pytest.mark.parametrize("hot", [20_000, 2])  # 2: nearly every code is dealt to a grid
def test_search_against_brute_force(spark, hot):
    import random
    from protea.operators import simsearch
    rng = random.Random(7)
    text = lambda: "".join(rng.choice("AAB-C") for _ in range(rng.randrange(0, 40)))
    queries, refs = [(i, text()) for i in range(8)], [(i, text()) for i in range(25)]
    df = [spark.createDataFrame(x, "EntryID int, seq string") for x in (queries, refs)]
    got = {(r["query_id"], r["subject_id"]): (r["aln_len"], r["qstart"], r["sstart"])
           for r in simsearch.search(*df, K=4, max_targets=100, hot=hot).collect()}
    assert got == _longest_runs(queries, refs, 4)


@pytest.mark.parametrize("most", [1, 3, 100])
def test_search_long_runs_first(spark, monkeypatch, most):
    """Levels, many blocks, tables and slices give the same best runs."""
    import random
    from protea.operators import simsearch
    for name, value in (("DEEP", 0), ("SLICE", 50), ("TABLE", 64)):
        monkeypatch.setattr(simsearch, name, value)
    rng = random.Random(11)
    line = "".join(rng.choice("ABCD") for _ in range(60))
    text = lambda: "".join(rng.choice("AAB-C") for _ in range(rng.randrange(0, 30)))
    part = lambda: line[rng.randrange(30):][:rng.randrange(40)]
    queries, refs = ([(i, text() + part() + text()) for i in range(n)] for n in (8, 40))
    df = [spark.createDataFrame(x, "EntryID int, seq string") for x in (queries, refs)]
    got = {(r["query_id"], r["subject_id"]): (r["aln_len"], r["qstart"], r["sstart"])
           for r in simsearch.search(*df, K=4, max_targets=most).collect()}
    want = _longest_runs(queries, refs, 4)
    ranked = {q: sorted((-want[k][0], k[1]) for k in want if k[0] == q)[:most] for q, _ in queries}
    assert got == {(q, s): want[q, s] for q in ranked for _, s in ranked[q]}


def test_search_of_blocks(monkeypatch):
    """Two blocks against every pair of positions, for windows of any step."""
    import numpy as np
    import random
    from protea.operators import simsearch
    monkeypatch.setattr(simsearch, "SLICE", 40)
    monkeypatch.setattr(simsearch, "TABLE", 32)
    rng = random.Random(12)
    sides = [[(i, "".join(rng.choice("AABC-") for _ in range(rng.randrange(80)))) for i in range(n)] for n in (6, 9)]

    def block(rows):
        letters, starts = simsearch.GAP, []
        for _, x in rows:
            starts.append(len(letters))
            letters += bytes(ord(c) - 65 if c != "-" else simsearch.OTHER for c in x) + simsearch.GAP[:1]
        return np.frombuffer(letters + simsearch.GAP, np.uint8), np.array(starts)
    (q, qs), (r, rs) = map(block, sides)
    q = np.where(q == simsearch.OTHER, simsearch.OTHER - 1, q).astype(np.uint8)
    for L, k in ((4, 4), (8, 4), (12, 5), (6, 3)):
        want = {k2: v for k2, v in _longest_runs(*sides, L).items()}
        got = {(d, s): (n, a + 1, b + 1) for d, s, n, a, b in simsearch._longest(q, qs, r, rs, L, k, 100).T.tolist()}
        assert got == want


def test_runs_between_blocks_that_follow_each_other():
    """Windows of the queries are made once; what one block has spares work in
    the next, and takes no run that is among the best."""
    from protea.operators import simsearch
    rng = np.random.default_rng(4)

    def block(seqs, other):
        letters, starts = [np.full(simsearch.PAD, simsearch.OTHER)], []
        for x in seqs:
            starts.append(sum(map(len, letters)))
            letters += [x, [simsearch.OTHER]]
        b = np.concatenate([*letters, letters[0]]).astype(np.uint8)
        return np.where(b == simsearch.OTHER, other, b).astype(np.uint8), np.array(starts)

    common = [rng.integers(0, 3, n) for n in (40, 90, 700, 5000)]

    def some(n):
        return [np.concatenate([rng.integers(0, 3, 30), common[rng.integers(4)], rng.integers(0, 3, 30)]) for _ in range(n)]
    q, qs = block(some(6), simsearch.OTHER - 1)
    parts = [some(8) for _ in range(4)]
    for L, k, most in ((12, 12, 3), (24, 12, 3), (40, 8, 2)):
        whole = simsearch._longest(q, qs, *block([x for p in parts for x in p], simsearch.OTHER), L, k, most)
        windows, found = simsearch._Windows(q, qs, k), []
        for at, part in enumerate(parts):
            got = simsearch._longest(q, qs, *block(part, simsearch.OTHER), L, k, most, windows)
            found.append(got + np.array([0, 8 * at, 0, 0, 0])[:, None])
        assert simsearch._best(np.concatenate(found, axis=1), most, len(qs))[0].tolist() == whole.tolist()
        assert whole[2].max() >= 5000 and len(set(whole[0])) == 6
        assert sum(f.shape[1] for f in found[1:]) < 18 * most


def test_equal_letters_and_sparse_hashes():
    from protea.operators import simsearch
    rng = np.random.default_rng(5)
    x = np.concatenate([np.full(8, 254), rng.integers(0, 26, 3000), np.full(9, 254)]).astype(np.uint8)
    y = x.copy()
    y[y == 254] = 255
    cut = np.sort(rng.choice(np.arange(8, 3008), 25, replace=False))
    y[cut] = 30
    i = rng.integers(8, 3008, 400)
    ends, begins = (np.append(cut, 3008), np.append(7, cut))
    assert (simsearch._equal(x, i, y, i) == ends[np.searchsorted(ends, i)] - i).all()
    assert (simsearch._equal(x, i, y, i, back=True) == i - 1 - begins[np.searchsorted(begins, i) - 1]).all()
    assert (np.minimum(simsearch._equal(x, i, y, i, most=20), 20) == np.minimum(simsearch._equal(x, i, y, i), 20)).all()
    for k, step, n in ((3, 4, 2), (12, 13, 500), (24, 25, 3017)):
        assert (simsearch._hashes_at(x[:n], k, step) == simsearch._hashes(x[:n], k)[::step]).all()


def test_search_writes_no_seeds(spark, tmpdir_path):
    """What a search leaves on disk is below two bytes a letter."""
    import os
    import random
    from protea import session
    from protea.operators import simsearch
    rng = random.Random(13)
    refs = spark.createDataFrame([(i, "".join(rng.choice("ABCDEFGH") for _ in range(2000))) for i in range(200)], "EntryID int, seq string")
    known = len(session._SCRATCH.get(spark.sparkContext.applicationId, []))
    assert simsearch.search(refs.where("EntryID % 10 = 0"), refs).count() >= 20
    made = session._SCRATCH[spark.sparkContext.applicationId][known:]
    size = sum(os.path.getsize(os.path.join(d, f)) for p in made for d, _, names in os.walk(p.removeprefix("file:")) for f in names)
    assert 0 < size < 2 * 200 * 2000


def test_half_precision(spark):
    import numpy as np
    from protea.functions.math import half_precision
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.standard_normal(2000), rng.standard_normal(500) * 1e-6, rng.standard_normal(500) * 3e4,
                        [0.0, 65504.0, 65519.9, 65520.0, -70000.0, 2.0 ** -14, 2.0 ** -24, 1 + 2.0 ** -11, 1 + 3 * 2.0 ** -11]])
    x = x.astype(np.float32).astype(np.float64)
    got = np.array([r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double")
                    .orderBy("i").select(half_precision(F.col("v"))).collect()])
    with np.errstate(over="ignore"):
        assert (got == x.astype(np.float16).astype(np.float64)).all()


def test_metric_inputs_must_correspond(spark):
    from pyspark.errors import PySparkException
    c = spark.createDataFrame([("e", "t", 0.3, 1.0), ("e", "u", -2.0, 0.0), ("f", "t", 1.5, 0.0), ("f", "u", 1.0, 1.0)],
                              "EntryID string, term string, logit double, y double")
    cells = c.withColumn("score", F.lit(0.5))
    one = spark.createDataFrame([("t", 0.25)], "term string, score double")
    twice = spark.createDataFrame([("t", 0.25), ("t", 0.25), ("u", 1.0)], "term string, score double")
    alpha = one.withColumnRenamed("score", "alpha")
    for bad in (lambda: metrics.focal_loss(c, 2.0, alpha, "mean"), lambda: metrics.focal_loss(c, 2.0, alpha, "none"),
                lambda: metrics.weighted_focal_loss(c, one), lambda: metrics.weighted_focal_loss(c, twice),
                lambda: metrics.fmax(cells, one), lambda: metrics.fmax(cells, twice)):
        with pytest.raises(PySparkException):
            bad().collect()
    sparse = c.where("NOT (EntryID = 'f' AND term = 'u')")
    both = spark.createDataFrame([("t", 0.25), ("u", 1.0)], "term string, score double")
    with pytest.raises(PySparkException):
        metrics.weighted_focal_loss(sparse, both).collect()
    assert metrics.weighted_focal_loss(c, both).first()["loss"] > 0


def test_infinite_scores(spark):
    c = spark.createDataFrame([("a", "t", float("inf"), True), ("b", "t", float("-inf"), False), ("c", "t", 3e7, True)],
                              "EntryID string, term string, score double, y boolean")
    r = metrics.fmax(c).first()
    assert (r["fmax"], r["precision"], r["recall"]) == (1.0, 1.0, 1.0)


def test_readers_find_the_id_column(spark, tmpdir_path):
    for name in ("EntryID", "id", "protein"):
        p = os.path.join(tmpdir_path, name)
        spark.createDataFrame([("x", "ABC")], f"{name} string, seq string").write.parquet(p)
        assert tables.read_sequences(spark, p).first().asDict() == {"EntryID": "x", "seq": "ABC"}
        assert tables.read_keyed(spark, p).columns[0] == "EntryID"


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    from protea import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Fake())


def test_drop_scratch(spark):
    from protea import session
    df = session.saved(spark.range(5), "drop-me")
    path = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert df.count() == 5 and os.path.isdir(path)
    session.drop_scratch(spark)
    assert not os.path.exists(path)


def test_dense_index_across_partitions(spark):
    from protea.operators.common import dense_index
    df = spark.range(0, 5000).selectExpr("id * 7 % 5003 AS k").repartition(17)
    got = dense_index(df, [F.desc("k")], "r").collect()
    ranks = sorted((r["k"], r["r"]) for r in got)
    exp = sorted(zip(sorted((r["k"] for r in got), reverse=True), range(1, 5001)))
    assert ranks == sorted(exp)


def test_optional_inputs(spark, tmpdir_path):
    nowhere = os.path.join(tmpdir_path, "absent")
    assert tables.read_sequences(spark, nowhere, required=False) is None
    assert tables.read_test_ids(spark, nowhere) is None
    assert tables.read_ia(spark, nowhere) is None
    assert tables.read_taxonomy(spark, nowhere, required=False) is None
    with pytest.raises(FileNotFoundError):
        tables.read_taxonomy(spark, nowhere)
    ents = spark.createDataFrame([("a",)], "EntryID string")
    assert align.with_taxonomy(ents, None).first()["taxonomyID"] == -1
    t = os.path.join(tmpdir_path, "test.csv")
    with open(t, "w") as f:
        f.write("id\nP1\nP2\n")
    assert sorted(r["EntryID"] for r in tables.read_test_ids(spark, t).collect()) == ["P1", "P2"]


def test_focal_per_class_alpha(spark):
    c = spark.createDataFrame([("e", "t", 0.3, 1.0), ("e", "u", -2.0, 0.0), ("f", "t", 1.5, 0.0)],
                              "EntryID string, term string, logit double, y double")
    a = spark.createDataFrame([("t", 0.25), ("u", 0.75)], "term string, alpha double")
    per_cell = {(r["EntryID"], r["term"]): r["loss"] for r in metrics.focal_loss(c, 2.0, a, "none").collect()}
    mean = metrics.focal_loss(c, 2.0, a, "mean").first()["loss"]
    total = metrics.focal_loss(c, 2.0, a, "sum").first()["loss"]
    assert total == pytest.approx(sum(per_cell.values()))
    assert mean == pytest.approx(total / 3)


def test_metric_states_add_up(spark):
    from protea.operators import metrics
    rows = [("a", 0.29, True), ("a", 0.5, False), ("b", None, True), ("b", float("nan"), False), ("b", 0.9, True), ("c", float("inf"), True)]
    cells = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "EntryID int, term string, score float, y boolean")
    parts = [metrics.cell_state(cells.where(F.col("EntryID") % 3 == k)) for k in range(3)]
    whole, merged = (sorted(map(tuple, x.collect())) for x in (metrics.cell_state(cells), metrics.merge_states(*parts)))
    assert whole == merged
    assert metrics.fmax_of_state(metrics.merge_states(*parts)).collect() == metrics.fmax(cells).collect()


def test_last_weight_of_a_term(spark):
    from protea.operators import align
    vocab = spark.createDataFrame([("x",), ("y",), ("z",)], "term string")
    ia = spark.createDataFrame([("x", 5.0, 1), ("x", 2.0, 3), ("x", 9.0, 2), ("y", 4.0, 1), ("y", 4.0, 1)], "term string, score double, row int")
    got = {r.term: r.weight for r in align.ia_weights(vocab, ia, on_duplicate="last", order="row").collect()}
    assert got == {"x": 2.0, "y": 4.0, "z": 1.0}
    with pytest.raises(ValueError):
        align.ia_weights(vocab, ia, on_duplicate="last")
    tied = ia.unionByName(spark.createDataFrame([("x", 3.0, 3)], ia.schema))
    with pytest.raises(Exception, match="no last one"):
        align.ia_weights(vocab, tied, on_duplicate="last", order="row").collect()
