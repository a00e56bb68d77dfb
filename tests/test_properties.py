"""Property tests against brute-force renditions of the reference semantics."""

import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from protea.operators import align, metrics, vote

hit = st.tuples(st.sampled_from(["A", "B", "C"]), st.sampled_from(["q1", "q2", "q3"]),
                st.sampled_from(["s1", "s2", "s3", "s4"]),
                st.sampled_from([1e-5, 1e-4, 0.00099, 0.001, 0.5, float("nan")]),
                st.integers(0, 50).map(float))
term = st.tuples(st.sampled_from(["s1", "s2", "s3"]), st.sampled_from(["t1", "t2", "t3"]))


def brute_vote(hits, terms, thr=1e-3):
    go = defaultdict(list)
    for e, t in terms:
        go[e].append(t)
    per_set = defaultdict(lambda: defaultdict(dict))
    for src in {h[0] for h in hits}:
        by_q = defaultdict(list)
        for s, q, subj, ev, bits in hits:
            if s == src:
                by_q[q].append((subj, ev, bits))
        for q, rows in by_q.items():
            kept = [r for r in rows if r[1] < thr]
            if not kept:
                continue
            total = sum(r[2] for r in kept)
            score = defaultdict(float)
            for subj, _, bits in kept:
                for t in go.get(subj, []):
                    score[t] += bits
            for t, v in score.items():
                per_set[src][q][t] = v / total if total else None
    merged = {}
    for src, qs in per_set.items():
        for q, ts in qs.items():
            for t, v in ts.items():
                if v is None:
                    continue
                merged[(q, t)] = max(merged.get((q, t), v), v)
    return merged


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(hit, min_size=1, max_size=25), st.lists(term, max_size=10))
def test_vote_merge_equals_brute_force(spark, hits, terms):
    h = spark.createDataFrame(hits, "source string, query_id string, subject_id string, evalue double, bitscore double")
    t = spark.createDataFrame(terms or [("zz", "t0")], "EntryID string, term string")
    got = {(r["query_id"], r["term"]): r["score"] for r in vote.max_merge(vote.weighted_vote(h, t)).collect()}
    exp = brute_vote(hits, terms or [("zz", "t0")])
    assert set(got) == set(exp)
    for k in exp:
        assert math.isclose(got[k], exp[k], rel_tol=1e-12)


def brute_fmax(s, y, w=None):
    w = np.ones_like(s, dtype=np.float64) if w is None else w
    best = (0.0, 0.0, 0.0)
    for k in range(1, 100):
        p = s >= np.float32(k / 100.0)
        tp, fp, fn = (w * (p & y)).sum(), (w * (p & ~y)).sum(), (w * (~p & y)).sum()
        pr = tp / (tp + fp) if tp + fp > 0 else 0.0
        rc = tp / (tp + fn) if tp + fn > 0 else 0.0
        if pr + rc > 0:
            f = 2 * pr * rc / (pr + rc)
            if f > best[0]:
                best = (f, pr, rc)
    return best


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 100), st.booleans(), st.sampled_from(["t1", "t2", "t3"])),
                min_size=1, max_size=60))
def test_weighted_fmax_equals_brute_force(spark, cells):
    rows = [(f"e{i}", t, np.float32(v / 100.0).item(), y) for i, (v, y, t) in enumerate(cells)]
    c = spark.createDataFrame(rows, "EntryID string, term string, score float, y boolean")
    ia = spark.createDataFrame([("t1", 2.0), ("t2", 0.5)], "term string, score double")
    s = np.array([r[2] for r in rows], dtype=np.float32)
    y = np.array([r[3] for r in rows])
    w = np.array([{"t1": 2.0, "t2": 0.5}.get(r[1], 1.0) for r in rows])
    r = metrics.fmax(c, align.ia_weights(c, ia)).first()
    assert (r["fmax"], r["precision"], r["recall"]) == pytest.approx(brute_fmax(s, y, w), rel=1e-9)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["e1", "e2", "e3", "e4"]), st.sampled_from(list("abcdefg"))),
                min_size=1, max_size=40), st.integers(1, 8))
def test_top_k_and_dedupe_equal_brute_force(spark, pairs, k):
    from collections import Counter

    from protea.operators import labels, seqops
    df = spark.createDataFrame(pairs, "EntryID string, term string")
    counts = Counter(t for _, t in pairs)
    exp = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:k]
    got = [(r["term"], r["n"]) for r in labels.top_k_labels(df, k).orderBy("rank").collect()]
    assert got == exp
    ranks = [r["rank"] for r in labels.top_k_labels(df, k).orderBy("rank").collect()]
    assert ranks == list(range(1, len(exp) + 1))
    rep = seqops.dedupe_report(df.withColumnRenamed("term", "seq")).first()
    assert (rep["n_in"], rep["n_out"]) == (len(pairs), len(set(pairs)))
    assert rep["has_duplicates"] == (len(pairs) != len(set(pairs)))
