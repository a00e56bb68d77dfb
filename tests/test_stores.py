"""Votes over stored pairs, and embedding in batches of padded cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paths import SF_ORACLE, SF_SMALL
from protea.operators import embed, vote, votestore
from protea.sources import driver


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", -1)
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def _rows(df):
    return sorted(((r.source, r.query_id, r.term, round(float(r.score), 9)) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [votestore.HOT, 3])
def test_stored_votes_are_the_votes(spark, tmpdir_path, hot):
    hits, terms = driver.hits(spark, SF_SMALL), driver.terms(spark, SF_SMALL)
    hits = hits.unionByName(hits.limit(5).withColumn("subject_id", F.lit(None).cast("long")))
    store = votestore.save_pairs(hits, f"{tmpdir_path}/p", hot=hot)
    assert store.hubs.isEmpty() == (hot > 3)
    for i, t in enumerate([terms, terms.where("term like 'B%'"), terms.unionByName(terms)]):
        kept = votestore.save_terms(t, f"{tmpdir_path}/t{i}")
        assert _rows(store.vote(kept)) == _rows(vote.weighted_vote(hits, t))


def test_nothing_is_shuffled_below_the_join(no_broadcast, tmpdir_path):
    spark = no_broadcast
    store = votestore.save_pairs(driver.hits(spark, SF_SMALL), f"{tmpdir_path}/p")
    terms = votestore.save_terms(driver.terms(spark, SF_SMALL), f"{tmpdir_path}/t")
    joined = store.pairs.join(terms, "subject_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2, plan
    # the whole vote: the buckets' scans feed its first join as they are
    lines = store.vote(terms)._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(lines) if "Union" in x)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-*()0123456789"))
    first = lines[at + 1:]
    second_join = [i for i, x in enumerate(first) if "SortMergeJoin" in x][1]
    assert not any("Exchange" in x for x in first[:second_join]), (depth, lines)


def test_sets_without_a_name_and_no_sets(spark, tmpdir_path):
    hits = spark.createDataFrame([(None, "q", "s", 0.0, 2.0), (None, "q", "x", 0.0, 2.0), ("A", "q", "s", 0.0, 3.0)],
                                 "source string, query_id string, subject_id string, evalue double, bitscore double")
    terms = votestore.save_terms(spark.createDataFrame([("s", "t"), (None, "u")], "EntryID string, term string"), f"{tmpdir_path}/t")
    got = votestore.save_pairs(hits, f"{tmpdir_path}/a").vote(terms)
    assert sorted(map(tuple, got.collect()), key=str) == [("A", "q", "t", 1.0), (None, "q", "t", 0.5)]
    got = votestore.save_pairs(hits, f"{tmpdir_path}/b", by=()).vote(terms)
    assert list(map(tuple, got.collect())) == [("q", "t", 5.0 / 7.0)]
    got = votestore.save_pairs(hits.where("false"), f"{tmpdir_path}/c").vote(terms)
    assert got.collect() == []


# ------------------------------------------------------------ padded cells

def test_batches_hold_at_most_their_cells():
    rng = np.random.default_rng(0)
    for lengths in (np.sort(rng.integers(0, 300, 500))[::-1], rng.integers(0, 300, 500), np.array([5000, 3, 0, 0]), np.array([], int)):
        cuts = list(embed.cell_batches(lengths, 1000))
        assert [i for lo, hi in cuts for i in range(lo, hi)] == list(range(len(lengths)))
        for lo, hi in cuts:
            assert (hi - lo) * lengths[lo:hi].max() <= 1000 or hi - lo == 1


def test_the_mean_is_over_masked_tokens_only():
    v = np.array([[[1, 2], [3, 4], [100, 100]], [[5, 5], [7, 7], [9, 9]]], np.float32)
    got = embed.masked_mean(v, np.array([[1, 1, 0], [0, 0, 0]], bool))
    assert got.tolist() == [[2, 3], [0, 0]]


@pytest.mark.parametrize("cells", [1, 3_000, 1 << 15])
def test_cells_change_no_vector_and_padding_is_small(spark, cells):
    s = driver.seqs(spark, SF_SMALL).select("EntryID", "seq")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "é1"), (-4, "AB" * 40_000)], s.schema)
    s = s.unionByName(extra)
    got = embed.embed_tokens(s, embed.table_token_model(8), cells=cells, padded_col="padded")
    want = embed.embed(s.na.fill("", ["seq"]), embed.table_model(8), dim=8)
    a = {r.EntryID: r.embedding for r in got.collect()}
    b = {r.EntryID: r.embedding for r in want.collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-4) for k in a)


def test_padding_ratio(spark):
    s = driver.seqs(spark, SF_ORACLE).select("EntryID", "seq").coalesce(2)
    e = embed.embed_tokens(s, embed.table_token_model(8), padded_col="padded")
    r = e.agg((F.sum("padded") / F.sum(F.length("seq"))).alias("r")).first().r
    assert 1 <= r < 1.15, r
