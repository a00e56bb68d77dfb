"""The pipeline's stages, each against a brute-force version of its decision."""

import brute
import corpus_pipeline
from protea.llm.common import saved

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "secrets", "bpe"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, SF), "test-stage")
        seen[name] = (before, docs)
        assert name == "bpe" or docs.columns == columns
    before, after = map(rows, seen["toxicity"])
    assert 0 < len(after) < len(before) and all(before[i] == t for i, t in after.items())
    before, after = map(rows, seen["near_duplicates"])
    assert set(after) == {c for _, c in brute.near_duplicates(list(before.items()), 80).values()}
    before, after = map(rows, seen["decontamination"])
    assert set(after) == {x[0] for x in brute.contamination(list(before.items()), bench) if not x[5]}
    before, after = map(rows, seen["secrets"])
    assert set(after) == set(before)
    for i, t in before.items():
        found = brute.secrets(t)
        if not any(found[f"n_{k}"] for k in brute.KIND_7):
            assert after[i] == t
        else:
            assert "[SECRET]" in after[i] and not any(brute.secrets(after[i])[f"n_{k}"] for k in brute.KIND_7)
    last = docs.collect()
    assert len(last) == len(after) and all(r.lossless and r.n_tokens * 4 == len(r.ids) for r in last)


def test_run_equals_stages(spark):
    import __spark_entry__ as entry
    out = entry.queries()["pipeline"](spark, SF)
    assert out.count() > 0 and "ids" in out.columns


def test_empty_documents(spark):
    docs = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF), "test-empty")
    assert docs.count() == 0


def test_odd_documents(spark):
    from test_contracts import ODD
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, kind int, _k1 string, spans string"
    rows = [(i, t, None if i % 2 else "en", None, None if t is None else len(t), "r", 1, None, "s") for i, t in enumerate(ODD)]
    rows += [rows[8], (None, "a row without an id", "en", "s", 19, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, SF), "test-odd")
        assert name == "bpe" or docs.dtypes == before.dtypes
        assert docs.where("doc_id is null").count() == 2  # nothing in them is toxic, a copy, or of the benchmark
    texts = dict(enumerate(ODD))
    last = {r.doc_id: r for r in docs.collect()}
    assert all(r.lossless for r in last.values())
    assert 8 in last and 9 not in last  # one of two equal texts stays
    assert {0, 1, 2, 3} <= set(last)    # texts without words are linked with nothing
    assert last[0].n_tokens == 0 and texts[0] is None
