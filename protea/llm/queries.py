"""The registered queries of this subpackage: operator N on its whole table,
with production parameters, plus DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from protea.llm import (bpe, decontaminate, html_text, minmax, pieces, pii, prefix_trie, quality, runs, secrets,
                        token_counts, toxicity, warc)
from protea.llm.common import read, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


@_query("op8_toxicity")
def op8(spark, sf_dir):
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@_query("op6_minmax", minmax.ORACLE)
def op6(spark, sf_dir):
    return minmax.near_duplicates(read(spark, sf_dir, "documents"), threshold=0.85)


@_query("op5_decontaminate", decontaminate.ORACLE)
def op5(spark, sf_dir):
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@_query("op7_secrets", secrets.ORACLE)
def op7(spark, sf_dir):
    return secrets.report(read(spark, sf_dir, "documents"))


@_query("op1_pii")
def op1(spark, sf_dir):
    return pii.report(read(spark, sf_dir, "documents"))


@_query("op2_bpe")
def op2(spark, sf_dir):
    return bpe.report(read(spark, sf_dir, "documents"))


@_query("op3_quality", quality.ORACLE)
def op3(spark, sf_dir):
    return quality.report(read(spark, sf_dir, "documents"))


@_query("op9_token_counts")
def op9(spark, sf_dir):
    return token_counts.report(read(spark, sf_dir, "documents"))


@_query("op4_warc", warc.ORACLE)
def op4(spark, sf_dir):
    return warc.round_trip(read(spark, sf_dir, "pages"))


@_query("op10_html_text")
def op10(spark, sf_dir):
    return html_text.extract(read(spark, sf_dir, "pages"))


@_query("op11_runs")
def op11(spark, sf_dir):
    return runs.report(read(spark, sf_dir, "documents"))


@_query("op12_pieces")
def op12(spark, sf_dir):
    return pieces.report(read(spark, sf_dir, "documents"))


@_query("op13_prefix_trie")
def op13(spark, sf_dir):
    return prefix_trie.report(read(spark, sf_dir, "conversations"))
