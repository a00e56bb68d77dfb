"""Python work on whole groups without one call per group, and connected
components as DataFrame joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protea.llm.common import saved, ship


def map_runs(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]],
             schema: str) -> DataFrame:
    """Deal ``df`` by integer ``keys`` and call ``fn(table, bounds)`` with
    tables of whole groups: group ``i`` is rows ``bounds[i]:bounds[i + 1]``.
    A task holds an Arrow batch and one group at most, so callers bound the
    size of a group by making a block number part of the key."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            cols = [table.column(k).to_numpy() for k in keys]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
            first = tuple(c[0] for c in cols)
            if rest and first != last:
                done = pa.concat_tables(rest)
                yield from fn(done, np.array([0, done.num_rows]))
                rest = []
            last = tuple(c[-1] for c in cols)
            if not len(change):
                rest.append(table)
                continue
            cut = int(change[-1])
            head = pa.concat_tables([*rest, table.slice(0, cut)])
            carried = head.num_rows - cut
            yield from fn(head, np.concatenate([[0], change[:-1] + carried, [head.num_rows]]))
            rest = [table.slice(cut)]
        if rest:
            done = pa.concat_tables(rest)
            yield from fn(done, np.array([0, done.num_rows]))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def with_block_pairs(df: DataFrame, group: str, member: str, count: str, size: int) -> DataFrame:
    """Columns bi <= bj: the pairs of blocks in which a row takes part. The
    ``count`` members of a group are dealt to blocks of about ``size``; any two
    members meet in exactly one pair of blocks (twice, if in the same block of
    a pair of different blocks)."""
    blocks = F.ceil(F.col(count) / F.lit(size)).cast("int")
    b = F.pmod(F.xxhash64(F.lit(11), F.col(member)), blocks).cast("int")
    return (df.withColumn("_b", b)
            .withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
            .withColumn("bi", F.least("_b", "_o")).withColumn("bj", F.greatest("_b", "_o"))
            .drop("_b", "_o"))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component, for every node of
    ``edges`` other than the roots themselves. Alternating star contraction:
    each node hands its larger neighbours, then its smaller ones, to the
    smallest node that it knows. A round is two aggregations and joins over
    the edges, saved in the shared folder; rounds grow with the logarithm of
    the longest path."""
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where("u <> v").distinct())
    e = saved(e, "cc-0")
    seen = None
    for i in range(max_rounds):
        stats = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if not stats["n"] or seen == (stats["n"], stats["s"]):
            break
        seen = (stats["n"], stats["s"])
        # larger neighbours to the smallest of the closed neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        large = saved(large, f"cc-{i}l")
        # smaller neighbours, and the node itself, to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = saved(small, f"cc-{i}s")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
