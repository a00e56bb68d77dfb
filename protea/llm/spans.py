"""Where patterns match in texts, with DataFrame functions only.

``regexp_extract_all`` gives the matches of a pattern and ``split`` what lies
between them; both search leftmost and without overlap, so the lengths, summed
up in order, give each match's place in code points.

Patterns are possessive wherever the character after a repetition cannot
belong to it: the matches are the same, and no text makes the search go back
or nest deeply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MATCH = "struct<kind:string,i:int,gap:int,value:string,before:string>"


def _found(text: Column, kind: str, pattern: str, context: int) -> Column:
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    return F.zip_with(F.transform(gaps, lambda g, i: F.struct(g.alias("g"), i.alias("i"))), matches, lambda x, m: F.struct(
        F.lit(kind).alias("kind"), x["i"].alias("i"), F.length(x["g"]).alias("gap"), m.alias("value"),
        F.right(x["g"], F.lit(context)).alias("before")))


def find(docs: DataFrame, patterns: dict[str, tuple[str, str | None]], context: int = 0) -> DataFrame:
    """Rows (row, doc_id, kind, start, stop, value, before) for every match of
    ``patterns`` {kind: (pattern, pattern that the text must contain)} and,
    with a null kind, one row per document. ``before`` is up to ``context``
    code points between the match and the one of its kind before it. ``docs``
    has row, doc_id and text (not null)."""
    none = F.array().cast(f"array<{MATCH}>")
    each = []
    for kind, (pattern, needs) in patterns.items():
        needs = pattern if needs is None else needs
        each.append(F.when(F.col("text").rlike(needs), _found(F.col("text"), kind, pattern, context)).otherwise(none))
    marker = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"),
                              F.lit("").alias("value"), F.lit("").alias("before")))
    rows = docs.select("row", "doc_id", F.explode(F.concat(marker, *each)).alias("x")).select("row", "doc_id", "x.*")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap").cast("long") + F.length("value")).over(before)
    return rows.withColumn("stop", stop).select(
        "row", "doc_id", "kind", (F.col("stop") - F.length("value")).alias("start"), "stop", "value", "before")


def numbered(docs: DataFrame, text: Column) -> DataFrame:
    """row, doc_id, text; see decontaminate.numbered."""
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))


def listed(kinds: list[str], keep: Column) -> Column:
    """Aggregate: kind:start:end of the spans that ``keep`` selects, by start,
    then kind as listed, comma-joined."""
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    entry = F.struct("start", order.alias("o"), "stop", "kind")
    return F.array_join(F.transform(
        F.sort_array(F.collect_list(F.when(keep, entry))),
        lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
