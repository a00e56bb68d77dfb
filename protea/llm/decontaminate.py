"""Benchmark decontamination with a broadcast set of test n-grams.

Only DataFrame functions. Every window of ``n`` consecutive words of a
benchmark item (an item of fewer words is one window) is filed under its
longest word. The documents are scanned once: their words are exploded and
meet the set in a broadcast hash join on that word; a candidate is then
verified against the words of the whole window. Nothing is shuffled but the
hits and one marker row per document.

The set grows with the benchmark and not with the corpus; its size is measured
first, and beyond ``broadcast_mb`` single words are shuffled to it instead, and
what they meet is verified back at the document: linear in the words as well.

Words are maximal runs of ``[a-z0-9]`` and characters beyond ASCII, after
lower-casing A to Z.

Cases: a null or empty text has no words and is never contaminated; repeated
rows of ``docs`` are judged each on its own, also where ids repeat or are null;
repeated items count once per item_id; items with a null id hit as others do,
have no name in the list of items and count there as one; items without words
are ignored; an empty table on either side gives no hits; ``remove`` keeps
every other column of its input as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protea.llm.common import free_names, saved, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORIGINAL_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
N = 13
BROADCAST_MB = 64


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), "")


def windows(bench: DataFrame, n: int = N) -> DataFrame:
    """One row per distinct window: anchor (its longest word), offset of the
    anchor, length, the window's words joined by spaces, and its items."""
    w = (bench.select(F.col("item_id").cast("string").alias("item"), words(text_of(bench)).alias("w"))
         .where(F.size("w") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (n - 1)))
    each = w.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), n).alias("w"))
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("l"), x.alias("x"))))["x"]
    return (each.groupBy("w")
            .agg(F.sort_array(F.collect_set(F.struct("item"))["item"]).alias("items"))  # with null, in a struct
            .select("w", "items", longest.alias("anchor"))
            .select("anchor", (F.array_position("w", F.col("anchor")) - 1).cast("int").alias("offset"),
                    F.size("w").alias("len"), F.array_join("w", " ").alias("window"), "items"))


def hits(docs: DataFrame, bench: DataFrame, n: int = N, broadcast_mb: float = BROADCAST_MB) -> DataFrame:
    """Per row of ``docs`` (column ``row``: its number): doc_id, n_words, spans
    (sorted distinct [first word, length] of occurring windows) and items."""
    found = windows(bench, n)
    mb = (found.agg(F.sum(F.length("window") + F.length("anchor") + F.length(F.array_join("items", ",")) + 64)
                    .alias("b")).first()["b"] or 0) / 1e6
    d = docs.select("row", "doc_id", words(text_of(docs)).alias("w"))
    start = F.col("p") - F.col("offset")  # counted from 1; the marker stands at 0
    whole = (start >= 1) & (start + F.col("len") <= F.size("w") + 1) & \
            (F.array_join(F.slice("w", F.greatest(start, F.lit(1)), F.col("len")), " ") == F.col("window"))
    span = F.struct(start.alias("s"), "len")
    if mb <= broadcast_mb:
        marker = found.sparkSession.createDataFrame(
            [("", 0, 0, "", [])], "anchor string, offset int, len int, window string, items array<string>")
        each = (d.select("row", "doc_id", "w", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("p", "anchor"))
                .join(F.broadcast(found.unionByName(marker)), "anchor"))
        kept = each.where((F.col("anchor") == "") | whole) \
                   .select("row", "doc_id", F.size("w").alias("n"), F.when(F.col("anchor") != "", span).alias("span"),
                           F.when(F.col("anchor") != "", F.col("items")).alias("items"))
    else:
        # single words go through the shuffle, and what has met a window goes
        # back to its document's words, which move once
        d = saved(d, "document-words")
        met = (d.select("row", F.posexplode("w").alias("p", "anchor")).withColumn("p", F.col("p") + 1)
               .join(found, "anchor").drop("anchor"))
        hit = met.join(d.select("row", "w"), "row").where(whole).select("row", span.alias("span"), "items")
        kept = d.select("row", "doc_id", F.size("w").alias("n"), F.lit(None).cast(hit.schema["span"].dataType).alias("span"),
                        F.lit(None).cast("array<string>").alias("items")).unionByName(
            hit.select("row", F.lit(None).cast(dict(d.dtypes)["doc_id"]).alias("doc_id"), F.lit(0).alias("n"), "span", "items"))
    return (kept.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n"),
                                    F.sort_array(F.collect_set("span")).alias("spans"),
                                    F.collect_set("items").alias("items"))
            .select("row", "doc_id", F.col("n").cast("long").alias("n_words"), "spans",
                    F.sort_array(F.array_distinct(F.flatten("items"))).alias("items")))


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted [start, length] spans."""
    def step(acc, x):
        end = x["s"] + x["len"]
        return F.struct((acc["n"] + F.greatest(F.lit(0), end - F.greatest(x["s"], acc["end"]))).alias("n"),
                        F.greatest(acc["end"], end).alias("end"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"]).cast("long")


def judge(docs: DataFrame, bench: DataFrame, n: int = N, **how) -> DataFrame:
    """row, doc_id, n_words, n_hit, n_items, items, spans and contaminated (at
    least one hit, and a twentieth of the words or more)."""
    h = hits(docs, bench, n, **how).withColumn("n_hit", _covered(F.col("spans")))
    return h.select("row", "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "spans",
                    ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def numbered(docs: DataFrame) -> DataFrame:
    """A number for each row; the rows must come from files, so that a task
    that runs again numbers them as before."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def report(docs: DataFrame, bench: DataFrame, n: int = N) -> DataFrame:
    return judge(numbered(docs.select("doc_id", "text")), bench, n).select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def remove(docs: DataFrame, bench: DataFrame, n: int = N, spans_only: bool = False) -> DataFrame:
    """``docs`` without contaminated rows; or, with ``spans_only``, with the
    hit words of contaminated rows cut out of their texts (separators stay)."""
    *keys, hit = free_names(docs, "_k1", "_k2", "_hit_spans")
    content = F.struct(F.coalesce("doc_id", F.lit(-1)).alias("i"), F.col("doc_id").isNull().alias("none"),
                       text_of(docs).alias("t"))  # equal rows are judged alike
    d = docs.withColumns({keys[0]: F.xxhash64(content), keys[1]: F.xxhash64(F.lit(1), content)})
    bad = (judge(numbered(d.select(F.struct(*keys).alias("doc_id"), "text")), bench, n).where("contaminated")
           .groupBy("doc_id").agg(F.first("spans").alias(hit))
           .select("doc_id.*", hit))
    if not spans_only:
        return d.join(bad.hint("shuffle_hash"), keys, "left_anti").drop(*keys)  # the texts need no sorting
    both = d.join(bad, keys, "left")
    parts = F.split(both["text"], ORIGINAL_WORDS, -1)
    found = F.regexp_extract_all(both["text"], F.lit(ORIGINAL_WORDS), F.lit(0))
    zipped = F.zip_with(parts, F.transform(
        found, lambda x, i: F.when(F.exists(hit, lambda s: (i + 1 >= s["s"]) & (i + 1 < s["s"] + s["len"])),
                                   F.lit("")).otherwise(x)),
        lambda gap, x: F.concat(gap, F.coalesce(x, F.lit(""))))
    text = F.when(F.col(hit).isNull(), both["text"]).otherwise(F.array_join(zipped, ""))
    return both.withColumn("text", text).select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT row, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS win
  FROM (SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS s
        FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT DISTINCT dw.row, dw.s, dw.k, bw.item FROM dw JOIN bw USING (k, win)),
h AS (SELECT row, count(DISTINCT p) AS n_hit
      FROM (SELECT row, unnest(range(s, s + k)) AS p FROM m) GROUP BY row),
i AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT row, item FROM m) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN i USING (row)
"""
