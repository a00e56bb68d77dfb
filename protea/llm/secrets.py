"""Secret scan with multipart credential linking.

Strong patterns (an assignment, an access identifier, a long hexadecimal run)
are reported wherever they occur. Weak parts say little alone: a name or
account assignment, an endpoint, an opaque token. They are interval-joined
within a scope of ``SCOPE`` code points before and after each part, whatever
the parts' lengths, and reported only
where complementary parts meet there: a token with an identifier or endpoint
beside it, an identifier with a secret beside it, an endpoint with both. The
join only asks whether a partner exists, so it runs as range windows over a
document's parts, and no pairs are made. Only DataFrame functions.

Spans are code points, end exclusive; of an assignment the span is the whole
match. Weak spans that overlap a strong one are left out.

Cases: a null or empty text has no spans; repeated rows are scanned each on
its own; null ids stay null; an empty table gives an empty result;
``without_secrets`` keeps every other column as it is, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protea.llm import spans
from protea.llm.common import free_names, sha256_hex, text_of

SCOPE = 200
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
BASE = {
    "assign": (ASSIGN, None),
    "access": (r"AKIA[A-Z0-9]++", None),
    "hex": (r"[0-9a-f]{16,}+", None),
}
WEAK = {
    "ident": (r"""(?i:access_?key_?id|client_?id|user_?name|user|login|account)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9@._+-]{3,}+""",
              r"(?i)access_?key_?id|client_?id|user|login|account"),
    "endpoint": (r"""(?i:https?|s3|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp)://[A-Za-z0-9][^\x00-\x20"'<>]{3,}+""",
                 "://"),
    "opaque": (r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}+)?", r"[A-Za-z0-9+/_-]{20}"),
}
KINDS = [*BASE, *WEAK]


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Rows (row, doc_id, kind, start, stop, value) of reported spans, and one
    with a null kind per document."""
    found = spans.find(spans.numbered(docs, text_of(docs)), BASE | WEAK)
    value, kind = F.col("value"), F.col("kind")
    valid = (kind.isNull()
             | ((kind == "assign") & (F.length(F.regexp_extract(value, "^" + ASSIGN + "$", 1)) >= 12))
             | ((kind == "access") & (F.length(value) >= 18)) | kind.isin("hex", "ident", "endpoint")
             | ((kind == "opaque") & value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")))
    found = found.where(valid)
    base = kind.isin(*BASE)
    # overlap with a strong span: the farthest end of those that start before,
    # or one that starts inside
    at_or_before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    found = (found.withColumn("_end", F.max(F.when(base, F.col("stop"))).over(at_or_before))
             .withColumn("_next", F.min(F.when(base, F.col("start"))).over(later))
             .withColumn("_over", (F.coalesce("_end", F.lit(0)) > F.col("start"))
                         | (F.coalesce(F.col("_next") < F.col("stop"), F.lit(False)))))
    found = found.where(kind.isNull() | base | ~F.col("_over")).drop("_end", "_next", "_over")

    def near(*kinds: str) -> Column:
        # at most ``scope`` between the end of the one and the start of the other
        part = kind.isin(*kinds)
        return (F.coalesce(F.max(F.when(part, F.col("stop"))).over(at_or_before) >= F.col("start") - scope, F.lit(False))
                | F.coalesce(F.min(F.when(part, F.col("start"))).over(later) <= F.col("stop") + scope, F.lit(False)))
    found = (found.withColumn("_secret", near("assign", "hex", "opaque"))
             .withColumn("_id", near("access", "ident")).withColumn("_place", near("endpoint")))
    linked = (F.when(kind == "opaque", F.col("_id") | F.col("_place"))
              .when(kind == "ident", F.col("_secret")).when(kind == "endpoint", F.col("_secret") & F.col("_id"))
              .otherwise(F.lit(True)))
    return found.where(linked).drop("_secret", "_id", "_place")


def report(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    kind = F.col("kind")
    return (scan(docs, scope).groupBy("row").agg(
                F.max("doc_id").alias("doc_id"),
                *[F.count(F.when(kind == k, 1)).alias(f"n_{k}") for k in BASE],
                sha256_hex(spans.listed(KINDS, kind.isin(*BASE))).alias("base_sha256"),
                spans.listed(KINDS, kind.isNotNull()).alias("spans"))
            .drop("row"))


def without_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span cut out of its text and replaced by
    ``[SECRET]``; no row goes. ``n_chars``, where present, is brought up to date."""
    *keys, cut = free_names(docs, "_k1", "_k2", "_cuts")
    content = F.coalesce(docs["text"], F.lit(""))
    d = docs.withColumns({keys[0]: F.xxhash64(content), keys[1]: F.xxhash64(F.lit(1), content)})
    found = scan(d.select(F.struct(*keys).alias("doc_id"), "text"), scope).where("kind is not null")
    cuts = (found.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("c"))
            .groupBy("doc_id").agg(F.first("c").alias(cut)).select("doc_id.*", cut))
    both = d.join(cuts.hint("shuffle_hash"), keys, "left")  # the texts need no sorting
    text = F.col("text")

    def step(acc, x):
        piece = F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        new = F.when(x["start"] >= acc["at"], F.concat(piece, F.lit("[SECRET]"))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], F.array(new)).alias("out"),
                        F.greatest(acc["at"], x["stop"].cast("int")).alias("at"))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    cleaned = F.aggregate(cut, start, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    out = both.withColumn("text", F.when(F.col(cut).isNull(), text).otherwise(cleaned))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars"))
                             .otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
m1 AS (SELECT row, 1 AS o, 'assign' AS kind, regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS m, regexp_split_to_array(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') AS g FROM d
       UNION ALL SELECT row, 2, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM d
       UNION ALL SELECT row, 3, 'hex', regexp_extract_all(t, '[0-9a-f]{16,}'), regexp_split_to_array(t, '[0-9a-f]{16,}') FROM d
       UNION ALL SELECT row, 4, 'ident', regexp_extract_all(t, '(?i:access_?key_?id|client_?id|user_?name|user|login|account)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._+-]{3,}'), regexp_split_to_array(t, '(?i:access_?key_?id|client_?id|user_?name|user|login|account)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@._+-]{3,}') FROM d
       UNION ALL SELECT row, 5, 'endpoint', regexp_extract_all(t, '(?i:https?|s3|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp)://[A-Za-z0-9][^\x00-\x20"''<>]{3,}'), regexp_split_to_array(t, '(?i:https?|s3|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqps?|ftp)://[A-Za-z0-9][^\x00-\x20"''<>]{3,}') FROM d
       UNION ALL SELECT row, 6, 'opaque', regexp_extract_all(t, '[A-Za-z0-9+/_-]{20,}={0,2}'), regexp_split_to_array(t, '[A-Za-z0-9+/_-]{20,}={0,2}') FROM d),
each AS (SELECT row, o, kind, m, g, unnest(range(1, len(m) + 1)) AS i FROM m1 WHERE len(m) > 0),
placed AS (
  SELECT row, o, kind, m[i] AS v,
         list_sum([length(x) for x in g[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS start
  FROM each),
valid AS (
  SELECT row, o, kind, CAST(start AS BIGINT) AS start, CAST(start + length(v) AS BIGINT) AS stop FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(v, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12
             WHEN 'access' THEN length(v) >= 18
             WHEN 'opaque' THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
             ELSE true END),
free AS (
  SELECT * FROM valid v
  WHERE o <= 3 OR NOT EXISTS (SELECT 1 FROM valid s WHERE s.row = v.row AND s.o <= 3 AND s.start < v.stop AND s.stop > v.start)),
near AS (
  SELECT a.row, a.o, a.kind, a.start, a.stop, bool_or(b.kind IN ('assign', 'hex', 'opaque')) AS secret,
         bool_or(b.kind IN ('access', 'ident')) AS id, bool_or(b.kind = 'endpoint') AS place
  FROM free a JOIN free b ON a.row = b.row AND b.start <= a.stop + 200 AND b.stop >= a.start - 200
  GROUP BY a.row, a.o, a.kind, a.start, a.stop),
kept AS (
  SELECT * FROM near
  WHERE CASE kind WHEN 'opaque' THEN id OR place WHEN 'ident' THEN secret WHEN 'endpoint' THEN secret AND id ELSE true END),
s AS (
  SELECT row, count(*) FILTER (WHERE o = 1) AS n_assign, count(*) FILTER (WHERE o = 2) AS n_access,
         count(*) FILTER (WHERE o = 3) AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (WHERE o <= 3) AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans
  FROM kept GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s ON s.row = d.row
"""
