"""Line-first cleaning.

Every line with a word is judged on its own, before the document is:

* punctuation: symbols ``#*$%&|<>`` are over 5 % of its characters, or it has
  fewer than 5 words and does not end a sentence;
* navigation: a fifth of its words or more are separators between items, or a
  third or more only repeat the word before;
* boilerplate: it holds a phrase of page furniture.

Failing lines are removed, and a document that loses over ``max_lost`` of its
words by that is rejected, as is one that fails the base rules. Everything is
an expression over a row, in one scan and without a shuffle.

Base rules, over words ``[^\\x20\\x09-\\x0D]+`` of the whole text: fewer than
20 words, or over 30 % of the words inside 8-word windows that occur twice or
more. Windows are told apart by 64-bit hashes of their words.

Cases: a null or empty text has no words, fails the base rules and has an empty
cleaned text; repeated rows are judged each on its own; null ids stay; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from protea.llm.common import free_names, text_of

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 30
MAX_LOST = 0.5
SENTENCE_END = r"""[.!?\u2026\u3002]["'\u00BB\u201D)\]]*[\x20\x09-\x0D]*$"""

# phrases of page furniture; a fixed list
BOILERPLATE = (r"(?i)all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|licensed under"
               r"|released under the|click here|subscribe to our|enable javascript|copyright (?:\(c\)|\u00A9|[0-9]{4})")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def bind(value: Column, fn) -> Column:
    """fn(value), with the value computed once however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def window_hashes(ws: Column, size: int = WINDOW) -> Column:
    """A 64-bit hash of the words of each window; none in a shorter text."""
    return F.when(F.size(ws) >= size, F.transform(
        F.sequence(F.lit(1), F.size(ws) - (size - 1)), lambda i: F.xxhash64(F.slice(ws, i, size)))) \
        .otherwise(F.array().cast("array<bigint>"))


def repeated_words(hashes: Column, size: int = WINDOW) -> Column:
    """How many words lie in windows that occur at least twice. Windows are
    sorted by hash, twins are neighbours, and their places, sorted, cover the
    words; a text without twins is spared that."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twins(s: Column) -> Column:
        def same(e: Column, j: Column) -> Column:
            return (F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False))
                    | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
        return F.array_sort(F.transform(F.filter(s, same), lambda e: e["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last"))
    covered = F.aggregate(bind(placed, twins), zero, lambda a, x: F.struct(
        (a["n"] + F.least(F.lit(size), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered)


def line_fails(line: Column, ws: Column) -> Column:
    n = F.size(ws)
    symbols = F.length(F.regexp_replace(line, r"[^#*$%&|<>]++", ""))
    litter = 20 * symbols > F.length(F.regexp_replace(line, SPACE, ""))
    fragment = (n < 5) & ~line.rlike(SENTENCE_END)
    separators = F.size(F.filter(ws, lambda w: w.isin("|", "\u00BB", "\u203A", "\u2022", "\u00B7", ">", "/")))
    echoes = F.size(F.filter(ws, lambda w, i: (i > 0) & F.coalesce(F.get(ws, i - 1) == w, F.lit(False))))
    return litter | fragment | (5 * separators >= n) | (3 * echoes >= n) | line.rlike(BOILERPLATE)


def clean(docs: DataFrame, max_lost: float = MAX_LOST, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lost_words (in failing lines), base_failed, kept and
    clean_text (the lines that passed). Columns of these names are replaced."""
    t, ws, ls, g, j = free_names(docs, "_text", "_words", "_lines", "_g", "_judged")
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    judged = F.transform(ls, lambda x: bind(words(x), lambda w: F.struct(
        x.alias("line"), F.size(w).alias("n"), line_fails(x, w).alias("fails"))))
    d = docs.withColumn(t, text_of(docs, text_col)).withColumns({ws: words(F.col(t)), ls: lines})
    d = d.withColumns({g: window_hashes(F.col(ws)), j: judged})
    lost = F.aggregate(j, F.lit(0), lambda a, x: a + F.when(x["fails"], x["n"]).otherwise(0))
    n = F.col("n_words")
    d = d.withColumns({
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]++", "")).cast("long"),
        "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
        "n_repeat_words": repeated_words(F.col(g)).cast("long"),
        "n_lost_words": lost.cast("long"),
        "clean_text": F.array_join(F.transform(F.filter(j, lambda x: ~x["fails"]), lambda x: x["line"]), "\n"),
    })
    d = d.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * n))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= max_lost * n))
    return d.drop(t, ws, ls, g, j)


def report(docs: DataFrame) -> DataFrame:
    return clean(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(list_slice(w, s, s + 7), ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM d WHERE len(w) >= 8)),
twin AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c >= 2),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + 8)) AS p FROM twin) GROUP BY doc_id),
line AS (
  SELECT doc_id, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)),
judged AS (
  SELECT doc_id, l, len(w) AS n,
         20 * length(regexp_replace(l, '[^#*$%&|<>]+', '', 'g')) > length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))
         OR (len(w) < 5 AND NOT regexp_matches(l, '[.!?\x{2026}\x{3002}]["''\x{00BB}\x{201D})\]]*[\x20\x09-\x0D]*$'))
         OR 5 * len([x for x in w if x IN ('|', chr(187), chr(8250), chr(8226), chr(183), '>', '/')]) >= len(w)
         OR 3 * len([i for i in range(2, len(w) + 1) if w[i] = w[i - 1]]) >= len(w)
         OR regexp_matches(l, '(?i)all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|licensed under|released under the|click here|subscribe to our|enable javascript|copyright (?:\(c\)|\x{00A9}|[0-9]{4})')
         AS fails
  FROM line WHERE len(w) > 0),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS dup, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost FROM judged GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
       length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines,
       coalesce(repeated.n, 0) AS n_repeat_words,
       len(w) < 20 OR 100 * coalesce(repeated.n, 0) > 30 * len(w) AS base_failed,
       NOT (len(w) < 20 OR 100 * coalesce(repeated.n, 0) > 30 * len(w)) AND coalesce(lost, 0) <= 0.5 * len(w) AS kept
FROM d LEFT JOIN lines ON lines.doc_id = d.doc_id LEFT JOIN repeated ON repeated.doc_id = d.doc_id
"""
