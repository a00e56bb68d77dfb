"""Personal data by weak supervision.

Base patterns (email, ip, card, phone) are reported wherever they match and
pass their check. Wider patterns give candidates that a pattern alone cannot
decide: written-out addresses, number groups, account numbers, titled names.
On each candidate labelers vote yes, no or nothing:

* regex: the candidate has one of the exact shapes of its kind;
* gazetteer: it holds an entry of its kind in a table of domain endings, given
  names and country codes (``gazetteer``, or a table given by the caller);
* context: a telling word stands just before it, or one that tells against it;
* shape: it looks like a plain number, a date or a measure.

Expectation-maximisation over the votes estimates each labeler's reliability
and each vote pattern's probability, without labels. Those probabilities train
the final span classifier, a naive Bayes model over features of the text alone
(the votes are its labels and no features), which decides. Votes are counted
per pattern (at most 3 ^ labelers of them for a kind), so both steps work on
tables of a bounded size, whatever the corpus. Only DataFrame functions.

Spans are code points, end exclusive. Candidates that overlap a base span are
left out: base spans stay.

Cases: a null or empty text has no spans; repeated rows are scanned each on
its own; null ids stay; with no candidate in the whole table nothing is added;
an empty table gives an empty result; a gazetteer's null entries and repeats
count for nothing, and with an empty one that labeler never says yes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from protea.llm import spans
from protea.llm.common import saved, sha256_hex, text_of

BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", None),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
CONTEXT = 24  # code points before a candidate
CANDIDATES = {
    "address": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]++"
                r"(?:(?:\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?|\.)[A-Za-z0-9-]++)++", r"[\[({]at[\])}]"),
    "number": (r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}+\)?(?:[\x20.-][0-9]{2,4}+(?![0-9A-Za-z])){2,}+", None),
    "account": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,}+(?:\x20?[A-Z0-9]{1,3}+)?(?![0-9A-Za-z])",
                r"[A-Z]{2}[0-9]{2}"),
    "name": (r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?", r"(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20"),
}
KINDS = [*BASE, *CANDIDATES]

# fixed values: entries of the gazetteer that comes with the operator. Generic
# and country domain endings, frequent given names, countries with an IBAN
DOMAINS = """com org net edu gov mil int info biz name io app dev ai me tv co eu
at au be bg br ca ch cl cn cy cz de dk ee es fi fr gr hk hr hu ie il in is it jp kr lt lu lv mt mx my nl no nz
ph pl pt ro rs ru se sg si sk th tr tw ua uk us vn za"""
NAMES = """james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan
joseph jessica thomas sarah charles karen daniel nancy matthew lisa anthony margaret mark sandra paul ashley
steven emily andrew donna kenneth michelle george carol joshua amanda kevin melissa brian deborah edward stephanie
anna maria peter marie jean pierre hans karl carlos jose juan ana luis carmen francisco isabel antonio lucia
giovanni giulia marco francesca andrea paolo klaus ursula wolfgang monika stefan petra jan eva lars ingrid erik
olga ivan natalia dmitri elena sergei tatiana ahmed fatima mohammed aisha omar layla ali hassan yusuf zainab
wei li ming mei hiroshi yuki kenji sakura raj priya amit sunita arjun lakshmi"""
COUNTRIES = """AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL
IQ IS IT JO KW KZ LB LC LI LT LU LV LY MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL
TN TR UA VA VG XK"""
ENTRIES = {"address": DOMAINS, "name": NAMES, "account": COUNTRIES}
TELLING = {"address": r"(?i)mail|contact|write|reach", "number": r"(?i)phone|tel|call|mobile|fax|ssn|social|contact",
           "account": r"(?i)iban|account|bank|pay", "name": r"(?i)contact|from|dear|signed|by|patient|client"}
AGAINST = r"(?i)version|page|chapter|isbn|doi|fig|table|no\.|nr\.|#|\$|€"
LABELERS = ["regex", "gazetteer", "context", "shape"]
ROUNDS = 12


def _by_kind(table: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for k, c in table.items():
        out = F.when(F.col("kind") == k, c) if out is None else out.when(F.col("kind") == k, c)
    return out.otherwise(otherwise)


def gazetteer(spark: SparkSession) -> DataFrame:
    """The table (kind, entry) that comes with the operator."""
    lists = [spark.range(1).select(F.lit(k).alias("kind"), F.explode(F.split(F.lit(v.lower()), r"\s+")).alias("entry"))
             for k, v in ENTRIES.items()]
    return reduce(DataFrame.unionByName, lists)


def _tokens() -> list[Column]:
    """The two parts of a candidate that are looked up, in lower case."""
    v = F.lower("value")
    return [_by_kind({"address": F.regexp_extract(v, r"([a-z0-9-]+)$", 1), "account": F.substring(v, 1, 2),
                      "name": F.regexp_extract(v, r"\x20([a-z]+)", 1)}, F.lit(None).cast("string")),
            _by_kind({"name": F.regexp_extract(v, r"\x20[a-z]+\x20([a-z]+)$", 1)}, F.lit(None).cast("string"))]


def looked_up(cands: DataFrame, entries: DataFrame) -> DataFrame:
    """``cands`` and ``known``: whether a part of them is an entry of their
    kind. An entry is there once for a kind, so no row is repeated."""
    once = entries.select("kind", F.lower("entry").alias("entry")).where("entry <> ''").distinct()
    out = cands
    for i, token in enumerate(_tokens()):
        side = once.select("kind", F.col("entry").alias("_token"), F.lit(True).alias(f"_hit{i}"))
        out = out.withColumn("_token", token).join(side, ["kind", "_token"], "left").drop("_token")
    return out.withColumn("known", F.coalesce("_hit0", "_hit1", F.lit(False))).drop("_hit0", "_hit1")


def _votes() -> Column:
    """1 yes, -1 no, 0 nothing, in the order of LABELERS."""
    v, before = F.col("value"), F.col("before")
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    digits = F.length(F.regexp_replace(v, "[^0-9]++", ""))
    regex = _by_kind({
        "address": F.when(v.rlike(r"^[A-Za-z0-9._%+-]+.*(?:\[dot\]|\(dot\)|\{dot\}|\.)\x20?[A-Za-z]{2,}$"), yes).otherwise(no),
        "number": F.when(v.rlike(r"^(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"), yes).otherwise(no),
        "account": F.when(F.length(F.regexp_replace(v, " ", "")).between(15, 34), yes).otherwise(no),
        "name": F.when(v.rlike(r"[A-Z][a-z]+\x20[A-Z][a-z]+$"), yes).otherwise(none)}, none)
    listed = _by_kind({k: F.when(F.col("known"), yes).otherwise(no if k == "account" else none) for k in ENTRIES}, none)
    context = F.when(before.rlike(AGAINST), no).when(
        _by_kind({k: before.rlike(p) for k, p in TELLING.items()}, F.lit(False)), yes).otherwise(none)
    shape = _by_kind({
        "number": F.when(v.rlike(r"^[0-9]{1,4}([.\x20-])[0-9]{2}\1[0-9]{2,4}$") | ~digits.between(9, 15), no).otherwise(none),
        "account": F.when(digits < 8, no).otherwise(none)}, none)
    return F.array(regex, listed, context, shape)


def _features() -> Column:
    """One value of each feature, of a bounded number of values."""
    v = F.col("value")
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")

    def hashed(name: str, c: Column) -> Column:
        return F.concat(F.lit(f"{name}:"), F.pmod(F.xxhash64(c), F.lit(256)).cast("string"))
    return F.array(hashed("shape", shape),
                   hashed("before", F.lower(F.regexp_extract("before", r"([A-Za-z]+)[^A-Za-z]*$", 1))),
                   hashed("head", F.lower(F.substring(v, 1, 2))),
                   hashed("last", F.lower(F.regexp_extract(v, r"([A-Za-z]*)$", 1))),
                   F.concat(F.lit("length:"), F.least(F.length(v), F.lit(64)).cast("string")),
                   F.concat(F.lit("digits:"), F.least(F.length(F.regexp_replace(v, "[^0-9]++", "")), F.lit(32)).cast("string")))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Expectation-maximisation. ``patterns``: kind, votes (array), n. Returns
    kind, votes, n and p, the probability that such a candidate is personal
    data. A labeler that votes is right with one probability, kept between
    0.05 and 0.95; the fold below runs the rounds inside one row per kind."""
    k = len(LABELERS)
    each = patterns.groupBy("kind").agg(F.collect_list(F.struct("votes", "n")).alias("ps"))

    def posterior(votes: Column, state: Column) -> Column:
        def odds(acc: Column, j: Column) -> Column:
            a = F.get(state["acc"], j)
            return acc * F.when(F.get(votes, j) == 1, a / (1 - a)).when(F.get(votes, j) == -1, (1 - a) / a).otherwise(1.0)
        o = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), state["prior"] / (1 - state["prior"]), odds)
        return o / (1 + o)

    def clamp(c: Column) -> Column:
        return F.least(F.lit(0.95), F.greatest(F.lit(0.05), c))

    def step(state: Column, _: Column) -> Column:
        scored = F.transform("ps", lambda x: F.struct(x["votes"].alias("v"), x["n"].cast("double").alias("n"),
                                                      posterior(x["votes"], state).alias("p")))

        def maximise(s: Column) -> Column:
            def right(j: Column) -> Column:
                num = F.aggregate(s, F.lit(1.0), lambda a, x: a + x["n"] * F.when(F.get(x["v"], j) == 1, x["p"])
                                  .when(F.get(x["v"], j) == -1, 1 - x["p"]).otherwise(0.0))
                den = F.aggregate(s, F.lit(1.5), lambda a, x: a + F.when(F.get(x["v"], j) != 0, x["n"]).otherwise(0.0))
                return clamp(num / den)
            total = F.aggregate(s, F.lit(2.0), lambda a, x: a + x["n"])
            good = F.aggregate(s, F.lit(1.0), lambda a, x: a + x["n"] * x["p"])
            return F.struct(clamp(good / total).alias("prior"),
                            F.transform(F.sequence(F.lit(0), F.lit(k - 1)), right).alias("acc"))
        return F.transform(F.array(scored), maximise)[0]
    start = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.lit(0.8)] * k).alias("acc"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return (each.withColumn("state", state)
            .select("kind", "state", F.explode("ps").alias("x"))
            .select("kind", F.col("x.votes").alias("votes"), F.col("x.n").alias("n"),
                    posterior(F.col("x.votes"), F.col("state")).alias("p")))


def classify(cands: DataFrame) -> DataFrame:
    """Candidates (row, kind, start, stop, votes, features) -> those that the
    span classifier takes for personal data: naive Bayes over the features,
    trained with the estimated probabilities as labels."""
    soft = estimate(cands.groupBy("kind", "votes").agg(F.count("*").alias("n"))).drop("n")
    # per kind: 4 * 256 + 64 + 32 values of features at most, 3 ^ 4 patterns
    trained = cands.join(F.broadcast(soft), ["kind", "votes"])

    def smooth(part: str, whole: str) -> Column:
        # one candidate more, of both classes in their shares: a feature of
        # few candidates weighs little, whichever class is the larger
        return F.log(F.col(part) / F.col(whole) + 1 / (F.col("yes") + F.col("no")))
    totals = trained.groupBy("kind").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    per = (trained.select("kind", "p", F.explode("features").alias("f")).groupBy("kind", "f")
           .agg(F.sum("p").alias("y"), F.sum(1 - F.col("p")).alias("n"))
           .join(F.broadcast(totals), "kind")
           .select("kind", "f", (smooth("y", "yes") - smooth("n", "no")).alias("w")))
    bias = totals.select("kind", F.log((F.col("yes") + 0.5) / (F.col("no") + 0.5)).alias("b"))
    scored = (cands.select("row", "kind", "start", "stop", F.explode("features").alias("f"))
              .join(F.broadcast(per), ["kind", "f"]).groupBy("row", "kind", "start", "stop").agg(F.sum("w").alias("w"))
              .join(F.broadcast(bias), "kind"))
    return scored.where(F.col("w") + F.col("b") > 0).select("row", "kind", "start", "stop")


def _valid() -> Column:
    v, kind = F.col("value"), F.col("kind")
    digits = F.regexp_replace(v, "[^0-9]++", "")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return (kind.isNull() | (kind == "email") | ((kind == "ip") & v.rlike(rf"^{part}(?:\.{part}){{3}}$"))
            | ((kind == "card") & F.length(digits).between(14, 19) & F.call_function("luhn_check", F.substring(digits, 1, 19)))
            | ((kind == "phone") & F.length(digits).between(10, 15)) | kind.isin(*CANDIDATES))


def scan(docs: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Rows (row, doc_id, kind, start, stop) of all reported spans, and one
    with a null kind per document. ``entries`` is the gazetteer (kind, entry)."""
    texts = spans.numbered(docs, text_of(docs))
    found = spans.find(texts, BASE | CANDIDATES, context=CONTEXT).where(_valid())
    found = saved(found, "pii-found")
    kind = F.col("kind")
    base = kind.isin(*BASE)
    rows = found.where(kind.isNull() | base).select("row", "doc_id", "kind", "start", "stop")
    at_or_before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    marked = (found.where(kind.isNotNull())
              .withColumn("_end", F.max(F.when(base, F.col("stop"))).over(at_or_before))
              .withColumn("_next", F.min(F.when(base, F.col("start"))).over(later)))
    free = marked.where(~base & (F.coalesce("_end", F.lit(0)) <= F.col("start"))
                        & F.coalesce(F.col("_next") >= F.col("stop"), F.lit(True)))
    free = looked_up(free, gazetteer(docs.sparkSession) if entries is None else entries)
    cands = saved(free.select("row", "kind", "start", "stop", _votes().alias("votes"), _features().alias("features")),
                  "pii-candidates")
    extra = classify(cands).select("row", F.lit(None).cast("long").alias("doc_id"), "kind", "start", "stop")
    return rows.unionByName(extra)


def report(docs: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    kind = F.col("kind")
    return (scan(docs, entries).groupBy("row").agg(
                F.max("doc_id").alias("doc_id"),
                *[F.count(F.when(kind == k, 1)).alias(f"n_{k}") for k in BASE],
                sha256_hex(spans.listed(KINDS, kind.isin(*BASE))).alias("base_sha256"),
                spans.listed(KINDS, kind.isNotNull()).alias("spans"))
            .drop("row"))
