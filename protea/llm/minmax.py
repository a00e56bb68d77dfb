"""Near duplicates by min-max hashing.

Under each of ``n_perm`` permutations of the shingle hashes both the smallest
and the largest value are kept: two signature values for one hash evaluation,
each equal between two sets with a probability of their similarity. The
2 * n_perm values are cut into bands; texts that share a band meet in a bucket.

1. One pass makes, per row, the size and a 128-bit digest of the set of
   distinct k-word shingles, the band keys and a signature of 16-bit values.
2. Rows with equal digests form a class; only classes go on.
3. Buckets with two or more classes: within a bucket, classes whose signatures
   agree well below the threshold (six standard deviations) are joined into
   coarse groups. A bucket is handled in pairs of blocks of ``block`` members,
   and a block pair emits a spanning forest, never its pairs.
4. Within a coarse group, again in pairs of blocks, the *full sets* are
   compared, and a spanning forest of the confirmed links comes out.
5. The components of those links.

Any pair that shares a bucket is judged by its full sets or already joined by
confirmed links, so components are exact up to pairs that share no band: with
60 permutations in 24 bands of 5 a pair of similarity 0.85 is missed with a
probability of 8e-7, at 0.8 of 7e-5.

Cases: a null or empty text, or one of white space only, has no shingles, is
linked with nothing and is its own component; a text with fewer than k words
is one shingle; repeated rows and ties are one class; a row without an id is
linked with nothing, gets a null component and is kept; rows that repeat an id
with other texts are judged each by its own text, and a component is named by
the smallest id in it; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from protea.llm.common import saved, ship
from protea.llm.groups import components, map_runs, with_block_pairs

WORDS_CACHED = 50_000
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection: multiply, shift and xor)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for so many words."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= WORDS_CACHED:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


class Shingler:
    """Text -> sorted distinct 64-bit hashes of its k-word shingles."""

    def __init__(self, k: int = 5):
        self.k = k
        self.weights = np.random.default_rng(5).integers(1, 1 << 63, k + 1, dtype=U64) * U64(2) + U64(1)
        self.known = WordHashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()  # ASCII only, in bytes
        n = len(words)
        if not n:
            return np.zeros(0, U64)
        h = np.fromiter(map(self.known.__getitem__, words), U64, n)
        if n < self.k:
            s = (h * self.weights[:n]).sum(dtype=U64, keepdims=True) + self.weights[self.k:] * U64(n)
        else:
            s = np.zeros(n - self.k + 1, U64)
            for j in range(self.k):
                s += h[j:n - self.k + 1 + j] * self.weights[j]
        return np.unique(mix(s))


class Signer:
    """Set of hashes -> min-max signature and band keys."""

    CHUNK = 1 << 11

    def __init__(self, n_perm: int = 60, rows: int = 5):
        if n_perm % rows:
            raise ValueError("n_perm must be a multiple of the rows of a band")
        rng = np.random.default_rng(17)
        self.a = (rng.integers(1, 1 << 63, n_perm, dtype=U64) * U64(2) + U64(1))[:, None]
        self.b = rng.integers(0, 1 << 63, n_perm, dtype=U64)[:, None]
        self.rows, self.bands = rows, 2 * n_perm // rows
        self.mult = rng.integers(1, 1 << 63, rows, dtype=U64) * U64(2) + U64(1)
        self.band_no = mix(np.arange(1, self.bands + 1, dtype=U64))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low = high = None
        for i in range(0, len(hashes), self.CHUNK):
            v = hashes[None, i:i + self.CHUNK] * self.a + self.b
            v ^= v >> U64(29)
            lo, hi = v.min(axis=1), v.max(axis=1)
            low = lo if low is None else np.minimum(low, lo)
            high = hi if high is None else np.maximum(high, hi)
        return np.concatenate([low, high])

    def keys(self, sig: np.ndarray) -> np.ndarray:
        mixed = (mix(sig.reshape(self.bands, self.rows)) * self.mult).sum(axis=1, dtype=U64)
        return mix(mixed + self.band_no).view(np.int64)

    @staticmethod
    def short(sig: np.ndarray) -> bytes:
        return (mix(sig) & U64(0xFFFF)).astype(np.uint16).tobytes()


def digest(hashes: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def agree_least(threshold: float, values: int) -> float:
    """Signature agreement that a pair at the threshold has but once in a billion."""
    return max(0.0, threshold - 6 * math.sqrt(threshold * (1 - threshold) / values))


SIGNED = "id long, n_shingles long, d1 long, d2 long, keys array<long>, sig binary, t1 long, t2 long"


def _sign(k: int, n_perm: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sign = Shingler(k), Signer(n_perm, rows)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                h = shingle(t.as_py())
                if i is None or not len(h):
                    row = (i, len(h), None, None, None, None)
                else:
                    s = sign(h)
                    row = (i, len(h), *digest(h), sign.keys(s), sign.short(s))
                for c, v in zip(out, row):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                                                        pa.list_(pa.int64()), pa.binary()))],
                 batch.column(2), batch.column(3)],
                ["id", "n_shingles", "d1", "d2", "keys", "sig", "t1", "t2"])
    return run


def _forest(n: int, neighbours) -> Iterator[tuple[int, int]]:
    """A spanning forest: ``neighbours(i, others)`` gives those of ``others``
    that are linked with i."""
    left = np.ones(n, bool)
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        stack = [start]
        while stack:
            i = stack.pop()
            others = np.flatnonzero(left)
            if not len(others):
                return
            for j in neighbours(i, others).tolist():
                left[j] = False
                stack.append(j)
                yield i, j


def _coarse(threshold: float, values: int):
    least = agree_least(threshold, values) * values
    pct = round(100 * threshold)

    def run(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        nodes = table.column("node").to_numpy()
        size = table.column("n_shingles").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, values)
        width = np.diff(bounds)
        two = bounds[:-1][width == 2]
        ok = (nodes[two] != nodes[two + 1])
        ok &= 100 * np.minimum(size[two], size[two + 1]) >= pct * np.maximum(size[two], size[two + 1])
        ok &= (sig[two] == sig[two + 1]).sum(axis=1) >= least
        a, b = [nodes[two[ok]]], [nodes[two[ok] + 1]]
        for s, e in zip(bounds[:-1][width > 2], bounds[1:][width > 2]):
            _, at = np.unique(nodes[s:e], return_index=True)
            at = at + s
            m, n = sig[at], size[at]

            def near(i, others):
                fits = 100 * np.minimum(n[i], n[others]) >= pct * np.maximum(n[i], n[others])
                others = others[fits]
                return others[(m[others] == m[i]).sum(axis=1) >= least]
            got = list(_forest(len(at), near))
            if got:
                i, j = np.array(got).T
                a.append(nodes[at[i]])
                b.append(nodes[at[j]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
    return run


def _confirm(threshold: float, values: int):
    least = agree_least(threshold, values) * values
    pct = round(100 * threshold)

    def run(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        nodes = table.column("node").to_numpy()
        raw, raw_sig = table.column("hashes"), table.column("sig")
        a: list = []
        b: list = []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            sets = [np.frombuffer(raw[x].as_buffer(), U64) for x in range(s, e)]
            n = np.array([len(x) for x in sets])
            m = np.frombuffer(b"".join(raw_sig.slice(s, e - s).to_pylist()), np.uint16).reshape(-1, values)

            def near(i, others):
                fits = 100 * np.minimum(n[i], n[others]) >= pct * np.maximum(n[i], n[others])
                others = others[fits]
                others = others[(m[others] == m[i]).sum(axis=1) >= least]
                hit = []
                for j in others.tolist():
                    both = np.concatenate((sets[i], sets[j]))
                    both.sort(kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    hit.append(100 * common >= pct * (n[i] + n[j] - common))
                return others[np.array(hit, bool)]
            for i, j in _forest(e - s, near):
                if nodes[s + i] != nodes[s + j]:
                    a.append(nodes[s + i])
                    b.append(nodes[s + j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return run


def _sets(k: int, n_perm: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sign = Shingler(k), Signer(n_perm, rows)
        for batch in batches:
            hashes, sigs = [], []
            for t in batch.column(1):
                h = shingle(t.as_py())
                hashes.append(h.tobytes())
                sigs.append(sign.short(sign(h)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(hashes, pa.binary()), pa.array(sigs, pa.binary())],
                ["node", "grp", "n", "hashes", "sig"])
    return run


def text_digest(text: Column) -> list[Column]:
    """128 bits of a text, null as the empty text."""
    content = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(content), F.xxhash64(F.lit(1), content)]


def _grouped(docs: DataFrame, threshold: float, k: int, n_perm: int, rows: int, block: int, set_block: int,
             id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and per class (d1, d2): the row (rep, t1, t2) that
    stands for it, component_id, and whether the class ``leads`` its component."""
    ship(docs.sparkSession)
    values = 2 * n_perm
    t1, t2 = text_digest(docs[text_col])
    texts = docs.select(docs[id_col].cast("long").alias("id"),
                        docs[text_col].cast("string").cast("binary").alias("text"), t1.alias("t1"), t2.alias("t2"))
    signed = saved(texts.mapInArrow(_sign(k, n_perm, rows), SIGNED), "signed")
    full = signed.where("d1 is not null")

    # classes of equal sets; the smallest id, and of its texts the one of the
    # smallest digest, stands for the class. An id may stand for several, so
    # they are numbered; the written table fixes the numbers
    first = full.groupBy("d1", "d2").agg(F.min(F.struct("id", "t1", "t2")).alias("f"))
    classes = saved(first.select("d1", "d2", F.col("f.id").alias("rep"), "f.t1", "f.t2")
                    .withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = full.withColumnRenamed("id", "rep").join(classes, ["d1", "d2", "rep", "t1", "t2"])

    # buckets with two classes or more
    banded = reps.select("node", F.explode("keys").alias("key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = banded.join(crowded, "key").join(reps.select("node", "n_shingles", "sig"), "node")
    pairs = with_block_pairs(members, "key", "node", "members", block) \
        .select("key", "bi", "bj", "node", "n_shingles", "sig")
    edges = saved(map_runs(pairs, ["key", "bi", "bj"], _coarse(threshold, values), "a long, b long").distinct(),
                  "coarse")

    # full sets within the coarse groups
    roots = components(edges)
    groups = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    sizes = roots.groupBy("root").agg((F.count("*") + 1).alias("n"))
    grouped = groups.join(sizes, "root").join(classes, "node") \
                    .select("node", F.col("rep").alias("id"), "t1", "t2", F.col("root").alias("grp"), "n")
    with_text = texts.join(grouped.hint("shuffle_hash"), ["id", "t1", "t2"]).select("node", "text", "grp", "n")
    sets = with_text.mapInArrow(_sets(k, n_perm, rows), "node long, grp long, n long, hashes binary, sig binary")
    links = saved(map_runs(with_block_pairs(sets, "grp", "node", "n", set_block), ["grp", "bi", "bj"],
                           _confirm(threshold, values), "a long, b long").distinct(), "links")

    # a component is named by its smallest id, which its leading class has
    linked = components(links)
    nodes = linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
    lead = nodes.join(classes, "node").groupBy("root").agg(F.min(F.struct("rep", "d1", "d2")).alias("lead"))
    comp = classes.join(nodes.join(lead, "root").select("node", "lead"), "node", "left").select(
        "d1", "d2", "rep", "t1", "t2", F.coalesce("lead.rep", "rep").alias("component_id"),
        (F.col("lead").isNull() | (F.col("lead") == F.struct("rep", "d1", "d2"))).alias("leads"))
    return signed, comp


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, n_perm: int = 60, rows: int = 5,
                    block: int = 1024, set_block: int = 256, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links of
    ``threshold`` similarity or more) and kept, for every row of ``docs``.
    ``id_col`` must hold integers."""
    signed, comp = _grouped(docs, threshold, k, n_perm, rows, block, set_block, id_col, text_col)
    out = signed.where("d1 is not null").select("id", "n_shingles", "d1", "d2") \
                .join(comp.select("d1", "d2", "component_id"), ["d1", "d2"], "left") \
                .select("id", "n_shingles", "component_id")
    alone = signed.where("d1 is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return out.unionByName(alone).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id",
        (F.col("id").isNull() | (F.col("id") == F.col("component_id"))).alias("kept"))


def without_near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, n_perm: int = 60, rows: int = 5,
                            block: int = 1024, set_block: int = 256, id_col: str = "doc_id",
                            text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, of its
    texts that of the smallest digests, and of rows that repeat both the first
    by their other columns. Rows without an id all stay."""
    signed, comp = _grouped(docs, threshold, k, n_perm, rows, block, set_block, id_col, text_col)
    alone = signed.where("d1 is null and id is not null").select("id", "t1", "t2").distinct()
    names = [name + "_" * sum(c.startswith(name) for c in docs.columns) for name in ("_copy", "_k1", "_k2")]
    name, *keys = names
    keep = (comp.where("leads").select(F.col("rep").alias("id"), "t1", "t2").unionByName(alone)
            .toDF(id_col, *keys))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    same = Window.partitionBy(id_col, *keys).orderBy(order)  # as the join has dealt the rows
    one = (docs.withColumns({id_col: F.col(id_col).cast("long")} | dict(zip(keys, text_digest(docs[text_col]))))
           .join(keep.hint("shuffle_hash"), [id_col, *keys])
           .withColumn(name, F.row_number().over(same)).where(F.col(name) == 1))
    return one.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 85 * (na.n + nb.n - c)),
pairs AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""
