"""Periodic runs: maximal stretches of words that repeat themselves.

A run is a stretch of words with smallest period q, at least 4 q and at least
6 words long, that keeps its period no further on either side. They are found
by their Lyndon roots: under one of the two orders of the alphabet (the order
of the words, or its reverse) every run holds the longest Lyndon word that
starts at some place, so each place has two candidates. A suffix tree of the
words and one of their reversal (Ukkonen) say how far a candidate's period
goes on to the right and to the left: the string depth of the lowest common
ancestor of two leaves, the least depth between their visits on the Euler tour,
found in constant time over a table of minima of powers of two.

A run of at least four periods holds each of its three-word sequences at least
three times. Places whose sequence is rarer (in the document, then again in
what is left of each stretch) lie in no run, so the trees are built over the
other stretches, with a symbol of its own between any two. This takes nothing
away from the runs, only work: most texts need no tree at all.

Time is linear in the words (times log for the table of minima), memory linear
in the words of one document. Documents do not meet: there is no shuffle.

Cases: null, empty and white texts have no words, no runs and an empty
collapsed text; repeated rows and null ids stay, each row on its own; equal
runs are one; an empty table gives an empty result. The result has the columns
of this operator only, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protea.llm.bpe import _slices
from protea.llm.common import ship, text_of

PERIODS = 4     # a run has at least so many periods
LEAST = 6       # and so many words
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def words_of(text: str) -> list[bytes]:
    """Words as UTF-8: bytes split at space and the controls 9 to 13 only."""
    return text.encode().split()


def suffix_tree(s: list[int]) -> tuple[dict[int, int], list[int], list[int]]:
    """Ukkonen's construction, left to right with suffix links, for symbols of
    which the last is unique. Children by parent * (largest symbol + 1) +
    symbol, and each node's label s[first:last]."""
    n, size = len(s), max(s) + 1
    child: dict[int, int] = {}
    first, last, link = [0], [0], [0]
    node = edge = length = rest = 0
    for i, symbol in enumerate(s):
        rest += 1
        unlinked = 0
        while rest:
            if not length:
                edge = i
            key = node * size + s[edge]
            to = child.get(key)
            if to is None:
                child[key] = len(first)
                first.append(i)
                last.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = node
                unlinked = 0
            else:
                begin = first[to]
                span = min(last[to], i + 1) - begin
                if length >= span:
                    edge += span
                    length -= span
                    node = to
                    continue
                if s[begin + length] == symbol:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                split = len(first)
                child[key] = split
                first += (begin, i)
                last += (begin + length, n)
                link += (0, 0)
                child[split * size + symbol] = split + 1
                first[to] = begin + length
                child[split * size + s[begin + length]] = to
                if unlinked:
                    link[unlinked] = split
                unlinked = split
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return child, first, last


class CommonPrefixes:
    """Longest common prefixes of two suffixes of ``s`` in constant time."""

    def __init__(self, s: list[int]):
        child, first, last = suffix_tree(s)
        n, size, nodes = len(s), max(s) + 1, len(first)
        key = np.fromiter(child, np.int64, len(child))
        kids = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(key)
        begin = np.searchsorted(key[order] // size, np.arange(nodes + 1)).tolist()
        kids = kids[order].tolist()
        label = (np.array(last) - np.array(first)).tolist()
        # Euler tour: the string depth at each visit; leaves in their order
        at, depth, tour, path = begin[:-1], [0] * nodes, [], []
        leaves, visit = [], []
        node = 0
        while True:
            d = depth[node]
            tour.append(d)
            k = at[node]
            if k < begin[node + 1]:
                at[node] = k + 1
                path.append(node)
                node = kids[k]
                depth[node] = d + label[node]
                continue
            if begin[node] == k:
                leaves.append(n - d)
                visit.append(len(tour) - 1)
            if not path:
                break
            node = path.pop()
        self.rank = np.empty(n, np.int64)
        self.rank[leaves] = np.arange(n)
        # only leaves are asked for: of the visits between two neighbours the
        # least depth is enough
        low = np.minimum.reduceat(np.array(tour, np.int32), visit)[:-1] if n > 1 else np.zeros(1, np.int32)
        self.table = [low]
        while 2 << (len(self.table) - 1) <= len(low):
            half, least = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(least[:-half], least[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Their lengths for the suffixes at i and at j, i != j."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level).tolist():
            some = np.flatnonzero(level == k)
            t = self.table[k]
            out[some] = np.minimum(t[a[some]], t[b[some] - (1 << k)])
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """The next place with a smaller rank, -1 without one: where the longest
    Lyndon word from a place ends."""
    out, open_ = [-1] * len(rank), []
    for j, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = j
        open_.append(j)
    return out


def runs_between(s: list[int], least: int = LEAST, periods: int = PERIODS) -> np.ndarray:
    """(start, length, period) of the runs of symbols, of which the last is
    unique."""
    m = len(s) - 1
    right = CommonPrefixes(s)
    left = CommonPrefixes([*s[:m][::-1], s[m]])
    i, j = [], []
    for rank in (right.rank, m - right.rank):  # an order and its reverse
        end = np.array(next_smaller(rank.tolist()), np.int64)
        some = np.flatnonzero(end >= 0)
        i.append(some)
        j.append(end[some])
    i, j = np.concatenate(i), np.concatenate(j)
    before = left.of(m - i, m - j)
    start, stop, period = i - before, j + right.of(i, j), j - i
    ok = stop - start >= np.maximum(least, periods * period)
    return np.unique(np.stack([start, stop - start, period], 1)[ok], axis=0)


def repeating(words: list[bytes], least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches (start, stop) outside of which no run has a word. Sequences are
    compared by hash: a chance meeting only keeps a stretch too many."""
    n = len(words)
    if n < least:
        return []
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    key = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    ordered = np.sort(key)
    often = ordered[2:][ordered[2:] == ordered[:-2]]
    if not len(often):
        return []
    at = np.flatnonzero(np.isin(key, often))
    while len(at):
        # places in a row are a stretch; in it, each sequence occurs three times
        stretch = np.cumsum(np.diff(at, prepend=at[0]) > 1)
        _, which, count = np.unique(np.stack([stretch.astype(np.uint64), key[at]]), axis=1, return_inverse=True,
                                    return_counts=True)
        keep = (count[which.ravel()] >= 3) & (np.bincount(stretch)[stretch] >= least - 2)
        if keep.all():
            edge = np.flatnonzero(np.diff(stretch)) + 1
            return [(int(x[0]), int(x[-1]) + 3) for x in np.split(at, edge)]
        at = at[keep]
    return []


def runs_of(words: list[bytes]) -> np.ndarray:
    """(start, length, period) of all runs of a text's words."""
    stretches = repeating(words)
    if not stretches:
        return np.zeros((0, 3), np.int64)
    symbol: dict[bytes, int] = {}
    s: list[int] = []
    for a, b in stretches:
        s += [symbol.setdefault(w, len(symbol)) for w in words[a:b]]
        s.append(-1)
    place = np.concatenate([np.arange(a, b + 1) for a, b in stretches])
    own = iter(range(len(symbol), len(symbol) + len(stretches)))
    found = runs_between([x if x >= 0 else next(own) for x in s])
    found[:, 0] = place[found[:, 0]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that repeat the first period of a run."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              change: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """id, runs (by start, then period) and collapsed text of every row;
    ``change`` may give other words for a row's id and words."""
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                found, texts = [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = words_of(text)
                    words = change(key, words) if change else words
                    runs = runs_of(words)
                    found.append(runs)
                    texts.append(collapse(words, runs).decode())
                offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
                flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(RUN))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), structs),
                                                  pa.array(texts, pa.string())], ["id", "runs", "collapsed"])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def repeat_tail(key: object, words: list[bytes]) -> list[bytes]:
    """The contract's rebuilt words: of every tenth checksum of an id, the words
    from some place on repeat. A null id changes nothing."""
    n = len(words)
    if key is None or not n:
        return words
    g, h = divmod(zlib.crc32(str(key).encode()), 10)
    if h:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def report(docs: DataFrame) -> DataFrame:
    found = find_runs(docs, change=repeat_tail)
    # the greatest length / period, compared exactly; the first one stays
    best = F.reduce("runs", F.expr("cast(null as struct<start:bigint,length:bigint,period:bigint>)"),
                    lambda a, x: F.when(a.isNull() | (x.length * a.period > a.length * x.period), x).otherwise(a))
    listed = F.transform("runs", lambda x: F.concat_ws(",", x.start, x.length, x.period))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(listed, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
