"""Byte-level BPE encoding and decoding with a minimal acyclic transducer.

The words (pre-tokens) of the whole corpus are counted, the most frequent are
compiled with their ids into a minimal acyclic automaton: sorted words are
added one by one, and equal suffixes share their states. The path of a word
adds up to its number, and the number finds its ids. The automaton is a
handful of flat arrays in one file, sent to the executors with the job and
memory-mapped there. Words that it lacks are merged exactly, lowest rank
first, leftmost first.

The lexicon only decides how fast a word is encoded, never how: its size is a
parameter, and any lexicon gives equal ids.

Words are split by a pattern over Unicode's letters and numbers. Which these
are depends on the Unicode version that a library was built with; the driver
asks the tokenizers library about every code point, once, and texts with a
character about which the two differ are encoded by that library.

Cases: a null or empty text has no ids and decodes to the empty text; the
special string ``<|endoftext|>`` inside a text is its special token; unused
truncation and padding; repeated rows are encoded each on its own; an empty
table gives an empty result (and an empty lexicon); other columns stay.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protea.llm.common import saved, ship, text_of

TOKENIZER = "byte_bpe_50k.json"
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEXICON_WORDS = 60_000
CACHED = 100_000          # words and pieces that a task remembers
COUNTED = 150_000
LEAST = 8                 # a word seen less often is not frequent
SLICE_BYTES = 1 << 20
WIDTHS = (4, 8, 12, 16, 24, 48, 96, 192)  # words up to so many bytes are merged together
TOGETHER = 1 << 21        # bytes of such words, padded, that are merged at once
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII without letters, digits and space
NONE = 1 << 60


def tokenizer_path(tokenizer: str) -> str:
    """A file, or the name of a public tokenizer installed on the node."""
    if os.path.exists(tokenizer):
        return tokenizer
    import public_tokenizers
    return public_tokenizers.path(tokenizer)


def is_byte_level(spec: dict) -> bool:
    """Whether a tokenizer file is of the kind that this module encodes: plain
    merges over byte letters, the pattern above, nothing normalised, special
    strings taken as they are."""
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                                           "byte_fallback", "ignore_merges"))
    return (model.get("type") == "BPE" and plain and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
            and pre.get("use_regex", True) and spec.get("normalizer") is None
            and not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word", "normalized")))


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files of this kind write bytes: the
    printable ones stand for themselves, the others for 256, 257, ..."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordSplitter:
    """Texts -> pre-tokens."""

    def __init__(self):
        self.pretoken = regex.compile(PRETOKEN)

    def words_of(self, piece: str) -> list[str]:
        """Pre-tokens of a piece; most pieces are one word."""
        if piece.isalpha() or (piece[:1] == " " and piece[1:].isalpha()):
            return [piece]
        return self.pretoken.findall(piece)


class Vocabulary(WordSplitter):
    """Ranks, ids and bytes of a byte-level BPE file."""

    def __init__(self, tokenizer: str):
        super().__init__()
        with open(tokenizer_path(tokenizer), encoding="utf-8") as f:
            spec = json.load(f)
        if not is_byte_level(spec):
            raise ValueError(f"{tokenizer}: not a byte-level BPE file")
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max(*ids.values(), *self.special.values()) + 1)
        for token, i in ids.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = ids[c]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        # pairs in one number (left id, right id), sorted, with their ranks;
        # rank -> merged id
        key = np.array([(ids[x] << 20) | ids[y] for x, y in pairs], np.int64)
        self.pair, self.pair_rank = np.unique(key, return_index=True)
        self.rank_of = dict(zip(self.pair.tolist(), self.pair_rank.tolist()))
        self.merged = np.array([ids[x + y] for x, y in pairs], np.int64)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where there is no merge; ids below 0 stand for
        nothing."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after the other, and where each starts."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        counts = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # numbers of words, their ids
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(length) - length
        low = 0
        for high in WIDTHS:
            fit = np.flatnonzero((length > low) & (length <= high))
            low = high
            for at in range(0, len(fit), TOGETHER // high):
                some = fit[at:at + TOGETHER // high]
                row, ids = self._merge_together(data, first[some], length[some], high)
                counts[some] = np.bincount(row, minlength=len(some))
                found.append((some[row], ids))
        for i in np.flatnonzero(length > WIDTHS[-1]).tolist():
            ids = self._merge_long([int(self.byte_id[b]) for b in words[i]])
            counts[i] = len(ids)
            found.append((np.full(len(ids), i), np.array(ids, np.int64)))
        start = np.concatenate([[0], np.cumsum(counts)])
        if not found:
            return np.zeros(0, np.int64), start
        order = np.argsort(np.concatenate([r for r, _ in found]), kind="stable")
        return np.concatenate([x for _, x in found])[order], start

    def _merge_together(self, data, first, length, width) -> tuple[np.ndarray, np.ndarray]:
        """Words of at most ``width`` bytes, a merge of each per round: the
        lowest rank, and of equal ones the leftmost. A column beyond the last
        stands for nothing."""
        n, cols = len(first), np.arange(width)
        inside = cols < length[:, None]
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = np.where(inside, self.byte_id[data[np.minimum(first[:, None] + cols, len(data) - 1)]], -1)
        after = np.tile(np.append(cols + 1, width), (n, 1))
        after[:, :width][cols + 1 >= length[:, None]] = width
        before = np.tile(np.append(cols - 1, width), (n, 1))
        before[:, 0] = width
        rank = np.full((n, width + 1), NONE, np.int64)
        rank[:, :width] = self.ranks(ids[:, :width], ids[:, 1:])
        row = np.arange(n)
        while len(row):
            r = rank[row]
            i = r.argmin(axis=1)
            low = r[np.arange(len(row)), i]
            go = low < NONE
            row, i, low = row[go], i[go], low[go]
            j = after[row, i]
            k, h = after[row, j], before[row, i]
            new = self.merged[low]
            ids[row, i], ids[row, j] = new, -1
            after[row, i], before[row, k] = k, i
            rank[row, j] = NONE
            rank[row, i] = self.ranks(new, ids[row, k])
            rank[row, h] = self.ranks(ids[row, h], new)
        live = ids >= 0
        return np.nonzero(live)[0], ids[live]

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for a word without end."""
        n, known = len(ids), self.rank_of
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            if j < n and (rank := known.get((ids[i] << 20) | ids[j])) is not None:
                heapq.heappush(heap, (rank, i, ids[i], ids[j]))
        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has gone meanwhile
            ids[i], ids[j] = int(self.merged[rank]), -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [i for i in ids if i >= 0]


def other_letters() -> str:
    """A pattern of the characters that are letters or numbers to the
    tokenizers library and not here, or the other way round; empty without any.
    All code points are asked for, on the driver."""
    if not _OTHER:
        from tokenizers import Regex, pre_tokenizers
        text = "".join([chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000])
        other = {c for c in text if c.isalpha()} - set(regex.findall(r"\p{L}", text))
        for kind in "LN":
            # what the library takes away from all that is of the kind here,
            # and what it finds among the rest
            for mine, theirs in ((rf"\p{{{kind}}}", rf"\P{{{kind}}}"), (rf"\P{{{kind}}}", rf"\p{{{kind}}}")):
                asked = "".join(regex.findall(mine, text))
                kept = pre_tokenizers.Split(Regex(theirs), "removed").pre_tokenize_str(asked)
                other |= set(asked).difference(*(piece for piece, _ in kept))
        ranges: list[list[int]] = []
        for c in sorted(map(ord, other)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        _OTHER.append("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]" if ranges else "")
    return _OTHER[0]


_OTHER: list[str] = []


def compile_lexicon(words: Iterable[bytes], vocabulary: Vocabulary, path: str) -> None:
    """Write the minimal automaton of ``words`` (any order) to ``path``."""
    words = sorted(set(words))
    ids, start = vocabulary.merge(words)
    final: list[bool] = [False]
    edges: list[dict[int, int]] = [{}]
    register: dict[tuple, int] = {}
    chain = [0]  # the states along the last word
    last = b""

    def settle(depth: int) -> None:
        while len(chain) > depth + 1:
            state = chain.pop()
            key = (final[state], tuple(edges[state].items()))
            same = register.setdefault(key, state)
            if same != state:
                edges[chain[-1]][last[len(chain) - 1]] = same
    for word in words:
        common = next((i for i, (x, y) in enumerate(zip(word, last)) if x != y), min(len(word), len(last)))
        settle(common)
        for b in word[common:]:
            final.append(False)
            edges.append({})
            edges[chain[-1]][b] = len(edges) - 1
            chain.append(len(edges) - 1)
        final[chain[-1]] = True
        last = word
    settle(0)

    # number the reachable states; count the words below each, leaves first
    order, stack, number = [], [0], {0: 0}
    while stack:
        s = stack.pop()
        order.append(s)
        for t in edges[s].values():
            if t not in number:
                number[t] = len(number)
                stack.append(t)
    below: dict[int, int] = {}

    def count(s: int) -> int:
        todo = [s]
        while todo:
            x = todo[-1]
            missing = [t for t in edges[x].values() if t not in below]
            if missing:
                todo.extend(missing)
            else:
                below[x] = int(final[x]) + sum(below[t] for t in edges[x].values())
                todo.pop()
        return below[s]
    count(0)
    rows = []
    for s in order:
        skip = int(final[s])
        for b, t in sorted(edges[s].items()):
            rows.append((number[s] * 256 + b, number[t], skip))
            skip += below[t]
    rows.sort()
    ends = np.zeros(len(number), np.int64)
    for s, k in number.items():
        ends[k] = final[s]
    arrays = [np.array([r[i] for r in rows], np.int64) for i in range(3)] + [ends]
    arrays += [start, ids]
    with open(path, "wb") as f:
        f.write(np.array([len(a) for a in arrays], np.int64).tobytes())
        for a in arrays:
            f.write(a.tobytes())


class Lexicon:
    """A compiled automaton, memory-mapped."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.int64, "r")
        at, parts = 6, []
        for n in raw[:6].tolist():
            parts.append(raw[at:at + n])
            at += n
        self.keys, self.target, self.skip, self.final, self.offsets, self.ids = parts

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for one that is not there. All words
        walk the automaton together, a byte a step."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.concatenate([[0], np.cumsum(length)[:-1]]) if n else np.zeros(0, np.int64)
        out = np.full(n, -1, np.int64)
        alive = np.arange(n)
        state, total, step = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
        while len(alive) and len(self.keys):
            over = length[alive] == step
            ended = alive[over]
            hit = self.final[state[ended]] == 1
            out[ended[hit]] = total[ended[hit]]
            alive = alive[~over]
            key = state[alive] * 256 + data[first[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            alive, at = alive[ok], at[ok]
            total[alive] += self.skip[at]
            state[alive] = self.target[at]
            step += 1
        return out


class Codec:
    """Encodes and decodes texts; remembers what it has seen, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None, other: str = "", tokenizer: str = TOKENIZER):
        self.v, self.lexicon, self.tokenizer = vocabulary, lexicon, tokenizer
        self.other = re.compile(other) if other else None
        self.beyond_latin = self.other is None or not self.other.search("".join(map(chr, range(256))))
        self.words: dict[str, bytes] = {}
        # pieces between single spaces: the first of a text, and the others
        # (which stand for the piece with its space); None: not on its own
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes | None] = {}

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of words: from the automaton, or merged."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        at = self.lexicon.numbers(raw) if self.lexicon is not None else np.full(len(raw), -1)
        known, unseen = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        ids, start = self.v.merge([raw[i] for i in unseen.tolist()])
        out: list[bytes] = [b""] * len(words)
        found = [(unseen, ids, start)]
        if len(known):
            a, b = self.lexicon.offsets[at[known]], self.lexicon.offsets[at[known] + 1]
            start = np.concatenate([[0], np.cumsum(b - a)])
            found.append((known, self.lexicon.ids[np.repeat(a - start[:-1], b - a) + np.arange(start[-1])], start))
        for which, ids, start in found:
            data, cuts = ids.astype("<u4").tobytes(), (4 * start).tolist()
            for i, x, y in zip(which.tolist(), cuts, cuts[1:]):
                out[i] = data[x:y]
        return out

    def _learn(self, words: set[str]) -> None:
        new = list(words.difference(self.words))
        self.words.update(zip(new, self._ids(new)))

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """Split texts at single spaces, and encode pieces not met before. A
        new pre-token starts before a space after a non-space; a piece that
        begins with more white space, or is empty, sends its text the long way.
        Most pieces are a word, or a word and ASCII marks, which are a
        pre-token of their own."""
        split = [t.split(" ") for t in texts]
        if len(self.later) + len(self.words) > CACHED:
            self.later.clear()
            self.first.clear()
            self.words.clear()
        later = self.later
        new = set().union(*(x[1:] for x in split)).difference(later)
        plain, marked, other = set(), [], {}
        for p in new:
            if p.isalpha():
                plain.add(p)
                continue
            core = p.rstrip(MARKS)
            if core.isalpha():
                marked.append((p, core))
                if core not in later:
                    plain.add(core)
            elif not p or p[0].isspace():
                later[p] = None
            else:
                other[p] = self.v.pretoken.findall(" " + p)
        names = list(plain)
        later.update(zip(names, self._ids([" " + p for p in names])))
        first = {p: self.v.words_of(p) for p in {x[0] for x in split}.difference(self.first)}
        need = {p[len(core):] for p, core in marked}
        for ws in (*other.values(), *first.values()):
            need.update(ws)
        self._learn(need)
        words = self.words
        for p, core in marked:
            later[p] = later[core] + words[p[len(core):]]
        for memory, found in ((later, other), (self.first, first)):
            for p, ws in found.items():
                memory[p] = b"".join([words[w] for w in ws])
        return split

    def _plain(self, split: list[str]) -> bytes:
        try:
            return b"".join([self.first[split[0]], *map(self.later.__getitem__, split[1:])])
        except TypeError:  # a piece that does not stand on its own
            words = self.v.pretoken.findall(" ".join(split))
            self._learn(set(words))
            return b"".join([self.words[w] for w in words])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        apart = [i for i, t in enumerate(texts) if self.other and not self._latin(t) and self.other.search(t)]
        if not apart:
            return self._encode(texts)
        own = list(texts)
        for i in apart:
            own[i] = ""
        out = self._encode(own)
        for i, ids in zip(apart, library_ids(self.tokenizer, [texts[i] for i in apart])):
            out[i] = np.array(ids, "<u4").tobytes()
        return out

    def _latin(self, text: str) -> bool:
        """Whether a text has only characters up to U+00FF, and these are
        agreed on: quicker to tell than by the pattern."""
        if not self.beyond_latin:
            return False
        try:
            return text.isascii() or bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            return False

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut, parts = [], []
        for t in texts:
            pieces = [t]
            if self.v.split_special is not None and any(s in t for s in self.v.special):
                pieces = self.v.split_special.split(t)
            cut.append(len(pieces))
            parts.extend(pieces)
        plain = [p for p in parts if p and p not in self.v.special]
        done = iter([self._plain(s) for s in self.prepare(plain)])
        out, at = [], iter(parts)
        for n in cut:
            row = []
            for _ in range(n):
                p = next(at)
                if p:
                    row.append(np.array([self.v.special[p]], "<u4").tobytes() if p in self.v.special else next(done))
            out.append(b"".join(row))
        return out

    def decode(self, ids: bytes) -> str:
        table = self.v.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _slices(batch: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about SLICE_BYTES of its texts."""
    start, size = 0, 0
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(col)]
    for i, n in enumerate(sizes):
        if size and size + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = WordSplitter().words_of

        def emit() -> pa.RecordBatch:
            words: Counter = Counter()
            for space, pieces in (("", first), (" ", later)):
                for p, n in pieces.items():
                    for w in words_of(space + p):
                        words[w] += n
                pieces.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()),
                                               pa.array(list(words.values()), pa.int64())], ["word", "n"])
        first: Counter = Counter()
        later: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                p, *rest = t.split(" ")
                first[p] += 1
                later.update(rest)
                if len(later) > COUNTED:
                    yield emit()
        yield emit()
    ship(docs.sparkSession)
    return (docs.select(text_of(docs, text_col).alias("text")).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def frequent_words(counts: DataFrame, size: int, least: int = LEAST) -> list[str]:
    """At most ``size`` of the most frequent words, of those with ``least``
    occurrences. Counts are put into classes (an eighth of a doubling each);
    the classes from the top that fit are taken whole, so that no task sends
    more than it holds of them to the driver."""
    counts = saved(counts.where((F.col("n") >= least) & (F.col("word") != ""))
                   .withColumn("c", F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")), "frequent-words")
    taken, lowest = 0, None
    for r in sorted(counts.groupBy("c").agg(F.count("*").alias("k")).collect(), reverse=True):  # some hundred classes
        if taken + r["k"] > size:
            break
        taken, lowest = taken + r["k"], r["c"]
    if lowest is None:
        return []
    return [r["word"] for r in counts.where(F.col("c") >= lowest).select("word").collect()]


def build_lexicon(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compile up to ``size`` of the most frequent words of ``docs`` and add
    the file to the job. Returns its name there."""
    top = frequent_words(count_words(docs, text_col), size)
    folder = tempfile.mkdtemp(prefix="lexicon-")  # on the driver; the job's file service sends it out
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    compile_lexicon([w.encode() for w in top], Vocabulary(tokenizer), os.path.join(folder, name))
    docs.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    return name


_LIBRARIES: dict = {}


def library_ids(tokenizer: str, texts: list[str]) -> list[list[int]]:
    """Ids by the library, without added special tokens."""
    if tokenizer not in _LIBRARIES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers
        _LIBRARIES[tokenizer] = tokenizers.Tokenizer.from_file(tokenizer_path(tokenizer))
        _LIBRARIES[tokenizer].no_truncation()
        _LIBRARIES[tokenizer].no_padding()
    return [e.ids for e in _LIBRARIES[tokenizer].encode_batch(texts, add_special_tokens=False)]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(tokenizer: str) -> Vocabulary:
    """One per Python worker, kept between its tasks."""
    if tokenizer not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[tokenizer] = Vocabulary(tokenizer)
    return _VOCABULARIES[tokenizer]


def codec(tokenizer: str, lexicon: str | None = None, other: str = "") -> Codec:
    """A codec for one task: what it remembers goes with it. ``other`` is what
    ``other_letters`` says on the driver."""
    return Codec(vocabulary(tokenizer), Lexicon(SparkFiles.get(lexicon)) if lexicon else None, other, tokenizer)


def _map_column(df: DataFrame, source: str, new: list[tuple[str, T.DataType, pa.DataType]], start) -> DataFrame:
    """Add columns computed from one column, slice by slice; ``start()`` gives
    a task its function."""
    fields = [f for f in df.schema.fields if f.name not in {n for n, _, _ in new}]
    keep = [f.name for f in fields]
    out_schema = T.StructType([*fields, *(T.StructField(n, t) for n, t, _ in new)])
    at = keep.index(source)
    names = [*keep, *(n for n, _, _ in new)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        for batch in batches:
            for part in _slices(batch, at):
                made = fn(part.column(at).to_pylist())
                arrays = [pa.array(m, t) for m, (_, _, t) in zip(made, new)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names)
    ship(df.sparkSession)
    return df.select(*keep).mapInArrow(run, out_schema)


def encode(docs: DataFrame, lexicon: str | None, tokenizer: str = TOKENIZER, text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """``docs`` with ids (little-endian unsigned 32-bit numbers) and n_tokens;
    with ``decoded`` also what the ids decode to, in the same pass."""
    new = [("ids", T.BinaryType(), pa.binary()), ("n_tokens", T.LongType(), pa.int64())]
    other = other_letters()

    def start():
        c = codec(tokenizer, lexicon, other)

        def fn(texts):
            ids = c.encode([t or "" for t in texts])
            out = [ids, [len(i) // 4 for i in ids]]
            return [*out, [c.decode(i) for i in ids]] if decoded else out
        return fn
    return _map_column(docs, text_col, new + [("decoded", T.StringType(), pa.string())] * decoded, start)


def decode(encoded: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """A table with ids, with the column decoded."""
    def start():
        c = codec(tokenizer)
        return lambda ids: [[c.decode(i or b"") for i in ids]]
    return _map_column(encoded, "ids", [("decoded", T.StringType(), pa.string())], start)


def report(docs: DataFrame, tokenizer: str = TOKENIZER, size: int = LEXICON_WORDS) -> DataFrame:
    docs = docs.select("doc_id", "text")
    both = encode(docs, build_lexicon(docs, tokenizer, size), tokenizer, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                                         F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
