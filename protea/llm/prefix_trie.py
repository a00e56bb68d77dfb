"""Prefix trie of conversations, built by bursting.

A conversation is the row of its turns, a turn the 128-bit digest of its role
and text; so a path is bytes, and its order is that of the trie. Equal
conversations are one path with several members.

All paths begin in the container of the root. A container of more than
CAPACITY turns bursts: its head becomes a unit of the trie's top (the head, and
the nodes that all of its paths share below it), and its paths go to new
containers by their next turn. This goes on by rounds, a Spark job each, until
no container is too large; each round parts what is left, so a long common
beginning is one round however long. Then the containers are dealt to tasks,
each sorted by path and swept into nodes with a stack. What the containers'
heads add up to is carried up through the units, level by level.

No task holds more than a container (or a single conversation), whatever the
copies and common first turns: sizes and sums of hot heads are aggregated
before they are shuffled, and the join that deals a hot container's paths is
salted. Member lists are hashed from strings of up to 4,096 consecutive ids
each, in order, as a stream.

Cases: null roles and texts are empty; null turns come first, and equal turns
in the order of their digests; repeated rows are turns of their own; rows
without a conversation's id belong to none; a conversation without turns is a
member of the root; an empty table has no nodes. The result has the columns of
this operator only, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protea.llm.common import saved, ship

CAPACITY = 4096          # turns in a container
TURN = 16                # bytes of a turn's digest
SALTS = 16
MEMBERS = "key string, path binary, words array<int>, n long, least long, ends string"
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (digest and words of each, in order), one row each, and
    the twenty's first one with its first three turns."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN)
    conv = conversations["conv_id"].cast("long")
    rows = (conversations.where(conv.isNotNull())
            .select((conv - F.pmod(conv, F.lit(20))).alias("first"), conv.alias("conv_id"), conversations["turn"].alias("turn"),
                    digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
            .repartition("first"))
    return rows.groupBy("first", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the contract's conversations, whose beginning is that of
    the first one of their twenty. Twenty meet in a window, after one shuffle."""
    twenty = Window.partitionBy("first")
    begin = F.max(F.when(F.col("conv_id") == F.col("first"), F.slice("turns", 1, 3))).over(twenty)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    return (turns_of(conversations).withColumn("begin", begin).withColumn("h", h)
            .select("conv_id", F.concat(F.expr("slice(coalesce(begin, slice(turns, 1, 0)), 1, h)"),
                                        F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")).alias("turns")))


def _hash_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of paths, sorted by key and part, to one row a path."""
    names = ["key", "path", "words", "n", "least", "ends"]
    done: list[list] = [[] for _ in names]
    key, h, row = None, None, None

    def close() -> None:
        for column, value in zip(done, (*row, h.hexdigest())):
            column.append(value)

    def emit() -> pa.RecordBatch:
        types = [pa.string(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, types)], names)
        for c in done:
            c.clear()
        return out
    for batch in batches:
        for k, path, words, n, least, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if key is not None:
                    close()
                key, h, row = k, hashlib.sha256(ids.encode()), [k, path, words, n, least]
            else:
                h.update(b"," + ids.encode())
                row[3] += n
        yield emit()
    if key is not None:
        close()
        yield emit()


def distinct_paths(sequences: DataFrame) -> DataFrame:
    """A row for each distinct conversation: path, words of its turns, members,
    the least of them, and the digest of them all."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t.digest), ""))
    rows = sequences.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t.words).alias("words"))
    parts = (rows.withColumn("key", F.sha2("path", 256)).withColumn("part", F.shiftright("conv_id", 12))
             .groupBy("key", "part").agg(F.first("path").alias("path"), F.first("words").alias("words"),
                                         F.count("*").alias("n"), F.min("conv_id").alias("least"),
                                         F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")))
    return (parts.repartition("key").sortWithinPartitions("key", "part")
            .select("key", "path", "words", "n", "least", "ids").mapInArrow(_hash_members, MEMBERS))


def common_turns(lo: bytes, hi: bytes, at: int = 0) -> int:
    """Turns that two paths share at their beginning, from ``at`` on."""
    end = min(len(lo), len(hi)) // TURN
    while at < end and lo[TURN * at:TURN * at + TURN] == hi[TURN * at:TURN * at + TURN]:
        at += 1
    return at


def _bottoms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units with the depth to which all their paths are one."""
    for batch in batches:
        depth, lo, hi = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("depth", "lo", "hi"))
        bottom = [common_turns(x["path"], y, d) for d, x, y in zip(depth, lo, hi)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bottom, pa.int32())], [*batch.schema.names, "bottom"])


def burst(paths: DataFrame, capacity: int) -> tuple[list[DataFrame], DataFrame]:
    """Units of the trie's top, a table per round, and all paths with the
    container that they are in at last: its head, the depth of that, the unit
    above and the least member there."""
    def head(depth: str) -> Column:
        return F.sha2(F.expr(f"substring(path, 1, {TURN} * ({depth}))"), 256)
    held: list[DataFrame] = []
    units: list[DataFrame] = []
    state = paths.select("path", "words", "n", "least", "ends", head("0").alias("head"), F.lit(0).alias("depth"),
                         F.lit(None).cast("string").alias("up"), F.lit(None).cast("long").alias("up_conv"))
    columns = state.columns
    while True:
        large = (state.groupBy("head", "depth", "up", "up_conv")
                 .agg(F.sum(F.greatest(F.length("path") / TURN - F.col("depth"), F.lit(0)) + 1).alias("turns"),
                      F.min(F.struct("path", "words", "ends")).alias("lo"), F.max("path").alias("hi"),
                      F.min("least").alias("conv"), F.sum("n").alias("n_convs"))
                 .where(F.col("turns") > capacity))
        large = saved(large.mapInArrow(_bottoms, T.StructType([*large.schema.fields, T.StructField("bottom", T.IntegerType())])),
                      "trie-units")
        if large.isEmpty():
            held.append(state)
            break
        units.append(large)
        salted = large.select(F.col("head").alias("h"), "bottom", "conv", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        dealt = saved(state.join(salted, (F.col("head") == F.col("h")) & (F.pmod(F.hash("path"), F.lit(SALTS)) == F.col("salt")),
                                 "left").drop("salt"), "trie-state")
        held.append(dealt.where("h is null").select(*columns))
        state = dealt.where(f"h is not null and length(path) > {TURN} * bottom").select(
            "path", "words", "n", "least", "ends", head("bottom + 1").alias("head"), (F.col("bottom") + 1).alias("depth"),
            F.col("h").alias("up"), F.col("conv").alias("up_conv"))
    out = held[0]
    for rows in held[1:]:
        out = out.unionByName(rows)
    return units, out


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths sorted by container and path, to nodes. A node is
    [depth, parent, conv, members, children, leaves, saved, ends, words]."""
    head, up, up_conv, before = None, None, None, b""
    nodes: list[list] = []
    stack: list[int] = []

    def close() -> None:
        x = nodes[stack.pop()]
        x[5] = x[5] or 1
        x[6] += (x[3] - 1) * x[8]
        if stack:
            p = nodes[stack[-1]]
            p[2] = x[2] if p[2] is None else min(p[2], x[2])
            p[3] += x[3]
            p[4] += 1
            p[5] += x[5]
            p[6] += x[6]

    def emit() -> pa.RecordBatch:
        while stack:
            close()
        conv = [x[2] for x in nodes]
        parent = [up_conv if x[1] < 0 else conv[x[1]] for x in nodes]
        long = pa.int64()
        columns = [pa.array(conv, long), pa.array([x[0] for x in nodes], long), pa.array(parent, long)]
        columns += [pa.array([x[i] for x in nodes], long) for i in (3, 4, 5, 6)]
        columns += [pa.array([x[7] for x in nodes], pa.string()),
                    pa.array([up if x[1] < 0 else None for x in nodes], pa.string())]
        nodes.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
                                                    "n_leaves", "saved_tokens", "ends_sha256", "up"])
    for batch in batches:
        rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in
                     ("head", "depth", "up", "up_conv", "path", "words", "n", "least", "ends")))
        for h, depth, u, uc, path, words, n, least, ends in rows:
            if h != head:
                if nodes:
                    yield emit()
                head, up, up_conv = h, u, uc
                nodes.append([depth, -1, None, 0, 0, 0, 0, NO_ENDS, words[depth - 1] if depth else 0])
                stack.append(0)
                shared = depth
            else:
                shared = common_turns(before, path, depth)
            while nodes[stack[-1]][0] > shared:
                close()
            for d in range(shared + 1, len(path) // TURN + 1):
                nodes.append([d, stack[-1], None, 0, 0, 0, 0, NO_ENDS, words[d - 1]])
                stack.append(len(nodes) - 1)
            x = nodes[stack[-1]]
            x[2], x[3], x[7] = least, x[3] + n, ends
            before = path
    if nodes:
        yield emit()


def trie(paths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The nodes of the trie of distinct paths."""
    ship(paths.sparkSession)
    units, held = burst(saved(paths, "trie-paths"), capacity)
    swept = held.repartition("head").sortWithinPartitions("head", "path").mapInArrow(_sweep, NODE + ", up string")
    if not units:
        return swept.drop("up")
    swept = saved(swept, "trie-nodes")

    def sums(heads: DataFrame) -> DataFrame:
        return heads.groupBy("up").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"),
                                       F.sum("saved_tokens").alias("below"))
    heads = swept.where("up is not null").select("up", "n_leaves", "saved_tokens")
    top = []
    below: DataFrame | None = None
    for level in reversed(units):
        # all that hangs on this level: containers, and the units beneath
        hanging = sums(heads if below is None else heads.unionByName(below))
        own = level.join(hanging.withColumnRenamed("up", "at"), F.col("head") == F.col("at"), "left")
        # words of the unit's turns, from its head to its bottom
        turns = "slice(lo.words, greatest(depth, 1), bottom - greatest(depth, 1) + 1)"
        own = own.select("head", "up", "up_conv", "conv", "n_convs", "depth", "bottom",
                         F.when(F.length("lo.path") == TURN * F.col("bottom"), F.col("lo.ends")).otherwise(NO_ENDS).alias("ends"),
                         F.expr(f"if(bottom = 0, array(), {turns})").alias("words"),
                         F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"),
                         F.coalesce("below", F.lit(0)).alias("below"))
        own = saved(own, "trie-top")
        top.append(own)
        all_words = F.reduce("words", F.lit(0).cast("long"), lambda a, x: a + x)
        below = own.where("up is not null").select("up", F.col("leaves").alias("n_leaves"),
                                                   (F.col("below") + (F.col("n_convs") - 1) * all_words).alias("saved_tokens"))
    out = swept.drop("up")
    for own in top:
        out = out.unionByName(_unit_nodes(own))
    return out


def _unit_nodes(own: DataFrame) -> DataFrame:
    """The nodes of units: a chain from the head to the bottom each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        for batch in batches:
            rows = []
            for u in batch.to_pylist():
                saved_tokens = u["below"]
                for d in range(u["bottom"], u["depth"] - 1, -1):
                    last = d == u["bottom"]
                    if d:
                        saved_tokens += (u["n_convs"] - 1) * u["words"][d - max(u["depth"], 1)]
                    rows.append((u["conv"], d, u["up_conv"] if d == u["depth"] else u["conv"], u["n_convs"],
                                 u["children"] if last else 1, u["leaves"], saved_tokens, u["ends"] if last else NO_ENDS))
            types = [pa.int64()] * 7 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
    return own.mapInArrow(run, NODE)


def nodes(conversations: DataFrame, capacity: int = CAPACITY, rebuild: bool = False) -> DataFrame:
    """The nodes of the prefix trie of all conversations; with ``rebuild`` of
    the contract's rebuilt ones."""
    sequences = rebuilt(conversations) if rebuild else turns_of(conversations).select("conv_id", "turns")
    return trie(distinct_paths(sequences), capacity)


def report(conversations: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return nodes(conversations, capacity, rebuild=True)
