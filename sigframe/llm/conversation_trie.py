"""Prefix trie over conversations, by ternary search trees on range shards.

1. Turns become tokens: a digest of role and text, and the text's length. They are numbered
   within their conversation, conversations are rebuilt (see ``sequences``) and cut into
   segments of ``SEGMENT`` tokens, so that no row holds a conversation of unbounded length.
2. Equal segments after equal beginnings are one row with a count: a group of copies is one
   sequence. The ids that end with a sequence are sorted by range, joined in pieces and
   hashed from a stream.
3. Sequences are sorted by range. Each block of bounded size is a shard with a dictionary of
   its tokens and a ternary search tree over their codes, filled from the median outwards. An
   iterative traversal numbers the nodes, and its reverse sums members, leaves and savings.
4. Only prefixes of a shard's first and last sequence can be in other shards too. These
   boundary nodes meet by a key that chains the tokens; what each adds itself then goes to
   all its ancestors, which are boundary nodes as well.
5. Segments after the first are tries of their own below the node they go on from, the
   deepest first. A beginning that one conversation alone has needs no tree: its further
   nodes are a path and are written out as such.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.llm.common import cut
from sigframe.operators.ordering import ordered_index

SEGMENT = 512
SHARD_TOKENS = 400_000
TOKEN = 20  # bytes: 16 of a digest, 4 of a length
STEP, HEADS = 100, 6  # fixed values: which conversation gives the first turns, and how many at most
NOTHING = hashlib.sha256(b"").hexdigest()
_ROOT = bytes(16)


def _numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, tok): the turns with an id, numbered by turn (null first; of one turn by token)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    tok = F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), F.lpad(F.hex(F.length(text).cast("long")), 8, "0"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", tok.alias("tok")).filter("conv_id is not null")
    return cut(ordered_index(turns, ["conv_id"], ["turn", "tok"], out="pos").select("conv_id", "pos", "tok"))


def _joined(order: str, value: str):
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "")


def sequences(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, level, total, p, p_next, seq): the rebuilt conversations in segments of tokens.

    Conversation c is the first h turns of conversation c - c % 100 (all if it has fewer, none
    if it is absent), then its own after its first h; h is the unsigned crc32 of its decimal
    id, % 6. ``total`` is its length, ``p`` a digest of all before the segment (``p_next`` of
    all before the next). A conversation left without turns has one empty segment.
    """
    if segment < HEADS:
        raise ValueError(f"a segment has {HEADS} tokens at least")
    rows = _numbered(conversations)
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"h": h, "b": F.col("conv_id") - F.col("conv_id") % STEP})
    givers = convs.filter(F.col("conv_id") % STEP == 0).select(F.col("conv_id").alias("b"), F.col("own").alias("given"))
    k = F.least("h", F.coalesce("given", F.lit(0)))
    convs = cut(convs.join(givers, "b", "left").select("conv_id", "b", k.alias("k"), (k + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")))

    own = (rows.filter(F.col("pos") >= h).select("conv_id", (F.col("pos") - h).alias("q"), "tok")
           .groupBy("conv_id", F.floor(F.col("q") / segment).alias("piece")).agg(_joined("q", "tok").alias("s")).join(convs, "conv_id"))
    # a piece starts k tokens after the start of a level
    width = 2 * TOKEN
    inside = ((segment - F.col("k")) * width).cast("int")
    parts = F.array(F.struct(F.col("piece").alias("level"), F.lit(1).alias("at"), F.substring("s", F.lit(1), inside).alias("s")),
                    F.struct((F.col("piece") + 1).alias("level"), F.lit(0).alias("at"), F.substring("s", inside + 1, F.lit(segment * width)).alias("s")))
    own = own.select("conv_id", "total", F.inline(parts)).filter("s != ''")
    heads = rows.filter((F.col("conv_id") % STEP == 0) & (F.col("pos") < HEADS)).groupBy(F.col("conv_id").alias("b")).agg(_joined("pos", "tok").alias("s"))
    lent = convs.filter("k > 0").join(heads, "b").select(
        "conv_id", "total", F.lit(0).cast("long").alias("level"), F.lit(0).alias("at"), F.substring("s", F.lit(1), (F.col("k") * width).cast("int")).alias("s"))
    bare = convs.filter("total = 0").select("conv_id", "total", F.lit(0).cast("long").alias("level"), F.lit(0).alias("at"), F.lit("").alias("s"))
    segments = own.unionByName(lent).unionByName(bare).groupBy("conv_id", "level").agg(F.max("total").alias("total"), F.unhex(_joined("at", "s")).alias("seq"))
    segments = cut(segments)

    first = F.lit(_ROOT)
    short = segments.filter(F.col("total") <= segment).select("conv_id", "level", "total", first.alias("p"), F.lit(None).cast("binary").alias("p_next"), "seq")
    by_level = Window.partitionBy("conv_id").orderBy("level")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    chain = lambda salt: F.sum(F.xxhash64(F.lit(salt), "level", "seq").cast("decimal(38,0)")).over(before).cast("string")
    p = F.when(F.col("level") == 0, first).otherwise(F.unhex(F.md5(F.concat_ws(",", F.col("level").cast("string"), chain("a"), chain("b")))))
    long = segments.filter(F.col("total") > segment).withColumn("p", p)
    long = long.withColumn("p_next", F.lead("p").over(by_level)).select(*short.columns)
    return cut(short.unionByName(long))


def _ends(segments: DataFrame) -> DataFrame:
    """(key, sha): for each sequence with which conversations end, the hash of their ids."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[i] for i in starts], pa.binary()), pa.array([ids[i] for i in starts], pa.int64()),
                pa.array([",".join(map(str, ids[i:j])) for i, j in zip(starts, starts[1:] + [len(ids)])], pa.string())], ["key", "least", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
                if k == key:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], ["key", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "sha"])

    packed = (segments.select(_key().alias("key"), "conv_id").repartitionByRange("key", "conv_id")
              .sortWithinPartitions("key", "conv_id").mapInArrow(pack, "key binary, least long, ids string"))
    return packed.repartition("key").sortWithinPartitions("key", "least").mapInArrow(digest, "key binary, sha string")


def _key():
    return F.unhex(F.md5(F.concat("p", "seq")))


class Tree:
    """Ternary search tree over sequences of codes, one node per node of the trie."""

    def __init__(self):
        self.char: list[int] = []
        self.low: list[int] = []
        self.equal: list[int] = []
        self.high: list[int] = []
        self.row: list[int] = []  # the sequence that ends at the node

    def _new(self, code: int) -> int:
        for column, value in ((self.char, code), (self.low, -1), (self.equal, -1), (self.high, -1), (self.row, -1)):
            column.append(value)
        return len(self.char) - 1

    def insert(self, codes: list[int], row: int) -> None:
        char, low, equal, high = self.char, self.low, self.equal, self.high
        node = 0 if char else self._new(codes[0])
        at, last = 0, len(codes) - 1
        while True:
            code = codes[at]
            if code == char[node]:
                if at == last:
                    self.row[node] = row
                    return
                at += 1
                side, start = equal, codes[at]
            else:
                side, start = (low if code < char[node] else high), code
            if side[node] < 0:
                side[node] = self._new(start)
            node = side[node]

    def fill(self, sequences: list[list[int]]) -> None:
        """Insert sorted sequences, the median first, then those of either half."""
        todo = [(0, len(sequences))]
        while todo:
            start, stop = todo.pop()
            if start < stop:
                middle = (start + stop) // 2
                self.insert(sequences[middle], middle)
                todo += [(middle + 1, stop), (start, middle)]

    def walk(self) -> Iterator[tuple[int, int, int]]:
        """(node, place of its parent in this order or -1, depth), parents before children."""
        todo = [(0, -1, 0)] if self.char else []
        n = 0
        while todo:
            node, parent, depth = todo.pop()
            yield node, parent, depth
            for side in (self.low[node], self.high[node]):
                if side >= 0:
                    todo.append((side, parent, depth))
            if self.equal[node] >= 0:
                todo.append((self.equal[node], n, depth + 1))
            n += 1


NODES = ("inner boolean, shard string, key binary, up binary, path array<binary>, depth int, least long, up_least long, n long, "
         "children long, leaves long, saved long, size long, sha string")


def _shard(name: str, rows: list[dict]) -> pa.RecordBatch:
    """The nodes of one shard's tree. Inner ones are whole but for a parent that is a boundary
    node (``up``); boundary ones hold what the inner nodes below them sum to."""
    tokens = [[r["seq"][i:i + TOKEN] for i in range(0, len(r["seq"]), TOKEN)] for r in rows]
    words, starts = sorted({t for seq in tokens for t in seq}), sorted({r["p"] for r in rows})
    code, first = {t: i for i, t in enumerate(words)}, {p: i for i, p in enumerate(starts)}
    coded = [[first[r["p"]], *(code[t] for t in seq)] for r, seq in zip(rows, tokens)]
    tree = Tree()
    tree.fill(coded)
    order = list(tree.walk())
    shared = set()  # places of the prefixes of the first and the last sequence
    children_of: list[dict[int, int]] = [{} for _ in order]
    tops: dict[int, int] = {}
    for i, (node, parent, _) in enumerate(order):
        (children_of[parent] if parent >= 0 else tops)[tree.char[node]] = i
    for seq in (coded[0], coded[-1]):
        at = tops[seq[0]]
        shared.add(at)
        for c in seq[1:]:
            at = children_of[at][c]
            shared.add(at)
    m = len(order)
    n, children, leaves, saved, least = [0] * m, [0] * m, [0] * m, [0] * m, [None] * m
    for i in range(m - 1, -1, -1):  # children come after their parents
        node, parent, depth = order[i]
        if tree.row[node] >= 0:
            r = rows[tree.row[node]]
            n[i] += r["n"]
            least[i] = r["least"] if least[i] is None else min(least[i], r["least"])
            children[i] += r["more_children"]
            leaves[i] += r["more_leaves"]
            saved[i] += r["more_saved"]
        if i not in shared:  # all of it is in this shard
            if not children[i]:
                leaves[i] = 1
            if depth:
                saved[i] += (n[i] - 1) * int.from_bytes(words[tree.char[node]][16:], "big")
        if parent >= 0:
            n[parent] += n[i]
            least[parent] = least[i] if least[parent] is None else min(least[parent], least[i])
            leaves[parent] += leaves[i]
            saved[parent] += saved[i]
            children[parent] += i not in shared
    keys: dict[int, list[bytes]] = {}
    for i in sorted(shared):
        node, parent, depth = order[i]
        keys[i] = [*keys[parent], hashlib.md5(keys[parent][-1] + words[tree.char[node]]).digest()] if depth else [starts[tree.char[node]]]
    out = []
    for i, (node, parent, depth) in enumerate(order):
        inner, end = i not in shared, tree.row[node]
        out.append((inner, name, starts[tree.char[node]] if inner and not depth else None if inner else keys[i][-1],
                    keys[parent][-1] if parent in shared else None, None if inner else keys[i], depth, least[i],
                    least[parent] if parent >= 0 and parent not in shared else None, n[i], children[i], leaves[i], saved[i],
                    int.from_bytes(words[tree.char[node]][16:], "big") if depth else 0, rows[end]["sha"] if end >= 0 else None))
    types = [pa.bool_(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int32(), *[pa.int64()] * 7, pa.string()]
    names = [c.strip().split()[0] for c in NODES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names)


def _level(rows: DataFrame, shard_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots) of the tries over ``rows`` (p, seq, n, least, sha, more_children,
    more_leaves, more_saved). ``nodes`` has depths from 1 below each p, ``roots`` a row per p."""
    names = ["p", "seq", "n", "least", "sha", "more_children", "more_leaves", "more_saved"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                size += len(row["seq"]) // TOKEN + 1
                if size >= shard_tokens:
                    yield _shard(f"{part}-{block}", held)
                    block, held, size = block + 1, [], 0
        if held:
            yield _shard(f"{part}-{block}", held)

    total = rows.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    shards = 1 + (total["bytes"] // TOKEN + total["n"]) // shard_tokens
    found = cut(rows.select(*names).repartitionByRange(shards, "p", "seq").sortWithinPartitions("p", "seq").mapInArrow(build, NODES))

    edge = found.filter("not inner")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    met = edge.groupBy("key").agg(F.max("up").alias("up"), F.max("path").alias("path"), F.max("depth").alias("depth"), F.min("least").alias("least"),
                                  F.max("size").alias("size"), F.max("sha").alias("sha"), *sums)
    met = cut(met)
    below = met.filter("up is not null").groupBy(F.col("up").alias("key")).agg(F.count("*").alias("edges"))
    met = met.join(below, "key", "left").withColumn("children", F.col("children") + F.coalesce("edges", F.lit(0))).drop("edges")
    adds = met.select(F.explode("path").alias("key"), (F.col("children") == 0).cast("long").alias("own_leaf"),
                      F.when(F.col("depth") > 0, (F.col("n") - 1) * F.col("size")).otherwise(0).alias("own_saved"))
    adds = adds.groupBy("key").agg(F.sum("own_leaf").alias("own_leaf"), F.sum("own_saved").alias("own_saved"))
    met = met.join(adds, "key").withColumns({"leaves": F.col("leaves") + F.col("own_leaf"), "saved": F.col("saved") + F.col("own_saved")})
    met = cut(met.drop("path", "own_leaf", "own_saved"))

    columns = ["key", "depth", "least", "up_least", "n", "children", "leaves", "saved", "sha"]
    parents = met.select(F.col("key").alias("up"), F.col("least").alias("up_least"))
    edges = met.join(parents, "up", "left").select(*columns)
    # the root has children in every shard: they meet it by shard and key
    of_shard = edge.select("shard", "key").join(met.select("key", "least"), "key").select("shard", F.col("key").alias("up"), F.col("least").alias("met_least"))
    inner = found.filter("inner")
    whole = inner.filter("up is null").select(*columns)
    under = inner.filter("up is not null").drop("up_least").join(of_shard, ["shard", "up"]).withColumnRenamed("met_least", "up_least").select(*columns)
    nodes = whole.unionByName(under).unionByName(edges)
    return nodes, nodes.filter("depth = 0")


def trie(conversations: DataFrame, segment: int = SEGMENT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Null roles and texts are empty, null turns come first, turns of equal number are ordered
    by a digest of role and text, and repeated rows are turns of their own. Rows without a
    conv_id are left out; the remainder of a negative id has its sign. An empty table gives
    no rows.
    """
    segments = sequences(conversations, segment)
    done = F.col("level") * segment + F.length("seq") / TOKEN == F.col("total")
    groups = segments.filter("level > 0").groupBy("level", "p").agg(F.count("*").alias("sharing"))
    groups = cut(groups)
    rows = segments.filter("level = 0").withColumn("sharing", F.lit(2).cast("long")).unionByName(
        segments.filter("level > 0").join(groups, ["level", "p"]), allowMissingColumns=True)
    ends = _ends(segments.filter(done))
    some = (rows.filter("sharing > 1").groupBy("level", "p", "seq").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), F.max("p_next").alias("p_next"))
        .withColumn("key", _key()).join(ends, "key", "left"))
    some = cut(some)
    levels = [0] + [r["level"] for r in groups.filter("sharing > 1").select("level").distinct().collect()]

    out = roots = None
    for level in sorted(levels, reverse=True):
        here = some.filter(F.col("level") == level)
        more = [F.when(F.col("p_next").isNull(), 0).otherwise(F.lit(v)).cast("long") for v in (1, 1, 0)]
        if roots is not None:
            deeper = roots.select(F.col("key").alias("p_next"), "children", "leaves", "saved")
            here = here.join(deeper, "p_next", "left")
            more = [F.coalesce(F.col(c), m) for c, m in zip(("children", "leaves", "saved"), more)]
        here = here.select("p", "seq", "n", "least", "sha", *(m.alias(f"more_{c}") for c, m in zip(("children", "leaves", "saved"), more)))
        nodes, roots = _level(here, shard_tokens)
        if level:
            nodes = nodes.filter("depth > 0")
        nodes = nodes.withColumn("depth", F.col("depth").cast("long") + level * segment)
        out = nodes if out is None else out.unionByName(nodes)
    out = out.select(F.col("least").alias("conv_id"), "depth", F.col("up_least").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                     F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                     F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"))
    one = F.lit(1).cast("long")
    tail = (rows.filter("sharing = 1").select("conv_id", "total", F.explode(F.sequence(
        F.col("level") * segment + 1, F.col("level") * segment + (F.length("seq") / TOKEN).cast("long"))).alias("depth"))
        .select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"),
                (F.col("depth") < F.col("total")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                F.when(F.col("depth") < F.col("total"), F.lit(NOTHING)).otherwise(F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends_sha256")))
    return out.unionByName(tail)
