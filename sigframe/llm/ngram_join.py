"""Jaccard similarity join on word n-grams, by rare-first prefix filtering.

1. One pass over the texts gives every document the identity of its set of shingles, the
   set's size and its profile (members in each of 64 ranges of the hash), and the corpus
   a table of fixed size with the document frequencies of hashed shingles.
2. A set's members are ordered rarest first. Sets as alike as asked share a member among
   their first ``n - ceil(t n) + 1``, so only that prefix is posted. Any one order gives
   the same links, so the size of the frequency table decides speed only.
3. Postings meet by shingle. Equal sets are one class before that, and members of one
   list within reach of its first member's length are offered to that member. Every class
   verifies the offer it meets most often. In a group of near copies this finds nearly all
   links, one per class, instead of one per pair.
4. The classes so linked are one label. While long lists hold several labels, their members
   are offered to a few of the list's most common label, each time others. What is left is
   whole: all pairs of different labels that share a list pass the length and the positional filter, the suffix filter (a bound from the profiles, the
   set cut into ranges as by probes of its suffix), and are then verified on whole sets.
   Pairs of one label cannot change a component and are never formed.

A class is known by 64 bits of a digest of its whole set, a shingle by 64 bits of its words.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.llm.common import spread_join, text_slices
from sigframe.llm.components import components
from sigframe.session import scratch_path

WORDS = 4
PERCENT = 85
BUCKETS = 1 << 20
PARTS = 16  # rows the frequency table is summed in
RANGES = 64
BLOCK = 1024  # members of a list offered to one of them
SEEN = 200_000  # classes a task remembers, so that copies are posted once by it
LONG = 64  # members of a list from which on its labels are first brought together by offers
PIVOTS = 8
ROUNDS = 1
BLOCK_BYTES = 1 << 20
_SPACE = re.compile(rb"[\t-\r ]")


def _words(text: str) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased, read in blocks of bounded size."""
    data = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    while at < len(data):
        end = at + BLOCK_BYTES
        if end < len(data):
            space = _SPACE.search(data, end)
            end = space.start() if space else len(data)
        words = data[at:end].lower().split()  # bytes: ASCII case and white space only
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of a sequence of word hashes, other for every length and order."""
    with np.errstate(over="ignore"):
        acc = np.full(len(parts[0]), len(parts), np.uint64)
        for part in parts:
            acc = (acc ^ part) * np.uint64(0x9E3779B97F4A7C15)
            acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            acc ^= acc >> np.uint64(29)
        return acc


def sets_of(texts: list[str], k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(members, offsets): the distinct shingles of each text, ascending. Fewer than ``k``
    words are one shingle of them all, no words an empty set."""
    words = [_words(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = np.concatenate(words) if words else np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(words)), sizes)
    members, rows = [], []
    if len(flat) >= k:
        at = np.flatnonzero(row[k - 1:] == row[:len(row) - k + 1])
        members.append(_fold([flat[at + i] for i in range(k)]))
        rows.append(row[at])
    starts = np.cumsum(sizes) - sizes
    for few in range(1, k):
        short = np.flatnonzero(sizes == few)
        if len(short):
            members.append(_fold([flat[starts[short] + i] for i in range(few)]))
            rows.append(short)
    if not members:
        return np.empty(0, np.uint64), np.zeros(len(words) + 1, np.int64)
    h, r = np.concatenate(members), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.concatenate(([0], np.cumsum(np.bincount(r, minlength=len(words))))).astype(np.int64)


def _class_of(members: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(members.tobytes())


def least_overlap(total):
    """The smallest intersection of two sets of ``total`` members together that are linked."""
    return -(-PERCENT * total // (100 + PERCENT))


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, f"ngrams-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def facts(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """One row per document (doc_id, th, n, cls, profile), and per task ``PARTS`` rows (part,
    counts) with the frequencies of the shingles' buckets; stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for first, texts in text_slices(batch.column(2)):
                h, offsets = sets_of(texts, k)
                counts += np.bincount(h & np.uint64(BUCKETS - 1), minlength=BUCKETS)
                n = np.diff(offsets)
                at = np.repeat(np.arange(len(n)), n) * RANGES + (h >> np.uint64(64 - 6)).astype(np.int64)
                profile = np.bincount(at, minlength=len(n) * RANGES).reshape(len(n), RANGES)
                yield _fact_rows(batch.column(0).slice(first, len(n)), batch.column(1).slice(first, len(n)), n,
                                 np.array([_class_of(h[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64).view(np.int64),
                                 [p.astype("<u2" if p.max() < 1 << 16 else "<u4").tobytes() for p in profile])
        if counts.any():
            none = pa.nulls(PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, none, pa.nulls(PARTS, pa.int64()), none, pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()),
                 pa.array([zlib.compress(c.astype("<i8").tobytes(), 1) for c in np.split(counts, PARTS)], pa.binary())], FACTS)

    return _stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(
        run, "doc_id long, th long, n long, cls long, profile binary, part int, counts binary"), "facts")


FACTS = ["doc_id", "th", "n", "cls", "profile", "part", "counts"]


def _fact_rows(ids, hashes, n, cls, profiles) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, hashes, pa.array(n, pa.int64()), pa.array(cls), pa.array(profiles, pa.binary()),
                                       pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], FACTS)


def rarity(known: DataFrame) -> np.ndarray:
    """A byte for each bucket that rises with the logarithm of its frequency (a fixed size)."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(zlib.decompress(packed.as_py()), "<i8")
                total[part] = total[part] + counts if part in total else counts
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(255, 6 * np.log2(1 + c)).astype(np.uint8).tobytes() for c in total.values()], pa.binary())], ["part", "codes"])

    rows = known.filter("part is not null").select("part", "counts").repartition(PARTS, "part").mapInArrow(add, "part int, codes binary").collect()
    out = np.zeros(BUCKETS, np.uint8)
    for r in rows:
        out[r["part"] * (BUCKETS // PARTS):][:BUCKETS // PARTS] = np.frombuffer(r["codes"], np.uint8)
    return out


def postings(docs: DataFrame, codes: np.ndarray, k: int = WORDS) -> DataFrame:
    """(token, cls, n, pos): the prefix of every set, rarest members first."""
    sent = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in text_slices(batch.column(0)):
                h, offsets = sets_of(texts, k)
                n = np.diff(offsets)
                cls = np.array([_class_of(h[s:e]) for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64).view(np.int64)
                new = np.zeros(len(n), bool)
                for i, c in enumerate(cls.tolist()):
                    if n[i] and c not in seen:
                        new[i] = True
                        seen.add(c)
                if len(seen) > SEEN:
                    seen.clear()
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((h, sent.value[(h & np.uint64(BUCKETS - 1)).astype(np.int64)], row))
                pos = np.arange(len(h)) - offsets[:-1][row]  # rows stay in place, only their members move
                prefix = n - -(-PERCENT * n // 100) + 1
                keep = np.flatnonzero(new[row] & (pos < prefix[row]))
                yield pa.RecordBatch.from_arrays([pa.array(h[order[keep]].view(np.int64)), pa.array(cls[row[keep]]),
                                                  pa.array(n[row[keep]].astype(np.int32)), pa.array(pos[keep].astype(np.int32))], ["token", "cls", "n", "pos"])

    return docs.select("text").mapInArrow(run, "token long, cls long, n int, pos int")


def lists(posted: DataFrame) -> DataFrame:
    """(token, cls, n, pos, anchor): the postings of shingles that several classes post. The
    anchor is the first of the at most ``BLOCK`` members before that are near enough in
    length, and of such first members the first of the list. Lists are streamed, so a list
    of any length needs no more memory than an Arrow batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, matched = None, False  # the last row, and whether the one before has its token
        token = head = block = None
        size = 0

        def anchored(rows: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal token, head, block, size
            anchors = np.empty(len(rows[0]), np.int64)
            for i, (t, c, n) in enumerate(zip(*(x.tolist() for x in rows[:3]))):
                if t != token or 100 * head[1] < PERCENT * n:
                    token, head, block, size = t, (c, n), (c, n), 0
                elif size == BLOCK or 100 * block[1] < PERCENT * n:
                    block, size = (c, n), 0
                anchors[i] = (head if size == 0 else block)[0]
                size += 1
            return pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows), pa.array(anchors)], ["token", "cls", "n", "pos", "anchor"])

        for batch in _nonempty(batches, 4):
            now = batch if held is None else [np.concatenate(both) for both in zip(held, batch)]
            new = np.ones(len(now[0]), bool)
            new[1:] = (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])
            now = [x[new] for x in now]
            before = np.concatenate(([matched], now[0][1:] == now[0][:-1]))  # the row before has the same token
            yield anchored([x[:-1][before[:-1] | before[1:]] for x in now])
            held, matched = [x[-1:] for x in now], bool(before[-1])
        if held is not None and matched:
            yield anchored(held)

    return _stored(posted.repartition("token").sortWithinPartitions("token", "n", "cls")
                   .mapInArrow(run, "token long, cls long, n int, pos int, anchor long"), "lists")


def _nonempty(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]


def _range_counts(profiles: list[bytes]) -> np.ndarray:
    return np.array([np.frombuffer(p, "<u2" if len(p) == 2 * RANGES else "<u4") for p in profiles], np.int64).reshape(-1, RANGES)


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int = WORDS) -> DataFrame:
    """The pairs (u, v) of classes that are linked: those that pass the suffix filter are
    compared on their whole sets, which one document of each class gives again."""
    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
            most = np.minimum(_range_counts(batch.column(4).to_pylist()), _range_counts(batch.column(5).to_pylist())).sum(axis=1)
            ok = pa.array(most >= least_overlap(n))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["u", "v"])

    def side(name: str) -> DataFrame:
        return classes.select(F.col("cls").alias(name), F.col("n").alias(f"n_{name}"), F.col("profile").alias(f"p_{name}"))

    alive = _stored(pairs.join(side("u"), "u").join(side("v"), "v").filter(
        F.lit(100) * F.least("n_u", "n_v") >= F.lit(PERCENT) * F.greatest("n_u", "n_v"))
        .select("u", "v", "n_u", "n_v", "p_u", "p_v").mapInArrow(suffix, "u long, v long"), "pairs")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                h, offsets = sets_of(texts, k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(
                    [h[s:e].tobytes() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())], ["cls", "members"])

    asked = alive.select(F.explode(F.array("u", "v")).alias("cls")).distinct()
    named = asked.join(classes, "cls").select("cls", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    one = (texts.join(named, (texts["th"] == named["rep_th"]) & texts["doc_id"].eqNullSafe(named["rep_id"]))
           .groupBy("cls").agg(F.max("text").alias("text")))  # repeated rows are one
    held = _stored(one.mapInArrow(sets, "cls long, members binary"), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                common = np.intersect1d(a, b, assume_unique=True).size
                ok.append(common >= least_overlap(len(a) + len(b)))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["u", "v"])

    both = (alive.join(held.select(F.col("cls").alias("v"), F.col("members").alias("m_v")), "v")
            .join(held.select(F.col("cls").alias("u"), F.col("members").alias("m_u")), "u"))
    return _stored(both.select("u", "v", "m_u", "m_v").mapInArrow(compare, "u long, v long"), "links")


def _mixed(met: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists whose members have several labels, with the most common one and the list's length."""
    marked = _stored(met.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select(
        "token", "cls", "n", "pos", F.coalesce("root", "cls").alias("label")), "labels")
    several = (marked.groupBy("token", "label").agg(F.count("*").alias("n"))
               .groupBy("token").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("labels"), F.sum("n").alias("members"))
               .filter("labels > 1").select("token", F.col("most.label").alias("major"), "members"))
    return _stored(marked.join(several, "token"), "mixed")


def _near(pairs: DataFrame) -> DataFrame:
    """The pairs (a_cls, a_n, a_pos, cls, n, pos) that pass the length and the positional filter.
    The latter holds where a shingle is the first that both prefixes share: what both sets
    have from there on must suffice."""
    total = F.col("a_n") + F.col("n")
    return (pairs.filter(F.lit(100) * F.least("a_n", "n") >= F.lit(PERCENT) * F.greatest("a_n", "n"))
            .filter(F.lit(100 + PERCENT) * F.least(F.col("a_n") - F.col("a_pos"), F.col("n") - F.col("pos")) >= F.lit(PERCENT) * total))


def _offers(mixed: DataFrame, nth: int) -> DataFrame:
    """(u, v): every class of another than the most common label with the ``PIVOTS`` members of
    that label it meets most often; each list names ``PIVOTS`` of them, others in every round."""
    draw = lambda i: F.xxhash64("cls", F.lit(nth * PIVOTS + i)).alias("draw")
    pivots = mixed.filter("label = major").groupBy("token").agg(*(F.min(F.struct(draw(i), "cls", "n", "pos")).alias(f"p{i}") for i in range(PIVOTS)))
    met = mixed.filter("label != major").join(pivots, "token").select(
        F.col("cls").alias("a_cls"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"), F.explode(F.array_distinct(F.array(*(f"p{i}" for i in range(PIVOTS))))).alias("p"))
    votes = _near(met.select("a_cls", "a_n", "a_pos", "p.cls", "p.n", "p.pos")).groupBy("a_cls", "cls").agg(F.count("*").alias("votes"))
    best = Window.partitionBy("a_cls").orderBy(F.desc("votes"), "cls")  # at most PIVOTS for each shingle of its prefix
    chosen = votes.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= PIVOTS)
    return chosen.select(F.least("a_cls", "cls").alias("u"), F.greatest("a_cls", "cls").alias("v")).distinct()


def near_duplicates(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row.

    Documents are linked when 100 times the intersection of their sets of shingles is at
    least ``PERCENT`` times the union; component_id is the smallest doc_id reachable over
    links, the document's own included. Texts without words, empty or null, are linked with
    nothing. Null ids take part but never name a component (one of null ids only has a null
    id). Repeated rows, and rows of one id with several texts, are documents of their own.
    An empty table gives no rows.
    """
    known = facts(docs, k)
    rows = known.filter("part is null")
    classes = _stored(rows.filter("n > 0").groupBy("cls").agg(
        F.max("n").alias("n"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("rep"),
        F.max("profile").alias("profile"), F.count("*").alias("copies")), "classes")
    met = lists(postings(docs, rarity(known), k))

    # first the offer that a class meets most often
    votes = met.filter("anchor != cls").groupBy("cls", "anchor").agg(F.count("*").alias("n"))
    tried = _stored(votes.groupBy("cls").agg(F.max(F.struct("n", "anchor")).alias("best")).select(
        F.least("cls", "best.anchor").alias("u"), F.greatest("cls", "best.anchor").alias("v")).distinct(), "offers")
    links = verified(tried, classes, docs, k)
    # then, in long lists of several labels, offers to members of the most common label
    for nth in range(ROUNDS):
        mixed = _mixed(met, components(links))
        offers = _stored(_offers(mixed.filter(F.col("members") > LONG), nth).join(tried, ["u", "v"], "left_anti"), "offers")
        if offers.isEmpty():
            break
        more = verified(offers, classes, docs, k)
        tried, links = tried.unionByName(offers), links.unionByName(more)
        if more.isEmpty():
            break
    else:
        mixed = _mixed(met, components(links))
    # then whatever shares a list across labels
    a = mixed.filter("label != major").select("token", *(F.col(c).alias(f"a_{c}") for c in ("cls", "n", "pos", "label")))
    crossing = _near(a.join(mixed, "token").filter("a_label != label").filter("label = major or a_cls < cls")).select(
        F.least("a_cls", "cls").alias("u"), F.greatest("a_cls", "cls").alias("v")).distinct()
    roots = components(links.unionByName(verified(crossing.join(tried, ["u", "v"], "left_anti"), classes, docs, k)))

    named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least", "copies", F.coalesce("root", "cls").alias("root"))
    named = _stored(named, "roots")
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("size"))
    mapped = spread_join(named, of_root, "root", "size").select("cls", "copies", "component_id")
    linked = spread_join(rows.filter("n > 0").select("doc_id", "n", "cls"), _stored(mapped, "named"), "cls", "copies")
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n", "component_id").unionByName(alone).withColumnRenamed("n", "n_shingles")
