"""Benchmark decontamination by latent semantic retrieval.

1. Texts become 32-bit word hashes, stored once in the shared folder.
2. Passages (32 words, every 16) are rows of a TF-IDF matrix over ``FEATURES`` hashed
   words (idf over halves of passages, squared). Its leading right singular vectors and
   values come from a distributed randomised SVD: every passage is added, with a random
   sign, to one of ``SKETCH`` rows; the sum over all passages has a fixed size, keeps
   their row space, and is decomposed on the driver.
3. Every passage of the documents meets every passage of the benchmark by cosine in the
   latent space, each dimension divided by its singular value, so that what all passages
   of a language share does not make them alike. Pairs of high cosine are candidates.
4. A passage is also a candidate when the words around it hold as many of an item's
   rarest words as a pair must that is not alike in the latent space (a count, exact), so
   that no copy is lost by the place of its windows or by the latent space.
5. A candidate is confirmed on words: the longest common subsequence of the whole item
   with the document around the passage, and the item's answer (its last words). A
   latent candidate may have a shorter subsequence: clauses in another order, words replaced.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import text_slices
from sigframe.session import scratch_path

HALF = 16  # a passage is two halves
FEATURES = 4096
SKETCH = 128
RANK = 64
# From this cosine on a passage is a candidate of the latent search (unrelated ones of one
# language seldom pass 0.55, measured).
COSINE = 0.65
# Shares of an item's words that the common subsequence must have: with the answer and a latent
# candidate, with the answer, or by itself.
LCS_ALIKE = 0.35
LCS_WITH_ANSWER = 0.6
LCS_ALONE = 0.8
ANSWER_WORDS = 5
ANSWER_SHARE = 0.6
# Share of an item's words, its rarest, that are counted in documents. Every share above
# 1 - LCS_WITH_ANSWER finds the same pairs; at 0.6 the fewest subsequences were run (measured).
COUNTED = 0.6
# Benchmark items searched for at a time; more are searched in blocks.
ITEM_BLOCK = 2000
SLICE_WORDS = 200_000

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the words: runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).view(np.int32)


def tokenised(docs: DataFrame) -> DataFrame:
    """(doc_id, th, words), one row per distinct id and text; written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_slices(batch.column(2)):
                words = [words_of(t) for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int32)
                flat = np.concatenate(words) if words else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)),
                                                  pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "th", "words"])

    spark = docs.sparkSession
    path = scratch_path(spark, f"latent-{uuid.uuid4().hex}")
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
         .mapInArrow(run, "doc_id long, th long, words array<int>").write.parquet(path))
    return spark.read.parquet(path)


def _slices(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words, offsets) of some rows of a list column at a time."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    row, n = 0, len(lists)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_WORDS, "right")) - 1)
        yield row, flat[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


class Passages:
    """The passages of some texts: two halves each, one where a text has only one."""

    def __init__(self, offsets: np.ndarray):
        sizes = np.diff(offsets)
        halves = -(-sizes // HALF)
        row = np.repeat(np.arange(len(sizes)), halves)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(halves) - halves, halves)
        self.begin = offsets[row] + nth * HALF  # first word of each half
        self.sizes = np.minimum(HALF, offsets[row + 1] - self.begin)
        lone = halves[row] == 1
        self.first = np.flatnonzero(lone | (nth + 1 < halves[row]))
        self.second = np.where(lone[self.first], -1, self.first + 1)
        self.row = row[self.first]

    def distinct(self, features: np.ndarray) -> np.ndarray:
        """In how many halves each feature is."""
        place, out = np.arange(HALF), np.zeros(FEATURES, np.int64)
        features = features.astype(np.int16)
        for at in range(0, len(self.begin), 4096):
            begin, sizes = self.begin[at:at + 4096, None], self.sizes[at:at + 4096, None]
            words = np.sort(np.where(place < sizes, features[np.minimum(begin + place, len(features) - 1)], np.int16(-1)), axis=1)
            new = words >= 0
            new[:, 1:] &= words[:, 1:] != words[:, :-1]
            out += np.bincount(words[new], minlength=FEATURES)
        return out

    def sums(self, table: np.ndarray, features: np.ndarray) -> np.ndarray:
        """The sum of the table's rows over the words of every passage."""
        halves = np.empty((len(self.begin), table.shape[1]), np.float32)
        table = np.concatenate((table, np.zeros((1, table.shape[1]), table.dtype)))  # the row of a missing word
        place = np.arange(HALF)
        for at in range(0, len(self.begin), 2048):
            begin, sizes = self.begin[at:at + 2048, None], self.sizes[at:at + 2048, None]
            words = np.where(place < sizes, features[np.minimum(begin + place, len(features) - 1)], len(table) - 1)
            total = table.take(words[:, 0], axis=0)
            for i in range(1, HALF):  # a word of every half at a time: far faster than sums over runs
                total += table.take(words[:, i], axis=0)
            halves[at:at + 2048] = total
        out = halves[self.first]
        two = self.second >= 0
        out[two] += halves[self.second[two]]
        return out


def _features(words: np.ndarray) -> np.ndarray:
    return words.astype(np.int64) & (FEATURES - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of arrays by their row number; a fixed number of rows of fixed length."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                v = np.frombuffer(v, np.float64)
                total[k] = total[k] + v if k in total else v.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["k", "v"])

    schema = "k int, v binary"
    rows = parts.repartition(16, "k").mapInArrow(add, schema).collect()
    return {r["k"]: np.frombuffer(r["v"], np.float64) for r in rows}


def fit(tokens: DataFrame, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(table, idf): the table has one row of ``rank`` numbers per feature, its weight times
    its right singular vectors over their singular values. An empty corpus gives zeros."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, n_halves = np.zeros(SKETCH * FEATURES), np.zeros(FEATURES), 0
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for first, words, offsets in _slices(batch.column(1)):
                f, p = _features(words), Passages(offsets)
                if not len(f):
                    continue
                of_half = np.repeat(np.arange(len(p.begin)), p.sizes)
                n_halves += len(p.begin)
                seen += p.distinct(f)
                code = _mix(keys[first + p.row] + _mix(p.begin[p.first].astype(np.uint64) - offsets[p.row].astype(np.uint64)))
                bucket, sign = (code >> np.uint64(40)).astype(np.int64) % SKETCH, np.where(code >> np.uint64(63), 1.0, -1.0)
                for half in (p.first, p.second):  # each half adds to the passages it belongs to
                    own = half >= 0
                    b, s = np.full(len(p.begin), -1), np.zeros(len(p.begin))
                    b[half[own]], s[half[own]] = bucket[own], sign[own]
                    w = b[of_half] >= 0
                    total += np.bincount(b[of_half][w] * FEATURES + f[w], weights=s[of_half][w], minlength=SKETCH * FEATURES)
        rows = list(total.reshape(SKETCH, FEATURES)) + [seen, np.array([float(n_halves)])]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["k", "v"])

    got = _summed(tokens.select("th", "words").mapInArrow(sketch, "k int, v binary"))
    if SKETCH not in got or not got[SKETCH].any():
        return np.zeros((FEATURES, rank), np.float32), np.zeros(FEATURES)
    idf = np.log((1 + got[SKETCH + 1][0]) / (1 + got[SKETCH])) + 1e-3
    _, scale, turn = np.linalg.svd(np.array([got[i] for i in range(SKETCH)]) * idf ** 2, full_matrices=False)
    rank = int(min(rank, (scale > 1e-9 * scale[0]).sum()))
    return (turn[:rank].T * (idf ** 2)[:, None] / scale[:rank]).astype(np.float32), idf


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def common(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words.tolist():
        m = where.get(w)
        if m is not None:
            u = row & m
            row = (row + u | row - u) & full
    return len(item) - row.bit_count()


class Search:
    """A block of benchmark items, ready to meet passages."""

    def __init__(self, names: list[int], items: list[np.ndarray], table: np.ndarray, idf: np.ndarray):
        self.names, self.items, self.table, self.idf = names, items, table, idf.astype(np.float32)
        offsets = np.concatenate(([0], np.cumsum([len(w) for w in items]))).astype(np.int64)
        flat = np.concatenate(items)
        p = Passages(offsets)
        self.owner, self.latent = p.row, _unit(p.sums(table, _features(flat))).T.copy()
        self.sizes = np.array([len(w) for w in items])
        # A confirmed pair lacks at most L - ceil(LCS_WITH_ANSWER * L) of an item's L words, so at least
        # ``need`` of the counted ones are near the passage.
        counted = np.ceil(COUNTED * self.sizes - 1e-9).astype(np.int64)
        self.need = counted - (self.sizes - np.ceil(LCS_WITH_ANSWER * self.sizes - 1e-9).astype(np.int64))
        rare = [np.unique(w[np.argsort(-self.idf[_features(w)], kind="stable")[:n]]) for w, n in zip(items, counted.tolist())]
        words, owner = np.concatenate(rare), np.repeat(np.arange(len(items)), [len(w) for w in rare])
        order = np.argsort(words, kind="stable")
        self.holders = owner[order]  # items of each counted word
        self.counted, self.held_from, self.n_holders = np.unique(words[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.counted & 0xFFFF] = True

    def near(self, words: np.ndarray, offsets: np.ndarray, p: Passages) -> tuple[np.ndarray, np.ndarray]:
        """(passages, items), all those where ``need`` of the counted words are around the passage."""
        at = np.flatnonzero(self.maybe[words & 0xFFFF])
        which = np.minimum(np.searchsorted(self.counted, words[at]), len(self.counted) - 1)
        own = self.counted[which] == words[at]
        at, which = at[own], which[own]
        n = self.n_holders[which]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        key = np.sort(self.holders[np.repeat(self.held_from[which], n) + nth] * len(words) + np.repeat(at, n))
        item, place = key // len(words), key % len(words)
        last = np.arange(len(key)) + self.need[item] - 1  # the place that makes the count full
        i = np.flatnonzero(last < len(key))
        i = i[(item[last[i]] == item[i]) & (place[last[i]] - place[i] < 2 * HALF + 2 * self.sizes[item[i]])]
        first, stop, item = place[i], place[last[i]], item[i]
        row = np.searchsorted(offsets, first, "right") - 1
        within = stop < offsets[row + 1]
        first, stop, item, row = first[within], stop[within], item[within], row[within]
        # the passages of the row whose surroundings (see ``confirmed``) hold both places
        size, begin = self.sizes[item], offsets[row]
        passages = np.bincount(p.row, minlength=len(offsets) - 1)
        low = np.maximum(0, -(-(stop - begin - 2 * HALF - size + 1) // HALF))
        n = np.maximum(0, np.minimum(passages[row] - 1, (first - begin + size) // HALF) - low + 1)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        q = np.repeat((np.cumsum(passages) - passages)[row] + low, n) + nth
        both = np.unique(q * len(self.items) + np.repeat(item, n))
        return both // len(self.items), both % len(self.items)

    def confirmed(self, item: int, words: np.ndarray, at: int, least: float = LCS_WITH_ANSWER) -> tuple[float, float]:
        """(share of the item, share of its answer) that the words around ``at`` have in order;
        the answer's is 0 where the item's is below ``least`` and it cannot matter."""
        own = self.items[item]
        near = words[max(0, at - len(own)):at + 2 * HALF + len(own)]
        share, answer = common(own, near) / len(own), own[-ANSWER_WORDS:]
        return share, common(answer, near) / len(answer) if share >= least else 0.0

    def alike(self, latent: np.ndarray) -> Iterator[tuple[int, int]]:
        """(passage, item) of every pair whose latent cosine is ``COSINE`` or more."""
        for at in range(0, len(latent), 1024):
            cosine = latent[at:at + 1024] @ self.latent
            near = np.flatnonzero(cosine.max(axis=1) >= COSINE)
            passage, which = np.nonzero(cosine[near] >= COSINE)
            yield from sorted({(int(near[p]) + at, int(self.owner[w])) for p, w in zip(passage.tolist(), which.tolist())})

    def hits(self, words: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(row, item) to cosine, share and answer share of the confirmed pairs: the largest
        cosine of any passage of the row, the largest share of a candidate."""
        out: dict[tuple[int, int], tuple[float, float]] = {}
        if not len(words):
            return {}
        p = Passages(offsets)
        latent = _unit(p.sums(self.table, _features(words)))

        def confirm(q: int, i: int, least: float) -> None:
            row = int(p.row[q])
            share, answer = self.confirmed(i, words[offsets[row]:offsets[row + 1]], int(p.begin[p.first[q]] - offsets[row]), least)
            if share >= LCS_ALONE or (share >= least and answer >= ANSWER_SHARE):
                out[row, i] = max((share, answer), out.get((row, i), (0.0, 0.0)))

        for q, i in self.alike(latent):  # what is alike as a whole may have its words in another order
            confirm(q, i, LCS_ALIKE)
        for q, i in zip(*(x.tolist() for x in self.near(words, offsets, p))):
            confirm(q, i, LCS_WITH_ANSWER)
        return {(row, i): (float((latent[p.row == row] @ self.latent[:, self.owner == i]).max()), *shares) for (row, i), shares in out.items()}


def matches(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> tuple[DataFrame, DataFrame]:
    """(tokens, matches): ``tokens`` as written, and a row (doc_id, th, item_id, cosine, share,
    answer) per document and item that it holds. Items without a word or an id match nothing;
    of items with one id each counts."""
    tokens = tokenised(docs)
    table, idf = fit(tokens)
    spark = docs.sparkSession
    schema = "doc_id long, th long, item_id long, cosine double, share double, answer double"
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item"))
             .filter("item_id is not null and item is not null").distinct())
    blocks = max(1, -(-items.count() // item_block))
    out = None
    for number in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == number)
        rows = sorted((r["item_id"], r["item"]) for r in block.collect())  # about item_block items
        words = [(name, words_of(text)) for name, text in rows]
        words = [(name, w) for name, w in words if len(w)]
        if not words:
            continue
        sent = spark.sparkContext.broadcast(Search([n for n, _ in words], [w for _, w in words], table, idf))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            search = sent.value
            for batch in batches:
                ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for first, flat, offsets in _slices(batch.column(2)):
                    hits = search.hits(flat, offsets)
                    if hits:
                        yield pa.RecordBatch.from_pydict({
                            "doc_id": pa.array([ids[first + r] for r, _ in hits], pa.int64()), "th": pa.array([hashes[first + r] for r, _ in hits], pa.int64()),
                            "item_id": pa.array([search.names[i] for _, i in hits], pa.int64()),
                            **{n: pa.array([float(v[k]) for v in hits.values()]) for k, n in enumerate(("cosine", "share", "answer"))}})

        found = tokens.select("doc_id", "th", "words").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return tokens, spark.createDataFrame([], schema) if out is None else out


def _marked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    _, found = matches(docs, benchmark)
    return found.groupBy("doc_id", "th").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("cosine").alias("cosine"), F.max("share").alias("share"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, item_ids, cosine, share), one row per input row. A document
    that holds no item has an empty list and null figures; null and empty texts hold none."""
    found = _marked(docs, benchmark).withColumnsRenamed({"doc_id": "own", "th": "own_th"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    return rows.join(found, rows["doc_id"].eqNullSafe(found["own"]) & (rows["th"] == found["own_th"]), "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("item_ids"), "cosine", "share")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, all columns kept."""
    found = _marked(docs, benchmark).select(F.col("doc_id").alias("__own"), F.col("th").alias("__own_th"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__own"]) & (F.xxhash64(docs["text"]) == found["__own_th"]), "left_anti")
