"""SimHash near-duplicates with pivot distance tables.

Fingerprints are linked when they differ in at most ``max_distance`` bits. The
table of pivots holds the Hamming distance of every fingerprint to reference
fingerprints; a pair whose distances to any one reference differ by more than
``max_distance`` cannot be linked (triangle inequality), so it is discarded
before the bits are compared.

Pairs come from groups: the 64 bits are cut into ``max_distance + 2`` blocks, two
linked fingerprints agree in at least two whole blocks, and every pair of blocks
is a group key. That is exact for any data. Pivot distances of unrelated 64-bit
fingerprints lie within a few units of 32, so cells of distances alone would keep
most pairs; the groups do what cells cannot and the table prunes inside them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.llm.common import cut, fresh, spread_join, text_slices
from sigframe.llm.components import components

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
N_PIVOTS = 16
# Rows of one group compared in one piece; larger groups are dealt into chunks
# and every two chunks meet in a cell of their own.
CHUNK = 2048
SEED = 42


def fingerprint_of(text: str, k: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the XXH64 values of k-word shingles (see ``fingerprints``)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 16384):
        ones += np.unpackbits(hashes[at:at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, hashed: bool = False) -> DataFrame:
    """(doc_id, fp) with one row per input row, with ``hashed`` also th, the XXH64 of the whole text.

    A-Z are lower-cased, words are runs without ASCII white space, shingles are k
    words joined by a space with repeats; with fewer words the whole sequence is
    one shingle, with none (null text too) the fingerprint is 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for first, texts in text_slices(batch.column(1)):
                for i, text in enumerate(texts):
                    out[first + i] = fingerprint_of(text, k)
            rest = batch.columns[2:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), *rest], ["doc_id", "fp", "th"][:2 + len(rest)])

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if hashed:
        return docs.select(*columns, F.xxhash64(text_col).alias("th")).mapInArrow(run, "doc_id long, fp long, th long")
    return docs.select(*columns).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Reference fingerprints: the first 64 bits of SHA-256 of their number."""
    return np.array([int.from_bytes(hashlib.sha256(f"pivot {i}".encode()).digest()[:8], "big") for i in range(n)], np.uint64)


def _block_masks(max_distance: int) -> list[int]:
    """Masks of every two of ``max_distance + 2`` blocks of the 64 bits, signed."""
    n = max_distance + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    masks = [a | b for a, b in itertools.combinations(blocks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def _linked(i: np.ndarray, j: np.ndarray, fps: np.ndarray, coords: np.ndarray, d: int) -> np.ndarray:
    """Which pairs (i, j) survive the pivot table and the comparison of bits."""
    ok = np.abs(coords[i] - coords[j]).max(axis=1) <= d
    at = np.flatnonzero(ok)
    return at[np.bitwise_count(fps[i[at]] ^ fps[j[at]]) <= d]


def _forest(fps: np.ndarray, coords: np.ndarray, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of one cell: breadth-first search in which every
    member meets only what is not yet reached, within its range of the first pivot."""
    order = np.argsort(coords[:, 0], kind="stable")
    fps, coords = fps[order], coords[order]
    left = np.arange(len(fps))
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        at = queue.pop()
        first = coords[left, 0]
        lo, hi = np.searchsorted(first, coords[at, 0] - d, "left"), np.searchsorted(first, coords[at, 0] + d, "right")
        near = left[lo:hi]
        if len(near):
            hit = _linked(np.full(len(near), at), near, fps, coords, d)
            if len(hit):
                found = near[hit]
                yield np.full(len(found), fps[at]), fps[found]
                queue.extend(found.tolist())
                left = np.delete(left, lo + hit)


def _cells(combo, key, pair, fp, refs, d, small=32):
    """Links within the cells of sorted rows."""
    same = (combo[1:] == combo[:-1]) & (key[1:] == key[:-1]) & (pair[1:] == pair[:-1])
    starts = np.concatenate(([0], np.flatnonzero(~same) + 1))
    sizes = np.diff(np.concatenate((starts, [len(fp)])))
    cell = np.repeat(np.arange(len(starts)), sizes)
    few = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= small), sizes))
    if len(few):
        f, c = fp[few], cell[few]
        coords = _table(f, refs)
        for step in range(1, small):
            i = np.flatnonzero(c[step:] == c[:-step]) if len(c) > step else np.empty(0, np.int64)
            if not len(i):
                break
            hit = _linked(i, i + step, f, coords, d)
            yield f[i[hit]], f[i[hit] + step]
    for at in np.flatnonzero(sizes > small):
        f = np.unique(fp[starts[at]:starts[at] + sizes[at]])
        yield from _forest(f, _table(f, refs), d)


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE, n_pivots: int = N_PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """(u, v): links that connect all fingerprints within ``max_distance`` bits.

    ``distinct`` has the column ``fp`` (long, no repeats). Links of a large cell are
    a spanning forest of it, so their number follows the fingerprints, not the
    pairs. Groups of more than ``chunk`` rows are dealt into chunks by hash.
    """
    masks = _block_masks(max_distance)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("combo", "key"))
    hot = keyed.groupBy("combo", "key").count().filter(F.col("count") > chunk).select(
        "combo", "key", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    n = F.coalesce("chunks", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), n).cast("int")
    dealt = (keyed.join(hot, ["combo", "key"], "left")
             .select("combo", "key", "fp", n.alias("n"), mine.alias("mine"))
             .select("combo", "key", "fp", "mine", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
             .select("combo", "key", "fp", (F.least("mine", "other").cast("long") * F.lit(1 << 31) + F.greatest("mine", "other")).alias("pair")))
    refs = pivots(n_pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
                now[3] = now[3].astype(np.int64).view(np.uint64)
                held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
                # the last cell may go on in the next batch
                differs = (held[0] != held[0][-1]) | (held[1] != held[1][-1]) | (held[2] != held[2][-1])
                end = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            else:
                end = 0 if held is None else len(held[0])
            if end:
                for u, v in _cells(*(x[:end] for x in held), refs, max_distance):
                    if len(u):
                        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u).view(np.int64)), pa.array(np.ascontiguousarray(v).view(np.int64))], ["u", "v"])
                held = [x[end:] for x in held]

    return (dealt.repartition("combo", "key", "pair").sortWithinPartitions("combo", "key", "pair")
                 .select("combo", "key", "pair", "fp").mapInArrow(run, "u long, v long"))


def _rooted(docs: DataFrame, k: int, max_distance: int, hashed: bool = True) -> tuple[DataFrame, DataFrame]:
    """(fingerprints, (fp, least, n, root)): the smallest id of every fingerprint, its rows and its component's root."""
    prints = cut(fingerprints(docs, k=k, hashed=hashed))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    roots = components(links(groups.select("fp"), max_distance))
    rooted = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    return prints, cut(rooted)


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row.

    component_id is the smallest doc_id among the documents reachable over links,
    the document's own included; null ids take part but never name a component
    (a component of null ids only has a null id). Repeated rows share a
    fingerprint and so a component; an empty table gives no rows.
    """
    prints, rooted = _rooted(docs, k, max_distance, hashed=False)
    named = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")))
    mapped = cut(spread_join(rooted.select("root", "fp", "n"), named, "root", "size").select("fp", "component_id", "n"))
    return spread_join(prints.select("doc_id", "fp"), mapped, "fp", "n").select("doc_id", "fp", "component_id")


def fingerprint_hex(column: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")


def keep_components(docs: DataFrame, k: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One document of every component, all columns kept: the one of the smallest id and,
    where that id has several texts in the component, of the smallest hash of the text.

    Two texts of one id are two documents. Of repeated rows (id and text) any one stays.
    Documents without an id stay, since nothing names them.
    """
    prints, rooted = _rooted(docs, k, max_distance)
    th, lead, lead_th, nth = (fresh(docs, n) for n in ("__own_text", "__leader", "__leader_text", "__nth"))
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))
    least = prints.groupBy("fp").agg(F.min(named).alias("least"))  # few rows a print before the components meet
    leaders = (least.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("least").alias("least"))
               .filter("least is not null").select(F.col("least.doc_id").alias(lead), F.col("least.th").alias(lead_th)))
    keyed = docs.withColumn(th, F.xxhash64("text"))
    kept = keyed.join(leaders, (keyed["doc_id"] == leaders[lead]) & (keyed[th] == leaders[lead_th]), "left_semi")
    first = kept.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", th).orderBy("text"))).filter(F.col(nth) == 1).drop(nth, th)
    return first.unionByName(docs.filter(docs["doc_id"].isNull()))
