"""Nearest neighbours by a forest of hash prefixes.

A tree is a sorted array of 64-bit hash strings: the signs of random projections.
A query descends each tree to its longest matching prefixes; then all trees ascend
together, one bit at a time, until the rows that share the current prefix number
``share`` of the block. Those rows are compared exactly.

Inner products become angles by one more dimension, sqrt(M^2 - |x|^2) with M the
largest norm of all rows; for queries it is 0.

Rows and queries are dealt into blocks of bounded size by hash and every block of
rows answers every block of queries, so no task holds more than two blocks. Equal
vectors are one entry of the index, with the few smallest ids a result can name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigframe.llm.common import cut

BITS = 64
TREES = 40
SHARE = 1.0
BLOCK = 8192
# Keys over which the figures of a vector length are spread.
SALTS = 256
K = 20
SEED = 5


def planes(dims: int, trees: int = TREES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dims, trees * BITS)).astype(np.float32)


def strings(x: np.ndarray, hyper: np.ndarray) -> np.ndarray:
    """(rows, trees) hash strings as unsigned numbers, the first bit the highest."""
    out = np.empty((len(x), hyper.shape[1] // BITS), np.uint64)
    for at in range(0, len(x), 1024):
        signs = np.packbits(x[at:at + 1024].astype(np.float32) @ hyper >= 0, axis=1)
        out[at:at + 1024] = signs.reshape(len(signs), -1, 8).view(">u8")[:, :, 0]
    return out


def candidates(index: np.ndarray, asked: np.ndarray, share: float = SHARE, least: int = K + 1):
    """For each query the rows of the index to compare, ``least`` different ones at least
    where there are so many. ``index`` and ``asked`` hold hash strings."""
    n, trees = index.shape
    order = np.argsort(index, axis=0, kind="stable")
    ranked = np.take_along_axis(index, order, axis=0)
    quota = max(1, min(n * trees, int(np.ceil(share * n))))
    depths = int(np.ceil(np.log2(n + 1))) + 2  # a deeper prefix holds a row or two of a block at most
    low, high = np.zeros((depths + 1, trees, len(asked)), np.int32), np.full((depths + 1, trees, len(asked)), n, np.int32)
    for d in range(1, depths + 1):
        rest = np.uint64(BITS - d)
        first = (asked >> rest) << rest
        last = first | np.uint64((1 << (BITS - d)) - 1)
        for t in range(trees):
            low[d, t] = np.searchsorted(ranked[:, t], first[:, t], "left")
            high[d, t] = np.searchsorted(ranked[:, t], last[:, t], "right")
    enough = (high - low).sum(axis=1) >= quota
    depth = depths - np.argmax(enough[::-1], axis=0)  # the deepest level with enough rows; level 0 has all
    marked = np.zeros(n, bool)
    for q in range(len(asked)):
        d = depth[q]
        marked[:] = False
        while True:
            for t in range(trees):
                marked[order[low[d, t, q]:high[d, t, q], t]] = True
            found = np.flatnonzero(marked)
            if len(found) >= min(n, least):
                break
            d -= 1
        yield found


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a vector of doubles that is
    not empty, not zero and without null or non-finite components. Repeated rows are one."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(~bad).filter(~zero).distinct())


def search(vectors: DataFrame, every: int = 20, k: int = K, trees: int = TREES, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every`` the
    ``k`` nearest found, or all where there are no more; ties go to the smaller id.

    A query never finds its own id. Of several vectors with one id each is found, and
    the smallest asks. Vectors of another length than most are compared among
    themselves only. An empty table gives no rows.
    """
    rows = cut(usable(vectors).withColumn("dims", F.size("v")).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))))
    ids = Window.partitionBy("v").orderBy("vec_id")
    entries = (rows.withColumn("nth", F.row_number().over(ids)).filter(F.col("nth") <= k + 1)
               .groupBy("v", "dims", "norm").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asks = rows.filter(F.col("vec_id") % every == 0)
    asks = asks.groupBy("vec_id", "dims").agg(F.min("v").alias("v"))
    size = rows.groupBy("dims").agg(F.max("norm").alias("top"), F.approx_count_distinct("v").alias("n"),
                                    F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("m"))
    size = size.select("dims", "top", F.ceil(F.col("n") / block).cast("long").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("m") / block)).cast("long").alias("asked"))
    nothing = F.expr("cast(null as array<bigint>)")
    # Most tables hold vectors of one length: its row of figures is copied to SALTS keys, so that no key holds all vectors.
    size = size.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    entries, asks = entries.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")), asks.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    dealt = entries.join(size, ["dims", "salt"]).select(
        "dims", "top", F.pmod(F.xxhash64("v"), "blocks").alias("block"), F.explode(F.expr("sequence(0L, asked - 1)")).alias("part"),
        "v", "ids", F.expr("cast(null as bigint)").alias("query_id"))
    asked = asks.join(size, ["dims", "salt"]).select(
        "dims", "top", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.pmod(F.xxhash64("vec_id"), "asked").alias("part"),
        "v", nothing.alias("ids"), F.col("vec_id").alias("query_id"))

    def answer(key, table):
        dims = key[0].as_py()
        table = table.combine_chunks()
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        top = table["top"][0].as_py()
        is_ask = table["query_id"].is_valid().to_numpy(zero_copy_only=False)
        names, asker = table["ids"].to_pylist(), table["query_id"].to_pylist()
        base, quest = x[~is_ask], x[is_ask]
        own = [n for n in names if n is not None]
        out: tuple[list, list, list] = [], [], []
        if len(base) and len(quest):
            hyper = planes(dims + 1, trees)
            more = np.sqrt(np.maximum(0.0, top * top - (base * base).sum(axis=1)))
            index = strings(np.column_stack((base, more)), hyper)
            asks = strings(np.column_stack((quest, np.zeros(len(quest)))), hyper)
            for q, (name, found) in enumerate(zip((a for a in asker if a is not None), candidates(index, asks, share, k + 1))):
                score = (base[found] * quest[q]).sum(axis=1)
                if len(found) > k + 1:  # the k + 1 best entries and all their ties
                    best = score >= -np.partition(-score, k)[k]
                    found, score = found[best], score[best]
                best = sorted((-s, i) for r, s in zip(found.tolist(), score.tolist()) for i in own[r] if i != name)[:k]
                out[0].extend([name] * len(best))
                out[1].extend(i for _, i in best)
                out[2].extend(-s for s, _ in best)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = dealt.unionByName(asked).groupBy("dims", "block", "part").applyInArrow(answer, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
