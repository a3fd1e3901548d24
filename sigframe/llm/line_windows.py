"""Line dedup over overlapping windows of three lines.

Lines are split at line feeds and compared without outer white space; blank lines
belong to no window and stay. Every three consecutive lines are a window, keyed by the
three 64-bit hashes of its lines. Of all places of a window in the whole table the first
(by id, then text hash, then line) keeps its lines; each later place is covered, and a
document loses the union of its covered lines. Documents of fewer than three lines
have no window and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import fresh

WINDOW = 3


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.xxhash64("text").alias("th"), F.col("text"))


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, th, lines): the numbers (from 0, ascending) of the lines to remove, for documents with any.

    ``th`` is the hash of the text: rows with one id and different texts are different
    documents, equal rows are one. A null text has no lines; a null id comes first.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("n"), F.trim(F.regexp_replace(x, r"[\t\r\x0b\f]", " ")).alias("x"))), lambda s: s["x"] != "")
    hashed = F.transform(lines, lambda s: F.struct(s["n"].alias("n"), F.xxhash64(s["x"]).alias("h")))
    windows = F.when(F.size("l") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("l") - (WINDOW - 1)), lambda i: F.slice("l", i, WINDOW)))
    flat = (_keyed(docs).select("doc_id", "th", hashed.alias("l")).select("doc_id", "th", F.explode(windows).alias("w"))
            .select("doc_id", "th", *[F.col("w")[i]["h"].alias(f"h{i}") for i in range(WINDOW)], F.col("w.n").alias("lines")))
    keys = [f"h{i}" for i in range(WINDOW)]
    place = F.struct("doc_id", "th", F.col("lines")[0].alias("line"))
    repeated = flat.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select(*keys, "first")
    later = flat.join(repeated, keys).filter(place > F.col("first"))
    return later.groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))


def dedup(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """The documents, all columns and rows kept, with repeated windows taken out of ``text``
    and ``n_chars`` (if there is one) brought up to date where a line went.

    ``removed`` names a column for the number of lines taken out; it and the text are
    all that changes. Equal rows get the same result.
    """
    gone, own_id, own_th, th = (fresh(docs, n) for n in ("__lines", "__id", "__hash", "__th"))
    table = covered(docs).select(F.col("doc_id").alias(own_id), F.col("th").alias(own_th), F.col("lines").alias(gone))
    keyed = docs.withColumn(th, F.xxhash64("text"))
    joined = keyed.join(table, keyed["doc_id"].eqNullSafe(table[own_id]) & (keyed[th] == table[own_th]), "left")
    lines = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.element_at(F.transform(F.array(lines), lambda a: F.array_join(F.transform(kept, lambda i: F.get(a, i)), "\n")), 1))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(text.alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col(gone).isNull(), F.col(c)).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    if removed:
        columns.append(F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed))
    return joined.select(*columns)
