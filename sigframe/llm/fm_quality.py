"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

A document is a set of features, each with a value: its hashed words
(sub-linear counts, scaled to unit length), its structure statistics and the stored
length as metadata (both cut into bins by quantiles of the training sample). The score is the
logistic of w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j; the pair term is computed
in time linear in the features as half of (sum v x)^2 - sum (v x)^2 per factor.

Training uses a sample of at most ``max_rows`` labelled documents, the ones with the
smallest hash of their id, so the model and the fit are bounded at any input size.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigframe.llm.common import text_slices

BUCKETS = 2048
FACTORS = 8
BINS = 8
MAX_ROWS = 6000
EPOCHS = 12
BATCH = 256
RATE = 0.05
L2 = 1e-4

STATISTICS = (
    "log_chars", "log_words", "word_length", "upper", "digit", "symbol", "other_script", "white", "distinct",
    "shouted", "symbol_words", "bare_marks", "log_lines", "line_length", "repeated_lines", "ended_lines", "log_stored_chars",
)
N_FEATURES = BUCKETS + len(STATISTICS) * (BINS + 1)

# Byte classes: 1 upper, 2 lower, 3 digit, 4 symbol, 5 white, 6 beyond ASCII.
_KIND = np.full(256, 4, np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[list(b" \t\n\r\x0b\x0c")] = 5


def measure(text: str, stored: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, their counts, statistics) of one text; defined for the empty text too."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    words = low.split()
    n, n_words = max(1, len(raw)), max(1, len(words))
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=7)
    own = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_lines = max(1, len(lines))
    ids, counts = np.unique(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS, return_counts=True)
    statistics = np.array([
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n_words, kinds[1] / n, kinds[3] / n, kinds[4] / n, kinds[6] / n, kinds[5] / n,
        len(set(words)) / n_words, sum(map(bytes.isupper, own)) / n_words,
        sum(1 for w in own if w[-1:] in b"#$%&*!|") / n_words, sum(1 for w in own if len(w) == 1 and not w.isalnum()) / n_words,
        np.log1p(len(lines)), np.log1p(len(raw) / n_lines), 1 - len(set(lines)) / n_lines, sum(1 for x in lines if x.rstrip()[-1:] in b".!?") / n_lines,
        np.log1p(max(0, len(text) if stored is None else stored)),
    ])
    return ids, counts, statistics


def scaled(counts: np.ndarray) -> np.ndarray:
    """Values of a text's buckets: sub-linear counts of unit length."""
    return np.sqrt(counts) / np.sqrt(counts.sum()) if len(counts) else np.zeros(0)


@dataclasses.dataclass
class Model:
    """Weights; ``edges`` are the bin limits of the statistics. An untrained model scores 0.5."""

    edges: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def features(self, ids, values, statistics) -> tuple[np.ndarray, np.ndarray]:
        bins = (statistics[:, None] > self.edges).sum(axis=1)
        own = BUCKETS + np.arange(len(STATISTICS)) * (BINS + 1) + bins
        return np.concatenate((ids, own)), np.concatenate((values, np.full(len(own), 0.3)))

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        total = vx.sum(axis=0)
        return float(self.w0 + self.w[at] @ x + 0.5 * (total @ total - (vx * vx).sum()))

    def score(self, text: str, stored: int | None) -> float:
        ids, counts, statistics = measure(text, stored)
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.margin(*self.features(ids, scaled(counts), statistics)), -30, 30))))


def untrained() -> Model:
    return Model(np.zeros((len(STATISTICS), BINS)), 0.0, np.zeros(N_FEATURES), np.zeros((N_FEATURES, FACTORS)))


def fit(measured: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit on the measures of the training texts: AdaGrad on mini-batches, log loss. One class or no row at all gives a constant model."""
    model = untrained()
    if not len(labels) or labels.min() == labels.max():
        model.w0 = float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))) if len(labels) else 0.0
        return model
    model.edges = np.quantile(np.array([m[2] for m in measured]), np.arange(1, BINS + 1) / (BINS + 1), axis=0).T.copy()
    rng = np.random.default_rng(seed)
    model.v = rng.normal(0, 0.05, (N_FEATURES, FACTORS))
    rows = [model.features(ids, scaled(counts), statistics) for ids, counts, statistics in measured]
    g0, gw, gv = 1e-6, np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, FACTORS), 1e-6)
    dense = np.zeros((BATCH, N_FEATURES), np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for first in range(0, len(order), BATCH):
            part = order[first:first + BATCH]
            x = dense[:len(part)]
            x[:] = 0
            for i, r in enumerate(part):
                x[i, rows[r][0]] = rows[r][1]
            vx = x @ model.v
            squares = x * x
            z = model.w0 + x @ model.w + 0.5 * ((vx * vx).sum(axis=1) - squares @ (model.v * model.v).sum(axis=1))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            d0, dw = err.sum(), x.T @ err + L2 * model.w
            dv = x.T @ (err[:, None] * vx) - model.v * (squares.T @ err)[:, None] + L2 * model.v
            g0, gw, gv = g0 + d0 * d0, gw + dw * dw, gv + dv * dv
            model.w0 -= RATE * d0 / np.sqrt(g0)
            model.w = model.w - RATE * dw / np.sqrt(gw)
            model.v = model.v - RATE * dv / np.sqrt(gv)
    return model


def held_out(id_col):
    """Whether crc32 of the id's text leaves 1 when divided by 3; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most ``max_rows`` labelled documents that are not held out.

    Of several labels of one id the mean decides (0.5 counts as 1); of several
    documents with one id the smallest text is taken. Null labels and ids are left out.
    Texts are measured where they are; what the driver fetches of a row is at most
    ``BUCKETS`` counts and the statistics, however long its text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored, found = batch.column("n_chars").to_pylist(), []
            for first, texts in text_slices(batch.column("text")):
                found += [measure(t, stored[first + i]) for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), *[pa.array([m[k] for m in found], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.int64(), pa.float64()))]],
                ["doc_id", "y", "ids", "counts", "statistics"])

    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("double").alias("y"))
             .filter("doc_id is not null and y is not null").groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")))
    known = known.filter(~held_out("doc_id"))
    present = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(known, "doc_id").distinct()
    sample = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "n_chars")
            .join(F.broadcast(sample), "doc_id")  # at most max_rows rows
            .groupBy("doc_id").agg(F.min(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("n_chars").cast("long").alias("n_chars"), "y")).alias("r")).select("doc_id", "r.*")
            .mapInArrow(run, "doc_id long, y int, ids array<int>, counts array<bigint>, statistics array<double>")).toArrow().sort_by("doc_id")
    measured = list(zip(*[[np.asarray(x.values) for x in rows[c]] for c in ("ids", "counts", "statistics")]))
    return fit(measured, rows["y"].to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (all by default) and the score, one row per input row.

    A null text is scored as the empty one. Only text and n_chars are read as inputs;
    a null n_chars counts as the text's own length.
    """
    keep = docs.columns if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights
    kept = docs.select(*keep)
    inputs = docs.select(F.struct("text", F.col("n_chars").cast("long").alias("n_chars")).alias("input"), F.struct(*keep).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, stored = batch.column(0).field(0), batch.column(0).field(1).to_pylist()
            out = np.empty(batch.num_rows)
            for first, texts in text_slices(text):
                for i, t in enumerate(texts):
                    out[first + i] = sent.value.score(t, stored[first + i])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out)], ["row", "score"])

    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("row", kept.schema), T.StructField("score", T.DoubleType())])
    return inputs.mapInArrow(run, schema).select("row.*", F.col("score").alias(name))
