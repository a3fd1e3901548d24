"""Array and vector expressions (FN-7..FN-11, FN-13, SIG-5, SIG-6).

All are higher-order functions evaluated in the JVM; none ships rows to Python.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def argmax(scores: Column | str) -> Column:
    """0-based index of the largest score; the first maximum wins and NaN counts
    as the largest value (numpy's rule). NULL for an empty or NULL array."""
    a = _c(scores)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def one_hot(label: Column | str, n_classes: int) -> Column:
    """``array<double>`` of length ``n_classes`` with 1.0 at ``label``; NULL for a label
    that is NULL or no class."""
    lab = _c(label)
    return F.when(lab.between(0, n_classes - 1), F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                       lambda i: F.when(i == lab, F.lit(1.0)).otherwise(F.lit(0.0))))


def flatten_channels(*channel_arrays) -> Column:
    """Channel-major flat array: all of channel 1, then channel 2, ..."""
    return F.concat(*[_c(a) for a in channel_arrays])


def channel_major_to_time_major(flat: Column | str, n_channels: int) -> Column:
    """(channels, n) flattened -> array of n rows of ``n_channels`` values."""
    a = _c(flat)
    n = (F.size(a) / n_channels).cast("int")
    # sequence(0, -1) would count down: an empty array has no rows
    steps = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)
    return F.transform(
        steps,
        lambda i: F.transform(F.sequence(F.lit(0), F.lit(n_channels - 1)),
                              lambda j: F.element_at(a, j * n + i + 1)))


def time_major_to_channel_major(rows: Column | str, n_channels: int) -> Column:
    """Array of n rows of channel values -> channel-major flat array."""
    m = _c(rows)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n_channels - 1)),
                                 lambda j: F.transform(m, lambda r: F.element_at(r, j + 1))))


def vector_element(vec: Column | str, index: int, dtype: str = "float32") -> Column:
    """One element of an ML vector as a number column."""
    return vector_to_array(_c(vec), dtype)[index]


def relu(x: Column | str) -> Column:
    """max(x, 0) for a number column; NULL stays NULL."""
    v = _c(x)
    # greatest() skips NULLs, so keep them explicitly.
    return F.when(v.isNull(), F.lit(None)).otherwise(F.greatest(v.cast("double"), F.lit(0.0)))


def relu_array(a: Column | str) -> Column:
    """max(x, 0) element-wise; NULL elements stay NULL (greatest() would skip them)."""
    return F.transform(_c(a), lambda x: F.when(x.isNotNull(), F.greatest(x, F.lit(0.0).cast("float"))))


def softmax(scores: Column | str) -> Column:
    """exp(x - max) / sum(exp(x - max)), element-wise over an array."""
    a = _c(scores)
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)
