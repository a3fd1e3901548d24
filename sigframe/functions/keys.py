"""Keys, file-name parts and equality flags (PRJ-6, PRJ-7, FN-5, FN-12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def composite_key(*cols, sep: str = "_") -> Column:
    """String key such as ``patient_timestep``. NULL parts are skipped, as in
    ``concat_ws``, so joins use the typed columns and this stays an output."""
    if all(isinstance(c, str) for c in cols):
        parts = ", ".join(f"CAST(`{c}` AS STRING)" for c in cols)
        return F.expr(f"concat_ws('{sep}', {parts})")
    return F.concat_ws(sep, *[_c(c).cast("string") for c in cols])


def file_name_of(path: Column | str) -> Column:
    """Last path component of a file path or URI."""
    return F.element_at(F.split(_c(path), "/"), -1)


def recording_id(name: Column | str, length: int = 8) -> Column:
    """Recording id: the first ``length`` characters of a file name."""
    return F.substring(_c(name), 1, length)


def eq_flag(a: Column | str, b: Column | str) -> Column:
    """1 when equal, else 0; NULL against a value counts as 0, NULL against NULL as 1."""
    return _c(a).eqNullSafe(_c(b)).cast("int")
