"""Stage name -> class id lookups (FN-1, FN-2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sigframe.schemas import STAGE_MAP

UNKNOWN = -1


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def stage_map_sql(mapping: dict | None = None) -> str:
    """The stage map as a SQL map literal."""
    mapping = STAGE_MAP if mapping is None else mapping
    return "map(" + ", ".join(f"{_sql_str(k)}, {int(v)}" for k, v in mapping.items()) + ")"


def stage_map_column(mapping: dict | None = None) -> Column:
    """A literal map column; Catalyst folds it into the generated code."""
    return F.expr(stage_map_sql(mapping))


def stage_label(condition: Column | str, unknown: str = "keep", mapping: dict | None = None) -> Column:
    """Class id of a stage name.

    unknown='keep'  -> -1 for names outside the map and for NULL (FN-1)
    unknown='error' -> the task fails on the first unknown name (FN-2)
    unknown='null'  -> NULL, for callers that filter with ``isNotNull``
    """
    cond = F.col(condition) if isinstance(condition, str) else condition
    looked_up = stage_map_column(mapping)[cond]
    if unknown == "keep":
        return F.coalesce(looked_up, F.lit(UNKNOWN)).cast("int")
    if unknown == "error":
        msg = F.concat(F.lit("unknown sleep stage: "), F.coalesce(cond, F.lit("NULL")))
        return F.coalesce(looked_up, F.raise_error(msg)).cast("int")
    if unknown == "null":
        return looked_up.cast("int")
    raise ValueError(f"unknown mode {unknown!r}")
