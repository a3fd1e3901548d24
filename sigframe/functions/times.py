"""Time helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_US = 86_400_000_000


def ntz_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 00:00 of a TIMESTAMP_NTZ wall-clock value.

    Built from the date and the clock fields, so no cast to a zoned timestamp
    happens: the result is the same in every session time zone and keeps the
    order of the values (a zoned cast would not across a daylight-saving change).
    """
    c = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    secs = F.date_part(F.lit("SECOND"), c)  # seconds with microsecond fraction
    return (days * _DAY_US + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000
            + (secs * 1_000_000).cast("long"))
