"""Output conventions shared by the registered queries.

Results leave as portable types so two engines can be compared exactly:
dates and timestamps as ISO text, counts as bigint, computed doubles
rounded to 6 places (last-bit differences of float sums stay invisible).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SQL_TS_TEXT = "%Y-%m-%d %H:%M:%S.%f"


def iso_date(c) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def ts_text(c) -> Column:
    return F.date_format(c, TS_TEXT)


def r6(c) -> Column:
    return F.round(c, 6)


def big(c) -> Column:
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")
