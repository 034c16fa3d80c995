"""Opening hours of tables: every distinct text is read once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hours import parse_opening_hours
from ..storage import stored


def with_hours(rows: DataFrame, body: Callable[[Column], Column] = lambda hours: hours, name: str = "h", raw: str = "opening_hours_raw", zone: str = "timezone") -> DataFrame:
    """``rows`` with ``name``, what ``body`` makes of the hours of their text and zone; ``body`` may only depend on these.

    Texts repeat from row to row, so each distinct (text, zone) is read once,
    and the rows are joined with what was read. Rows of null texts get what
    ``body`` makes of null hours.
    """
    texts = rows.select(F.col(raw).alias("_raw"), F.col(zone).alias("_zone")).distinct()
    read = stored(stored(texts).repartition("_raw", "_zone").select("_raw", "_zone", parse_opening_hours(F.col("_raw"), F.col("_zone")).alias("_hours")))
    made = stored(read.select("_raw", "_zone", body(F.col("_hours")).alias(name)))
    return rows.join(made, F.col(raw).eqNullSafe(F.col("_raw")) & F.col(zone).eqNullSafe(F.col("_zone")), "left").drop("_raw", "_zone")
