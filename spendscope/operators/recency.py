"""Was a key used shortly before or after a row? Answered in bounded tasks.

A prompt prefix or a request hash can be shared by a large part of a log, so a ``lag`` over the key would
sort all of those rows in one task. Time is cut into slices no longer than the window asked about. Then
every row of a (key, slice) but its first has an earlier use inside the window, and only the first row has
to look at the nearest earlier slice (likewise forwards). One partial aggregation per (key, slice) carries
all that is needed; the rows themselves are never sorted. The one window left runs over slices, whose
number per key depends on the covered time and not on the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Room for any 63-bit sequence number below the time.
_SEQ_RANGE = "1" + "0" * 19


def moment(at: str = "at_us", seq: str = "seq") -> Column:
    """(time, seq) packed into one number: a total order that hash aggregation can hold in its buffer."""
    return F.col(at).cast("decimal(18,0)") * F.lit(_SEQ_RANGE).cast("decimal(20,0)") + F.col(seq).cast("decimal(19,0)")


def slice_of(at: str, seconds: int) -> Column:
    return F.floor(F.col(at) / F.lit(seconds * 1_000_000)).cast("bigint")


def slice_edges(rows: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    """One row per (keys, slice): its first and last moment, their times, and the times right outside of it.

    ``rows`` carries ``slice``, ``at_us`` and ``moment``; ``extra`` are further aggregates of the group. Times are kept
    beside the moments: to divide them out of so long a number again would cost more than the rest of a row.
    """
    groups = rows.groupBy(*keys, "slice").agg(
        F.min("moment").alias("first_moment"),
        F.max("moment").alias("last_moment"),
        F.min("at_us").alias("first_us"),
        F.max("at_us").alias("last_us"),
        *extra,
    )
    across = Window.partitionBy(*keys).orderBy("slice")
    return groups.withColumns(
        {
            "prev_us": F.lag("last_us").over(across),
            "next_us": F.lead("first_us").over(across),
        }
    )
