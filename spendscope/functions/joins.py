"""Join helpers that keep broadcasts behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROW_LIMIT = 100_000


def checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Hint a broadcast only once the side has been counted and found small.

    Beyond ``max_rows`` the frame is returned without a hint: Spark then shuffles both sides and adaptive
    execution splits the partitions of a hot key. The frame must be narrow (a key and a few numbers), and cheap to
    compute twice: a written table or a small aggregate. Nothing stays cached.
    """
    return F.broadcast(small) if small.limit(max_rows + 1).count() <= max_rows else small
