"""Rows chosen by a list of ids, without moving the rows.

A join by id shuffles whole texts once the list is too long for a broadcast. Here the ids alone travel, sorted, eight bytes
each, ``MOST_IDS`` at a time. A longer list is dealt by hash, and each row is looked up in the part of its own id, with a
pass over the rows for each part: the bound decides how many passes there are, never what they find.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendscope.llm.common import brief_shuffles

#: Ids that a task holds at once; 64 MB.
MOST_IDS = 1 << 23


def _among(ids: DataFrame):
    """Test of a column of ids against those of a table, as a function of columns; a null is not among them."""
    with brief_shuffles(ids.sparkSession):
        held = ids.filter("doc_id is not null").toArrow()["doc_id"].to_numpy()
    sorted_ids = ids.sparkSession.sparkContext.broadcast(np.unique(held))

    @F.arrow_udf("boolean")
    def among(doc_id: pa.Array) -> pa.Array:
        known, own = sorted_ids.value, doc_id.fill_null(0).to_numpy()
        found = np.zeros(len(own), bool)
        if len(known):
            found = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
        return pa.array(found & doc_id.is_valid().to_numpy(zero_copy_only=False))

    return among


def chosen(rows: DataFrame, ids: DataFrame, inside: bool) -> DataFrame:
    """The rows whose doc_id is in ``ids`` (a written table), or the others, those with a null doc_id among them."""
    ids = ids.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.count()
    if not n:
        return rows.filter(F.lit(False)) if inside else rows
    parts, key = -(-n // MOST_IDS), F.col("doc_id").cast("long")

    def part_of(k: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(parts)) == k  # a null has a hash too

    found = None
    for k in range(parts):
        among = _among(ids.filter(part_of(k)) if parts > 1 else ids)(key)
        some = (rows.filter(part_of(k)) if parts > 1 else rows).filter(among if inside else ~among)
        found = some if found is None else found.union(some)
    return found
