"""Packing of token sequences: first-fit decreasing by a tournament tree, in randomised groups.

A document's ids are followed by an end id and cut into pieces no longer than a sequence; only the last piece
is shorter. Pieces are dealt by a hash to groups of some ``GROUP_PIECES``; each group is packed on its own by
first-fit decreasing, so no group grows with the table and a lost task costs one group. Only lengths and
checksums are shuffled, never ids.

Defined cases: a null or empty text is one piece that holds the end id alone; equal lengths are packed by
(doc_id, start, checksum); rows with the same doc_id are packed each for itself; an empty table gives no row;
other columns of the table are not read; a text of any length is cut, never shortened.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm import tokens
from spendscope.llm.common import batch, settle, texts

SEQUENCE = 2048
END_ID = 1
#: Pieces of a group on average: large enough that its last, part-filled sequences hardly count.
GROUP_PIECES = 4000
#: Sequences of one group have ids below the next group's.
GROUP_SHIFT = 32

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PIECE = pa.schema([(x.split()[0], pa.int64()) for x in PIECE.split(", ")])


def cut_documents(docs: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its place in the document, its length and the checksum of its ids."""
    tail = int(end_id).to_bytes(4, "little")

    def cut(batches):
        encode = tokens.encoder().ids
        for b in batches:
            out = {f.name: [] for f in _PIECE}
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text) + tail
                n = len(ids) // 4
                for start in range(0, n, sequence):
                    piece = ids[4 * start : 4 * (start + sequence)]
                    row = (doc_id, start, len(piece) // 4, tokens.crc32(piece), n)
                    for name, value in zip(out, row):
                        out[name].append(value)
            yield batch(out, _PIECE)

    return texts(docs).mapInArrow(cut, PIECE)


class TournamentTree:
    """Capacities of bins as the leaves of a tree whose inner nodes hold the larger child."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> tuple[int, int]:
        """Put ``size`` in the first bin with room; returns the bin and the room it had."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        room = free[node]
        free[node] = room - size
        bin_no = node - self.leaves
        while node > 1:
            node //= 2
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
        return bin_no, room


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length; ``lengths`` come in decreasing order."""
    tree = TournamentTree(len(lengths), capacity)
    return [(b, capacity - room) for b, room in map(tree.first_fit, lengths)]


def pack(docs: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Rows of ``PIECE`` with sequence_id and offset; offsets of a sequence are gapless from 0."""
    pieces = settle(cut_documents(docs, sequence, end_id), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))

    def pack_group(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        places = first_fit_decreasing(frame["length"].tolist(), sequence)
        base = int(frame["grp"].iloc[0]) << GROUP_SHIFT
        return frame.drop(columns="grp").assign(sequence_id=[base + b for b, _ in places], offset=[o for _, o in places])

    return dealt.groupBy("grp").applyInPandas(pack_group, f"{PIECE}, sequence_id long, offset long")
