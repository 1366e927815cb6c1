"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors whose cosine is at least c differ by at most 2 - 2c in squared distance. After one fixed rotation,
which spreads that distance evenly, coordinates are split into low-dimensional blocks; each block gets its
proportional part of the squared distance as budget. A similar pair keeps within the budget in at least one block, so
a range join in each block finds every such pair. The range join deals vectors to grid cells over the first
coordinates of the block, as wide as the range; a vector visits half of its cell's neighbours, and all of a
cell's pairs are tested by one matrix product. A pair counts in the first block that finds it, and only there, so the union
needs no exchange of pairs. Each found pair is verified by its cosine in double precision.

Vectors with the same components are one node with a multiplicity. A cell with more than ``CHUNK`` rows or
``CHUNK_BYTES`` of vectors is split into chunks, and tasks compare two chunks each. Each tile's pairs are folded at once
into counts by vector and a running union of labels, which is all that leaves a task, so a group of near copies is
never held or written out as pairs.

Defined cases: null vectors, zero vectors and those with null or non-finite components link with nothing and are
kept; vectors of different length never link; rows with the same vec_id count as vectors of their own; an empty
table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm.common import batch, settle
from spendscope.llm.components import components

COSINE = 0.95
#: Coordinates of a block; coordinates of it that the grid uses.
BLOCK_DIMS, GRID_DIMS = 8, 2
#: Rows of one side of a task, and bytes of its vectors, some seven times as many when rotated and scaled. Fewer rows
#: mean more copies of each vector.
CHUNK, CHUNK_BYTES = 1 << 15, 1 << 24
#: Pairs tested at once; components of them when they are compared whole.
TILE, WHOLE = 1 << 21, 1 << 22
#: Added to squared distances: far above rounding, far below anything that matters.
SLACK = 1e-9

_VECTOR = pa.schema([("vec_id", pa.int64()), ("vec_key", pa.binary()), ("vec", pa.binary())])
_VISIT = pa.schema([("node", pa.int64()), ("copies", pa.int64()), ("block", pa.int32()), ("cell", pa.string()), ("home", pa.bool_()), ("vec", pa.binary())])
_FOUND = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


@lru_cache(maxsize=4)
def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int) -> np.ndarray:
    """First coordinate of each block."""
    n = max(1, dims // BLOCK_DIMS)
    return np.array([i * dims // n for i in range(n)])


def budgets(dims: int, cosine: float) -> np.ndarray:
    starts = blocks(dims)
    return (2 - 2 * cosine + SLACK) * np.diff(np.append(starts, dims)) / dims


def rotated(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(raw.shape[1])


def _usable(v) -> bool:
    return v is not None and len(v) > 0 and None not in v


def vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, and the components and their key where the vector can link."""
    double = "double" in table.schema[vec_col].dataType.simpleString()
    kind, rows = ("<f8" if double else "<f4"), table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))

    def read(batches):
        for b in batches:
            keys, raw = [], []
            for v in b.column(1).to_pylist():
                a = np.array(v, kind) if _usable(v) else None
                ok = a is not None and np.isfinite(a).all() and a.any()
                raw.append((a + 0.0).astype(kind).tobytes() if ok else None)  # -0.0 is 0.0
                keys.append(hashlib.md5(raw[-1]).digest() if ok else None)
            yield batch({"vec_id": b.column(0), "vec_key": keys, "vec": raw}, _VECTOR)

    return settle(rows.mapInArrow(read, "vec_id long, vec_key binary, vec binary"), f"vectors-{kind[1:]}"), kind


def _visits(nodes: DataFrame, kind: str, cosine: float) -> DataFrame:
    """Per node and block: its cell, and the neighbour cells that come after it in lexical order."""
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * GRID_DIMS, indexing="ij"), -1).reshape(-1, GRID_DIMS)
    steps = steps[len(steps) // 2 :]  # (0, 0) first, then the later half

    def visit(batches):
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in _VISIT}
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
            for size in sorted({len(r[2]) for r in rows}):
                own = [r for r in rows if len(r[2]) == size]
                x = rotated(np.frombuffer(b"".join(r[2] for r in own), kind).reshape(len(own), -1))
                dims = x.shape[1]
                for k, (start, budget) in enumerate(zip(blocks(dims), budgets(dims, cosine))):
                    cell = np.floor(x[:, start : start + GRID_DIMS] / np.sqrt(budget)).astype(int)
                    for step in steps[: 1 if dims == 1 else None]:
                        home = not step.any()
                        for (node, copies, raw), c in zip(own, (cell + step[: cell.shape[1]]).tolist()):
                            row = (node, copies, k, f"{dims}:" + ",".join(map(str, c)), home, raw)
                            for name, value in zip(out, row):
                                out[name].append(value)
                    if dims == 1:  # one coordinate: only the next cell is left
                        for (node, copies, raw), c in zip(own, (cell + 1).tolist()):
                            for name, value in zip(out, (node, copies, k, f"{dims}:{c[0]}", False, raw)):
                                out[name].append(value)
            yield batch(out, _VISIT)

    return nodes.mapInArrow(visit, "node long, copies long, block int, cell string, home boolean, vec binary")


class _Side:
    def __init__(self, rows: pa.Table, kind: str):
        self.nodes = rows["node"].to_numpy()
        self.copies = rows["copies"].to_numpy()
        raw = np.frombuffer(b"".join(rows["vec"].to_pylist()), kind)
        self.raw = raw.reshape(len(self.nodes), -1) if len(self.nodes) else raw.reshape(0, 1)
        if len(self.nodes):
            self.x = rotated(self.raw)
            y = self.raw.astype(np.float64)
            y = y / np.abs(y).max(axis=1, keepdims=True)
            self.y, self.norms = y, np.einsum("ij,ij->i", y, y)


def similar(one: _Side, other: _Side, block: int, cosine: float, same: bool):
    """Index pairs of similar vectors that this block is the first to find; ``same``: both sides are one."""
    if not len(one.nodes) or not len(other.nodes):
        return
    dims = one.raw.shape[1]
    starts, budget = blocks(dims), budgets(dims, cosine)
    stop = np.append(starts, dims)[block + 1]
    a, b = (s.x[:, starts[block] : stop].astype(np.float32) for s in (one, other))
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    limit = np.float32(budget[block] + 1e-5)
    step = max(1, TILE // len(b))
    for lo in range(0, len(a), step):
        near = aa[lo : lo + step, None] + bb[None, :] - 2 * (a[lo : lo + step] @ b.T) <= limit
        i, j = np.nonzero(near)
        i = i + lo
        if same:
            i, j = i[i < j], j[i < j]
        n = max(1, WHOLE // dims)
        for at in range(0, len(i), n):
            p, q = i[at : at + n], j[at : at + n]
            within = np.add.reduceat((one.x[p] - other.x[q]) ** 2, starts, axis=1) <= budget
            mine = within[:, block] & ~within[:, :block].any(axis=1)
            p, q = p[mine], q[mine]
            cos = np.einsum("ij,ij->i", one.y[p], other.y[q]) / np.sqrt(one.norms[p] * other.norms[q])
            yield p[cos >= cosine], q[cos >= cosine]


def _forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Smallest index of each one's component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[p], label[q])
        np.minimum.at(label, p, low)
        np.minimum.at(label, q, low)
        label = label[label]
        if (label == before).all():
            return label


class _Links:
    """Counts and smallest index of the component of each vector, brought up to date by some pairs at a time."""

    def __init__(self, copies: np.ndarray):
        self.copies = copies
        self.count = np.zeros(len(copies), np.int64)
        self.label = np.arange(len(copies))

    def add(self, p: np.ndarray, q: np.ndarray) -> None:
        np.add.at(self.count, p, self.copies[q])
        np.add.at(self.count, q, self.copies[p])
        a, b = self.label[p], self.label[q]
        new = a != b
        if new.any():
            ends, at = np.unique(np.concatenate([a[new], b[new]]), return_inverse=True)
            least = np.arange(len(self.label))
            least[ends] = ends[_forest(len(ends), *np.split(at, 2))]
            self.label = least[self.label]


def links(one: _Side, other: _Side, block: int, cosine: float, same: bool) -> _Links:
    """Links between the sides, ``same``: also within ``one``; vectors of ``other`` are numbered after those of ``one``."""
    n = len(one.nodes)
    out = _Links(np.concatenate([one.copies, other.copies]))
    for p, q in similar(one, other, block, cosine, False):
        out.add(p, q + n)
    if same:
        for p, q in similar(one, one, block, cosine, True):
            out.add(p, q)
    return out


def chunks(kind: str):
    """Number of chunks of a cell by its ``size`` and the dimensions that its name begins with."""
    width = F.substring_index("cell", ":", 1).cast("long") * np.dtype(kind).itemsize
    return F.ceil(F.greatest(F.col("size") / CHUNK, F.col("size") * width / CHUNK_BYTES)).cast("int")


def near_duplicates(table: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows, kind = vectors(table, id_col, vec_col)
    groups = rows.filter("vec_key is not null").groupBy("vec_key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    nodes = settle(groups.filter("node is not null"), "nodes")
    visits = settle(_visits(nodes.select("node", "copies", "vec"), kind, cosine), "visits")

    crowds = visits.groupBy("block", "cell").agg(F.count("*").alias("size"), F.count(F.when(F.col("home"), 1)).alias("homes"))
    crowds = crowds.filter("homes > 0 and size > 1").select("block", "cell", chunks(kind).alias("chunks"))
    dealt = visits.join(settle(crowds, "crowds"), ["block", "cell"]).withColumn("own", F.pmod(F.xxhash64("node", "home"), "chunks").cast("int"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    left = dealt.filter("home").withColumn("j", F.explode(every)).withColumn("i", F.col("own")).withColumn("side", F.lit(0))
    right = dealt.filter("not home or own > 0").withColumn("i", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("own") - 1)).otherwise(every)))
    right = right.withColumn("j", F.col("own")).withColumn("side", F.lit(1))
    columns = ["block", "cell", "i", "j", "side", "node", "copies", "vec"]
    tasks = left.select(columns).union(right.select(columns))

    def join(group: pa.Table) -> pa.Table:
        block, i, j = (group[x][0].as_py() for x in ("block", "i", "j"))
        side = group["side"].to_numpy()
        sides = [_Side(group.filter(pa.array(side == s)), kind) for s in (0, 1)]
        nodes_ = np.concatenate([x.nodes for x in sides])
        out = links(*sides, block, cosine, i == j)
        hit = np.flatnonzero(out.count)
        return pa.table({"node": nodes_[hit], "n": out.count[hit], "root": nodes_[out.label[hit]]}, schema=_FOUND)

    found = tasks.groupBy("block", "cell", "i", "j").applyInArrow(join, "node long, n long, root long")
    found = settle(found, "found")
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a <> b"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    known = nodes.select("vec_key", "node", "copies").join(counts, "node", "left").join(linked, "node", "left")
    known = settle(known.select("vec_key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("component")), "known")
    out = rows.select("vec_id", "vec_key").join(known, "vec_key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
