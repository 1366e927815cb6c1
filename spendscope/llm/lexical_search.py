"""Ranked lexical search by pipelined term partitioning: bundles of items travel through the owners of the terms.

1. One pass over the documents makes blocks of some 500 of them: places of the items' terms in the documents, with
   term frequencies, and the documents' lengths. Statistics (documents, terms, documents of a term) follow from them.
2. The terms are dealt to owners by the share of documents that hold them, rarest first (``OWNER_SHARES``). An owner's
   part of a block holds each posting's contribution, an integer, and for each item the most that a document of the block
   can still gain from later owners (sums of the block's largest contributions).
3. An item's bundle for a block holds its sparse accumulators: places of documents in the block and their sums so far.
   Bundles go from owner to owner; each stage is a cogroup of bundles and the owner's postings by block and adds
   contributions. After a stage, each item's 50th best sum is known from its blocks' best sums; whatever can't reach it any
   more, by sum and possible gain, leaves the bundle, and no new document enters if none could. Nothing that belongs to
   the result is lost by that, as sums only grow.
4. The last owner's sums are final. Each block gives its best 50 documents of an item; the best 50 of these remain.

A block bounds every group, so a term that all documents hold is spread over all blocks. Items are asked in parts of some
``PART_TERMS`` terms, which bounds what tasks and the driver hold; the documents are read once for each part.

Terms are known by 64-bit hashes. Defined cases: a null text has no terms; a document without doc_id counts in the
statistics and is never returned; rows with one doc_id are documents each for itself; items without item_id or without
terms ask nothing; rows with one item_id are one item with the terms of all; an empty table gives no row; texts of any
length are read whole; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendscope.llm.common import batch, settle, texts
from spendscope.llm.shingles import word_hashes

FIRST = 50
#: Largest share of documents of the terms of each owner but the last, which has the rest.
OWNER_SHARES = (0.01, 0.03, 0.1, 0.25)
#: Distinct terms of the items of one part, on average at most half of it.
PART_TERMS = 400_000
#: Bytes of text hashed at once.
TEXT_BLOCK = 1 << 19

#: A-Z to lower case; bytes that belong to no term become spaces.
_TERMS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

_ITEM = pa.schema([("item_id", pa.int64()), ("term", pa.int64())])
_BLOCK = pa.schema([("block", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), *[(x, pa.binary()) for x in ("ids", "named", "lengths", "terms", "places", "freqs")]])
BLOCK = "block long, n_docs long, n_terms long, ids binary, named binary, lengths binary, terms binary, places binary, freqs binary"
_PART = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("terms", pa.binary()), ("places", pa.binary()), ("gains", pa.binary()), ("later", pa.binary()), ("owner", pa.int32())])
PART = "block long, ids binary, terms binary, places binary, gains binary, later binary, owner int"
_BUNDLE = pa.schema([("item", pa.int32()), ("block", pa.int64()), ("places", pa.binary()), ("sums", pa.binary()), ("best", pa.list_(pa.int64()))])
BUNDLE = "item int, block long, places binary, sums binary, best array<long>"
_RANKED = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
RANKED = "item int, doc_id long, score long"
RESULT = "item_id long, rank int, doc_id long, score long"


def term_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(raw.translate(_TERMS))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def split(batches):
        for b in batches:
            ids, terms = [], []
            for item_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = np.unique(term_hashes(text.encode())[0])
                ids.append(np.full(len(found), item_id, np.int64))
                terms.append(found.view(np.int64))
            yield batch({"item_id": np.concatenate(ids), "term": np.concatenate(terms)} if ids else {"item_id": [], "term": []}, _ITEM)

    rows = texts(items, "item_id").filter("doc_id is not null and text is not null")
    return rows.mapInArrow(split, "item_id long, term long").distinct()


@dataclass
class Questions:
    """The items of one part: their ids, the distinct terms, and each item's terms as places in these."""

    items: np.ndarray
    terms: np.ndarray
    first: np.ndarray  # of an item in ``held``
    held: np.ndarray
    weights: np.ndarray | None = None
    owner: np.ndarray | None = None


def _questions(rows: pd.DataFrame) -> Questions:
    rows = rows.sort_values(["item_id", "term"])
    items, item = np.unique(rows["item_id"].to_numpy(), return_inverse=True)
    terms, held = np.unique(rows["term"].to_numpy().view(np.uint64), return_inverse=True)
    return Questions(items, terms, np.searchsorted(item, np.arange(len(items) + 1)), held.astype(np.int64))


def _spans(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """All places first[x] to first[x + 1] - 1, for each x of ``at``."""
    n = first[at + 1] - first[at]
    return np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())


# -- the blocks of documents -----------------------------------------------------------------------


def _postings(raws: list[bytes], wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """Number of terms of each text; term, text and frequency of the wanted ones, by term and text."""
    lengths, keys, counts = np.zeros(len(raws), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lo = 0
    while lo < len(raws):
        hi, size = lo, 0
        while hi < len(raws) and (hi == lo or size + len(raws[hi]) <= TEXT_BLOCK):
            size += len(raws[hi]) + 1
            hi += 1
        h, starts = term_hashes(b" ".join(raws[lo:hi]))
        first = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raws[lo:hi]]))
        lengths[lo:hi] = np.diff(first)
        if len(h) and len(wanted):
            doc = np.repeat(np.arange(lo, hi), np.diff(first))
            at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
            some = wanted[at] == h
            k, n = np.unique(at[some] * len(raws) + doc[some], return_counts=True)
            keys.append(k)
            counts.append(n)
        lo = hi
    key, freq = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, freq = key[order], freq[order]
    return lengths, key // max(1, len(raws)), key % max(1, len(raws)), freq


def _blocks(docs: DataFrame, sent) -> DataFrame:
    def make(batches):
        block = TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0)
            lengths, term, place, freq = _postings([(t or "").encode() for t in b.column(1).to_pylist()], sent.value.terms)
            row = {
                "block": block, "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()),
                "ids": ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
                "named": ids.is_valid().to_numpy(zero_copy_only=False).tobytes(),
                "lengths": lengths.astype("<i8").tobytes(), "terms": term.astype("<u4").tobytes(),
                "places": place.astype("<u2").tobytes(), "freqs": freq.astype("<u4").tobytes(),
            }
            yield batch({k: [v] for k, v in row.items()}, _BLOCK)
            block += 1

    return settle(texts(docs).mapInArrow(make, BLOCK), "search-blocks")


def _document_counts(blocks: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each of the part's terms."""
    pair = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def count(batches):
        df = np.zeros(n_terms, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                df += np.bincount(np.frombuffer(raw, "<u4"), minlength=n_terms)
        term = np.flatnonzero(df)
        yield batch({"term": term, "df": df[term]}, pair)

    rows = blocks.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # at most n_terms
    df = np.zeros(n_terms, np.int64)
    df[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return df


def _owners(df: np.ndarray, n_docs: int, shares: tuple[float, ...]) -> np.ndarray:
    return np.searchsorted(np.array(shares) * n_docs, df).astype(np.int64)


def _weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def _parts(blocks: DataFrame, sent, n_docs: int, n_terms: int, owners: int) -> DataFrame:
    """Each owner's part of each block; written by owner."""

    def cut(batches):
        q: Questions = sent.value
        for b in batches:
            for block, ids, named, lengths, terms, places, freqs in zip(*(b.column(i).to_pylist() for i in range(7))):
                named, n = np.frombuffer(named, bool), np.frombuffer(lengths, "<i8")
                term, place, freq = np.frombuffer(terms, "<u4").astype(np.int64), np.frombuffer(places, "<u2"), np.frombuffer(freqs, "<u4").astype(np.int64)
                keep = named[place] & (q.weights[term] > 0)
                term, place, freq = term[keep], place[keep], freq[keep]
                m = 100 - 50 + (50 * n * n_docs) // n_terms
                gain = q.weights[term] * ((1_000_000_000 * freq) // (1000 * freq + 20 * m[place]))
                most = np.zeros(len(q.terms), np.int64)
                np.maximum.at(most, term, gain)
                for owner in range(owners):
                    own = q.owner[term] == owner
                    after = np.concatenate([[0], np.cumsum(np.where(q.owner > owner, most, 0)[q.held])])
                    later = after[q.first[1:]] - after[q.first[:-1]]
                    row = {
                        "block": block, "ids": ids, "terms": term[own].astype("<u4").tobytes(), "places": place[own].astype("<u2").tobytes(),
                        "gains": gain[own].tobytes(), "later": later.tobytes(), "owner": owner,
                    }
                    yield batch({k: [v] for k, v in row.items()}, _PART)

    rows = blocks.select("block", "ids", "named", "lengths", "terms", "places", "freqs").mapInArrow(cut, PART)
    return settle(rows, "search-postings", "owner")


# -- the stages ------------------------------------------------------------------------------------


def _stage(sent, floors: np.ndarray, last: bool, first: int):
    """What one owner does for the bundles of one block."""

    def add(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        q: Questions = sent.value
        held = {i: (p, s) for i, p, s in zip(*(bundles[x].to_pylist() for x in ("item", "places", "sums")))}
        out = {f.name: [] for f in (_RANKED if last else _BUNDLE)}
        for block, ids, terms, places, gains, later in zip(*(postings[x].to_pylist() for x in ("block", "ids", "terms", "places", "gains", "later"))):
            ids, later, place, gain = np.frombuffer(ids, "<i8"), np.frombuffer(later, "<i8"), np.frombuffer(places, "<u2"), np.frombuffer(gains, "<i8")
            term, begin = np.unique(np.frombuffer(terms, "<u4"), return_index=True)
            begin = np.append(begin, len(place))
            at = np.full(len(q.terms), -1)
            at[term] = np.arange(len(term))
            item_of = np.repeat(np.arange(len(q.items)), np.diff(q.first))
            here = at[q.held] >= 0  # the items' terms that the owner has in this block
            asked, own = item_of[here], at[q.held][here]
            bounds = np.searchsorted(asked, np.arange(len(q.items) + 1))
            for item in sorted({*np.unique(asked).tolist(), *held}):
                sums, old = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
                if item in held:
                    p = np.frombuffer(held[item][0], "<u2")
                    sums[p], old[p] = np.frombuffer(held[item][1], "<i8"), True
                mine = own[bounds[item] : bounds[item + 1]]
                span = _spans(begin, mine)
                # exact 64-bit sums: one term's places differ, so terms are added one after another
                for t in mine.tolist():
                    sums[place[begin[t] : begin[t + 1]]] += gain[begin[t] : begin[t + 1]]
                here_ = old.copy()
                here_[place[span]] = True
                some = np.flatnonzero(here_ & (sums + later[item] >= max(floors[item], 1)))
                if not len(some):
                    continue
                value = sums[some]
                if last:
                    order = np.lexsort((ids[some], -value))[:first]
                    out["item"] += [item] * len(order)
                    out["doc_id"] += ids[some[order]].tolist()
                    out["score"] += value[order].tolist()
                else:
                    top = np.sort(value[value > floors[item]])[::-1][:first]
                    for name, x in zip(out, (item, block, some.astype("<u2").tobytes(), value.tobytes(), top.tolist())):
                        out[name].append(x)
        return pa.table(out, schema=_RANKED if last else _BUNDLE)

    return add


def _floors(bundles: DataFrame, old: np.ndarray, first: int, n_blocks: int) -> np.ndarray:
    """Each item's 50th best sum so far, or what was known before; found in two steps, so that no group grows with the number of blocks
    but by its square root."""
    top = F.slice(F.sort_array(F.flatten(F.collect_list("best")), False), 1, first).alias("best")
    some = bundles.filter(F.size("best") > 0).withColumn("share", F.pmod(F.xxhash64("block"), F.lit(max(1, math.isqrt(n_blocks)))))
    rows = some.groupBy("item", "share").agg(top).groupBy("item").agg(top).filter(F.size("best") == first)
    found = rows.select("item", F.element_at("best", first).alias("floor")).toPandas()  # a number for each item of the part
    floors = old.copy()
    floors[found["item"].to_numpy()] = found["floor"].to_numpy()
    return floors


def _search_part(docs: DataFrame, questions: Questions, first: int, shares: tuple[float, ...]) -> DataFrame:
    spark = docs.sparkSession
    blocks = _blocks(docs, spark.sparkContext.broadcast(questions))
    n_docs, n_terms, n_blocks = blocks.agg(F.sum("n_docs"), F.sum("n_terms"), F.count("*")).first()
    if not n_terms:
        return spark.createDataFrame([], RESULT)
    df = _document_counts(blocks, len(questions.terms))
    questions.weights, questions.owner = _weights(df, n_docs), _owners(df, n_docs, shares)
    sent, owners = spark.sparkContext.broadcast(questions), len(shares) + 1
    parts = _parts(blocks, sent, n_docs, n_terms, owners)
    floors, bundles = np.zeros(len(questions.items), np.int64), spark.createDataFrame([], BUNDLE)
    for owner in range(owners):
        last = owner == owners - 1
        postings = parts.filter(F.col("owner") == owner).drop("owner")
        met = bundles.drop("best").groupBy("block").cogroup(postings.groupBy("block"))
        if last:
            return _ranked(met.applyInArrow(_stage(sent, floors, last, first), RANKED), questions, first, n_blocks)
        bundles = settle(met.applyInArrow(_stage(sent, floors, last, first), BUNDLE), "search-bundles")
        floors = _floors(bundles, floors, first, n_blocks)


def _ranked(rows: DataFrame, questions: Questions, first: int, n_blocks: int) -> DataFrame:
    spark = rows.sparkSession
    order = (F.desc("score"), "doc_id")
    shares = max(1, math.isqrt(n_blocks))
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(shares)))
    some = dealt.withColumn("r", F.row_number().over(Window.partitionBy("item", "share").orderBy(*order))).filter(F.col("r") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= first)
    ids = spark.createDataFrame(pd.DataFrame({"item": np.arange(len(questions.items)), "item_id": questions.items}), "item int, item_id long")
    return ranked.join(ids, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, first: int = FIRST, shares: tuple[float, ...] = OWNER_SHARES, part_terms: int = PART_TERMS) -> DataFrame:
    """Each item's ``first`` documents of highest score: item_id, rank, doc_id, score."""
    asked = settle(item_terms(items), "item-terms")
    parts, out = max(1, -(-2 * asked.count() // part_terms)), None
    for k in range(parts):
        rows = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).toPandas()  # some part_terms / 2 rows
        if len(rows):
            found = _search_part(docs, _questions(rows), first, shares)
            out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out
