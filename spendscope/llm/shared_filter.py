"""A bit filter of bounded size of the keys that more than one document has.

Keys travel packed, by bucket, three bytes each: a bucket's keys are told apart by 24 bits, which suffices for a filter.
Every bucket fills its own part of the filter, so the whole is gathered without a merge. A part has ``KEY_BITS`` for each key,
until all parts together reach ``MOST_BITS``, which is what the driver and the tasks get at most, at any size of the input. The
filter never misses a key; it lets some others pass, more of them the fuller it is, so an exact step follows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spendscope.llm.common import batch, brief_shuffles
from spendscope.llm.shingles import mixed

#: Bits of a key; 64 MB.
KEY_BITS, MOST_BITS = 16, 1 << 29

_PACK = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())])
PACK = "bucket int, keys binary, many binary"
_BITS = pa.schema([("bucket", pa.int32()), ("bits", pa.binary())])


class SharedFilter:
    """Bits of the keys that occur in more than one document, a part of the filter for each bucket of keys."""

    def __init__(self, buckets: int, parts: dict[int, bytes]):
        self.buckets = buckets
        ordered = [parts.get(k) or b"\0" for k in range(buckets)]
        self.bits = np.array([8 * len(p) for p in ordered], np.uint64)
        self.first = np.cumsum(self.bits) - self.bits
        self.data = np.frombuffer(b"".join(ordered), np.uint8)

    @staticmethod
    def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
        return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)

    @staticmethod
    def places(keys: np.ndarray, bits):
        h = mixed((keys & np.uint64(0xFFFFFF)) + np.uint64(1))
        yield (h & np.uint64(0xFFFFFFFF)) % bits
        yield (h >> np.uint64(32)) % bits

    @classmethod
    def part(cls, keys: np.ndarray, buckets: int) -> bytes:
        data = np.zeros(max(8, min(KEY_BITS * len(keys), MOST_BITS // buckets) // 8 * 8), np.uint8)
        for at in cls.places(keys, np.uint64(len(data))):
            data[at] = 1
        return np.packbits(data, bitorder="little").tobytes()

    def holds(self, keys: np.ndarray) -> np.ndarray:
        bucket, out = self.bucket_of(keys, self.buckets), np.ones(len(keys), bool)
        first, bits = self.first[bucket], self.bits[bucket]
        for at in self.places(keys, bits):
            at = at + first
            out &= (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
        return out


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 3)
    wide = np.zeros((len(raw), 4), np.uint8)
    wide[:, :3] = raw
    return wide.view("<u4").ravel().astype(np.uint64)


def by_bucket(k: np.ndarray, many: np.ndarray, buckets: int):
    """Rows of distinct keys by bucket, those that more than one document has apart."""
    bucket = SharedFilter.bucket_of(k, buckets)
    order = np.argsort(bucket, kind="stable")
    k, many, bucket = k[order] & np.uint64(0xFFFFFF), many[order], bucket[order]
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(k) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(k))
    parts = [(k[i:j], many[i:j]) for i, j in zip(cuts, ends)]
    return batch({"bucket": bucket[cuts], "keys": [_packed(x[~m]) for x, m in parts], "many": [_packed(x[m]) for x, m in parts]}, _PACK)


def filter_of(packed: DataFrame, buckets: int) -> SharedFilter:
    """Filter of the keys that are marked or come from more than one batch."""

    def part(bucket: int, keys: list[bytes], many: list[bytes]) -> pa.RecordBatch:
        k = np.sort(_unpacked(keys))
        shared = np.unique(np.concatenate([k[1:][k[1:] == k[:-1]], _unpacked(many)]))
        return batch({"bucket": [bucket], "bits": [SharedFilter.part(shared, buckets)]}, _BITS)

    def gather(batches):
        now, keys, many = None, [], []
        for b in batches:
            for bucket, k, m in zip(*(b.column(i).to_pylist() for i in range(3))):
                if bucket != now and keys:
                    yield part(now, keys, many)
                    keys, many = [], []
                now = bucket
                keys.append(k)
                many.append(m)
        if keys:
            yield part(now, keys, many)

    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    with brief_shuffles(packed.sparkSession):
        parts = dealt.mapInArrow(gather, "bucket int, bits binary").toPandas()  # MOST_BITS in all
    return SharedFilter(buckets, dict(zip(parts["bucket"].tolist(), parts["bits"].tolist())))
