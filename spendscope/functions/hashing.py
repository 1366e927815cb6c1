"""Keyed hashes of prompt blocks.

A prefix hash covers all text up to a block. Spark's ``sha2`` would have to hash every prefix from its
start again (quadratic in the number of blocks), so this one helper runs in Python over Arrow batches and
keeps a running digest. It also keeps the salt out of the query plan.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The whole digest. A shorter one saves space, at the price of false cache hits once keys are many.
HASH_HEX_CHARS = 64
FINGERPRINT_TYPE = "prefix_hashes array<string>, prefix_chars array<bigint>, request_hash string"


def new_salt() -> bytes:
    """One random salt per run, shared by all files and never written."""
    return secrets.token_bytes(32)


def keyed_fingerprint(blocks: Column, body: Column, salt: bytes) -> Column:
    """(canonical blocks, canonical body without transport fields) -> fingerprint struct."""

    def digest(running) -> str:
        return running.hexdigest()[:HASH_HEX_CHARS]

    @F.pandas_udf(FINGERPRINT_TYPE)
    def fingerprints(block_lists: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        out = []
        for texts, text in zip(block_lists, bodies, strict=True):
            if texts is None or text is None:
                out.append((None, None, None))
                continue
            running, hashes, chars, length = hmac.new(salt, digestmod=hashlib.sha256), [], [], 0
            for block in texts:
                running.update(block.encode())
                length += len(block)
                hashes.append(digest(running.copy()))
                chars.append(length)
            out.append((hashes, chars, digest(hmac.new(salt, text.encode(), hashlib.sha256))))
        return pd.DataFrame(out, columns=["prefix_hashes", "prefix_chars", "request_hash"])

    return fingerprints(blocks, body)
