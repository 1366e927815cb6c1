"""Secrets in whole texts: fixed rules, and Markov models of random strings and ordinary identifiers.

Rules find assignments, access keys and hex strings. Their values, and the other identifier-like strings of the same
texts, are the labelled samples of two first-order character models. A further string of at least ``SHORTEST``
identifier characters is a secret if it is likelier as a random string: if the log-likelihood ratio of the two
models reaches ``LEAST_RATIO`` in all and ``LEAST_MEAN`` for each character. Spans of the rules always stay;
the models only add spans (kind ``random``) that touch none of them.

The models are fitted on a bounded sample, about ``SAMPLE_ROWS`` whole texts chosen by a hash of doc_id; only bigram
counts leave a task, so what reaches the driver has a fixed size.

Defined cases: a null text is empty and has no span; repeated rows are scanned alike; without samples of secrets
nothing is added; other columns are not read. Places are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm.common import batch, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "random"]
#: An assignment holds one of these, in lower case.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
LEAST_VALUE, LEAST_ACCESS = 8, 16

#: Strings that the models judge. Longer than most words; keys of 128 random bits have 20 to 32 characters.
SHORTEST = 16
STRING = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
LEAST_RATIO, LEAST_MEAN = 16.0, 0.7
SAMPLE_ROWS = 20_000
#: Weight of the symbols' own frequencies, in observations.
BACKOFF = 8.0
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
_CODE = np.full(128, 0, np.uint8)
_CODE[[ord(c) for c in SYMBOLS]] = np.arange(1, len(SYMBOLS) + 1)  # 0 is the start of a string
N = len(SYMBOLS) + 1

_SAMPLE = pa.schema([("label", pa.int32()), ("pair", pa.int32()), ("n", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:3]], ("base_sha256", pa.string()), ("spans", pa.string())])
FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
Span = tuple[int, int, int]  # start, kind, end


def rule_spans(text: str) -> tuple[list[Span], list[str], list[re.Match]]:
    """Spans by rule, their values, and all strings long enough to be judged."""
    spans: list[Span] = []
    values: list[str] = []
    low = text.lower()
    if any(x in low for x in ASSIGN_HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_VALUE:
                spans.append((m.start(), 0, m.end()))
                values.append(m[2])
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                spans.append((m.start(), 1, m.end()))
                values.append(m[0])
    strings = list(STRING.finditer(text))
    for s in strings:  # a long hex string lies within such a string
        for m in HEX.finditer(s[0]):
            spans.append((s.start() + m.start(), 2, s.start() + m.end()))
            values.append(m[0])
    return spans, values, strings


def untouched(strings: list[re.Match], spans: list[Span]) -> list[re.Match]:
    """The strings that share no character with a span."""
    if not spans:
        return strings
    by_start = sorted((s, e) for s, _, e in spans)
    out, k, reach = [], 0, 0
    for m in strings:
        while k < len(by_start) and by_start[k][0] < m.end():
            reach = max(reach, by_start[k][1])
            k += 1
        if reach <= m.start():
            out.append(m)
    return out


def pair_counts(strings: list[str]) -> np.ndarray:
    """Counts of neighbours, the start of a string included."""
    count = np.zeros(N * N, np.int64)
    if strings:
        a = _CODE[np.frombuffer("\0".join(["", *strings]).encode("ascii"), np.uint8)].astype(np.int64)
        real = a[1:] > 0
        count += np.bincount((a[:-1] * N + a[1:])[real], minlength=N * N)
    return count


def log_model(count: np.ndarray) -> np.ndarray:
    """Log probabilities of each symbol after each other; rare contexts lean on the symbols' own frequencies. A pair seen
    once tells nothing: it may come from a secret that no rule knows, among the ordinary strings."""
    c = count.reshape(N, N)[:, 1:]
    alone = (c.sum(axis=0) + 0.5) / (c.sum() + 0.5 * (N - 1))
    c = np.maximum(c - 1, 0)
    p = (c + BACKOFF * alone) / (c.sum(axis=1, keepdims=True) + BACKOFF)
    return np.pad(np.log(p), ((0, 0), (1, 0)))  # nothing leads back to the start


def log_ratios(strings: list[str], ratio: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each string; ``ratio`` is the difference of the two models."""
    a = _CODE[np.frombuffer("\0".join(["", *strings]).encode("ascii"), np.uint8)].astype(np.int64)
    each = np.where(a[1:] > 0, ratio.ravel()[a[:-1] * N + np.maximum(a[1:], 1)], 0.0)
    return np.add.reduceat(each, np.flatnonzero(a[:-1] == 0))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray | None:
    """Difference of the log models; None without labelled secrets."""
    docs = texts(docs)
    rows = docs.count()
    part = min(1.0, sample_rows / max(rows, 1))
    sampled = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))

    def count(batches):
        for b in batches:
            secret, ordinary = [], []
            for text in b.column(1).to_pylist():
                spans, values, strings = rule_spans(text or "")
                secret += values
                ordinary += [m[0] for m in untouched(strings, spans)]
            for label, strings in enumerate((ordinary, secret)):
                n = pair_counts(strings)
                pairs = np.flatnonzero(n)
                yield batch({"label": np.full(len(pairs), label), "pair": pairs, "n": n[pairs]}, _SAMPLE)

    found = sampled.mapInArrow(count, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()  # at most 2 N * N rows
    counts = np.zeros((2, N * N), np.int64)
    for r in found:
        counts[r["label"], r["pair"]] = r["n"]
    return log_model(counts[1]) - log_model(counts[0]) if counts[1].any() else None


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, ratio: np.ndarray | None) -> DataFrame:
    """Per row: counts and digest of the rules' spans, and all spans."""
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def find(batches):
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in _FOUND}
            pending: list[str] = []
            owners: list[tuple[int, int, int]] = []
            bases = []
            for row, text in enumerate(b.column(1).to_pylist()):
                spans, _, strings = rule_spans(text or "")
                bases.append(spans)
                for m in untouched(strings, spans):
                    pending.append(m[0])
                    owners.append((row, m.start(), m.end()))
            added: list[list[Span]] = [[] for _ in bases]
            if pending and sent.value is not None:
                total = log_ratios(pending, sent.value)
                least = np.maximum(LEAST_RATIO, LEAST_MEAN * np.array([len(x) for x in pending]))
                for k in np.flatnonzero(total >= least):
                    row, start, end = owners[k]
                    added[row].append((start, 3, end))
            for doc_id, spans, more in zip(b.column(0).to_pylist(), bases, added):
                digest = hashlib.sha256(spelled(spans).encode()).hexdigest()
                counts = [sum(k == kind for _, k, _ in spans) for kind in range(3)]
                for name, value in zip(out, (doc_id, *counts, digest, spelled(spans + more))):
                    out[name].append(value)
            yield batch(out, _FOUND)

    return texts(docs).mapInArrow(find, FOUND)
