"""Language identification by a bit-sliced Bloom filter of character n-grams.

Each cell of the filter is a bit mask of languages. An n-gram has a few cells; the AND of their masks is the set of
all languages that contain it, in one look-up whatever their number. For each text the set bits are counted per
language; what the filter's filled share would set by chance is subtracted; the language with the largest share
of n-grams is predicted.

The filter is fitted on a bounded sample of labelled rows: about ``ROWS_A_LANGUAGE`` whole texts of each language,
chosen by a hash of doc_id, of the ``LANGUAGES`` most frequent labels. A language contains an n-gram that makes up
``LEAST_SHARE`` of its own n-grams and ``LEAST_RATIO`` of what it makes up where it is most frequent. So at most
1 / LEAST_SHARE n-grams of a language are kept, and the filter that every task gets has a fixed bound.

How much of a text the kept n-grams cover differs by language: nearly all where letters are few, little where there
are thousands of characters. So the least cover of a known text is each language's own: half of what all but
``LOW_ROWS`` of its sampled rows have, each row judged by what the other rows teach, and never over ``LEAST_COVER``.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing could be
learned; equal shares go to the label with more rows, then by name; a null label isn't learned from; repeated rows
are predicted alike; other columns are not read (``keep_known`` returns them as they are).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.functions.joins import checked_broadcast
from spendscope.llm.common import batch
from spendscope.llm.shingles import mixed

UNKNOWN = "und"
GRAM = 3
LANGUAGES = 256
ROWS_A_LANGUAGE = 1500
LEAST_SHARE = 1e-4
LEAST_RATIO = 0.2
CELLS_A_GRAM, HASHES = 32, 3
#: Texts whose best language holds a smaller share of their n-grams are in no known language, unless that language's
#: own rows have little cover too; share of its rows that may have less than what its bound is taken from.
LEAST_COVER = 0.2
LOW_ROWS = 0.01
#: Code points worked on at once.
BLOCK = 1 << 18

_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
_COVER = pa.schema([("lang", pa.string()), ("cover", pa.float64())])
_GUESS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cover", pa.float64())])
GUESS = "doc_id long, held_out boolean, lang_pred string, score double, cover double"


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams of the texts' letters, and where each text's begin (one bound more than texts), of so many
    texts at a time that they have ``BLOCK`` code points; a longer text makes a block of its own.
    Runs of other characters count as one gap; every text begins and ends with a gap."""
    block: list[str] = []
    size = 0
    for t in texts:
        t = (t or "").lower().replace("\0", " ")
        if block and size + len(t) > BLOCK:
            yield _block_grams(block)
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield _block_grams(block)


def _block_grams(block: list[str]) -> tuple[np.ndarray, np.ndarray]:
    letter = _letters()
    a = np.frombuffer((" " + " \0 ".join(block) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(letter[a], a, np.where(a == 0, 0, 32)).astype(np.uint64)
    first = np.ones(len(code), bool)
    first[1:] = (code[1:] != 32) | (code[:-1] != 32)  # one character for each gap
    code = code[first]
    split, is_letter = code == 0, (code != 0) & (code != 32)
    n = len(code) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(block) + 1, np.int64)
    h, bad, some = code[:n].copy(), split[:n].copy(), is_letter[:n].copy()
    for j in range(1, GRAM):
        h = (h << np.uint64(21)) ^ code[j : n + j]
        bad |= split[j : n + j]
        some |= is_letter[j : n + j]
    good = some & ~bad
    ends = np.append(np.flatnonzero(split), len(code))
    upto = np.concatenate([[0], np.cumsum(good)])
    return mixed(h[good]), np.concatenate([[0], upto[np.minimum(ends, n)]])


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all blocks at once, for a bounded number of texts."""
    hashes, bounds = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for h, b in gram_blocks(texts):
        bounds.append(bounds[-1][-1] + b[1:])
        hashes.append(h)
    return np.concatenate(hashes), np.concatenate(bounds)


@dataclass
class LanguageFilter:
    """Masks of languages by cell; languages in order of their labels' frequency."""

    languages: list[str]
    cells: np.ndarray  # [cells, words of 64 languages]
    least: np.ndarray | None = None  # smallest cover of a text of each language

    @classmethod
    def of(cls, languages: list[str], keys: np.ndarray, masks: np.ndarray) -> LanguageFilter:
        size = 1 << max(10, int(len(keys) * CELLS_A_GRAM - 1).bit_length())
        self = cls(languages, np.zeros((size, masks.shape[1]), np.uint64))
        for at in self._places(keys):
            np.bitwise_or.at(self.cells, at, masks)
        return self

    def _places(self, keys: np.ndarray):
        bits = int(len(self.cells) - 1).bit_length()
        step = (keys << np.uint64(32) | keys >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield (keys + np.uint64(k) * step) >> np.uint64(64 - bits)

    def by_chance(self) -> np.ndarray:
        """Share of unseen n-grams that the filter says a language contains."""
        filled = np.array([np.mean(self.cells[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(self.languages))])
        return filled**HASHES

    def _hits(self, keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """[texts, languages] number of n-grams of each text that the filter says a language contains."""
        hits = np.zeros((len(bounds) - 1, len(self.languages)))
        if len(keys):
            where = None
            for at in self._places(keys):
                where = self.cells[at] if where is None else where & self.cells[at]
            for i in range(len(self.languages)):
                bit = np.concatenate([[0], np.cumsum(where[:, i // 64] >> np.uint64(i % 64) & np.uint64(1))])
                hits[:, i] = bit[bounds[1:]] - bit[bounds[:-1]]
        return hits

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of n-grams of each text; [texts, languages] share of them, corrected for chance."""
        parts = [(np.diff(bounds), self._hits(keys, bounds)) for keys, bounds in gram_blocks(texts)]
        n = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in parts)])
        hits = np.concatenate([np.zeros((0, len(self.languages))), *(x for _, x in parts)])
        chance = self.by_chance()
        share = hits / np.maximum(n, 1)[:, None]
        return n, np.clip((share - chance) / np.maximum(1 - chance, 1e-9), 0, 1)


def fit(docs: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE, held_out: bool = True) -> LanguageFilter:
    """Learn from text and lang of the labelled rows; ``held_out`` leaves out the rows kept for testing."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("lang is not null and text is not null")
    if held_out:
        rows = rows.filter("doc_id is not null").filter(~is_held_out())
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES)
    languages = [(r["lang"], r["rows"]) for r in counts.collect()]
    names = [x for x, _ in languages]
    if not names:
        return LanguageFilter([], np.zeros((1, 1), np.uint64))
    shares = rows.sparkSession.createDataFrame([(x, min(1.0, rows_a_language / n)) for x, n in languages], "lang string, part double")
    sampled = rows.join(F.broadcast(shares), "lang")  # at most LANGUAGES rows
    sampled = sampled.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("part") * (1 << 20)))

    def count(batches):
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for keys, _ in gram_blocks([t for t, l in zip(texts, langs) if l == lang]):
                    g, n = np.unique(keys, return_counts=True)
                    yield batch({"lang": pa.repeat(lang, len(g)), "gram": g.view(np.int64), "n": n}, _GRAMS)

    counted = sampled.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = counted.persist()
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    often = counted.join(checked_broadcast(totals), "lang").withColumn("p", F.col("n") / F.col("total")).filter(F.col("p") >= LEAST_SHARE)
    kept = often.select("lang", "gram", "p", "n", "total").toPandas()  # at most 1 / LEAST_SHARE rows a language
    counted.unpersist()
    kept["top"] = kept.groupby("gram")["p"].transform("max")
    kept = kept[kept["p"] >= LEAST_RATIO * kept["top"]]
    keys, at = np.unique(kept["gram"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    number = kept["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(np.int64)
    masks = np.zeros((len(keys), -(-len(names) // 64)), np.uint64)
    np.bitwise_or.at(masks, (at, number // 64), np.uint64(1) << (number % 64).astype(np.uint64))
    model = LanguageFilter.of(names, keys, masks)
    model.least = np.full(len(names), LEAST_COVER)
    low = _low_covers(sampled.select("lang", "text"), kept)
    for i, x in enumerate(names):
        if x in low:
            model.least[i] = min(LEAST_COVER, low[x] / 2)
    return model


def cover_by_others(keys: np.ndarray, known: np.ndarray, n: np.ndarray, top: np.ndarray, total: int) -> float:
    """Share of a sampled text's n-grams ``keys`` that its language would keep without this text. ``known``: the n-grams
    that it keeps, in order, with their number and largest share in any language; ``total``: number of all its n-grams."""
    own, times = np.unique(keys, return_counts=True)
    rest = total - len(keys)
    if rest <= 0 or not len(known):
        return 0.0
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    p = np.where(known[at] == own, n[at] - times, 0) / rest
    return float(times[p >= np.maximum(LEAST_SHARE, LEAST_RATIO * top[at])].sum() / len(keys))


def _low_covers(sampled: DataFrame, kept) -> dict[str, float]:
    """Cover of the sampled rows of each language that has any n-gram: all but ``LOW_ROWS`` of its rows have as much."""
    learned = {}
    for lang, part in kept.groupby("lang"):
        known = part["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(known)
        learned[lang] = (known[order], part["n"].to_numpy(np.int64)[order], part["top"].to_numpy(float)[order], int(part["total"].iloc[0]))
    sent = sampled.sparkSession.sparkContext.broadcast(learned)  # at most 1 / LEAST_SHARE n-grams a language
    nothing = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0), 0)

    def judge(batches):
        for b in batches:
            of = iter(b.column(0).to_pylist())
            for keys, bounds in gram_blocks(b.column(1).to_pylist()):
                rows = [(lang, keys[lo:hi]) for lo, hi, lang in zip(bounds[:-1], bounds[1:], of) if lo < hi]
                covers = [cover_by_others(own, *sent.value.get(lang, nothing)) for lang, own in rows]
                yield batch({"lang": [lang for lang, _ in rows], "cover": covers}, _COVER)

    covers = sampled.mapInArrow(judge, "lang string, cover double")
    low = covers.groupBy("lang").agg(F.percentile("cover", F.lit(LOW_ROWS)).alias("low"))
    return {r["lang"]: r["low"] for r in low.collect()}  # at most LANGUAGES rows


def guesses(model: LanguageFilter, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and share of known n-grams of each text. The score is the best language's part of all languages' shares."""
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    n, share = model.shares(texts)
    best = share.argmax(axis=1)
    cover = share[np.arange(len(texts)), best]
    score = np.where(n > 0, cover / np.maximum(share.sum(axis=1), 1e-12), 0.0)
    return [model.languages[i] if k else UNKNOWN for i, k in zip(best, n)], np.clip(score, 0, 1), np.where(n > 0, cover, 0.0)


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))

    def guess(batches):
        for b in batches:
            langs, score, cover = guesses(sent.value, b.column(2).to_pylist())
            yield batch({"doc_id": b.column(0), "held_out": b.column(1), "lang_pred": langs, "score": score, "cover": cover}, _GUESS)

    return rows.mapInArrow(guess, GUESS)


def keep_known(docs: DataFrame, model: LanguageFilter, least_cover: float = LEAST_COVER) -> DataFrame:
    """The rows whose text is in a known language, all columns as they are. ``least_cover`` is the most that is asked
    of any language."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        model = sent.value
        least = model.least if model.least is not None else np.full(len(model.languages), least_cover)
        asked = {x: min(least_cover, max(v, 1e-9)) for x, v in zip(model.languages, least)}
        for b in batches:
            langs, _, cover = guesses(model, b.column(at).to_pylist())
            yield b.filter(pa.array([x != UNKNOWN and c >= asked[x] for x, c in zip(langs, cover)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
