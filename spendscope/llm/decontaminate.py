"""Benchmark decontamination: every training passage queries a BM25 index of the test items.

The index holds the items' units: an item of more than ``UNIT_WORDS`` words is several of just that many, the last of
which overlaps the one before, so that no rest of a few words stands for an item. A unit's impacts are BM25 weights
divided by the unit's own score, so a passage with all its words scores 1 and one threshold holds for all units.
Whole texts are cut into passages of two half-overlapping steps of ``UNIT_WORDS`` words, so each unit lies whole in one of
them. The question of a shorter item is a unit once more, for documents that hold it without the answer. Retrieval is exact and skips by upper bounds, as block-max WAND does: a passage whose words' list maxima
don't add up to the threshold has no hit; of the others, only the blocks of units are opened whose block maxima
add up; in those, scores are exact. What is retrieved is verified: the share of the unit's word trigrams in the
passage, of its question and its answer (the last sentence) each and together, must reach ``LEAST_OVERLAP`` together.

Units, their number, mean length and the units of each term are Spark tables over all items, so a unit's impacts do not
depend on how many indexes there are. An index has some ``INDEX_UNITS`` / 2 units and is built in a task, which bounds what
a task gets; the driver only passes it on. More test items make more indexes, and the documents are read once for each.

Defined cases: null texts and texts without words match nothing, null and empty items are matched by nothing; items
of fewer than three words match by their words; repeated documents and repeated items match alike; other columns are not read
(``keep_clean`` returns them as they are). Of equal scores in one document the first passage is reported.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm.common import batch, settle, texts
from spendscope.llm.shingles import mixed, word_hashes

UNIT_WORDS = 64
INDEX_UNITS = 20_000
BLOCK_UNITS = 16
K1, B = 1.2, 0.75
#: Share of a unit's own score that a passage must reach; share of its trigrams that it must hold.
LEAST_SCORE, LEAST_OVERLAP = 0.4, 0.5
#: A question of so many words is a unit of its own, of which so much must be held, whatever becomes of the answer.
QUESTION_WORDS, QUESTION_OVERLAP = 10, 0.9
GRAM = 3
#: Pairs of passages and units whose scores are added up at once.
PASSAGE_CELLS = 1 << 20
#: Bytes of text worked on at once.
TEXT_BLOCK = 1 << 19

#: A-Z to lower case, ASCII signs to spaces; letters of other alphabets are lower-cased before.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *[(x, pa.float64()) for x in ("score", "overlap", "question_overlap", "answer_overlap")], ("first_word", pa.int64())])
_UNIT = pa.schema([("item_id", pa.int64()), ("deal", pa.int64()), *[(x, pa.binary()) for x in ("words", "whole", "question", "answer")], ("least", pa.float64())])
UNIT = "item_id long, deal long, words binary, whole binary, question binary, answer binary, least double"
_TERM = pa.schema([("deal", pa.int64()), ("term", pa.int64()), ("n", pa.int64())])
_INDEX = pa.schema([("part", pa.int64()), ("index", pa.binary())])
MATCH = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double, first_word long"


def plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN)


def words_of(text: str) -> np.ndarray:
    return word_hashes(plain(text))[0]


def trigrams(w: np.ndarray) -> np.ndarray:
    n = min(GRAM, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + w[j : len(h) + j]
    return mixed(h)


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; a text of one sentence is all question."""
    ends = [m.end() for m in re.finditer(r"[.?!:](?=\s)", text.rstrip())]
    return (text[: ends[-1]], text[ends[-1] :]) if ends else (text, "")


@dataclass
class Unit:
    item_id: int
    words: np.ndarray
    parts: tuple[np.ndarray, np.ndarray, np.ndarray]  # trigrams of all, of the question, of the answer
    least: float = 0.0  # share of all trigrams that must be held, if more than what is asked for


def units_of(item_id: int, text: str | None) -> list[Unit]:
    if not text:
        return []
    w = words_of(text)
    n_question = len(words_of(question_and_answer(text)[0]))
    out = []
    for lo in range(0, len(w), UNIT_WORDS):
        hi = min(lo + UNIT_WORDS, len(w))
        lo = max(0, hi - UNIT_WORDS)
        cut = min(max(n_question, lo), hi)
        out.append(Unit(item_id, w[lo:hi], tuple(np.unique(trigrams(x)) if len(x) else x for x in (w[lo:hi], w[lo:cut], w[cut:hi]))))
    if QUESTION_WORDS <= n_question < len(w) and len(w) <= UNIT_WORDS:
        question = out[0].parts[1]
        out.append(Unit(item_id, w[:n_question], (question, question, out[0].parts[2]), QUESTION_OVERLAP))
    return out


@dataclass
class Corpus:
    """What BM25 asks about all units: their number and mean length; terms (sorted) and how many units hold each."""

    units: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


class ImpactIndex:
    """Postings of impacts by term, units in blocks with the largest impact of each term. ``corpus`` has all terms of the units; without it the
    units are all there are."""

    def __init__(self, units: list[Unit], corpus: Corpus | None = None):
        self.units = units
        n = len(units)
        terms, freqs = zip(*(np.unique(u.words, return_counts=True) for u in units)) if units else ((), ())
        unit = np.repeat(np.arange(n), [len(t) for t in terms])
        self.terms, term = np.unique(np.concatenate(terms) if units else np.zeros(0, np.uint64), return_inverse=True)
        tf = np.concatenate(freqs).astype(float) if units else np.zeros(0)
        size = np.array([len(u.words) for u in units], float)
        if corpus is None:
            corpus = Corpus(n, size.mean() if units else 0.0, self.terms, np.bincount(term, minlength=len(self.terms)))
        df = corpus.df[np.searchsorted(corpus.terms, self.terms)]
        idf = np.log(1 + (corpus.units - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(corpus.mean, 1.0))
        impact = idf[term] * tf * (K1 + 1) / (tf + norm[unit])
        impact /= np.bincount(unit, impact, minlength=n)[unit]
        order = np.lexsort((unit, term))
        self.unit, self.impact = unit[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.n_blocks = -(-n // BLOCK_UNITS)
        cell = term[order] * max(self.n_blocks, 1) + self.unit // BLOCK_UNITS
        # largest impact of each term in each block of units, where it has any
        self.cells, at = np.unique(cell, return_inverse=True)
        self.cell_max = np.zeros(len(self.cells))
        np.maximum.at(self.cell_max, at, self.impact)
        self.first_cell = np.searchsorted(self.cells // max(self.n_blocks, 1), np.arange(len(self.terms) + 1))
        self.term_max = np.zeros(len(self.terms))
        np.maximum.at(self.term_max, term[order], self.impact)

    def term_numbers(self, w: np.ndarray) -> np.ndarray:
        """Number of each word's term, or -1."""
        if not len(self.terms):
            return np.full(len(w), -1)
        at = np.minimum(np.searchsorted(self.terms, w), len(self.terms) - 1)
        return np.where(self.terms[at] == w, at, -1)

    @staticmethod
    def _all(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many entries each of the terms has, and their places."""
        n = first[terms + 1] - first[terms]
        return n, np.repeat(first[terms] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def opened(self, passage: np.ndarray, terms: np.ndarray, passages: int, least: float) -> np.ndarray:
        """For each passage and block of units whether the block maxima of its distinct terms add up to ``least``."""
        n, c = self._all(self.first_cell, terms)
        cell = np.repeat(passage, n) * self.n_blocks + self.cells[c] % self.n_blocks
        return np.bincount(cell, self.cell_max[c], minlength=passages * self.n_blocks).reshape(passages, self.n_blocks) >= least - 1e-9

    def scored(self, passage: np.ndarray, terms: np.ndarray, open_: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, unit and score, of the units of open blocks that a passage's distinct terms score at least ``least`` on."""
        n, p = self._all(self.first, terms)
        at = np.repeat(passage, n)
        some = open_[at, self.unit[p] // BLOCK_UNITS]
        score = np.bincount(at[some] * len(self.units) + self.unit[p[some]], self.impact[p[some]])
        found = np.flatnonzero(score >= least - 1e-12)
        return found // len(self.units), found % len(self.units), score[found]

    def retrieve(self, passage: np.ndarray, terms: np.ndarray, passages: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, unit and score of all units that a passage's distinct terms score at least ``least`` on."""
        return self.scored(passage, terms, self.opened(passage, terms, passages, least), least)


def share_of(part: np.ndarray, grams: np.ndarray) -> float:
    return float(np.isin(part, grams).mean()) if len(part) else 0.0


def matches(index: ImpactIndex, docs: list[str | None], least_score: float, least_overlap: float):
    """(document number, item_id, score, overlaps, first word) of the best verified unit of each item."""
    block: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, text in enumerate(docs):
        if text:
            raw = plain(text)
            if parts and size + len(raw) > TEXT_BLOCK:
                yield from _block_matches(index, block, parts, least_score, least_overlap)
                block, parts, size = [], [], 0
            block.append(i)
            parts.append(raw)
            size += len(raw) + 1
    if parts:
        yield from _block_matches(index, block, parts, least_score, least_overlap)


def _retrieved(index: ImpactIndex, steps: np.ndarray, pair: np.ndarray, held_term: np.ndarray, at: np.ndarray, least: float):
    """First step, end, units and scores of the passages that retrieve any; so many passages at once that they have PASSAGE_CELLS pairs with
    units."""
    some, span = max(1, PASSAGE_CELLS // max(1, len(index.units))), len(index.terms) + 1
    for lo in range(0, len(steps), some):
        s = steps[lo : lo + some]
        last = s + 1 + pair[s]
        n = at[last] - at[s]
        held = np.repeat(np.arange(len(s)), n) * span + held_term[np.repeat(at[s] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        held.sort()
        held = held[np.append(True, held[1:] != held[:-1])[: len(held)]]
        passage, unit, score = index.retrieve(held // span, held % span, len(s), least)
        first = np.searchsorted(passage, np.arange(len(s) + 1))
        for k in np.flatnonzero(np.diff(first)):
            own = slice(first[k], first[k + 1])
            yield s[k], last[k], list(zip(unit[own].tolist(), score[own].tolist()))


def _block_matches(index: ImpactIndex, block: list[int], parts: list[bytes], least_score: float, least_overlap: float):
    w, starts = word_hashes(b" ".join(parts))
    if not len(w):
        return
    first = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in parts]))
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(parts)), n_words)
    n_steps = -(-n_words // UNIT_WORDS)
    first_step = np.concatenate([[0], np.cumsum(n_steps)])
    step = first_step[doc] + (np.arange(len(w)) - first[doc]) // UNIT_WORDS
    term = index.term_numbers(w)
    known = np.flatnonzero(term >= 0)
    span = len(index.terms) + 1
    held = np.unique(step[known] * span + term[known])  # distinct terms of each step
    held_step, held_term = held // span, held % span
    at = np.searchsorted(held_step, np.arange(first_step[-1] + 1))
    bound = np.bincount(held_step, index.term_max[held_term], minlength=first_step[-1])
    step_doc = np.repeat(np.arange(len(parts)), n_steps)
    pair = np.zeros(len(bound), bool)
    pair[:-1] = step_doc[1:] == step_doc[:-1]
    alone = ~pair
    alone[1:] &= ~pair[:-1]  # the last step of a longer text is part of the passage before
    total = bound.copy()
    total[:-1] += np.where(pair[:-1], bound[1:], 0)
    best: dict[tuple[int, int], tuple] = {}
    for s, last, units in _retrieved(index, np.flatnonzero((total >= least_score - 1e-9) & (pair | alone)), pair, held_term, at, least_score):
        grams = None
        for u, score in units:
            if grams is None:
                d = step_doc[s]
                lo = first[d] + (s - first_step[d]) * UNIT_WORDS
                passage = w[lo : min(lo + (last - s) * UNIT_WORDS, first[d + 1])]
                grams = trigrams(passage)
            unit = index.units[u]
            held_in = passage if len(unit.words) < GRAM else grams
            overlap = share_of(unit.words if len(unit.words) < GRAM else unit.parts[0], held_in)
            if overlap >= max(least_overlap, unit.least):
                row = (score, overlap, share_of(unit.parts[1], grams), share_of(unit.parts[2], grams), int(lo - first[d]))
                key = (block[d], unit.item_id)
                if key not in best or (row[1], row[0]) > (best[key][1], best[key][0]):
                    best[key] = row
    for (i, item_id), row in best.items():
        yield i, item_id, *row


def unit_table(items: DataFrame) -> DataFrame:
    """The units of all items; those of one item and text have one ``deal``."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")

    def cut(batches):
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in _UNIT}
            for item_id, text, deal in zip(*(c.to_pylist() for c in b.columns)):
                for u in units_of(item_id, text):
                    row = (u.item_id, deal, u.words.tobytes(), *(x.tobytes() for x in u.parts), u.least)
                    for name, value in zip(out, row):
                        out[name].append(value)
            yield batch(out, _UNIT)

    return settle(rows.withColumn("deal", F.xxhash64("item_id", "text")).mapInArrow(cut, UNIT), "test-units")


def _words(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _terms(units: DataFrame) -> DataFrame:
    """(deal, term, n): how many of a batch's units with that deal hold the term."""

    def count(batches):
        for b in batches:
            words = [np.unique(w) for w in _words(b.column(1))]
            deal = np.repeat(b.column(0).to_numpy(), [len(w) for w in words])
            pairs = np.stack([deal, np.concatenate([np.zeros(0, np.uint64), *words]).view(np.int64)])
            pairs, n = np.unique(pairs, axis=1, return_counts=True)
            yield batch({"deal": pairs[0], "term": pairs[1], "n": n}, _TERM)

    return units.select("deal", "words").mapInArrow(count, "deal long, term long, n long")


def index_table(items: DataFrame, units: int = INDEX_UNITS) -> tuple[DataFrame, int]:
    """(part, index) of the pickled indexes, one a row, and the number of parts. A part without units has no row."""
    table = unit_table(items)
    total, size = table.agg(F.count("*"), F.coalesce(F.sum(F.length("words") / 8), F.lit(0.0))).first()
    parts = max(1, -(-total // max(1, units // 2)))  # hashing deals unevenly: half full on average
    mean = size / max(total, 1)
    part = F.pmod("deal", F.lit(parts)).alias("part")
    terms = settle(_terms(table), "test-terms")
    df = terms.groupBy("term").agg(F.sum("n").alias("df"))
    asked = terms.select(part, "term").distinct().join(df, "term")

    def build(key, units: pa.Table, terms: pa.Table) -> pa.Table:
        units = units.sort_by([(x, "ascending") for x in ("item_id", "deal", "least", "words")])
        parts_ = zip(*(_words(units[x]) for x in ("whole", "question", "answer")))
        own = [Unit(i, w, p, least) for i, w, p, least in zip(units["item_id"].to_pylist(), _words(units["words"]), parts_, units["least"].to_pylist())]
        names = terms["term"].to_numpy().view(np.uint64)
        order = np.argsort(names)
        index = ImpactIndex(own, Corpus(total, mean, names[order], terms["df"].to_numpy()[order]))
        return pa.table({"part": [key[0].as_py()], "index": [pickle.dumps(index)]}, schema=_INDEX)

    dealt = table.withColumn("part", part).groupBy("part")
    return settle(dealt.cogroup(asked.groupBy("part")).applyInArrow(build, "part long, index binary"), "test-index"), parts


def indexes(items: DataFrame, units: int = INDEX_UNITS):
    """The indexes one after another, as the tasks built them."""
    table, parts = index_table(items, units)
    for k in range(parts):
        row = table.filter(F.col("part") == k).select("index").first()
        if row is not None:
            yield pickle.loads(row["index"])


def contaminated(docs: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """One row per document and test item that it holds."""
    out, rows = None, texts(docs)
    for index in indexes(items):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def find(batches, sent=sent):
            for b in batches:
                ids = b.column(0).to_pylist()
                found = [(ids[i], *rest) for i, *rest in matches(sent.value, b.column(1).to_pylist(), least_score, least_overlap)]
                yield batch({f.name: [r[k] for r in found] for k, f in enumerate(_MATCH)}, _MATCH)

        part = rows.mapInArrow(find, MATCH)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], MATCH)


def keep_clean(docs: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE, least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """The documents that hold no test item, all columns as they are."""
    at = docs.columns.index("text")
    for k, index in enumerate(indexes(items)):
        if k:
            docs = settle(docs, "clean")  # a task holds one index
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def keep(batches, sent=sent):
            for b in batches:
                hit = {i for i, *_ in matches(sent.value, b.column(at).to_pylist(), least_score, least_overlap)}
                yield b.filter(pa.array([i not in hit for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
