"""Spelling variants: frequent words and their near words, by dynamic programming over sorted lists.

1. Runs of letters are counted; words of at least ``LEAST_LETTERS`` code points with ``LEAST_COUNT`` occurrences stay.
2. Near words differ by one inserted, deleted or replaced code point. Seen from the longer one's length n, the edit lies in
   its first half or in the rest, so the two words share the rest or the first half. Every word goes to the
   groups of its own length and of the next one, by its first half and by its rest. A group whose middles (what its words
   don't share) come to more than ``GROUP_BYTES`` is divided again by halves of the middle, until it is small or
   the middle is one code point, of which there are some 90. So no group grows with the vocabulary and none is cut.
3. A group's middles are sorted and scanned once for all its words. A range of the list whose words share a prefix has one
   banded row of the edit matrix for each word that it is compared with (three cells suffice for one edit); the row is
   carried from a prefix to the next longer ones, whose ranges follow from common prefixes of neighbours (LCPs).
   A range whose shared prefix is more than one edit away is skipped whole.
4. Two words can meet in several groups. They count in the one that takes the first half wherever they share it.
   Each word's count of near words and its most frequent one are combined by partial aggregation.
5. A word's form is its near word of largest count, if that is ``LEAST_RATIO`` times its own. Roots follow by
   doubling: each round, a word takes its root's root. Counts grow tenfold a step, so three or four rounds do.

Defined cases: null and empty texts have no words; a null doc_id is spelled as nothing where ``typo`` hashes it; rows with
the same doc_id count each; an empty table gives no row; words of any length are compared whole; other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.functions.joins import checked_broadcast
from spendscope.llm.common import batch, settle, texts, whole_groups

LEAST_LETTERS, LEAST_COUNT, LEAST_RATIO = 7, 2, 10
#: One occurrence in so many is given an error.
TYPO_EVERY = 31
#: Distinct words that one task counts before it sends them on.
HELD_WORDS = 400_000
#: Bytes of the middles of one group; bytes of middles, and pairs of word and range, worked on at once.
GROUP_BYTES, SCAN_BYTES, SCAN_PAIRS = 1 << 18, 1 << 19, 1 << 20
#: Bytes of rows of whole groups that one task holds.
HELD_BYTES = 16 << 20

COUNT = "word string, n long"
_COUNT = pa.schema([("word", pa.string()), ("n", pa.int64())])
NEAR = "word string, n_near long, best_n long, best string"
_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def typo(doc_id: bytes, run: str) -> str:
    """The run, less one code point where its hash says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(doc_id))
    return run if h % TYPO_EVERY else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences."""
    runs = re.compile(rf"[a-zÀ-ÿ]{{{least_letters},}}")  # a run is found at its first letter, so whole

    def send(counts: Counter) -> pa.RecordBatch:
        return batch({"word": list(counts), "n": list(counts.values())}, _COUNT)

    def count(batches):
        counts: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                before = (b"" if doc_id is None else b"%d" % doc_id) + b":"
                low = text.encode().lower().decode()  # bytes: only A-Z change
                for run, n in Counter(runs.findall(low)).items():
                    word = typo(before, run)
                    if len(word) >= least_letters:
                        counts[word] += n
            if len(counts) >= HELD_WORDS:
                yield send(counts)
                counts = Counter()
        if counts:
            yield send(counts)

    return texts(docs).mapInArrow(count, COUNT).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# -- the scan of sorted lists ----------------------------------------------------------------------


def _rows(width: int, parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def near_pairs(group: np.ndarray, words: list[bytes]):
    """Pairs (i, j) of words of one group at one edit, each from both sides, for many groups at once. Words are Latin-1 without zero
    bytes, sorted by group and word, and distinct within a group. Comes in parts of bounded size."""
    size = np.array([len(w) for w in words], np.int64)
    if not len(size):
        return
    width = int(size.max()) + 1
    letters = _rows(width, words)
    # common prefix with the word before; -1 where a group begins
    differs = letters[1:] != letters[:-1]
    lcp = np.append(-1, np.where(group[1:] == group[:-1], np.argmax(differs, axis=1), -1))
    begins = np.flatnonzero(lcp < 0)
    end = np.append(begins[1:], len(size))
    which = np.searchsorted(begins, np.arange(len(size)), "right") - 1
    wide = (end - begins)[which]
    some = np.flatnonzero(wide > 1)
    # a word and the whole list of its group: one exact prefix, so at most all first letters come of it
    load = np.minimum(wide[some], 256)
    part = np.cumsum(load) // SCAN_PAIRS
    for first, last in zip(np.flatnonzero(np.append(True, part[1:] != part[:-1])), np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(some))):
        query = some[first:last]
        if len(query):
            yield from _scan(letters, size, lcp, query, begins[which[query]], end[which[query]])


def _scan(letters, size, lcp, query, lo, hi):
    """Rows of the band for each word of ``query`` and each range lo to hi of words that share the first ``depth`` letters: distances of
    the shared prefix from the word's prefixes of depth - 1, depth and depth + 1 letters; 2 stands for more than one edit."""
    n = len(query)
    short, same, long = np.full(n, 2, np.int8), np.zeros(n, np.int8), np.where(size[query] > 0, 1, 2).astype(np.int8)
    depth, width = 0, letters.shape[1]
    while len(query):
        # a range's first word may end here: it is the prefix itself
        over = np.flatnonzero(size[lo] == depth)
        if len(over):
            q, t = query[over], lo[over]
            off = size[q] - depth
            d = np.select([off == -1, off == 0, off == 1], [short[over], same[over], long[over]], 2)
            found = d == 1
            if found.any():
                yield q[found], t[found]
        if depth + 1 >= width:
            return
        # the ranges of the next longer prefixes begin where neighbours share no more than ``depth`` letters
        cuts = np.flatnonzero(lcp <= depth)
        from_, to = np.searchsorted(cuts, lo), np.searchsorted(cuts, hi)
        many = to - from_
        row = np.repeat(np.arange(len(query)), many)
        at = np.repeat(from_ - (np.cumsum(many) - many), many) + np.arange(len(row))
        new_lo, new_hi = cuts[at], np.append(cuts, len(size))[at + 1]
        letter = letters[new_lo, depth]
        goes_on = letter > 0
        row, new_lo, new_hi, letter = row[goes_on], new_lo[goes_on], new_hi[goes_on], letter[goes_on]
        q = query[row]
        left = size[q] - depth
        own = lambda k: letters[q, np.clip(depth + k, 0, width - 1)] != letter
        a, b, c = short[row], same[row], long[row]
        x = np.minimum(a + own(-1), b + 1) if depth else b + 1
        x = np.where(left >= 0, x, 2)
        y = np.where(left >= 1, np.minimum(np.minimum(b + own(0), c + 1), x + 1), 2)
        z = np.where(left >= 2, np.minimum(c + own(1), y + 1), 2)
        short, same, long = (np.minimum(v, 2).astype(np.int8) for v in (x, y, z))
        keep = np.flatnonzero(np.minimum(np.minimum(short, same), long) < 2)
        query, lo, hi, short, same, long = (v[keep] for v in (q, new_lo, new_hi, short, same, long))
        depth += 1


# -- groups ----------------------------------------------------------------------------------------

#: A word in a group of words of ``whole`` or one letter less that share ``head`` first and ``tail`` last letters. Two of them count there if
#: they share fewer than ``less`` first letters.
PLACE = ("whole", "head", "tail", "less")


def _halves(rows: DataFrame) -> DataFrame:
    """Rows dealt to the two groups of each: by the first half of the middle, and by the rest of it."""
    half = F.expr("(whole - head - tail) div 2")
    first = F.struct(F.col("whole"), (F.col("head") + half).alias("head"), F.col("tail"), F.col("less"))
    rest = F.struct(F.col("whole"), F.col("head"), (F.col("whole") - F.col("head") - half).alias("tail"), F.least("less", F.col("head") + half).alias("less"))
    out = rows.select("word", "n", F.explode(F.array(first, rest)).alias("p")).select("word", "n", "p.*")
    shared = F.xxhash64("whole", "head", "tail", F.expr("left(word, head)"), F.expr("right(word, tail)"))
    return out.withColumn("key", shared)


def groups(words: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The rows (word, n, place, key) of all groups that have more than one word; words of one group have one key."""
    length = F.char_length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("whole"))
    rows = _halves(rows.select("word", "n", "whole", F.lit(0).alias("head"), F.lit(0).alias("tail"), F.col("whole").alias("less")))
    done = None
    while True:
        middle = F.first(F.expr("whole - head - tail"))
        large = rows.groupBy("key").agg(F.count("*").alias("rows"), middle.alias("middle"))
        large = settle(large.filter(f"middle > 1 and rows * middle > {group_bytes}").select("key"), "large-groups")
        if large.isEmpty():
            return rows if done is None else done.union(rows)
        large = checked_broadcast(large)
        small = rows.join(large, "key", "left_anti").select(*rows.columns)
        done = small if done is None else done.union(small)
        rows = _halves(rows.join(large, "key", "left_semi").drop("key"))
        rows = settle(rows, "divided-groups")


def _near_in_groups(table: pa.Table) -> pa.RecordBatch:
    """Partial NEAR rows of whole groups; rows come sorted by group and middle."""
    names, n = table["word"].to_pylist(), table["n"].to_numpy()
    place = np.stack([table[x].to_numpy() for x in ("key", *PLACE)])  # keys are hashes, so the place tells groups apart too
    group = np.cumsum(np.append(True, (place[:, 1:] != place[:, :-1]).any(axis=0)))
    whole, less = place[1], place[4]
    full = [w.encode("latin-1") for w in names]
    middles = [w.encode("latin-1") for w in table["middle"].to_pylist()]
    size = np.array([len(w) for w in full], np.int64)
    count, best_n, best = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), np.full(len(names), -1)
    rank = np.empty(len(names), np.int64)  # of words in code-point order
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    for lo, hi in _cuts(group, [len(m) for m in middles]):
        for i, j in near_pairs(group[lo:hi], middles[lo:hi]):
            i, j = lo + i, lo + j
            keep = (size[i] == whole[i]) | (size[j] == whole[i])
            i, j = i[keep], j[keep]
            keep = np.array([full[x][:m] != full[y][:m] for x, y, m in zip(i.tolist(), j.tolist(), less[i].tolist())], bool)
            i, j = i[keep], j[keep]
            np.add.at(count, i, 1)
            order = np.lexsort((rank[j], -n[j], i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else i
            i, j = i[first], j[first]
            better = (best[i] < 0) | (n[j] > best_n[i]) | ((n[j] == best_n[i]) & (rank[j] < rank[best[i]]))
            best_n[i[better]], best[i[better]] = n[j[better]], j[better]
    some = np.flatnonzero(count)
    columns = {"word": [names[k] for k in some], "n_near": count[some], "best_n": best_n[some], "best": [names[k] for k in best[some]]}
    return batch(columns, _NEAR)


def _cuts(group: np.ndarray, sizes: list[int]):
    """Ranges of whole groups whose padded middles take some SCAN_BYTES."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    ends = np.append(first[1:], len(group))
    lo, widest = 0, 0
    for i, j in zip(first.tolist(), ends.tolist()):
        wide = max(sizes[i:j])
        if i > lo and (j - lo) * max(widest, wide) > SCAN_BYTES:
            yield lo, i
            lo, widest = i, 0
        widest = max(widest, wide)
    if len(group):
        yield lo, len(group)


def near_words(words: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """word, n_near, best_n and best of the words that have near words."""

    def scan(batches):
        for table in whole_groups(batches, "key", HELD_BYTES):
            yield _near_in_groups(table)

    dealt = groups(words, group_bytes).select("word", "n", "key", *PLACE).repartition("key")
    middle = F.expr("substring(word, head + 1, char_length(word) - head - tail)")
    found = dealt.withColumn("middle", middle).sortWithinPartitions("key", *PLACE, "middle").mapInArrow(scan, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("b")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return near.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last word on the way from form to form."""
    now = settle(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = settle(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def variants(docs: DataFrame, least_ratio: int = LEAST_RATIO, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root."""
    words = settle(word_counts(docs), "words")
    near = near_words(words, group_bytes)
    found = settle(words.join(near, "word", "left"), "near-words")
    enough = F.col("best_n") >= least_ratio * F.col("n")
    found = found.select("word", F.when(enough, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best_n")).alias("form_n"))
    last = roots(found.filter("form is not null"))
    out = found.join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
