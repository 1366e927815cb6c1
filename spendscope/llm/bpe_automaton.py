"""BPE encoding and decoding by a tokenization automaton.

The merge list is compiled into a deterministic automaton whose arcs are labelled with tokens and which accepts a
sequence of tokens if and only if the merges, applied in order, give just that sequence. It begins as one state with a loop
for each base symbol. Then each merge (a, b) adds a gadget: all arcs labelled a enter one state s; they are led to a
copy of s that lacks the arc b, and wherever a led to s, a new arc labelled ab goes on to where b led from there. So a
merge adds at most one state, a state is known by its parent and the label it lacks, and all arcs of one label enter one
state. Arcs are not written out: whether a state has one follows from the gadgets, and each answer is kept in a table.

A word is encoded by the path that spells it: the state reached at a place and the tokens that begin there give the
arcs to later places. Exactly one path spells each prefix of a word, so a place has one state and is visited once,
and the work is linear in the word. Decoding emits the labels of the arcs.

Texts are normalised and split into words as the tokenizer's file says, by the tokenizers library; merging is done here.
White space ends words, so texts are cut at spaces and line feeds, and each chunk's ids are kept in a bounded memo.

Defined cases: a null text has null ids in ``encode`` (the query counts it as empty); an empty or blank text has none;
special tokens written in a text become their ids; repeated rows are answered each for itself; texts of any length
are encoded whole; other columns of the table are not read; ids outside the vocabulary raise an error in ``decode``.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendscope.llm.common import texts
from spendscope.llm.tokens import SIGNS, byte_signs

TOKENIZER_FILE = "word_bpe_49k.json"
#: Chunks of one generation of the memo of a Python worker (some 150 bytes each); two generations are kept.
MEMO_ENTRIES = 400_000
#: Entries of the table of arcs asked for; beyond it, the table starts anew.
ARC_ENTRIES = 1_000_000

#: Letters that normalising only lower-cases.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

IDS = "doc_id long, ids array<int>"
TEXT = "doc_id long, ids array<int>, decoded string"


class TokenAutomaton:
    """States are numbers; 0 is the first one. Labels are tokens; state, owner and time of a gadget share its number."""

    def __init__(self, base: list[str], merges: list[tuple[str, str]]):
        self.enters = dict.fromkeys(base, 0)  # label -> the state that its arcs enter
        self.made = dict.fromkeys(base, 0)  # label -> the gadget that made it
        self.left: dict[str, str] = {}
        self.owner, self.parent = [""], [0]  # of a state: the label whose arcs were led to it, and the state it copies
        self.lacks: dict[tuple[str, str], int] = {}  # (owner, label) -> the state from which on that arc is missing
        self.first: dict[str, int] = dict.fromkeys(base, 0)  # label -> the state that its arcs entered first
        self.copies: dict[str, list[int]] = {}  # label -> the copies made for it
        self.never: set[str] = set()  # labels that no text gives
        for a, b in merges:
            self._gadget(a, b)

    def _gadget(self, a: str, b: str) -> None:
        label = a + b
        if not all(x in self.enters or x in self.never for x in (a, b)) or label in self.enters or label in self.never:
            raise ValueError(f"the merge {a} {b} comes before its parts, or gives a token a second time")
        if a in self.never or b in self.never or not self.has(self.enters[a], b):
            self.never.add(label)  # b never follows a, so nothing is ever merged
            return
        state = self.enters[a]
        copy, target = len(self.owner), self.enters[b]
        self.owner.append(a)
        self.parent.append(state)
        self.lacks[a, b] = copy
        self.copies.setdefault(a, []).append(copy)
        self.enters[a] = copy
        self.enters[label] = self.first[label] = state if a == b else target
        self.made[label], self.left[label] = copy, a

    def has(self, state: int, label: str) -> bool:
        """Whether an arc with this label leaves the state."""
        while True:
            born, at = self.made[label], state
            # back to the state as it was when the label was made: the copies of one owner at a time
            while at > born:
                owner = self.owner[at]
                if born < self.lacks.get((owner, label), 0) <= at:
                    return False
                copies = self.copies[owner]
                before = bisect_right(copies, born)
                at = copies[before - 1] if before else self.first[owner]
            if not born:
                return True
            state, label = at, self.left[label]  # the gadget gave the new arc to every state with an arc for its left part


class Vocabulary:
    """A tokenizer's file: its automaton, the ids of labels, and how texts become words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model["type"] != "BPE" or any(model.get(x) for x in odd):
            raise ValueError("only plain BPE with an optional suffix of last pieces is compiled")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        merged = {a + b for a, b in merges}
        self.automaton = TokenAutomaton([t for t in self.ids if t not in merged], merges)
        self.arcs: dict[int, bool] = {}
        self._compile()
        self.tokenizer = Tokenizer.from_file(path)
        self.normal, self.pieces = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("only special tokens that are matched as they stand are compiled")
        self.added = {t.content: k for k, t in added.items()}
        self.labels = {k: t for t, k in (self.ids | self.added).items()}
        by_length = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        self.spelled = byte_signs()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _compile(self) -> None:
        """A tree of the labels that can stand inside a word, as (label's arc, children) by sign, and the labels of last
        pieces by their texts. An arc is (id, label, state that it enters)."""
        end, self.tree, self.longest = self.end, {}, max(map(len, self.ids))
        self.last: dict[str, tuple[int, str, int]] = {}
        for label, state in self.automaton.enters.items():
            arc = (self.ids[label], label, state)
            if not end or label.endswith(end):
                self.last[label.removesuffix(end)] = arc
            if not end or not label.endswith(end):
                node: list = [None, self.tree]
                for sign in label:
                    node = node[1].setdefault(sign, [None, {}])
                node[0] = arc

    def _arcs_at(self, word: str, i: int) -> list[tuple[tuple[int, str, int], int]]:
        """Labels that the word has from place i on, and where they end; the longest last."""
        found, below, j = [], self.tree, i
        for sign in word[i : min(i + self.longest, len(word) - 1)]:
            node = below.get(sign)
            if node is None:
                break
            j += 1
            arc, below = node
            if arc is not None:
                found.append((arc, j))
        if len(word) - i <= self.longest and (arc := self.last.get(word[i:])):
            found.append((arc, len(word)))
        return found

    def word(self, word: str) -> list[int]:
        """Ids of one word: the path through the automaton that spells it. Long labels are tried first; a place has one state at
        most, so a place from which the path can't go on is left for good."""
        n, arcs, has = len(word), self.arcs, self.automaton.has
        i = state = 0
        out: list[int] = []
        way, left, found = [], set(), self._arcs_at(word, 0)
        while i < n:
            while found:
                (k, label, to), j = found.pop()
                ok = arcs.get(state << 20 | k)
                if ok is None:
                    if len(arcs) >= ARC_ENTRIES:
                        arcs.clear()
                    arcs[state << 20 | k] = ok = has(state, label)
                if ok and j not in left:
                    way.append((i, state, found))
                    out.append(k)
                    i, state = j, to
                    found = self._arcs_at(word, i) if i < n else []
                    break
            else:
                left.add(i)
                i, state, found = way.pop()
                out.pop()
        return out

    def _chunk(self, chunk: str) -> bytes:
        stem = chunk.rstrip(SIGNS)
        if stem != chunk and LETTERS.fullmatch(stem[-1:]):  # signs after a letter are a word of their own
            return self._known(stem) + self._known(chunk[len(stem) :])
        if LETTERS.fullmatch(chunk):  # one word, and lower case is all there is to normalise
            return np.array(self.word(chunk.lower().encode().decode("latin-1").translate(self.spelled)), "<i4").tobytes()
        normal = self.normal.normalize_str(chunk)
        return np.array([k for piece, _ in self.pieces.pre_tokenize_str(normal) for k in self.word(piece)], "<i4").tobytes()

    def _known(self, chunk: str) -> bytes:
        ids = self.memo.get(chunk)
        if ids is None:
            if len(self.memo) >= MEMO_ENTRIES:
                self.older, self.memo = self.memo, {}
            ids = self.older.get(chunk)
            self.memo[chunk] = ids = self._chunk(chunk) if ids is None else ids
        return ids

    def _plain(self, text: str) -> list[bytes]:
        get, known = self.memo.get, self._known
        low = text.encode().lower().decode()  # bytes: only A-Z change, as normalising would have it
        return [get(chunk) or known(chunk) for chunk in low.replace("\n", " ").split(" ")]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if self.special is None or not any(x in text for x in self.added):
            return b"".join(self._plain(text))
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [np.array([self.added[part]], "<i4").tobytes()] if k % 2 else self._plain(part)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs. The vocabulary's file names no decoder, so a space stands between labels."""
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(file: str = TOKENIZER_FILE) -> Vocabulary:
    """The compiled vocabulary of this Python process; the library's own threads are off."""
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Vocabulary(public_tokenizers.path(file))


def encode(docs: DataFrame, file: str = TOKENIZER_FILE) -> DataFrame:
    """doc_id and the ids of each row's text."""

    def run(batches):
        v = vocabulary(file)
        for b in batches:
            raw = [None if t is None else v.encode(t) for t in b.column(1).to_pylist()]
            bounds = np.cumsum([0] + [len(r or b"") // 4 for r in raw])
            values = pa.array(np.frombuffer(b"".join(r or b"" for r in raw), "<i4"))
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values, mask=pa.array([r is None for r in raw], pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, IDS)


def decode(encoded: DataFrame, file: str = TOKENIZER_FILE) -> DataFrame:
    """``encode``'s rows with the text that their ids stand for."""

    def run(batches):
        v = vocabulary(file)
        for b in batches:
            decoded = [None if ids is None else v.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, TEXT)


def digests(docs: DataFrame, file: str = TOKENIZER_FILE) -> DataFrame:
    """Per row: doc_id, n_tokens, hashes of the ids and of the decoded text; a null text counts as empty."""
    rows = decode(encode(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), file), file)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
