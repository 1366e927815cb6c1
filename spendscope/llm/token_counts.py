"""Token counts of a unigram vocabulary without making tokens.

An Aho-Corasick automaton lists all vocabulary pieces that occur in a text; dynamic programming carries, for each
place, the best score and the number of pieces of the path that has it. Ties are the exact tokenizer's: of equal
scores at a place the path whose last piece starts first stays. A character that is no piece costs the lowest
score less ``UNKNOWN_PENALTY`` and counts as its bytes (byte fallback).

Spaces are spelled as the vocabulary does and one is put before the text. No piece reaches over the begin of
a word, and whole-number scores add up exactly, so the best path of a text is that of its words and each word is
counted once and remembered. Where a vocabulary has other pieces or scores, texts are counted whole.

The vocabulary is a public file's pieces with the scores it states; nothing is trained.

Defined cases: null and empty texts have no token; rows with one doc_id are counted alike; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from spendscope.llm.common import batch, texts

VOCABULARY_FILE = "piece_bpe_32k.model"
SPACE = "▁"
CUT = "\x1f"
UNKNOWN_PENALTY = 10.0
#: Words of one generation of a Python worker's memo; two generations are kept.
MEMO_ENTRIES = 400_000

_COUNT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
COUNT = "doc_id long, n_tokens long"


def vocabulary(file: str = VOCABULARY_FILE) -> list[tuple[str, float]]:
    """Pieces and scores of the file, without its control pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(file))
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.get_piece_size()) if not model.is_control(i)]


class PieceCounter(dict):
    """Number of pieces by chunk: a word with the space before it, or a line's first word."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        exact = all(s == int(s) for _, s in pieces)
        self.by_word = exact and not any(SPACE in p.lstrip(SPACE) or "\n" in p[:-1] + p[1:] for p, _ in pieces)
        self.feed = self.best("\n")
        self.older: dict[str, int] = {}

    def best(self, text: str) -> int:
        """Number of pieces on the best path through ``text``."""
        score, count = [0.0], [0]
        matches = self.automaton.iter(text)  # by end; of equal ends the longest first
        last, piece = next(matches, (-1, None))
        for at, char in enumerate(text):
            top, n, known = None, 0, False
            while last == at:
                size, s = piece
                got = score[at + 1 - size] + s
                if top is None or got > top:
                    top, n = got, count[at + 1 - size] + 1
                known |= size == 1
                last, piece = next(matches, (-1, None))
            if not known and (top is None or score[at] + self.unknown > top):
                top, n = score[at] + self.unknown, count[at] + len(char.encode("utf-8", "surrogatepass"))
            score.append(top)
            count.append(n)
        return count[-1]

    def __missing__(self, chunk: str) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.older = dict(self)
            self.clear()
        n = self.older.get(chunk)
        self[chunk] = n = self.best(chunk) if n is None else n
        return n

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if not self.by_word or SPACE * 2 in text or CUT in text:
            return self.best(text)
        cut = text.replace(SPACE, CUT + SPACE).replace("\n", CUT + "\n" + CUT)
        return sum(map(self.__getitem__, cut.split(CUT)))


@lru_cache(maxsize=2)
def counter(file: str = VOCABULARY_FILE) -> PieceCounter:
    return PieceCounter(vocabulary(file))


def token_counts(docs: DataFrame, file: str = VOCABULARY_FILE) -> DataFrame:
    """Per row: doc_id and the number of tokens of its whole text."""

    def count(batches):
        tokens = counter(file).tokens
        for b in batches:
            yield batch({"doc_id": b.column(0), "n_tokens": [tokens(t) for t in b.column(1).to_pylist()]}, _COUNT)

    return texts(docs).mapInArrow(count, COUNT)
