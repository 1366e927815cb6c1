"""Token ids of whole texts, chunk by chunk with a bounded memo of the chunks' ids.

A byte-level BPE tokenizer first cuts a text by the pattern that the vocabulary's makers published; merges
never cross a cut. In a text whose white space is single spaces and single line feeds between other
characters, three places are sure to be cuts, whatever else stands around them: before a space, and before and
after a line feed. So such a text is cut there, each chunk is encoded alone, and the ids are the same. Words
repeat, so most chunks are found in the memo. Any other text goes through the tokenizer whole.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

TOKENIZER_FILE = "byte_bpe_50k.json"
#: Chunks of one generation of the memo of a Python worker (about 200 bytes each); two generations are kept.
MEMO_ENTRIES = 300_000
#: White space but for space and line feed, as Unicode has it.
OTHER_SPACE = [chr(c) for c in range(0x10000) if chr(c).isspace() and chr(c) not in " \n"]
CUT = "\x1f"  # one of them, so no text that is cut holds it


def plain_spaced(text: str) -> bool:
    """Whether each white space is a single space or line feed between other characters."""
    return not (
        text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        or any(x in text for x in OTHER_SPACE)
    )


SIGNS = "!#$%&*.,;:?"


class _Memo(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MEMO_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids = self.older.get(chunk) or self.encode(chunk)
        return ids


def _packed(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def byte_signs() -> dict[int, str]:
    """How byte-level vocabularies spell each byte: visible Latin-1 characters as they are, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class TokenEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelled = byte_signs()
        self.memo = _Memo(self._chunk)

    def plain(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(SIGNS)
        if word != chunk and word[-1:].isalpha():  # signs after a letter are a piece of their own
            return self.memo[word] + self.memo[chunk[len(word) :]]
        if (chunk[1:] if chunk[0] == " " else chunk).isalpha():  # one piece: the model alone will do
            pieces = [chunk.encode().decode("latin-1").translate(self.spelled)]
        else:
            pieces = [piece for piece, _ in self.pieces(chunk)]
        return _packed([t.id for piece in pieces for t in self.model.tokenize(piece)])

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; of null and of the empty text, none."""
        if not text:
            return b""
        if not plain_spaced(text) or any(x in text for x in self.added):  # added tokens go before the pattern
            return self.plain(text)
        cut = text.replace(" ", CUT + " ").replace("\n", CUT + "\n" + CUT)
        return b"".join(map(self.memo.__getitem__, cut.split(CUT)))


@lru_cache(maxsize=2)
def encoder(file: str = TOKENIZER_FILE) -> TokenEncoder:
    """The encoder of this Python process. The library's own threads are off: Spark deals out the cores."""
    import os

    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TokenEncoder(public_tokenizers.path(file))


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
