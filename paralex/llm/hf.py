"""Ids of whole texts by the ``tokenizers`` library.

A byte-level tokenizer treats each match of its pattern alone, so each distinct
match is given to the library's model once, in the alphabet that the format
writes bytes in, and texts are put together from these ids.
Strings of special tokens in a text are ordinary text, as the vocabulary's
README sets it.
"""

from __future__ import annotations

import functools
import json
from array import array
from itertools import accumulate, chain, pairwise
from operator import attrgetter

from paralex.llm.common import tokenizer_file
from paralex.llm.pretokens import CACHE_WORDS, PieceEncoder

FILE = "byte_bpe_50k.json"
#: Matches whose tokens are held at once.
AT_ONCE = 4096


def byte_alphabet() -> dict[str, str]:
    """The character that stands for each byte: itself if it is printable Latin-1,
    else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = {}, 256
    for b in range(256):
        out[chr(b)] = chr(b if b in plain else spare)
        spare += b not in plain
    return out


class LibraryEncoder:
    def __init__(self, path: str | None = None, words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        place = tokenizer_file(FILE, path)
        self.library = Tokenizer.from_file(place)
        self.library.encode_special_tokens = True
        with open(place, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        #: Matches can be encoded alone only if nothing else looks at the text.
        self.apart = (
            kind.get("type") == "ByteLevel"
            and not kind.get("add_prefix_space")
            and kind.get("use_regex", True)
            and spec.get("normalizer") is None
            and spec["model"]["type"] == "BPE"
        )
        self.alphabet = str.maketrans(byte_alphabet())
        self.pieces = PieceEncoder(self._matches, words)

    def width(self, *more: int) -> int:
        """Bytes that hold any id of the vocabulary and the ids ``more``: 2 or 4."""
        return 2 if max(*more, *self.library.get_vocab(with_added_tokens=True).values(), 0) < 1 << 16 else 4

    def _many(self, texts: list[str]) -> list[bytes]:
        done = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in done]

    def _matches(self, words: list[str]) -> list[bytes]:
        tokenize, out = self.library.model.tokenize, []
        for first in range(0, len(words), AT_ONCE):
            raw = [w.encode() for w in words[first : first + AT_ONCE]]
            spelt = b"".join(raw).decode("latin-1").translate(self.alphabet)
            found = [tokenize(spelt[i:j]) for i, j in pairwise(accumulate(map(len, raw), initial=0))]
            ids = array("I", map(attrgetter("id"), chain.from_iterable(found))).tobytes()
            out += [ids[4 * i : 4 * j] for i, j in pairwise(accumulate(map(len, found), initial=0))]
        return out

    def encode(self, texts: list[str]):
        """Yield the little-endian 32-bit ids of each text, as bytes."""
        if not self.apart:
            yield from self._many(texts)
            return
        yield from self.pieces.encode(texts)


@functools.lru_cache(maxsize=2)
def encoder(path: str | None = None, words: int = CACHE_WORDS) -> LibraryEncoder:
    """The encoder of this worker process, which remembers about ``words`` matches."""
    return LibraryEncoder(path, words)
