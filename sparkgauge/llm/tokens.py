"""Token ids and token counts inside tasks; counts go through bounded worker caches."""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import regex


def place(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Runs of white space from this length on go to the library; tiktoken panics somewhere between 700,000 and 1,000,000.
RUN = 1 << 16
BLANK = re.compile(rf"(?<!\s)\s{{{RUN}}}")


class ByteBpe:
    """Ids of the byte-level BPE as little-endian uint32 bytes, the same as the tokenizers library gives.

    The vocabulary's ranks (tiktoken) encode whole texts several times faster than the library, and faster
    than a cache of words over texts with many rare words. Whole texts go to the library where they hold
    the start of a special string, which it knows, or a long run of white space, on which tiktoken's
    backtracking ends in a panic; so does any other text on which tiktoken panics.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = path or place("byte_bpe_50k.json")
        self.whole = Tokenizer.from_file(path)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.replace(".json", ".tiktoken"), "rb"))}
        self.ranks = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return np.array(self.ids(text), "<u4").tobytes()

    def ids(self, text: str) -> list[int]:
        if "<|" not in text and not (len(text) >= RUN and BLANK.search(text)):
            try:
                return self.ranks.encode_ordinary(text)
            except BaseException as e:  # a panic is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        return self.whole.encode(text, add_special_tokens=False).ids


class WordBpe:
    """Token counts of the word BPE: the counts of a text's pre-tokens, which the tokenizer's pattern gives, add up.

    Counts of frequent pre-tokens are given, others come from the library and stay in a cache that starts
    anew with the given ones when it is full. White space is in no pre-token.
    """

    def __init__(self, path: str | None = None, frequent: dict[str, int] | None = None, cache: int = 250_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path or place("word_bpe_49k.json"))
        self.frequent, self.size = frequent or {}, cache
        self.known = dict(self.frequent)

    def length(self, text: str) -> int:
        return len(self.whole.encode(text, add_special_tokens=False))

    def plain(self, text: str) -> str:
        """The text as the tokenizer normalises it, but for white space. Lower-casing a final sigma is its own."""
        if text.isascii() or "\u03a3" not in text and unicodedata.is_normalized("NFC", text):
            return text.lower()
        return self.whole.normalizer.normalize_str(text)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, many at a time but never all of a very long one."""
        if len(text) <= 1 << 20:
            yield PIECE.findall(self.plain(text))
        else:
            found = (m[0] for m in PIECE.finditer(self.plain(text)))
            while part := list(islice(found, 1 << 17)):
                yield part

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "<|" in text:  # special strings, which the library knows
            return self.length(text)
        return sum(map(self.part, self.pieces(text)))

    def part(self, pieces: list[str]) -> int:
        known = self.known
        if missing := list(set(pieces).difference(known)):
            known.update(zip(missing, map(len, self.whole.encode_batch_fast(missing, add_special_tokens=False)), strict=True))
        n = sum(map(known.__getitem__, pieces))
        for p in missing:
            if len(p) > 64:
                del known[p]
        if len(known) > self.size + len(self.frequent):
            self.known = dict(self.frequent)
        return n


#: The word BPE's pattern for pre-tokens.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
