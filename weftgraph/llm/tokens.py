"""Byte-level BPE ids of whole texts, through a cache of chunks.

The vocabulary's pattern never lets a merge cross from a character to white space after it, and
cuts runs of white space as ``CHUNK`` does. So a text's ids are the ids of its chunks (a word with
the space before it, or white space) one after another, and only chunks that a worker has not met
are encoded. Special strings in a text are ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

CACHE_ENTRIES = 400_000
#: Longer chunks are encoded each time.
CACHE_CHARS = 64
CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Texts without this are lines of words with one space between.
UNPLAIN = re.compile(r"[^\S \n]")
#: White space for Python but not for the tokenizer; texts with it are encoded as a whole.
ODD = re.compile("[\x1c-\x1f]")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Of one vocabulary file. Its ids are in the order of its merges, so they serve as ranks."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = self.tokenizer.get_added_tokens_decoder()
        byte = _byte_of()
        ranks = {bytes(map(byte.__getitem__, w)): i for w, i in self.tokenizer.get_vocab().items() if i not in special}
        self.ranked = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        #: Ids of chunks as they are, and of words after a space.
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _all(self, chunks: list[str], cache: dict[str, bytes], before: str = "") -> list[bytes]:
        out = list(map(cache.get, chunks))
        if None in out:
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
            for i, got in enumerate(out):
                if got is None:
                    c = chunks[i]
                    out[i] = ids = cache.get(c) or array("I", self.ranked(before + c)).tobytes()
                    if len(c) <= CACHE_CHARS:
                        cache[c] = ids
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if UNPLAIN.search(text) or "  " in text or "\n\n" in text or "\n " in text or " \n" in text or text[-1:] in (" ", "\n"):
            return self.whole(text) if ODD.search(text) else b"".join(self._all(CHUNK.findall(text), self.first))
        newline, out = self._all(["\n"], self.first)[0], []
        for line in text.split("\n"):
            words = line.split(" ")
            if words[0]:
                out += self._all(words[:1], self.first)
            if len(words) > 1:
                del words[0]
                out += self._all(words, self.later, " ")
            out.append(newline)
        return b"".join(out[:-1])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
