"""Token ids of whole texts by public tokenizer files (JSON of the tokenizers library).

The library defines the ids. It spends most of its time on offsets and normalisation that ids don't need, so two
shorter ways with equal results stand before it, each for the texts that it is right for:

- byte-level vocabularies without a normaliser: the same vocabulary as ranks, by tiktoken;
- word vocabularies (white space dropped, lower case, an end mark on each word): texts are split at white space,
  words of Latin letters are split and lower-cased here and merged by ranks, and words are remembered.

All other words and texts, those that hold an added token's content, and whatever the short way refuses, go through the
library itself, unaltered. Null texts are empty to callers; empty texts have no ids. Very long texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from functools import lru_cache

import numpy as np

#: Words remembered by a worker, some 120 bytes each; the memory is emptied when full.
CACHE_WORDS = 400_000
#: Splits of the byte-level pre-tokenizer.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stands for the end of a word; UTF-8 never has it.
END = b"\xff"


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts to the ids (uint32) that the library gives without adding special tokens."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.split = regex.compile(_WORD).findall
        self.library = Tokenizer.from_file(path)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.by_word = bool(self.suffix)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.mark = os.path.commonprefix(self.added)
        self.cache: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.ranks = self._ranks(spec)

    def _ranks(self, spec: dict):
        import tiktoken

        byte_of = byte_of_symbol()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {}
        for token, rank in spec["model"]["vocab"].items():
            if token in special:
                continue
            stem = token.removesuffix(self.suffix) if self.suffix else token
            ranks[bytes(byte_of[c] for c in stem) + (END if stem != token else b"")] = rank
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self._by_words(t) for t in texts] if self.by_word else [self._by_bytes(t) for t in texts]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def _apart(self, text: str) -> bool:
        """Whether only the library is right: added tokens, and characters that are white space to some libraries alone."""
        if self.added and self.mark in text and any(t in text for t in self.added):
            return True
        return any(c in text for c in "\x1c\x1d\x1e\x1f")

    def _by_bytes(self, text: str) -> np.ndarray:
        if self._apart(text):
            return self._whole(text)
        try:
            return np.array(self.ranks.encode_ordinary(text), "<u4")
        except BaseException as error:  # a panic of the regular expressions on very long runs
            if isinstance(error, KeyboardInterrupt | SystemExit):
                raise
            return self._whole(text)

    def _by_words(self, text: str) -> np.ndarray:
        if self._apart(text):
            return self._whole(text)
        words, cache = text.split(), self.cache
        new = set(words).difference(cache)
        if new:
            if len(cache) + len(new) > CACHE_WORDS:
                cache.clear()
                new = set(words)
            self._learn(new)
        return np.frombuffer(b"".join(map(cache.__getitem__, words)), self.dtype.newbyteorder("=")).astype("<u4")

    def _learn(self, words: set[str]) -> None:
        merge, dtype, cache, split = self.ranks._core_bpe.encode_single_piece, self.dtype.newbyteorder("="), self.cache, self.split
        code = "H" if dtype.itemsize == 2 else "I"
        rest, stems = [], self.stems
        if len(stems) > CACHE_WORDS:
            stems.clear()
        for w in words:
            if len(w) > 60 or (not w.isascii() and (max(w) >= "ƀ" or "İ" in w)):
                rest.append(w)
                continue
            if w.isalpha():
                parts = (w.lower(),)
            elif w[-1] in ".,;:!?" and w[:-1].isalpha():
                parts = (w[:-1].lower(), w[-1])
            else:
                parts = split(w.lower())
            found = [stems.get(p) or stems.setdefault(p, array(code, merge(p.encode() + END)).tobytes()) for p in parts]
            cache[w] = found[0] if len(found) == 1 else b"".join(found)
        for w, encoding in zip(rest, self.library.encode_batch(rest, add_special_tokens=False), strict=True):
            cache[w] = np.array(encoding.ids, dtype).tobytes()


#: Splits within a word of word vocabularies.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a file."""
    return Encoder(path)


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
