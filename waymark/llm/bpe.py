"""Byte-pair encodings of whole texts, with the words that a worker has met kept.

Both tokenizers part a text by a pattern before they merge bytes, and never merge across what the pattern parts. So the
encoding of a text is that of its chunks in order; a worker process keeps chunks and words, and encodes new words
together. It keeps them in two halves, of which the older one goes when the younger is full: what comes again in time moves on,
and words that come once don't drive out the common ones.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np

class ChunkEncoder:
    """Encodes texts chunk by chunk into bytes; `encoded` makes the bytes of what is met for the first time."""

    #: Python takes these for white space, the tokenizers take them for symbols: texts with one are encoded whole.
    SEPARATORS = "\x1c\x1d\x1e\x1f"
    #: Words that are encoded as one input, and bytes that are kept of a token.
    TOGETHER, WIDTH = 256, 4

    def __init__(self, path: str, words: str, most: int = 200_000, most_chars: int = 8_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.most_chars, self.chars = Tokenizer.from_file(path), most, most_chars, 0
        # Words that have been parted, and have nothing to normalise, need the merges alone.
        parts = {"normalizer": None, "post_processor": None, "decoder": None, "added_tokens": []}
        parts["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        self.merges = Tokenizer.from_str(json.dumps(json.loads(self.tokenizer.to_str()) | parts))
        self.met: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.split: Callable[[str], list[str]] = regex.compile(words).findall
        self.latin = regex.compile("[\\s -~\xa1-įı-ɏ]*").fullmatch

    def chunks(self, text: str) -> list[str]:
        """What the text parts into at white space."""
        raise NotImplementedError

    def is_word(self, chunk: str) -> bool:
        """Whether the tokenizer certainly takes the chunk as one word."""
        raise NotImplementedError

    def packed(self, ids: list[int]) -> bytes:
        """What is kept of the ids of a chunk."""
        raise NotImplementedError

    def encoded(self, texts: list[str]) -> list[bytes]:
        """The whole texts' encodings."""
        return [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded_words(self, words: list[str]) -> list[bytes]:
        """The encodings of single words in Latin letters, as the tokenizer makes them; many words are one input."""
        groups = [words[i : i + self.TOGETHER] for i in range(0, len(words), self.TOGETHER)]
        out: list[bytes] = []
        for group, e in zip(groups, self.merges.encode_batch(groups, is_pretokenized=True, add_special_tokens=False), strict=True):
            data = self.packed(e.ids)
            ends = (self.WIDTH * np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(group)))).tolist()
            out += [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]
        return out

    def learn(self, new: set[str]) -> None:
        """Words are encoded together. Other Latin chunks without a tokenizer's own markers are made up of words; what is left is encoded as it is."""
        parts: dict[str, list[str]] = {}
        words, other = set(), []
        for c in new:
            if not (c.isascii() or self.latin(c)) or "<|" in c:
                other.append(c)
            elif self.is_word(c):
                words.add(c)
            else:
                parts[c] = self.split(c)
        for p in parts.values():
            words.update(p)
        fresh = self.unknown(words)
        self.met.update(zip(fresh, self.encoded_words(list(fresh)), strict=True))
        self.met.update(zip(other, self.encoded(other), strict=True))
        for chunk, found in parts.items():
            self.met[chunk] = b"".join([self.met[w] for w in found])
        self.chars += sum(map(len, fresh)) + sum(map(len, other)) + sum(map(len, parts))

    def unknown(self, chunks: set[str]) -> set[str]:
        """Those of the chunks that have to be learned; of the others, what the older half has moves on to the younger."""
        new = chunks.difference(self.met)
        again = new.intersection(self.before)
        self.met.update((c, self.before[c]) for c in again)
        self.chars += sum(map(len, again))
        return new - again

    def texts(self, texts: list[str]) -> list[bytes]:
        """The encoding of each whole text."""
        split = [None if any(c in t for c in self.SEPARATORS) else self.chunks(t) for t in texts]
        if 2 * len(self.met) > self.most or 2 * self.chars > self.most_chars:
            self.before, self.met, self.chars = self.met, {}, 0
        if new := self.unknown(set().union(*filter(None, split))):
            self.learn(new)
        met = self.met
        return [b"".join(map(met.__getitem__, chunks)) if chunks is not None else self.encoded([t])[0] for t, chunks in zip(texts, split, strict=True)]


class WordIds(ChunkEncoder):
    """Ids, as little-endian unsigned 32-bit numbers, by a lower-casing word BPE that drops white space."""

    def __init__(self, path: str):
        super().__init__(path, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        by_case = self.split
        self.split = lambda chunk: by_case(chunk.lower())
        # The same pattern for Latin texts, which Python's own engine applies sooner.
        lower = sorted({chr(k).lower() for k in range(0x80, 0x250) if k != 0x130})
        letters, numbers = ("".join(c for c in lower if unicodedata.category(c)[0] == kind) for kind in "LN")
        self.parted = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{letters}]+|[0-9{numbers}]|[^\sa-z0-9{letters}{numbers}]+").findall

    def chunks(self, text: str) -> list[str]:
        # Beyond Latin, lower case may depend on the neighbours; the tokenizer sees to it.
        if not (text.isascii() or self.latin(text)):
            return text.split()
        # Words are kept without the signs beside them, but for a tokenizer's own markers.
        return text.lower().split() if "<|" in text else self.parted(text.lower())

    def is_word(self, chunk: str) -> bool:
        return chunk.isalpha() and chunk == chunk.lower()

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()


class ByteLengths(ChunkEncoder):
    """The UTF-8 bytes of each token, as unsigned 16-bit numbers, by a byte-level BPE: such tokens add up to the text."""

    WIDTH = 2

    def __init__(self, path: str):
        super().__init__(path, r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.tokenizer.encode_special_tokens = True
        self.chunks = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
        vocabulary = self.tokenizer.get_vocab()
        # One character of a vocabulary entry stands for one byte.
        self.length = {k: len(token) for token, k in vocabulary.items()}

    def is_word(self, chunk: str) -> bool:
        return chunk.isalpha() or chunk[0] == " " and chunk[1:].isalpha()

    def packed(self, ids: list[int]) -> bytes:
        return np.array([self.length[k] for k in ids], "<u2").tobytes()


_encoders: dict[tuple[type, str], ChunkEncoder] = {}


def encode(kind: type[ChunkEncoder], path: str, texts: list[str]) -> list[bytes]:
    """The encodings of whole texts; the worker process keeps what it has learned."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path].texts(texts)
