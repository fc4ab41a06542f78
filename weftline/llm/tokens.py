"""Token ids by the tokenizers library, with a cache of words.

A byte-level BPE with the usual pattern never joins what lies on both sides of a lone space or line feed between
two other characters. Texts are therefore cut there, and the library encodes each distinct piece once; where white
space runs together, the pieces stay joined and are encoded as they stand. The ids are those of the whole text.
"""

from __future__ import annotations

import functools
import os
from array import array

import numpy as np

MARKS = ",.!?%&*$#;:|"


@functools.cache
def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """``cache``: pieces held at most; a full cache is emptied, so memory stays bounded for any vocabulary."""

    def __init__(self, path: str, cache: int = 1_400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.limit, self.cache, self.starts = cache, {}, {}

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text; null counts as empty."""
        if not text:
            return np.empty(0, self.kind)
        first, *rest = text.replace("\n", " \n").split(" ")
        head = self.starts.get(first)
        if head is None and _plain(first) and first[0] != "\n":
            if len(self.starts) >= self.limit:
                self.starts.clear()
            head = self.starts[first] = self._bytes([first])[0]
        if head is not None:
            found = list(map(self.cache.get, rest))
            if None not in found:
                return np.frombuffer(head + b"".join(found), self.kind)
            gaps = [k for k, x in enumerate(found) if x is None]
            new = {rest[k] for k in gaps}
            if all(map(_plain, new - set(map(str.strip, new)))) and "" not in new:
                if len(self.cache) + 2 * len(new) > self.limit:
                    self.cache.clear()
                self._add(new)
                for k in gaps:
                    found[k] = self.cache[rest[k]]
                return np.frombuffer(head + b"".join(found), self.kind)
        return self._general(first, rest)

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, new: set[str]) -> None:
        """Caches pieces that stand after a space, or after the line feed that they begin with.

        A mark after a letter or digit begins a part of its own, so a word and the marks at its end are encoded
        apart and words are looked up without them.
        """
        cut = [(p, w) for p, w in zip(new, map(_unmarked, new)) if w != p and w and w[-1].isalpha()]
        words = new.difference(p for p, _ in cut)
        words.update(w for _, w in cut)
        words = [w for w in words if w not in self.cache]
        self.cache |= zip(words, self._bytes([w if w[0] == "\n" else " " + w for w in words]))
        for p, word in cut:
            marks = p[len(word) :]
            tail = self.starts.get(marks)
            if tail is None:
                tail = self.starts[marks] = self._bytes([marks])[0]
            self.cache[p] = self.cache[word] + tail

    def _general(self, first: str, rest: list[str]) -> np.ndarray:
        """Pieces with white space at their ends stay joined to their neighbours; nothing is cached."""
        chunks, after = [first], first
        for p in rest:
            body = p[1:] if p[:1] == "\n" else p
            whole = p if p[:1] == "\n" else " " + p
            if after and not after[-1].isspace() and body and not body[0].isspace():
                chunks.append(whole)
            else:
                chunks[-1] += whole
            after = whole
        distinct = list(dict.fromkeys(chunks))
        coded = dict(zip(distinct, self._bytes(distinct)))
        return np.frombuffer(b"".join(map(coded.__getitem__, chunks)), self.kind)


def _unmarked(piece: str) -> str:
    return piece.rstrip(MARKS)


def _plain(piece: str) -> bool:
    """Whether the piece, after a space or the line feed it begins with, has other characters at both ends."""
    body = piece[1:] if piece[:1] == "\n" else piece
    return bool(body) and not body[0].isspace() and not body[-1].isspace()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker."""
    return Encoder(path)
