"""Ids by the tokenizers library, each distinct word encoded once for a batch of texts."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np

from .chunk_table import ChunkTable


class WordEncoder:
    """What Tokenizer.encode(text, add_special_tokens=False) gives, for byte-level vocabularies that drop white space and end each word by a suffix.

    No pre-token spans a space or line feed, so texts are cut there and each distinct chunk is encoded once. A chunk made of
    letters up to U+017F and ASCII marks behind them is two pre-tokens, whose letters go to the library's model as its
    normaliser and pre-tokeniser would spell them; all other chunks go through the whole library.
    """

    _MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, cached: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cached = Tokenizer.from_file(path), cached
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in shown]
        self.spelt = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(others)}
        self.words: dict[str, bytes] = {}
        self.encode = ChunkTable(self._learn, strict=False).encode

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """A composed lower-case word of letters."""
        raw = word if word.isascii() else word.encode().decode("latin-1").translate(self.spelt)
        return array("I", [x.id for x in self._tokens(raw)]).tobytes()

    def _learn(self, chunks: list[str]) -> list[bytes]:
        words, out = self.words, []
        if len(words) > self.cached:
            words.clear()
        self._tokens = self.tokenizer.model.tokenize
        words[""] = b""
        for k in chunks:
            k = k.strip(" \n")
            core = k.rstrip(self._MARKS)
            if core.isalpha() and (core.isascii() or max(core) < "\u0180" and "\u0130" not in core):
                tail, core = k[len(core) :], core.lower()
                if (ids := words.get(core)) is None:
                    ids = words[core] = self._word(core)
                if (end := words.get(tail)) is None:
                    end = words[tail] = self._library(tail)
                out.append(ids + end)
            else:
                out.append(self._library(k))
        return out


@lru_cache(2)
def _one(path: str) -> WordEncoder:
    return WordEncoder(path)


def maker(path: str) -> Callable[[], Callable[[Sequence[str]], Iterator[bytes]]]:
    """For token_files.write: one encoder per Python worker."""
    return lambda: _one(path).encode
