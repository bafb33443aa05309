"""Token ids of a word-level BPE tokenizer file, kept per distinct word.

The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are its words' ids in a row. Texts with
anything beyond PLAIN characters, or with the opening of a special token, go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

_ODD = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ‘’“”–—]|<\\|")
MEMO = 400_000
_OPEN: dict[str, WordTokenizer] = {}


class WordTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall  # fixed values: the file's own pattern
        self.model = self.library.model
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.bytes = {ord(c): shown(c)[0][0] for c in map(chr, [*range(33, 127), *range(192, 256), *map(ord, "‘’“”–—")])}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.words) > MEMO:
            self.words.clear()
        if len(self.parts) > MEMO:
            self.parts.clear()
        cuts = {w: self.cut(w) for w in words}
        for c in cuts.values():
            for p in c:
                if p not in self.parts:
                    self.parts[p] = np.array([t.id for t in self.model.tokenize(p.translate(self.bytes))], "<u4").tobytes()
        for w, c in cuts.items():
            self.words[w] = self.parts[c[0]] if len(c) == 1 else b"".join([self.parts[p] for p in c])

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        if _ODD.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        rows = list(map(self.words.get, words))
        if None in rows:
            missing = {w for w, r in zip(words, rows, strict=True) if r is None}
            self._learn(missing)
            rows = [self.words[w] if r is None else r for w, r in zip(words, rows, strict=True)]
        return b"".join(rows)


def tokenizer(path: str) -> WordTokenizer:
    if path not in _OPEN:
        _OPEN[path] = WordTokenizer(path)
    return _OPEN[path]
