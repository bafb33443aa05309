"""Token ids of a byte-level BPE tokenizer file, kept per distinct word with the white space before it.

Words are parted at single spaces and newlines, at which the tokenizer parts too. Words that aren't known yet are encoded together by a faster
library whose ranks are read from the same file; texts with other white space, runs of it, or the opening of a special token go to the tokenizer whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

# fixed value: the pattern of this kind of tokenizer
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 1_000_000
_OPEN: dict[str, ByteTokenizer] = {}


def _plain(text: str) -> bool:
    """Whether all white space of a text is single spaces and newlines, or two newlines before a word, and no special token opens in it."""
    return text.replace("\n", "").isprintable() and not any(x in text for x in ("  ", " \n", "\n\n\n", "<|")) and not text.endswith((" ", "\n\n"))


def _byte_of() -> dict[str, int]:
    """The byte that each printable stand-in of the file means: printable Latin-1 bytes stand for themselves, the others follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        byte_of = _byte_of()
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        special = {t["content"] for t in told["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in special}
        size = self.library.get_vocab_size()
        self.size, self.stops, self.opens = np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size, bool)
        self.breaks = np.zeros(size, bool)
        for t, i in ranks.items():
            self.size[i], self.stops[i], self.opens[i], self.breaks[i] = len(t), t[-1:] in b".!?", t[:1] in b" \n", b"\n" in t
        self.fast = self._fast(ranks, told)
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _fast(ranks: dict[bytes, int], told: dict):
        """An encoder by ranks, if the file's merges come in the order of their ids and its words are cut by the usual pattern."""
        pairs = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in told["model"]["merges"]]
        ids = [told["model"]["vocab"][p] for p in pairs]
        cut = told["pre_tokenizer"]
        if told["normalizer"] is not None or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or ids != sorted(ids) or len(pairs) + 256 != len(ranks):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _learn(self, words: list[str]) -> None:
        if len(self.words) > MEMO:
            self.words.clear()
        shown = [w if w[:1] == "\n" else " " + w for w in words]
        if self.fast is None:
            self.words.update((w, np.array(self.library.encode(s, add_special_tokens=False).ids, "<u4").tobytes()) for w, s in zip(words, shown, strict=True))
            return
        ids = np.array(self.fast("".join(shown)), "<u4")
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(s.encode()) for s in shown])) + 1
        raw, at = ids.tobytes(), 0
        for w, e in zip(words, (4 * ends).tolist(), strict=True):
            self.words[w] = raw[at:e]
            at = e

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if not _plain(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        first, *words = text.replace("\n", " \n").split(" ")
        rows = list(map(self.words.get, words))
        if None in rows:
            self._learn(list({w for w, r in zip(words, rows, strict=True) if r is None}))
            rows = [self.words.get(w) if r is None else r for w, r in zip(words, rows, strict=True)]
        head = np.array((self.fast or (lambda s: self.library.encode(s, add_special_tokens=False).ids))(first), "<u4") if first else np.zeros(0, "<u4")
        return np.concatenate((head, np.frombuffer(b"".join(rows), "<u4")))

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of tokens after which a sentence ends: a stop before white space, or a token with a newline."""
        if len(ids) < 2:
            return np.zeros(0, np.int64)
        return np.flatnonzero((self.stops[ids[:-1]] & self.opens[ids[1:]]) | self.breaks[ids[:-1]]) + 1


def byte_tokenizer(path: str) -> ByteTokenizer:
    if path not in _OPEN:
        _OPEN[path] = ByteTokenizer(path)
    return _OPEN[path]
