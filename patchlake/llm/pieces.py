"""SentencePiece (merge-type) encoding and decoding by a prefix table.

A merge-type encoding is determined by its prefixes: each prefix of a text has one encoding, and that encoding's
last token is unique. Going through a text, an automaton gives all vocabulary pieces that end at a
position; a piece is the prefix's last token if it is compatible with the last token of the prefix before
it, that is, if the two pieces joined encode to just these two. The ids are then recovered backwards.
Where no piece of the vocabulary spans two neighbouring characters no merge can cross, so texts are cut there
and the table is kept per distinct part.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame

SPACE = "▁"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
MEMO = 500_000
#: Texts on which another normaliser, prefix or treatment of white space than the plain one shows.
_PROBES = ("a", " a", "a  b ", "\u3000x\u00a0", "\uff21\ufb01 e\u0301", "\u200bz\t\r\n", "\u2581 \u2581a")
_CODECS: dict[str, PieceCodec] = {}


class PieceCodec:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece: list[str | None] = []
        self.byte: dict[int, int] = {}
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.fallback: dict[int, int] = {}
        self.unknown = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            plain = not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            self.piece.append(p if plain else None)
            if model.is_byte(i):
                self.byte[i] = int(p[1:-1], 16)
                self.fallback[self.byte[i]] = i
            elif plain:
                self.score[p], self.ids[p] = model.get_score(i), i
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.spans = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.parts: dict[str, list[int]] = {}
        self.chunks: dict[str, tuple[str, int, str]] = {}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with spaces behind other characters are not supported")
        for text in _PROBES:
            ids = model.encode(text)
            if self.encode(text) != ids or self.decode(ids) != model.decode(ids):
                raise ValueError(f"the model normalises or cuts {text!r} in a way that is not supported")

    def merge(self, text: str) -> list[str]:
        """The defining procedure, for short strings: merge the best-scored neighbours, leftmost first among equals."""
        out, score = list(text), self.score.get
        best = [score(a + b, -1e30) for a, b in zip(out, out[1:], strict=False)]
        while best and (top := max(best)) > -1e30:
            k = best.index(top)
            out[k : k + 2] = [out[k] + out[k + 1]]
            del best[k]
            if k:
                best[k - 1] = score(out[k - 1] + out[k], -1e30)
            if k < len(best):
                best[k] = score(out[k] + out[k + 1], -1e30)
        return out

    def _fits(self, left: int, right: int) -> bool:
        known = self.compatible.get((left, right))
        if known is None:
            a, b = self.piece[left], self.piece[right]
            known = self.compatible[left, right] = self.merge(a + b) == [a, b]
        return known

    def _table(self, text: str) -> list[int]:
        """Ids of a text whose characters are all pieces."""
        last: list[tuple[int, int] | None] = [None] * (len(text) + 1)
        for end, (token, size) in self.automaton.iter(text):
            if last[end + 1] is None:
                start = end + 1 - size
                before = last[start]
                if start == 0 and self.merge_whole(token) or before is not None and self._fits(before[0], token):
                    last[end + 1] = (token, start)
        ids, at = [], len(text)
        while at:
            token, at = last[at]
            ids.append(token)
        return ids[::-1]

    def merge_whole(self, token: int) -> bool:
        """Whether a piece alone encodes to itself."""
        known = self.compatible.get((token, -1))
        if known is None:
            known = self.compatible[token, -1] = self.merge(self.piece[token]) == [self.piece[token]]
        return known

    def _part(self, text: str) -> list[int]:
        ids = self.parts.get(text)
        if ids is None:
            if len(self.parts) > MEMO:
                self.parts.clear()
            if len(text) == 1 and text not in self.ids:
                raw = text.encode("utf-8", "replace")
                ids = [self.fallback[b] for b in raw] if self.fallback else [self.unknown]
            else:
                ids = self._table(text)
            self.parts[text] = ids
        return ids

    def _chunk(self, text: str) -> list[int]:
        ids, start = [], 0
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in self.spans:
                ids += self._part(text[start:k])
                start = k
        return ids + self._part(text[start:])

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return [i for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE)) for i in self._chunk(c)]

    def _surface(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.piece[i] if self.piece[i] is not None else " ⁇ " if i == self.unknown else "")
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        text = self._surface(ids)
        return text[1:] if text.startswith(" ") else text

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal joined by commas, and the decoded text; by distinct chunk."""
        if not text:
            return 0, "", ""
        chunks = self.chunks
        if len(chunks) > MEMO:
            chunks.clear()
        cut = _CHUNK.findall(SPACE + text.replace(" ", SPACE))
        rows = list(map(chunks.get, cut))
        if None in rows:
            for k, row in enumerate(rows):
                if row is None:
                    ids = self._chunk(cut[k])
                    rows[k] = chunks[cut[k]] = (",".join(map(str, ids)), len(ids), self._surface(ids))
        names, sizes, parts = zip(*rows, strict=True)
        text = "".join(parts)
        return sum(sizes), ",".join(names), text[1:] if text.startswith(" ") else text


def codec(path: str) -> PieceCodec:
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> of each text, as the sentencepiece library encodes it; null and empty texts have no ids."""

    def run(batches):
        c = codec(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": [c.encode(t) for t in pdf["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text decoded from ids (null ids: empty text)."""

    def run(batches):
        c = codec(path)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": [c.decode([int(i) for i in ids]) if ids is not None else "" for ids in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text's ids and of the text decoded from them.

    Null and empty texts have no ids and decode to the empty text. Any row comes out once, null ids included.
    """

    def run(batches):
        c = codec(path)
        for pdf in batches:
            rows = [c.digest(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": [r[0] for r in rows], "ids_sha256": [hashlib.sha256(r[1].encode()).hexdigest() for r in rows], "decoded_sha256": [hashlib.sha256(r[2].encode("utf-8", "replace")).hexdigest() for r in rows]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
