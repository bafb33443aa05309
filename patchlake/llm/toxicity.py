"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, trained in numpy.

A text is cut into overlapping windows of WIDTH words, every one is scored, and the text's score is its windows'
greatest. A word enters as the learned vector of its hash, if it is in the vocabulary of the training sample, plus the mean of
the learned vectors of its bytes. Labels are given per text only, so training alternates between fitting windows and
choosing them anew: the best windows of texts labelled 1 as positives, the best and some others of the rest as negatives.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.llm.common import _BASE, _BYTE, _SPACE, _mix, byte_blocks
from patchlake.llm.langid import held_out
from patchlake.llm.nn import adam, sigmoid

WIDTH, STRIDE = 40, 32
HIDDEN, EMBED, CHARS = 8, 12, 8
BATCH = 128  # windows
_EDGE = _SPACE.copy()
_EDGE[[ord(c) for c in "!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~"]] = True  # words end at white space and ASCII punctuation


def _words(texts: list[bytes], chars: np.ndarray | None):
    """Word hashes, mean byte vectors (if chars is given), and where each text's words begin."""
    buf = b"\n".join(texts) + b"\n"
    arr = np.frombuffer(buf, np.uint8)
    ink = ~_EDGE[arr]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ink)).view(np.int8)))
    starts, size = edge[0::2], edge[1::2] - edge[0::2]
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros((0, CHARS), np.float32), bounds
    letters = arr[ink]
    first = np.cumsum(size) - size
    power = np.multiply.accumulate(np.full(int(size.max()), _BASE, np.uint64))
    hashes = _mix(np.add.reduceat(_BYTE[letters] * power[np.arange(len(letters)) - np.repeat(first, size)], first) + size.astype(np.uint64))
    means = None if chars is None else np.add.reduceat(chars[letters], first, axis=0) / size[:, None].astype(np.float32)
    return hashes, means, bounds


def _windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word and number of words of each window; a text without words has one empty window."""
    n = np.diff(bounds)
    many = 1 + np.maximum(0, -(-(n - WIDTH) // STRIDE))
    text = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return text, bounds[text] + k * STRIDE, np.minimum(n[text] - k * STRIDE, WIDTH)


def _raw(texts) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "replace") for t in texts]


class Vocabulary:
    """Number of each known word hash, 0 for all others; found in the sorted hashes."""

    def __init__(self, hashes: np.ndarray):
        self.key = np.unique(hashes)
        self.size = len(self.key) + 1

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.key, hashes), len(self.key) - 1)
        return np.where(self.key[at] == hashes, at + 1, 0).astype(np.int32)


def initial(vocabulary: int, seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
    p = {"words": f(vocabulary, EMBED), "chars": f(256, CHARS), "attend": f(2 * HIDDEN), "out": f(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {f"w{d}": f(EMBED, 3 * HIDDEN), f"k{d}": f(CHARS, 3 * HIDDEN), f"u{d}": f(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p


def _gru(u: np.ndarray, pre: np.ndarray, live: np.ndarray, backward: bool, keep: bool):
    """States for pre-activations (steps, windows, 3 * HIDDEN); where live is 0 the state stays."""
    steps, n, h = len(pre), pre.shape[1], HIDDEN
    out, memo, s = np.zeros((steps, n, h), np.float32), [], np.zeros((n, h), np.float32)
    for t in range(steps - 1, -1, -1) if backward else range(steps):
        g = sigmoid(pre[t, :, : 2 * h] + s @ u[:, : 2 * h])
        z, r = g[:, :h], g[:, h:]
        a = np.tanh(pre[t, :, 2 * h :] + (r * s) @ u[:, 2 * h :])
        m = live[t][:, None]
        if keep:
            memo.append((t, s, z, r, a, m))
        s = s + m * z * (a - s)
        out[t] = s
    return out, memo


def _gru_gradient(u: np.ndarray, memo, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, dpre, du = HIDDEN, np.zeros((*dout.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(u)
    ds = np.zeros(dout.shape[1:], np.float32)
    for t, s, z, r, a, m in reversed(memo):
        ds = ds + dout[t]
        da = ds * m * z * (1 - a * a)
        dz = ds * m * (a - s) * z * (1 - z)
        drs = da @ u[:, 2 * h :].T
        dr = drs * s * r * (1 - r)
        dzr = np.concatenate((dz, dr), 1)
        du[:, : 2 * h] += s.T @ dzr
        du[:, 2 * h :] += (r * s).T @ da
        dpre[t] = np.concatenate((dzr, da), 1)
        ds = ds * (1 - m * z) + drs * r + dzr @ u[:, : 2 * h].T
    return dpre, du


def _forward(p: dict[str, np.ndarray], pre: dict[str, np.ndarray], live: np.ndarray, keep: bool = False):
    """Logits of windows, from the pre-activations of both directions."""
    f, mf = _gru(p["uf"], pre["f"], live, False, keep)
    b, mb = _gru(p["ub"], pre["b"], live, True, keep)
    both = np.concatenate((f, b), 2)
    e = np.where(live > 0, both @ p["attend"], -1e9)
    a = np.exp(e - e.max(0)) * live
    a /= np.maximum(a.sum(0), 1e-9)
    pooled = (a[:, :, None] * both).sum(0)
    return pooled @ p["out"] + p["bias"][0], (both, a, pooled, mf, mb)


def loss_gradient(p, ids, letters, spell, live, y, decay: float = 1e-4) -> tuple[float, dict[str, np.ndarray]]:
    """Logistic loss of windows: word numbers (steps, windows), bytes of the live words in a row, their lengths, live words, labels."""
    x, c = p["words"][ids], np.zeros((*ids.shape, CHARS), np.float32)
    on, share = live > 0, 1 / spell[:, None].astype(np.float32)
    if len(spell):
        c[on] = np.add.reduceat(p["chars"][letters], np.cumsum(spell) - spell, axis=0) * share
    pre = {d: x @ p[f"w{d}"] + c @ p[f"k{d}"] + p[f"c{d}"] for d in "fb"}
    logit, (both, a, pooled, mf, mb) = _forward(p, pre, live, True)
    q = sigmoid(logit)
    n = len(y)
    dl = ((q - y) / n).astype(np.float32)
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["out"], grad["bias"] = pooled.T @ dl, np.array([dl.sum()])
    dpool = dl[:, None] * p["out"]
    da = (both * dpool).sum(2)
    de = a * (da - (a * da).sum(0))
    dboth = a[:, :, None] * dpool + de[:, :, None] * p["attend"]
    grad["attend"] = (de[:, :, None] * both).sum((0, 1))
    dx, dc = np.zeros_like(x), np.zeros_like(c)
    for d, memo, part in (("f", mf, dboth[:, :, :HIDDEN]), ("b", mb, dboth[:, :, HIDDEN:])):
        dpre, grad[f"u{d}"] = _gru_gradient(p[f"u{d}"], memo, part)
        flat = dpre.reshape(-1, 3 * HIDDEN)
        grad[f"w{d}"], grad[f"k{d}"], grad[f"c{d}"] = x.reshape(-1, EMBED).T @ flat, c.reshape(-1, CHARS).T @ flat, flat.sum(0)
        dx += dpre @ p[f"w{d}"].T
        dc += dpre @ p[f"k{d}"].T
    np.add.at(grad["words"], ids, dx * (live > 0)[:, :, None])
    grad["words"] += decay * p["words"]
    each = np.repeat(dc[on] * share, spell, axis=0)
    grad["chars"] = np.stack([np.bincount(letters, each[:, k], minlength=256) for k in range(CHARS)], 1).astype(np.float32)
    loss = np.mean(np.logaddexp(0, logit) - y * logit)
    return float(loss), grad


def _pieces(text: str | None, most: int, seed: int) -> list[str]:
    """The text, or of one of more than `most` windows that many of them, from anywhere."""
    raw = _raw([text])[0]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ~_EDGE[np.frombuffer(raw, np.uint8)], [False])).view(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    many = 1 + max(0, -(-(len(begin) - WIDTH) // STRIDE))
    if many <= most:
        return [text or ""]
    first = np.sort(np.random.default_rng(seed).choice(many, most, replace=False)) * STRIDE
    return [raw[begin[k] : end[min(k + WIDTH, len(end)) - 1]].decode("utf-8", "replace") for k in first]


def _fit(texts: list[list[str]], toxic: np.ndarray, least: int, epochs: int, per_text: int, seed: int, steps: int):
    """Network and vocabulary from texts in pieces, each cut into windows."""
    rng, raw = np.random.default_rng(seed), _raw([piece for pieces in texts for piece in pieces])
    whose = np.repeat(np.arange(len(texts)), [len(pieces) for pieces in texts])
    hashes, _, bounds = _words(raw, None)
    owner = np.repeat(whose, np.diff(bounds))
    pairs = np.unique(np.stack((hashes, owner.astype(np.uint64))), axis=1)[0] if len(hashes) else hashes
    names, seen = np.unique(pairs, return_counts=True)
    vocabulary = Vocabulary(names[seen >= least])
    ids = vocabulary(hashes)
    table = bytes(32 if _EDGE[i] else i for i in range(256))
    spelled = [w for t in raw for w in t.translate(table).split()]
    letters, spell = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64), np.array([len(w) for w in spelled], np.int64)
    begin = np.cumsum(spell) - spell
    piece, first, size = _windows(bounds)
    text = whose[piece]
    p = initial(vocabulary.size, seed)

    def batch(rows: np.ndarray):
        live = np.arange(WIDTH)[:, None] < size[rows]
        at = np.where(live, first[rows] + np.arange(WIDTH)[:, None], 0)
        own = at[live]
        n = spell[own]
        flat = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.where(live, ids[at], 0) if len(ids) else at, letters[flat], n, live.astype(np.float32)

    score = rng.random(len(text))
    for epoch in range(epochs):
        # the best windows of each text: all but the first round take them as the positives and the hard negatives
        order = np.lexsort((-score, text))
        place = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        rest = rng.random(len(order)) < per_text / np.maximum(np.bincount(text)[text[order]], 1)
        rows = order[np.where(toxic[text[order]], place < (4 * per_text if epoch == 0 else 2), (place < 2) | rest)]
        rows = np.concatenate([rng.permutation(rows) for _ in range(-(-steps * BATCH // max(1, len(rows))))])
        y = toxic[text].astype(np.float32)
        p = adam(p, ((*batch(b), y[b]) for b in (rows[i : i + BATCH] for i in range(0, len(rows), BATCH))), 0.02 if epoch < epochs - 2 else 0.005, loss_gradient)
        score = score_texts(p, vocabulary, raw, by_window=True)
    return p, vocabulary


def score_texts(p: dict[str, np.ndarray], vocabulary: Vocabulary, raw: list[bytes], by_window: bool = False, block: int = 4096) -> np.ndarray:
    """Score of each lower-cased text, or of each of its windows."""
    out = []
    for lo, hi in byte_blocks(raw):
        hashes, means, bounds = _words(raw[lo:hi], p["chars"])
        ids = vocabulary(hashes)
        dead = np.zeros((1, 3 * HIDDEN), np.float32)
        pre = {d: np.concatenate(((p["words"] @ p[f"w{d}"] + p[f"c{d}"])[ids] + means @ p[f"k{d}"], dead)) for d in "fb"}
        text, first, size = _windows(bounds)
        score = np.zeros(len(text), np.float32)
        for b in range(0, len(text), block):
            f, s = first[b : b + block], size[b : b + block]
            step = np.arange(max(1, int(s.max())))[:, None]
            live = (step < s).astype(np.float32)
            at = np.where(live > 0, f + step, len(ids))
            score[b : b + block] = sigmoid(_forward(p, {d: pre[d][at] for d in "fb"}, live)[0])
        if by_window:
            out.append(score)
        else:
            best = np.zeros(hi - lo, np.float32)
            np.maximum.at(best, text, score)
            out.append(best)
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def train(docs: DataFrame, labels: DataFrame, sample: int = 1500, least: int = 4, epochs: int = 6, per_text: int = 3, steps: int = 30, windows: int = 256, seed: int = 11):
    """Network from labelled documents.

    At most `sample` documents of either label are taken (those with the smallest hashes), each whole, as what makes it toxic may stand anywhere; tasks cut
    those of more than `windows` windows and send that many from anywhere in them, so what reaches the driver is bounded. A round takes a few
    windows of each text and goes over them until at least `steps` batches are done, so that few labels teach as much as many. Words must
    be in `least` texts to get a vector. Of texts that share a doc_id the smallest is learnt from; a document with both labels counts as toxic; null
    labels and labels without a document are left out.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic").withColumn("h", F.xxhash64("doc_id"))
    chosen: dict[int, int] = {}
    for value in (0, 1):
        chosen |= {r["doc_id"]: value for r in known.filter(F.col("toxic") == value).orderBy("h", "doc_id").limit(sample).collect()}
    texts = docs.filter(F.col("doc_id").isin(list(chosen)) if chosen else F.lit(False)).groupBy("doc_id").agg(F.min("text").alias("text"))

    def cut(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "pieces": [_pieces(t, windows, abs(int(d))) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True)]})

    rows = texts.mapInPandas(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pieces array<string>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    return _fit([r["pieces"] for r in rows], np.array([chosen[r["doc_id"]] == 1 for r in rows], bool), least, epochs, per_text, seed, steps)


def score(docs: DataFrame, p: dict[str, np.ndarray], vocabulary: Vocabulary, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted for each row of docs, repeated rows and null doc_ids included; null, empty and wordless texts get the score of an empty window."""

    def run(batches):
        for pdf in batches:
            s = score_texts(p, vocabulary, _raw(pdf["text"])).astype(np.float64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, predicted int")


def detect(docs: DataFrame, labels: DataFrame, fold: int = 1, of: int = 3, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of the held-out fold are never read."""
    p, vocabulary = train(docs, labels.filter(~held_out(fold, of)))
    return score(docs, p, vocabulary, threshold).withColumn("held_out", held_out(fold, of)).select("doc_id", "held_out", "score", "predicted")
