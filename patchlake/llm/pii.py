"""Personal data: exact base patterns plus a character BiLSTM with CRF transitions that adds spans.

The network (its gates and states are squashed by x / (1 + |x|)) is trained in numpy on windows of a bounded sample of documents, labelled by the base
patterns' spans. Most of these are replaced by invented ones, and others are put between words, with names, domains and digits drawn anew each time and
written in forms that the patterns miss (written-out at signs and dots, other separators of numbers, phone numbers without a plus sign), so
that the network learns forms and not the corpus's own addresses; dates, versions and the like stand beside them as what isn't meant.
Every text is scored whole, in overlapping windows of WIDTH characters; each window is decoded by Viterbi, and every character takes its tag
from the window in which it stands farthest from an edge, so that spans are reconciled over the whole text. A run of tags
stands for the nearest span of whole words that passes its kind's check (`_valid`): the digits, parts and Luhn sum that the base patterns ask for too.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlake.llm.common import byte_blocks, ddl, sliced
from patchlake.llm.nn import adam

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
WIDTH, STRIDE = 192, 160
LESSON = 80  # characters of a training window
HIDDEN, EMBED = 8, 12
BATCH = 80
RATES = ((0.5, 0.04), (0.3, 0.015), (0.2, 0.005))  # share of the epochs and learning rate
# each part of a number starts at the first digit of its run, which is what leftmost matches do, and never gives digits back
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_TRIGGER = re.compile("[0-9@]")
_NAME = re.compile("[A-Za-z]{2,10}")


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    """Whether digits, however many, are at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def _local_start(text: str, free: int, at: int) -> int:
    """Where the run of local-part characters that ends at `at` begins, not before free."""
    size = 64
    while True:
        lo = max(free, at - size)
        n = _LOCAL.match(text[lo:at][::-1]).end()
        if n < at - lo or lo == free:
            return at - n
        size *= 4


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS; leftmost matches of each kind, failing ones dropped."""
    found = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = _local_start(text, free, at)
        domain = start < at and _DOMAIN.match(text, at + 1)
        if domain:
            found.append((start, 0, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    if _TRIGGER.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


_AT = re.compile(r"\x20?(?:@|\(at\)|\[at\])\x20?", re.IGNORECASE)
_DOT = re.compile(r"\x20?(?:\.|\(dot\)|\[dot\])\x20?", re.IGNORECASE)
_WRITTEN = re.compile(r"[\w.%+-]+@[\w-]+(\.[\w-]+)+")
_PARTED = {"card": re.compile(r"[0-9]([\x20./_-]?[0-9])+"), "phone": re.compile(r"\+?[(]?[0-9][0-9().\x20/-]*[0-9]")}


def _valid(kind: str, s: str) -> bool:
    """What a span of the network must be to be added: what the base pattern asks for, with the separators that it lacks."""
    if kind == "email":
        return len(_AT.findall(s)) == 1 and _WRITTEN.fullmatch(_DOT.sub(".", _AT.sub("@", s))) is not None
    if kind == "ip":
        parts = re.split(r"\x20?(?:\[\.\]|\(\.\)|\.)\x20?", s)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and _byte(p) for p in parts)
    digits = _digits(s)
    if _PARTED[kind].fullmatch(s) is None:
        return False
    if kind == "card":  # with spaces and dashes alone the base pattern has judged it
        return 14 <= len(digits) <= 19 and luhn(digits) and any(c in s for c in "./_")
    return 10 <= len(digits) <= 15 and len(digits) < len(s)


@cache
def _classes() -> np.ndarray:
    """Number under 128 of each code point: ASCII letters lower-cased, digits as one, other letters 1, other digits 2, control characters 3, the rest 4."""
    out = np.full(0x110000, 4, np.uint8)
    far = range(127, 0x110000)
    out[127:] = np.fromiter((1 if c.isalpha() else 2 if c.isdigit() else 4 for c in map(chr, far)), np.uint8, len(far))
    out[:32] = 3
    out[32:127] = [ord("0") if chr(c).isdigit() else ord(chr(c).lower()) for c in range(32, 127)]
    return out


def _codes(text: str) -> np.ndarray:
    return _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def initial(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    p = {"emb": f(128, EMBED), "out": f(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
    for d in "fb":
        p |= {f"w{d}": f(EMBED, 4 * HIDDEN), f"u{d}": f(HIDDEN, 4 * HIDDEN), f"c{d}": np.concatenate((np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN))).astype(np.float32)}
    return p


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _lstm(p: dict[str, np.ndarray], x: np.ndarray, d: str, keep: bool):
    """States of one direction for x (windows, steps, features); with what the gradient needs."""
    n, steps, h = len(x), x.shape[1], HIDDEN
    pre = x @ p[f"w{d}"] + p[f"c{d}"]
    out, memo = np.zeros((n, steps, h), np.float32), []
    s, c = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = pre[:, t] + s @ p[f"u{d}"]
        z = _squash(z)
        g = 0.5 + 0.5 * z[:, : 3 * h]
        i, f, o, a = g[:, :h], g[:, h : 2 * h], g[:, 2 * h :], z[:, 3 * h :]
        before, c = c, f * c + i * a
        tc = _squash(c)
        if keep:
            memo.append((t, s, before, i, f, o, a, tc))
        s = o * tc
        out[:, t] = s
    return out, memo


def _lstm_gradient(p, x, d, memo, dout, grad):
    dx = np.zeros_like(x)
    ds = np.zeros((len(x), HIDDEN), np.float32)
    dc = np.zeros_like(ds)
    for t, s, before, i, f, o, a, tc in reversed(memo):
        ds = ds + dout[:, t]
        dc = dc + ds * o * (1 - np.abs(tc)) ** 2
        slope = 0.5 * (1 - np.abs(2 * np.concatenate((i, f, o), 1) - 1)) ** 2
        dz = np.concatenate((np.concatenate((dc * a, dc * before, ds * tc), 1) * slope, dc * i * (1 - np.abs(a)) ** 2), 1)
        grad[f"w{d}"] += x[:, t].T @ dz
        grad[f"u{d}"] += s.T @ dz
        grad[f"c{d}"] += dz.sum(0)
        dx[:, t] = dz @ p[f"w{d}"].T
        ds, dc = dz @ p[f"u{d}"].T, dc * f
    return dx


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def emissions(p: dict[str, np.ndarray], codes: np.ndarray, keep: bool = False):
    x = p["emb"][codes]
    f, mf = _lstm(p, x, "f", keep)
    b, mb = _lstm(p, x, "b", keep)
    both = np.concatenate((f, b), 2)
    return both @ p["out"] + p["bias"], (x, both, mf, mb)


def loss_gradient(p: dict[str, np.ndarray], codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of the tags under the CRF, and its gradient."""
    e, (x, both, mf, mb) = emissions(p, codes, True)
    n, steps, k = e.shape
    tr, rows = p["trans"], np.arange(n)
    grow = np.exp(tr.astype(np.float64))  # sums over states become products with it, each row shifted by its greatest value
    alpha, top = np.zeros((steps, n, k)), np.zeros((steps, n, 1))
    alpha[0] = e[:, 0]
    for t in range(1, steps):
        top[t - 1] = alpha[t - 1].max(1, keepdims=True)
        alpha[t] = np.log(np.exp(alpha[t - 1] - top[t - 1]) @ grow) + top[t - 1] + e[:, t]
    total = _lse(alpha[-1], 1)
    beta = np.zeros((n, k))
    de, dtr = np.zeros_like(e), np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        de[:, t] = np.exp(alpha[t] + beta - total[:, None])
        if t:
            nxt = e[:, t] + beta
            dtr += np.exp(alpha[t - 1] - top[t - 1]).T @ np.exp(nxt + top[t - 1] - total[:, None])
            high = nxt.max(1, keepdims=True)
            beta = np.log(np.exp(nxt - high) @ grow.T) + high
    dtr *= grow
    gold = e[rows[:, None], np.arange(steps), tags].sum(1) + tr[tags[:, :-1], tags[:, 1:]].sum(1)
    de[rows[:, None], np.arange(steps), tags] -= 1
    np.add.at(dtr, (tags[:, :-1], tags[:, 1:]), -1)
    de = (de / n).astype(np.float32)
    grad = {name: np.zeros_like(v) for name, v in p.items()}
    grad["trans"] = (dtr / n).astype(np.float32)
    grad["out"] = np.einsum("nth,ntk->hk", both, de)
    grad["bias"] = de.sum((0, 1))
    dboth = de @ p["out"].T
    dx = _lstm_gradient(p, x, "f", mf, dboth[:, :, :HIDDEN], grad) + _lstm_gradient(p, x, "b", mb, dboth[:, :, HIDDEN:], grad)
    np.add.at(grad["emb"], codes, dx)
    return float((total - gold).mean()), grad


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags of emissions (windows, steps, TAGS); windows stand last while it searches."""
    n, steps, k = e.shape
    e, from_to = np.ascontiguousarray(e.transpose(1, 2, 0)), trans[:, :, None]
    back = np.zeros((steps, k, n), np.int8)
    score = e[0]
    for t in range(1, steps):
        step = score[:, None] + from_to
        best = step[0].copy()
        for i in range(1, k):  # the first of equal ones, as argmax takes it
            over = step[i] > best
            back[t][over] = i
            np.maximum(best, step[i], out=best)
        score = best + e[t]
    tags = np.zeros((n, steps), np.int8)
    tags[:, -1] = score.argmax(0)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[t][tags[:, t], np.arange(n)]
    return tags


_VOWELS, _OTHERS = "aeiouy", "bcdfghjklmnprstvwxz"
_ENDINGS = ("com", "net", "org", "de", "fr", "it", "es", "eu", "io", "ai", "ch", "info", "co.uk", "edu", "gov", "nl", "se", "pl", "app", "dev")
_AT_FORMS = ("@", "(at)", "[at]", " @ ", " (at) ", " [at] ", "(AT)", " (at)")
_DOT_FORMS = (".", ".", "(dot)", "[dot]", " (dot) ", " [dot] ", "(DOT)")


class Inventor:
    """Personal data that stands nowhere: names, domains and numbers are drawn anew each time, and written in forms that the base patterns find or miss."""

    def __init__(self, seed: int, words: list[str]):
        self.rng, self.words = random.Random(seed), words
        self.pick = self.rng.choice

    def digits(self, n: int, first: str = "0123456789") -> str:
        return self.pick(first) + "".join(self.rng.choices("0123456789", k=n - 1))

    def word(self) -> str:
        """A word of the text, syllables, or letters at random."""
        kind = self.rng.random()
        if kind < 0.3 and self.words:
            return self.pick(self.words)
        if kind < 0.8:
            return "".join(self.pick(_OTHERS) + self.pick(_VOWELS) + self.pick(["", "", self.pick(_OTHERS)]) for _ in range(self.rng.randrange(1, 4)))
        return "".join(self.pick(_OTHERS + _VOWELS) for _ in range(self.rng.randrange(1, 10)))

    def email(self) -> str:
        parts = [self.word() for _ in range(self.rng.randrange(1, 4))]
        if self.rng.random() < 0.2:
            parts[0] = parts[0][:1]
        local = self.pick([".", ".", "_", "-", "", "+"]).join(parts) + self.pick(["", "", self.digits(self.rng.randrange(1, 5))])
        labels = [self.word() + self.pick(["", "", "", self.digits(1), "-" + self.word()]) for _ in range(self.pick([1, 1, 1, 2, 3]))]
        end = self.pick(_ENDINGS) if self.rng.random() < 0.7 else "".join(self.pick(_OTHERS + _VOWELS) for _ in range(self.rng.randrange(2, 5)))
        at, dot = self.pick(_AT_FORMS), self.pick(_DOT_FORMS)
        if self.rng.random() < 0.5:
            local = local.replace(".", dot)
        return f"{local}{at}{dot.join([*labels, *end.split('.')])}"

    def ip(self) -> str:
        return self.pick([".", "[.]", "(.)", " . ", " [.] "]).join(str(self.rng.randrange(0, 256)) for _ in range(4))

    def card(self) -> str:
        d = self.digits(self.pick([14, 15, 16, 16, 16, 18]), "3456")
        d += next(c for c in "0123456789" if luhn(d + c))
        n = self.pick([4, 4, 4, 3, 5, 6])
        return self.pick([".", "/", "_", " ", "-"]).join(d[i : i + n] for i in range(0, len(d), n))

    def phone(self) -> str:
        sep, left, groups = self.pick([" ", " ", "-", ".", "/"]), self.rng.randrange(7, 12), []
        while left > 0:
            n = min(left, self.rng.randrange(2, 7))
            n = left if left - n == 1 else n
            groups.append(self.digits(n))
            left -= n
        area, gap = self.digits(self.rng.randrange(2, 6), "0000123456789"), self.pick([sep, " ", "-", "/", ""])
        code = self.digits(self.rng.randrange(1, 4), "123456789")
        start = self.pick([area + sep, f"({area}){gap}", f"{code}{sep}{area}{sep}", f"{code} ({area}){gap}", f"00{code}{sep}{area}{sep}", f"00{code} ({area}){gap}", f"{code} (0){area}{sep}", f"00{code}(0){area}{sep}", f"+{code} {area}{sep}"])
        return start + sep.join(groups)

    def number(self) -> str:
        """Something with digits that is no personal data."""
        r, d = self.rng, self.digits
        return self.pick([f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}", f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.{r.randrange(1900, 2100)}", f"{r.randrange(0, 24)}:{r.randrange(0, 60):02}",
                          f"{d(3)},{d(3)}.{d(2)}", f"v{r.randrange(0, 9)}.{r.randrange(0, 30)}.{r.randrange(0, 30)}", f"{r.randrange(1900, 2100)}-{r.randrange(1900, 2100)}", d(r.randrange(5, 13)), f"#{d(6)}",
                          ", ".join(d(r.randrange(1, 5)) for _ in range(4)), f"{d(2)} x {d(2)} x {d(3)}", f"(dot) {self.word()}", f"{self.word()} at {self.word()}", f"@{self.word()}", f"{self.word()}[{d(1)}]"])

    def one(self, kind: str) -> str:
        """An item of the kind that either the base patterns find whole or `_valid` takes."""
        while True:
            s = getattr(self, kind)()
            found = base_spans(s)
            if found == [(kind, 0, len(s))] or (not found and _valid(kind, s)):
                return s


def _lessons(text: str, rng: np.random.Generator, most: int):
    """Up to `most` training windows (codes, tags) from anywhere in a text: round base spans, other digits and at signs, and at random places.

    Of the base spans in a window two thirds become invented ones of their kind. Other windows get an invented item, or digits that are none, between two
    words, or stay as they are.
    """
    spans = base_spans(text)
    new = Inventor(int(rng.integers(1 << 62)), [w.lower() for w in _NAME.findall(text[lo : lo + 2000])] if (lo := int(rng.integers(0, max(1, len(text) - 2000)))) >= 0 else [])
    inside = np.zeros(len(text) + 1, bool)
    for _, s, e in spans:
        inside[s:e] = True
    others = [m.start() for m in _TRIGGER.finditer(text) if not inside[m.start()]]
    chosen = [(s, e) for s, e in rng.permutation([x[1:] for x in spans]).tolist()][: most // 2] if spans else []
    if others:
        chosen += [(int(x), int(x)) for x in rng.choice(others, min(len(others), max(1, most // 8)), replace=False)]
    chosen += [(int(x), int(x)) for x in rng.integers(0, len(text), max(1, most - most // 2 - most // 8))]
    for s, e in chosen:
        lo = max(0, s - int(rng.integers(0, max(1, LESSON - (e - s)))))
        held = [(k, a, b) for k, a, b in spans if a >= lo and a < lo + LESSON]
        parts, tags, at = [], [], lo
        if not held and rng.random() < 0.8:
            gap = text.find(" ", lo + int(rng.integers(0, LESSON // 2)), lo + LESSON)
            if gap >= 0 and not inside[gap]:
                kind = new.pick([*KINDS, "email", "email", "phone", "phone", "card", None, None])
                held = [(kind, gap, gap)]
        for k, a, b in held:
            if a < at:
                continue
            own = text[a:b]
            if a == b:
                own = new.one(k) if k else new.number()
            elif rng.random() < 0.67:
                own = new.one(k)
            i = KINDS.index(k) if k else None
            parts += [text[at:a], " " * (a == b), own]
            tags += [0] * (a - at + (a == b)) + ([0] * len(own) if i is None else [1 + 2 * i] + [2 + 2 * i] * (len(own) - 1))
            at = b
        end = max(at, lo + LESSON)
        parts.append(text[at:end])
        tags += [0] * len(parts[-1])
        row, tag = np.full(LESSON, 32, np.uint8), np.zeros(LESSON, np.uint8)
        code = _codes("".join(parts))[:LESSON]
        row[: len(code)], tag[: len(code)] = code, tags[: len(code)]
        yield row, tag


def train(docs: DataFrame, sample: int = 700, most: int = 4000, epochs: int = 16, seed: int = 7) -> dict[str, np.ndarray]:
    """Network trained on at most `most` windows of about `sample` documents that hold a digit or an at sign, 8 to 64 windows of each.

    The documents are those of the smallest hashes; tasks read them whole and draw windows from anywhere in them, more of each where there are few, and
    only the `most` windows of the smallest hashes reach the driver, so what is sent there does not grow with the corpus. Without such a document the
    network stays as it starts.
    """
    held = docs.filter(F.col("text").rlike("[0-9@]")).select("text", (F.xxhash64("doc_id", F.length("text")) / F.lit(2.0**64) + 0.5).alias("h"))
    count = held.count()
    share = min(1.0, 1.5 * sample / max(1, count))
    per_text = min(64, max(8, 3 * most // (2 * max(1, min(sample, count)))))

    def draw(batches):
        for pdf in batches:
            rows = []
            for text, h in zip(pdf["text"], pdf["h"], strict=True):
                rng = np.random.default_rng([seed, int(h * 2**52)])
                rows += [(float(rng.random()), c.tobytes(), t.tobytes()) for c, t in _lessons(text, rng, per_text)]
            yield pd.DataFrame(rows, columns=["h", "codes", "tags"])

    found = held.filter(F.col("h") < share).mapInPandas(draw, "h double, codes binary, tags binary").orderBy("h", "codes").limit(most).collect()
    p = initial(seed)
    if not found:
        return p
    codes, tags = (np.frombuffer(b"".join(bytes(r[c]) for r in found), np.uint8).reshape(-1, LESSON).astype(np.int64) for c in ("codes", "tags"))
    rng = np.random.default_rng(seed)
    for share, rate in RATES:
        order = np.concatenate([rng.permutation(len(codes)) for _ in range(max(1, round(epochs * share)))])
        p = adam(p, ((codes[b], tags[b]) for b in (order[i : i + BATCH] for i in range(0, len(order), BATCH))), rate, loss_gradient)
    return p


class Scorer:
    """Emissions of many windows at once: features stand in rows, windows in columns, and both directions move in one product."""

    def __init__(self, p: dict[str, np.ndarray]):
        h = HIDDEN
        self.pre = {d: np.ascontiguousarray((p["emb"] @ p[f"w{d}"] + p[f"c{d}"]).T.reshape(4, h, 128)) for d in "fb"}
        self.u = np.zeros((4, 2, h, 2, h), np.float32)
        for k, d in enumerate("fb"):
            self.u[:, k, :, k] = p[f"u{d}"].T.reshape(4, h, h)
        self.u = self.u.reshape(8 * h, 2 * h)
        self.out, self.bias = np.ascontiguousarray(p["out"].T), p["bias"][:, None]

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """(steps, TAGS, windows) for codes (steps, windows)."""
        (steps, n), h = codes.shape, HIDDEN
        both = np.empty((steps, 2, h, n), np.float32)
        s, c = np.zeros((2 * h, n), np.float32), np.zeros((2 * h, n), np.float32)
        z, y, a = np.empty((8 * h, n), np.float32), np.empty((8 * h, n), np.float32), np.empty((2 * h, n), np.float32)
        four = z.reshape(4, 2, h, n)
        i, f, o, g = (z[k * 2 * h : (k + 1) * 2 * h] for k in range(4))
        gates = z[: 6 * h]
        for t in range(steps):
            np.matmul(self.u, s, out=z)
            four[:, 0] += self.pre["f"].take(codes[t], 2)
            four[:, 1] += self.pre["b"].take(codes[steps - 1 - t], 2)
            np.abs(z, out=y)
            y += 1
            z /= y
            gates *= 0.5
            gates += 0.5
            c *= f
            np.multiply(i, g, out=a)
            c += a
            np.abs(c, out=a)
            a += 1
            np.divide(c, a, out=s)
            s *= o
            both[t, 0], both[steps - 1 - t, 1] = s[:h], s[h:]
        e = np.matmul(self.out, both.reshape(steps, 2 * h, n))
        e += self.bias
        return e


def _starts(n: int) -> list[int]:
    """Where the windows of a text of n characters begin."""
    return list(range(0, max(1, n - (WIDTH - STRIDE)), STRIDE))


def _open(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Which windows of emissions (steps, TAGS, windows) may have a tag on their best path.

    The path without tags is the best one if not even the greatest emission of any tag at each step, with the greatest transitions
    into, between and out of tags, makes a run that beats it; such windows need no search.
    """
    trans = trans - trans[0, 0]
    top = e[:, 1:].max(1) - e[:, 0]
    enter, stay, leave = trans[0, 1:].max(), trans[1:, 1:].max(), trans[1:, 0].max()
    run, most = top[0], top[0] + max(leave, 0.0)
    for t in range(1, len(top)):
        run = np.maximum(run + stay, enter) + top[t]
        most = np.maximum(most, run + (leave if t + 1 < len(top) else 0.0))
    return np.flatnonzero(most >= -1e-3)


def _tagged(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Which windows of emissions (steps, TAGS, windows) have tags on their best path, or nearly.

    The best run of tags between two places without one is found exactly, without the path; only windows in which it gains something are searched.
    """
    trans = trans - trans[0, 0]
    between, enter, leave = trans[1:, 1:, None], trans[0, 1:, None], trans[1:, 0, None]
    run = e[0, 1:] - e[0, 0]
    most = (run + leave).max(0) if len(e) > 1 else run.max(0)
    for t in range(1, len(e)):
        run = np.maximum((run[:, None] + between).max(0), enter) + (e[t, 1:] - e[t, 0])
        np.maximum(most, (run + leave).max(0) if t + 1 < len(e) else run.max(0), out=most)
    return np.flatnonzero(most >= -1e-3)


_REACH = 12  # characters by which an end of a run may be moved
#: What may not stand before the first and after the last character of a kind's span.
_BESIDE = {"email": (re.compile(r"[\w.%+-]"), re.compile(r"[\w-]")), "ip": (re.compile(r"[\w.]"), re.compile(r"\w")), "card": (re.compile(r"\w"), re.compile(r"\w")), "phone": (re.compile(r"[\w+(]"), re.compile(r"\w"))}


def _snapped(kind: str, text: str, lo: int, hi: int, free: int) -> tuple[int, int] | None:
    """The valid span nearest to a run's ends, whole words at both; ends move by at most _REACH, the start not before free."""
    before, after = _BESIDE[kind]
    starts = [i for i in range(max(free, lo - _REACH), min(len(text), lo + _REACH + 1)) if not text[i].isspace() and not (i and before.match(text[i - 1]))]
    ends = [i for i in range(max(1, hi - _REACH), min(len(text), hi + _REACH) + 1) if not text[i - 1].isspace() and not (i < len(text) and after.match(text[i]))]
    for s, e in sorted(((s, e) for s in starts for e in ends if s < e), key=lambda x: (abs(x[0] - lo) + abs(x[1] - hi), x)):
        if _valid(kind, text[s:e]):
            return s, e
    return None


def _runs(text: str, tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Valid spans of a text's tags: a run of one kind, a begin tag opens a new one; a run stands for the nearest valid span of whole words."""
    at = np.flatnonzero(tags)
    if not len(at):
        return []
    kind, begin = (tags[at] - 1) // 2, tags[at] % 2 == 1
    new = np.ones(len(at), bool)
    new[1:] = begin[1:] | (np.diff(at) > 1) | (kind[1:] != kind[:-1])
    first = np.flatnonzero(new)
    out = []
    for lo, hi in zip(at[first], at[np.append(first[1:], len(at)) - 1] + 1, strict=True):
        name = KINDS[(int(tags[lo]) - 1) // 2]
        found = _snapped(name, text, int(lo), int(hi), out[-1][2] if out else 0)
        if found:
            out.append((name, *found))
    return out


def network_spans(p: dict[str, np.ndarray], texts: list[str], block: int = 512, scorer=None) -> list[list[tuple[str, int, int]]]:
    """Valid spans that the network finds in each text; all windows of all texts are scored.

    Windows of about one length go together: each is padded with spaces to a multiple of 32 characters, whatever stands beside it.
    """
    scorer = scorer or Scorer(p)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    edge = (WIDTH - STRIDE) // 2
    for first, last in byte_blocks(texts):
        codes = [_codes(t) for t in texts[first:last]]
        flat = np.concatenate([*codes, np.full(WIDTH, 32, np.uint8)])
        base = np.cumsum([0, *map(len, codes)])
        where = [(i, lo) for i, c in enumerate(codes) for lo in _starts(len(c))]
        own = np.array([i for i, _ in where])
        lo = np.array([s for _, s in where])
        size = np.minimum(base[own + 1] - base[own] - lo, WIDTH)
        steps = np.maximum(1, -(-size // 32)) * 32
        found: dict[int, np.ndarray] = {}
        for n in np.unique(steps):
            rows = np.flatnonzero(steps == n)
            held, near = [rows[:0]], [np.zeros((n, TAGS, 0), np.float32)]
            for b in range(0, len(rows), block):
                r = rows[b : b + block]
                step = np.arange(n)[:, None]
                window = np.where(step < size[r], flat[np.minimum(base[own[r]] + lo[r] + step, len(flat) - 1)], 32).astype(np.intp)
                e = scorer(window)
                on = _open(e, p["trans"])
                e = np.ascontiguousarray(e[:, :, on])
                some = _tagged(e, p["trans"])
                held.append(r[on[some]])
                near.append(e[:, :, some])
            for k, tags in zip(np.concatenate(held), viterbi(np.concatenate(near, 2).transpose(2, 0, 1), p["trans"]), strict=True):
                if tags.any():
                    i, start = int(own[k]), lo[k]
                    line = found.setdefault(i, np.zeros(len(codes[i]), np.int8))
                    a = edge if start else 0
                    z = min(len(line) - start, STRIDE + edge if start + WIDTH < len(line) else WIDTH)
                    line[start + a : start + z] = tags[a:z]
        for i, line in found.items():
            out[first + i] = _runs(texts[first + i], line)
    return out


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, p: dict[str, np.ndarray] | None = None, mask: bool = False, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of carry, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), and masked text if asked for.

    Network spans that overlap a base span are left out. Null and empty texts have no spans; a null text
    comes back null when masked. In masked texts each run of overlapping spans is `<kind>` of its first span.
    """
    p = train(docs) if p is None else p

    def run(batches):
        scorer = Scorer(p)
        for pdf in sliced(batches):
            texts = [t or "" for t in pdf["text"]]
            base = [base_spans(t) for t in texts]
            rows = []
            for own, more, text, given in zip(base, network_spans(p, texts, scorer=scorer), texts, pdf["text"], strict=True):
                new = [x for x in more if not any(x[1] < e and s < x[2] for _, s, e in own)]
                spans = sorted(own + new, key=lambda x: (x[1], KINDS.index(x[0])))
                counts = [sum(k == kind for k, _, _ in own) for kind in KINDS]
                row = [*counts, hashlib.sha256(_listed(own).encode()).hexdigest(), _listed(spans)]
                if mask:
                    out, at = [], 0
                    for k, s, e in spans:
                        if s >= at:
                            out += [text[at:s], f"<{k}>"]
                        at = max(at, e)
                    row.append("".join(out) + text[at:] if spans else given)
                rows.append(row)
            names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(["text"] if mask else [])]
            yield pd.concat([pdf[list(carry)].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = ddl(docs, list(carry)) + ", n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", text string" * mask
    return docs.select(*dict.fromkeys((*carry, "text"))).mapInPandas(run, schema)
