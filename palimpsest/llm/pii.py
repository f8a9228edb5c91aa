"""Operator 3, personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The network is trained in numpy on labelled spans from a seeded generator. It reads windows of characters that overlap by half;
each window is decoded by the Viterbi algorithm, a span that touches the inner edge of a window is left to the neighbour that sees it
whole or, if it is longer than that, put together from the parts that the windows see, and the spans of all windows of a document
compete for a non-overlapping choice of the largest total score. Every kind needs a digit, an ``@`` or the word "dot", so windows
are laid over the runs of signs that hold one, and only there. A proposal counts if the network is sure of it (``SURE``) and its
digits fit its kind: 9 to 15 for a phone, 13 to 19 that pass Luhn for a card, four parts up to 255 for an address of a machine.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import modest, table
from .tokens import slices

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, HIDDEN, EMBED = 64, 32, 24, 12
#: Labelled windows that the network learns from, and how often.
LESSONS, EPOCHS = 4000, 5
#: The mean probability of its kind that the characters of an added span have at least.
SURE = 0.85
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of every kind

TRIGGER, SPELLED, SPACE = re.compile("[0-9@]+"), re.compile(r"[0-9@]+|\b(?:dot|DOT|Dot)\b"), re.compile(r"\s")
NAMED = re.compile(r"[^\s(\[]{1,64}\s{0,3}(?:[(\[]at[)\]]|(?<=\s)at(?=\s))", re.I)  # a word, then an "at" in brackets or as a word of its own
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # equal to the plain pattern, but linear on long runs of digits
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str):
    """Leftmost non-overlapping matches of the e-mail pattern; every one has a single ``@``, so the search goes from one to the next."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    odd, even = sum(map(int, digits[-1::-2])), sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def only_digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in s.split("."))
    if kind == "email":
        return True
    n = only_digits(s)
    return 13 <= len(n) <= 19 and luhn(n) if kind == "card" else 9 <= len(n) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(number of the kind, start, end) of the fixed patterns; failing matches are dropped, and nothing is tried again inside them."""
    out = [(0, *span) for span in emails(text)] if "@" in text else []
    for k, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(k, m.start(), m.end()) for m in pattern.finditer(text) if valid(KINDS[k], m[0])]
    return out


# --- the network -------------------------------------------------------------------------------------------------------------

SYMBOLS = "abcdefghijklmnopqrstuvwxyz@.-+()_% \n"
_CODE = np.full(1 << 16, len(SYMBOLS) + 3, np.int16)  # other signs; 0 is padding
_CODE[ord("0") : ord("9") + 1] = len(SYMBOLS) + 1
for _i, _c in enumerate(SYMBOLS):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i + 1
_CODE[0xC0:0x250] = len(SYMBOLS) + 2  # letters beyond ASCII


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CODE[np.minimum(points, 0xFFFF)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Embedding, an LSTM in each direction, one linear layer for emissions, and CRF transitions between tags."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        p = {"e": r.normal(0, 0.3, (len(SYMBOLS) + 4, EMBED)), "o": r.normal(0, 0.2, (2 * HIDDEN, TAGS)), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}
        for d in "fb":
            p["w" + d] = r.normal(0, 0.25, (EMBED + HIDDEN, 4 * HIDDEN))
            p["b" + d] = np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)])  # forget gates start open
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """Hidden states of one direction, (batch, time, HIDDEN), and what the way back needs."""
        p, (n, t) = self.p, x.shape
        w, kind = p["w" + d], p["e"].dtype
        h, c = np.zeros((n, HIDDEN), kind), np.zeros((n, HIDDEN), kind)
        inner = p["e"] @ w[:EMBED] + p["b" + d]
        out, saved = np.empty((n, t, HIDDEN), kind), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = inner[x[:, i]] + h @ w[EMBED:]
            gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            f, a, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, h_before = c, h
            c = f * c + a * g
            tc = np.tanh(c)
            h = o * tc
            out[:, i] = h
            if keep:
                saved.append((i, h_before, before, f, a, o, g, tc))
        return out, saved

    def emissions(self, x: np.ndarray, keep: bool = False):
        (hf, sf), (hb, sb) = self._run(x, "f", keep), self._run(x, "b", keep)
        h = np.concatenate([hf, hb], 2)
        return h @ self.p["o"] + self.p["ob"], h, (sf, sb)

    def forward_backward(self, em: np.ndarray):
        """What the CRF's marginals are made of: alpha * beta, each place's alphas summing to 1."""
        trans, e = np.exp(self.p["t"]), np.exp(em - em.max(2, keepdims=True))
        alpha, beta, scale = np.empty_like(em), np.ones_like(em), np.empty((*em.shape[:2], 1), em.dtype)
        for i in range(em.shape[1]):
            a = e[:, i] * (np.exp(self.p["s"]) if i == 0 else alpha[:, i - 1] @ trans)
            scale[:, i] = a.sum(1, keepdims=True)
            alpha[:, i] = a / scale[:, i]
        for i in range(em.shape[1] - 2, -1, -1):
            beta[:, i] = (e[:, i + 1] * beta[:, i + 1] / scale[:, i + 1]) @ trans.T
        return trans, e, alpha, beta, scale

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Of the mean negative log-likelihood of the tags ``y``, by the forward-backward algorithm and back through time."""
        p, (n, t) = self.p, x.shape
        em, h, saved = self.emissions(x, True)
        trans, e, alpha, beta, scale = self.forward_backward(em)
        d = alpha * beta  # marginals
        g = {k: np.zeros_like(v) for k, v in p.items()}
        later = (e * beta / scale)[:, 1:].reshape(-1, TAGS)
        g["t"] = trans * (alpha[:, :-1].reshape(-1, TAGS).T @ later)
        np.add.at(g["t"], (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        d[np.arange(n)[:, None], np.arange(t), y] -= 1
        g["s"] = d[:, 0].sum(0)
        g["o"], g["ob"] = h.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, TAGS), d.sum((0, 1))
        dh_all = d @ p["o"].T
        signs = (x.reshape(-1, 1) == np.arange(len(p["e"]))).astype(em.dtype)
        for part, way, steps in ((slice(0, HIDDEN), "f", saved[0]), (slice(HIDDEN, None), "b", saved[1])):
            w, dh, dc = p["w" + way], 0, 0
            dz_all, h_all = np.empty((n, t, 4 * HIDDEN), em.dtype), np.empty((n, t, HIDDEN), em.dtype)
            for i, h_before, before, f, a, o, gg, tc in reversed(steps):
                dh = dh_all[:, i, part] + dh
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate([dc * before * f * (1 - f), dc * gg * a * (1 - a), dh * tc * o * (1 - o), dc * a * (1 - gg * gg)], 1)
                dz_all[:, i], h_all[:, i] = dz, h_before
                dh, dc = dz @ w[EMBED:].T, dc * f
            flat = dz_all.reshape(n * t, -1)
            by_sign = signs.T @ flat
            g["w" + way][:EMBED], g["w" + way][EMBED:] = p["e"].T @ by_sign, h_all.reshape(n * t, -1).T @ flat
            g["b" + way] = flat.sum(0)
            g["e"] += by_sign @ w[:EMBED].T
        return {k: v / n for k, v in g.items()}

    def likelihood(self, x: np.ndarray, y: np.ndarray) -> float:
        """The mean negative log-likelihood of the tags ``y``."""
        em, rows = self.emissions(x)[0].astype(np.float64), np.arange(len(x))
        best, score = em[:, 0] + self.p["s"], em[rows, 0, y[:, 0]] + self.p["s"][y[:, 0]]
        for i in range(1, x.shape[1]):
            best = np.logaddexp.reduce(best[:, :, None] + self.p["t"], 1) + em[:, i]
            score = score + self.p["t"][y[:, i - 1], y[:, i]] + em[rows, i, y[:, i]]
        return float((np.logaddexp.reduce(best, 1) - score).mean())

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 40, rate: float = 0.03, seed: int = 5) -> Tagger:
        r, m, s, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), batch):
                g = self.gradients(x[order[at : at + batch]], y[order[at : at + batch]])
                size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                t += 1
                now = rate * (1 - 0.9 * t / (epochs * -(-len(x) // batch)))
                for k, v in g.items():
                    v = v * min(1, 5 / (size + 1e-9))
                    m[k], s[k] = 0.9 * m.get(k, 0) + 0.1 * v, 0.999 * s.get(k, 0) + 0.001 * v * v
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of every window, and for every place of those with a tag the marginal probability of each kind."""
        em, _, _ = self.emissions(x)
        n, t = x.shape
        score, back = em[:, 0] + self.p["s"], np.empty((n, t, TAGS), np.int8)
        for i in range(1, t):
            options = score[:, :, None] + self.p["t"]
            back[:, i] = options.argmax(1)
            score = options.max(1) + em[:, i]
        tags = np.empty((n, t), np.int8)
        tags[:, -1] = score.argmax(1)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[np.arange(n), i, tags[:, i]]
        q, some = np.zeros((n, t, len(KINDS)), np.float32), np.flatnonzero(tags.any(1))
        _, _, alpha, beta, _ = self.forward_backward(em[some])
        q[some] = (alpha * beta)[:, :, 1::2] + (alpha * beta)[:, :, 2::2]
        return tags, q


# --- labelled spans ----------------------------------------------------------------------------------------------------------

# Syllables of the made-up text round the labelled spans.
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve que ent eau ción sch ung keit oi é ü ñ".split()


def lesson(r: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A made-up line and its spans as (kind, start, end); numbers that are no personal data are in it, too."""
    n = lambda k: "".join(map(str, r.integers(0, 10, k)))
    word = lambda: "".join(r.choice(SYLLABLES, r.integers(1, 4)))
    name = lambda: ".".join(word() for _ in range(int(r.choice([1, 1, 1, 2, 3, 6]))))
    pick = lambda options: options[int(r.integers(0, len(options)))]

    def mail() -> str:
        who, at, dot = f"{name()}{pick(['', '_', '+', '-'])}{pick(['', n(2), word()])}", "@", "."
        if r.random() < 0.25:  # spelled out
            at, dot = pick([(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" AT ", " DOT ")])
        return f"{who}{at}{pick(['', 'mail.', ''])}{word()}{pick(['', n(1), '-' + word()])}{dot}{pick(['com', 'org', 'net', 'test', 'de', 'co.uk'])}"

    def card() -> str:
        body = n(15)
        whole = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        gap = pick(["", "", " ", "-", ".", "/"])
        return gap.join(whole[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        gap = pick([" ", "-", "."])
        return pick([
            f"({n(3)}) {n(3)}-{n(4)}", gap.join((n(3), n(3), n(4))), gap.join(("0" + n(1), n(2), n(2), n(2), n(2))), f"0{n(2)} {n(4)} {n(4)}", f"0{n(3)} {n(3)} {n(4)}",
            f"0{n(2)}{pick([' ', '-', '/'])}{n(7)}", f"0{n(2)}{pick([' ', '-', '/'])}{n(8)}", f"0{n(4)} {n(6)}", f"0{n(3)}{pick([' ', '-', '/'])}{n(int(r.integers(6, 9)))}", f"6{n(2)} {n(2)} {n(2)} {n(2)}", f"9{n(2)} {n(3)} {n(3)}",
            f"+{pick(['1', '44', '49', '33', '34'])} {n(3)} {n(3)} {n(4)}", f"+{n(2)} ({n(3)}) {n(3)}-{n(4)}", f"+{n(2)}{gap}{n(2)}{gap}{n(4)}{gap}{n(3)}",
        ])

    def nothing() -> str:
        return pick([
            n(int(r.integers(1, 7))), n(int(r.integers(8, 15))), f"20{n(2)}-0{r.integers(1, 9)}-{r.integers(10, 28)}", f"20{n(2)}-1{r.integers(0, 3)}-{r.integers(10, 28)} {n(2)}:{n(2)}:{n(2)}",
            f"{r.integers(1, 9)}.{r.integers(0, 20)}.{r.integers(0, 9)}", bytes(r.integers(0, 256, 16, np.uint8)).hex(), f"{n(2)}:{n(2)}", f"@{word()}", f"{n(3)}%", f"${n(2)}.{n(2)}",
            f"978-{n(1)}-{n(3)}-{n(5)}-{n(1)}", f"{n(3)},{n(3)},{n(3)}", f"{n(2)}.{n(4)} {n(2)}.{n(4)}", f"{n(4)}-{n(4)}", f"{n(2)}/{n(2)}/{n(4)}", f"{n(4)} {n(4)}", f"{n(1)} {n(2)} {n(1)} {n(2)} {n(1)}",
            " ".join(n(int(r.integers(2, 6))) for _ in range(int(r.integers(2, 5)))), f"{word()}-{n(4)}-{n(6)}", f"{word()}_{n(8)}", f"{word()} at the dot of {n(2)}", f"#{n(9)}", f"{word()}.{word()}", f"{n(5)}-{n(4)} {n(5)}",
        ])

    text, spans = "", []
    while len(text) < 2 * WINDOW:
        if r.random() < 0.35:
            kind = int(r.integers(0, 7))
            s = mail() if kind == 0 else pick([".", ".", ".", "[.]"]).join(map(str, r.integers(1, 256, 4))) if kind == 1 else card() if kind == 2 else phone() if kind == 3 else nothing()
            if kind < len(KINDS):
                spans.append((kind, len(text), len(text) + len(s)))
            text += s + pick(["", "", ".", ",", "!!", "***", "###", ";", ")"])
        else:
            s = word()
            text += pick([s, s, s.capitalize(), s.upper()]) + pick(["", "", "", ".", ",", ":"])
        text += pick([" "] * 9 + ["\n"])
    return text, spans


def lesson_windows(r: np.random.Generator, lessons: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of made-up lines, cut anywhere, and their tags."""
    x, y = np.zeros((lessons, WINDOW), np.int16), np.zeros((lessons, WINDOW), np.int64)
    for i in range(lessons):
        text, spans = lesson(r)
        shift = int(r.integers(0, len(text) - WINDOW + 1))
        x[i] = encode(text)[shift : shift + WINDOW]
        tags = np.zeros(len(text), np.int64)
        for kind, start, end in spans:
            tags[start:end] = 2 + 2 * kind
            tags[start] = 1 + 2 * kind
        y[i] = tags[shift : shift + WINDOW]
    return x, y


@lru_cache(maxsize=4)
def trained(lessons: int = LESSONS, epochs: int = EPOCHS, seed: int = 17) -> Tagger:
    """The network, trained once in a Python process; the same arguments give the same weights."""
    return Tagger().fit(*lesson_windows(np.random.default_rng(seed), lessons), epochs)


# --- from windows to documents -------------------------------------------------------------------------------------------------


def window_starts(text: str) -> list[int]:
    """Starts of windows, on a grid of STRIDE, over every run of signs without white space that holds a digit or an ``@``, and round the word "dot"."""
    found, done = set(), 0
    for m in (SPELLED if "dot" in text or "DOT" in text or "Dot" in text else TRIGGER).finditer(text):
        a, b = m.span()
        if text[a] in "dD":
            a, b = max(0, a - STRIDE), min(len(text), b + STRIDE // 2)
        elif b <= done:
            continue
        else:
            a = max(done, 1 + max(text.rfind(c, done, a) for c in " \n\t"))
            stop = SPACE.search(text, b)
            b = done = stop.start() if stop else len(text)
        found.update(range(max(0, (a - WINDOW) // STRIDE + 1), (b - 1) // STRIDE + 1))
    return sorted(i * STRIDE for i in found)


def tidied(text: str, kind: int, start: int, end: int) -> tuple[int, int]:
    """A span of an e-mail address with an ``@`` is cut to the signs round it, as none of them is white space; one that is spelled out begins with the one word before its "at"."""
    at = text.find("@", start, end) if kind == 0 else -1
    if at < 0:
        aloud = list(NAMED.finditer(text, start, end)) if kind == 0 else []
        return (aloud[-1].start() if aloud else start), end
    gaps = [m.start() for m in SPACE.finditer(text, start, end)]
    return max([g + 1 for g in gaps if g < at], default=start), min([g for g in gaps if g > at], default=end)


def proposals(model: Tagger, texts: list[str], most: int = 512) -> list[list[tuple[float, int, int, int]]]:
    """(score, kind, start, end) of what the windows of each text hold.

    A score is the sum, over a span's characters, of the probability of its kind less a half. A span that begins before the next window and
    goes on beyond this one is put together with the part that the next window begins with."""
    todo = [(i, at) for i, text in enumerate(texts) for at in window_starts(text)]
    codes, out = {}, [[] for _ in texts]
    cut: dict[tuple[int, int, int], tuple[int, float]] = {}  # (text, next window, kind): where a span began and its score up to there
    for part in range(0, len(todo), most):
        some = todo[part : part + most]
        x = np.zeros((len(some), WINDOW), np.int16)
        for row, (i, at) in enumerate(some):
            if i not in codes:
                codes = {i: encode(texts[i])}  # texts come in order
            piece = codes[i][at : at + WINDOW]
            x[row, : len(piece)] = piece
        tags, q = model.decode(x)
        for row in np.flatnonzero(tags.any(1)).tolist():
            i, at = some[row]
            t, last = tags[row].tolist(), min(WINDOW, len(texts[i]) - at)
            start = 0
            while start < last:
                tag, end = t[start], start + 1
                if tag:
                    kind = (tag - 1) // 2
                    while end < last and t[end] == 2 + 2 * kind:
                        end += 1
                    sure = q[row, :end, kind] - 0.5
                    begun = cut.get((i, at, kind)) if start < 4 else None  # a window may need a few signs to see what it is in
                    first, before = begun or (at + start, 0.0)
                    own = 0 if begun else start
                    if begun or start or not at:
                        if end < WINDOW or at + end == len(texts[i]):
                            out[i].append((before + float(sure[own:].sum()), kind, *tidied(texts[i], kind, first, at + end)))
                        elif own < STRIDE:
                            cut[i, at + STRIDE, kind] = first, before + float(sure[own:STRIDE].sum())
                start = end
    return out


def reconciled(spans: list[tuple[float, int, int, int]]) -> list[tuple[int, int, int]]:
    """The non-overlapping spans of the largest total score, over the whole document."""
    best: dict[tuple[int, int, int], float] = {}
    for score, *span in spans:
        if score > 0:
            best[tuple(span)] = max(score, best.get(tuple(span), 0))
    order = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in order]
    total, take = [0.0], []
    for i, s in enumerate(order):
        before = int(np.searchsorted(ends[:i], s[1], "right"))
        take.append((total[before] + best[s] > total[i], before))
        total.append(max(total[i], total[before] + best[s]))
    out, i = [], len(order)
    while i:
        chosen, before = take[i - 1]
        if chosen:
            out.append(order[i - 1])
        i = before if chosen else i - 1
    return out


def plausible(kind: int, s: str, score: float) -> bool:
    """What a proposal of the network must be to count: sure, and with digits that fit its kind."""
    if score < (SURE - 0.5) * len(s):
        return False
    if kind == 0:
        return ("@" in s or re.search(r"\bat\b", s, re.I) is not None) and re.search(r"\w(\.|\W+dot\W+)\w", s, re.I) is not None and s[0].isalnum() and s[-1].isalnum()
    if kind == 1:
        parts = re.split(r"[^0-9]+", s)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if re.fullmatch(r"[+(]?[0-9][\x20().0-9/-]+[0-9]", s) is None or not valid(KINDS[kind], s):
        return False
    return kind == 2 or not s.isdigit()


def splits(text: str, start: int, end: int) -> bool:
    """Whether a span begins or ends within a word or a number."""
    return any(0 < i < len(text) and (text[i - 1].isalpha() and text[i].isalpha() or text[i - 1].isdigit() and text[i].isdigit()) for i in (start, end))


def find(model: Tagger, texts: list[str | None]) -> list[tuple[list, list]]:
    """Base spans and all spans of each whole text, both by kind and start. Added spans overlap no base span."""
    out: list[tuple[list, list]] = [([], [])] * len(texts)
    some = [i for i, t in enumerate(texts) if t and SPELLED.search(t)]
    for i, found in zip(some, proposals(model, [texts[i] for i in some])):
        base = base_spans(texts[i])
        taken = sorted(base, key=lambda s: s[1])
        checked = [p for p in found if plausible(p[1], texts[i][p[2] : p[3]], p[0]) and not splits(texts[i], p[2], p[3]) and not any(s[1] < p[3] and p[2] < s[2] for s in near(taken, p))]
        out[i] = base, sorted(base + reconciled(checked))
    return out


def near(spans: list, p: tuple) -> list:
    """The spans of a list sorted by start that may overlap a proposal."""
    lo = int(np.searchsorted([s[1] for s in spans], p[3]))
    return spans[:lo]


def written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list) -> str:
    """The text with every span replaced by its kind's name; of overlapping spans the first to start counts, with the ends of all."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, mask: bool = False, model: Tagger | None = None) -> DataFrame:
    """Findings in ``docs(doc_id, text)``, one row per row.

    Without ``mask``: doc_id, n_email, n_ip, n_card, n_phone (of the fixed patterns), base_sha256, spans (all), n_added. With it: all columns of
    ``docs``, the text masked and n_chars, if there, set to its new length. Null and empty texts have no findings (a null stays
    null when masked); texts of any length are read whole; repeated rows are answered each; an empty table gives no rows.
    """
    box = docs.sparkSession.sparkContext.broadcast(model or trained())  # a few KB
    rows = docs if mask else docs.select("doc_id", "text")
    schema = docs.schema if mask else T.StructType(
        [rows.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]
    )
    at = rows.columns.index("text")

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(at).to_pylist()
                found = find(box.value, texts)
                if mask:
                    new = [t if t is None or not s else masked(t, s) for t, (_, s) in zip(texts, found)]
                    cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {"text": pa.array(new, batch.column(at).type)}
                    if "n_chars" in cols:
                        cols["n_chars"] = pa.array([c if not s else len(t) for c, t, (_, s) in zip(cols["n_chars"].to_pylist(), new, found)], cols["n_chars"].type)
                    yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
                else:
                    counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))]
                    sha = pa.array([hashlib.sha256(written(sorted(b)).encode()).hexdigest() for b, _ in found], pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([written(s) for _, s in found], pa.string()), pa.array([len(s) - len(b) for b, s in found], pa.int64())], names=schema.names)

    return modest(rows).mapInArrow(run, schema)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the fixed patterns, spans and n_added of every text of ``documents``."""
    return scan(table(spark, sf_dir, "documents"))
