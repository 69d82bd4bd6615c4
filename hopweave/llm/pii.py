"""Personal data: four exact base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The base finds e-mail addresses, IP addresses, card and phone numbers by pattern and arithmetic, in time linear
in the text. The model finds what is written otherwise (addresses with ``[at]``, numbers without a plus or
with other separators). It is trained in numpy from labelled spans: windows of a bounded sample of texts, in which
the base's own spans are labelled and generated ones, of forms the base knows and doesn't, are put between the
words, besides look-alikes (versions, dates, keys, digests) without a label. Windows of WINDOW characters overlap by half.
A span of the model must hold a digit or an at sign (also one in brackets), so windows without have none
and aren't decoded. The most likely tags of each window give candidates; those cut by a window's edge are left to the next
window, those that touch a base span, don't pass the check of their kind or are less sure than SURE are dropped, and
of what overlaps in a text the set of the greatest total certainty stays. A span the model adds has at most WINDOW characters;
one of at most half of it is whole in some window.

Fitting takes SAMPLE rows at most, of the smallest hash, so it costs the same at any size; every row is searched whole.

Defined cases: a null or empty text has no spans. Repeated rows and null ids give a row each; an empty table
gives no rows (the model then learns from generated words); extra columns are ignored. Long texts take linear time.
"""

from __future__ import annotations

import ipaddress
import pickle
import random
import re
import zlib
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._common import bounded_batches, table

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window; rows, windows of a row and training windows; hidden units; least certainty of an added span.
WINDOW, SAMPLE, OF_A_ROW, EXAMPLES, HIDDEN, SURE = 96, 600, 4, 9_000, 28, 0.6
#: Windows decoded at once.
AT_ONCE = 1_024
SPANS = "array<struct<kind: string, start: int, end: int, base: boolean, score: double>>"

# --- The base -------------------------------------------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and host; a local part reaches back to its first character, so each @ is looked at once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        part = text[end:at]
        start = end + len(part.rstrip(_LOCAL))
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
        end = host.end() if host else at + 1
        at = text.find("@", end)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Four numbers joined by dots, of at most 255 each; a longer chain is taken four by four."""
    out = []
    for chain in _NUMBERS.finditer(text):
        if chain.group().count(".") < 3:
            continue
        parts, at = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """All base spans, by kind as listed, then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *s) for s in addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NO_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m.group())) <= 15]
    return out


# --- What an added span must look like ------------------------------------------------------------------------

_AT = r"\s*(?:@|[\[({<]\s*at\s*[\])}>])\s*"
_DOT = r"\s*(?:\.|[\[({<]\s*dot\s*[\])}>])\s*"
_SHAPES = {
    "email": re.compile(rf"[\w%+-]+(?:{_DOT}[\w%+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|[.,_-])\s?[0-9]{1,3}){3}|[0-9A-Fa-f:]{6,39}"),
    "card": re.compile(r"[0-9](?:[\s./_-]{0,2}[0-9])+"),
    "phone": re.compile(r"[+(]?[0-9(](?:[\s()./-]{0,3}[0-9])+"),
}
#: A span of the model has to hold one of these.
TRIGGER = re.compile(r"[0-9@]|[\[({<]\s?at\s?[\])}>]", re.I)


def email_in(s: str) -> tuple[int, int]:
    """The part of a span that has the shape of an e-mail address (words before it are left out), or nothing."""
    m = _SHAPES["email"].search(s)
    return m.span() if m else (0, 0)


def plausible(kind: str, s: str) -> bool:
    """The exact check of an added span: its shape, and the arithmetic of its kind."""
    if not _SHAPES[kind].fullmatch(s) or not TRIGGER.search(s):
        return False
    digits = _NO_DIGIT.sub("", s)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "ip" and ":" in s:
        try:
            return ipaddress.ip_address(s).version == 6
        except ValueError:
            return False
    return kind == "email" or all(int(p) <= 255 for p in re.findall("[0-9]+", s))


# --- The model ------------------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside; then begin and inside of each kind
PAD, CHARS = 132, 133
_INSIDE = np.arange(TAGS) % 2 == 0
_INSIDE[0] = False
#: Inside follows only begin or inside of its kind.
_BARRED = np.where(_INSIDE[None, :] & (np.arange(TAGS)[:, None] != np.arange(TAGS)[None, :]) & (np.arange(TAGS)[:, None] != np.arange(TAGS)[None, :] - 1), -1e4, 0).astype(np.float32)
_NO_START = np.where(_INSIDE, -1e4, 0).astype(np.float32)


def characters(text: str, size: int = WINDOW) -> np.ndarray:
    """Numbers of a window's characters: ASCII by itself, else letter, digit, space or other; filled up at the end."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(size, PAD, np.int16)
    out[: len(c)] = np.where(c < 128, c, 131)
    for k in np.flatnonzero(c >= 128):
        x = chr(c[k])
        out[k] = 128 if x.isalpha() else 129 if x.isdigit() else 130 if x.isspace() else 131
    return out


class Tagger:
    """A bidirectional LSTM over characters whose states give emissions of a linear-chain CRF.

    Both directions go in one loop (the first axis); sums over all tag sequences are taken in scaled probabilities.
    """

    def __init__(self, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
        self.h = hidden
        # X: what a character gives to all gates (input, forget, output, new); W: what a state gives; V, v: emissions; A, a: transitions.
        self.p = {"X": 0.3 * rng.standard_normal((2, CHARS, 4 * hidden)).astype(np.float32), "W": draw(2, hidden, 4 * hidden), "V": draw(2 * hidden, TAGS)}
        self.p |= {"v": np.zeros(TAGS, np.float32), "A": np.zeros((TAGS, TAGS), np.float32), "a": np.zeros(TAGS, np.float32)}
        self.p["X"][:, :, hidden : 2 * hidden] += 1

    def emissions(self, x: np.ndarray, kept: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of columns x (steps x windows): states (steps x windows x 2 hidden) and emissions (steps x windows x tags)."""
        h, (T, N) = self.h, x.shape
        X, W = self.p["X"], self.p["W"]
        turned = np.stack([x, x[::-1]])
        s = c = np.zeros((2, N, h), W.dtype)
        out = np.empty((2, T, N, h), W.dtype)
        side = np.arange(2)[:, None]
        for t in range(T):
            z = X[side, turned[:, t]] + s @ W
            gates = 0.5 * np.tanh(0.5 * z[..., : 3 * h]) + 0.5
            g = np.tanh(z[..., 3 * h :])
            before, c = c, gates[..., h : 2 * h] * c + gates[..., :h] * g
            u = np.tanh(c)
            if kept is not None:
                kept.append((s, before, gates, g, u))
            s = out[:, t] = gates[..., 2 * h :] * u
        states = np.concatenate([out[0], out[1][::-1]], 2)
        return states, states @ self.p["V"] + self.p["v"]

    def _messages(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per step and window: weights of all sequences up to a tag, weights after it, emission weights; and the log of the sum of all."""
        weights = np.exp(e - e.max(2, keepdims=True), dtype=np.float64)
        A = np.exp((self.p["A"] + _BARRED).astype(np.float64))
        fore, back = np.empty_like(weights), np.ones_like(weights)
        log = e.max(2).sum(0, dtype=np.float64)
        a = weights[0] * np.exp((self.p["a"] + _NO_START).astype(np.float64))
        for t in range(len(e)):
            a = a if t == 0 else (a @ A) * weights[t]
            size = a.sum(1, keepdims=True)
            log += np.log(size[:, 0])
            fore[t] = a = a / size
        for t in range(len(e) - 2, -1, -1):
            b = (weights[t + 1] * back[t + 1]) @ A.T
            back[t] = b / b.sum(1, keepdims=True)
        return fore, back, weights, log

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tags y (steps x windows) and its gradient."""
        kept: list = []
        states, e = self.emissions(x, kept)
        fore, back, weights, total = self._messages(e)
        (T, N), h = x.shape, self.h
        hot = np.eye(TAGS)[y]
        A = self.p["A"] + _BARRED
        gold = (e * hot).sum((0, 2)) + (self.p["a"] + _NO_START)[y[0]] + A[y[:-1], y[1:]].sum(0)
        one = fore * back
        de = ((one / one.sum(2, keepdims=True) - hot) / N).astype(e.dtype)
        after = weights[1:] * back[1:]
        Ae = np.exp(A.astype(np.float64))
        scale = ((fore[:-1] @ Ae) * after).sum(2, keepdims=True)
        pairs = Ae * np.einsum("tni,tnj->ij", fore[:-1] / scale, after) - np.einsum("tni,tnj->ij", hot[:-1], hot[1:])
        grads = {"a": de[0].sum(0), "A": (pairs / N).astype(e.dtype)}
        flat = de.reshape(T * N, TAGS)
        grads["V"], grads["v"] = states.reshape(T * N, -1).T @ flat, flat.sum(0)
        ds = de @ self.p["V"].T
        ds = np.stack([ds[..., :h], ds[::-1, :, h:]])
        W, dW = self.p["W"], np.zeros_like(self.p["W"])
        turnedW = W.transpose(0, 2, 1)
        dz, dc, dh = np.empty((2, T, N, 4 * h), W.dtype), np.zeros((2, N, h), W.dtype), np.zeros((2, N, h), W.dtype)
        for t in range(T - 1, -1, -1):
            s, before, gates, g, u = kept[t]
            i, f, o = gates[..., :h], gates[..., h : 2 * h], gates[..., 2 * h :]
            dh = dh + ds[:, t]
            dc = dc + dh * o * (1 - u * u)
            z = np.concatenate([dc * g, dc * before, dh * u], 2) * gates * (1 - gates)
            z = dz[:, t] = np.concatenate([z, dc * i * (1 - g * g)], 2)
            dW += s.transpose(0, 2, 1) @ z
            dh, dc = z @ turnedW, dc * f
        grads["W"], grads["X"] = dW, np.empty_like(self.p["X"])
        for d, columns in enumerate((x, x[::-1])):
            seen = np.zeros((T * N, CHARS), W.dtype)
            seen[np.arange(T * N), columns.reshape(-1)] = 1
            grads["X"][d] = seen.T @ dz[d].reshape(T * N, -1)
        return float((total - gold).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 3, batch: int = 64, rate: float = 0.025, seed: int = 0) -> "Tagger":
        """Adam over windows (rows of x and y) in shuffled batches, the rate falling to nothing."""
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        steps = rounds * (-(-len(x) // batch))
        k = 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for s in range(0, len(x), batch):
                at = order[s : s + batch]
                _, grads = self.loss(x[at].T, y[at].T)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                k += 1
                for name, g in grads.items():
                    g = g * min(1.0, 5 / (norm + 1e-9))
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.99 * second[name] + 0.01 * g * g
                    step = first[name] / (1 - 0.9**k) / (np.sqrt(second[name] / (1 - 0.99**k)) + 1e-8)
                    self.p[name] = (self.p[name] - rate * (1 - (k - 1) / steps) * step).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of windows (rows of x): the likeliest tags and each tag's probability."""
        _, e = self.emissions(x.T)
        A = self.p["A"] + _BARRED
        best, steps = e[0] + self.p["a"] + _NO_START, []
        for t in range(1, len(e)):
            through = best[:, :, None] + A[None]
            steps.append(through.argmax(1))
            best = through.max(1) + e[t]
        tags = np.empty(x.T.shape, np.int64)
        tags[-1] = best.argmax(1)
        for t in range(len(e) - 2, -1, -1):
            tags[t] = steps[t][np.arange(len(x)), tags[t + 1]]
        fore, back, *_ = self._messages(e)
        one = fore * back
        return tags.T, (np.take_along_axis(one, tags[:, :, None], 2)[:, :, 0] / one.sum(2)).T


# --- Labelled spans -------------------------------------------------------------------------------------------


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _card_digits(rng) -> str:
    d = str(rng.randrange(3, 7)) + "".join(rng.choices("0123456789", k=14))
    return next(d + str(c) for c in range(10) if luhn(d + str(c)))


def _planted(rng) -> tuple[str, int]:
    """A generated piece of text and its kind, or -1 for one that only looks alike."""
    pick = lambda *x: rng.choice(x)
    letters = lambda n: "".join(rng.choices(_LETTERS, k=n))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    kind = rng.randrange(-2, len(KINDS))
    if kind == 0:
        local = letters(rng.randrange(2, 11)) + pick("", "." + digits(2), "_" + letters(4), digits(2), "." + letters(5))
        at = pick("@", "@", " @ ", " [at] ", "[at]", "(at)", " (at) ", " {at} ", " [AT] ", " <at> ")
        dot = pick(".", ".", " . ", " [dot] ", "[dot]", "(dot)", " (dot) ") if at != "@" else "."
        host = [letters(rng.randrange(3, 9)) + pick("", digits(1)), *([letters(6)] if rng.random() < 0.5 else []), pick("com", "org", "net", "de", "fr", "example")]
        return local + at + dot.join(host), 0
    if kind == 1:
        if rng.random() < 0.25:
            return ":".join(f"{rng.randrange(65536):x}" for _ in range(8)), 1
        return pick(".", ".", "[.]", " . ", ",", "-", "_", "(.)").join(str(rng.randrange(256)) for _ in range(4)), 1
    if kind == 2:
        d = _card_digits(rng)
        return pick("", " ", "-", ".", "/", "_", "  ", " - ").join(d[k : k + 4] for k in range(0, 16, 4)), 2
    if kind == 3:
        a, b, c = digits(3), digits(3), digits(4)
        n = str(rng.randrange(1, 99))
        return pick(f"+{n} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{n} {a} {b}{c}", f"+{n}/{a}/{b}{c}", f"0{a}/{b}{c}", f"0{a} {b} {c}", f"{n}-{a}-{b}-{c}", f"+{n} {a} {b} {c}", f"({a}){b}{c}"), 3
    year = f"{rng.randrange(1900, 2100)}"
    month, day = f"{rng.randrange(1, 13):02d}", f"{rng.randrange(1, 29):02d}"
    hexes = "".join(rng.choices("0123456789abcdef", k=40))
    return pick(
        year, f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{month}/{day}/{year}", f"{year}-{year}", f"{day}:{month}", f"{day}:{month}:{day}", f"{rng.randrange(1, 20)}.{rng.randrange(0, 20)}.", f"{rng.randrange(1, 20)}.{rng.randrange(0, 20)}.{rng.randrange(0, 20)}",
        hexes, f'"{hexes}"', f"password={hexes[:18]}", f"AKIA{letters(8).upper()}{digits(4)}{letters(4).upper()}", digits(rng.randrange(1, 7)), digits(rng.randrange(20, 40)), f"{digits(3)},{digits(3)}.{digits(2)}", f"{digits(2)} %", f"p. {digits(3)}",
        f"{digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}", f"300.{digits(3)}.999.{digits(3)}", f"@{letters(6)}", f"{letters(3)} @ {digits(2)}", f"{letters(2)}{digits(3)}{letters(3)}", f"{digits(1)}.{digits(4)}e-{digits(2)}", f"#{digits(5)}", f"{letters(4)} at {letters(5)}",
    ), -1


def examples(windows: list[str], n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """n labelled windows: base spans of the texts, and generated pieces between their words."""
    rng = random.Random(seed)
    x, y = np.empty((n, WINDOW), np.int16), np.zeros((n, WINDOW), np.int64)
    for k in range(n):
        text = rng.choice(windows) if windows and rng.random() < 0.9 else " ".join("".join(rng.choices(_LETTERS, k=rng.randrange(1, 9))) for _ in range(20))
        spans = [(s, e, KINDS.index(kind)) for kind, s, e in base_spans(text)]
        if rng.random() < 0.9:
            for _ in range(rng.randrange(1, 3)):
                piece, kind = _planted(rng)
                gaps = [g for g in [0, *(m.end() for m in re.finditer(" ", text)), len(text)] if all(g <= s or g >= e for s, e, _ in spans)]
                at = rng.choice(gaps)
                tail = rng.choice((",", ".", "###", "", "", "", ";", ")", "\n"))
                spans = [(s, e, c) if e <= at else (s + len(piece + tail) + 1, e + len(piece + tail) + 1, c) for s, e, c in spans] + ([(at, at + len(piece), kind)] if kind >= 0 else [])
                text = text[:at] + piece + tail + " " + text[at:]
        if len(text) > WINDOW:  # any window, so that spans are also cut by its edges
            cut = rng.randrange(0, len(text) - WINDOW + 1)
            text, spans = text[cut : cut + WINDOW], [(max(s - cut, 0), min(e - cut, WINDOW), c) for s, e, c in spans]
        x[k] = characters(text)
        for s, e, c in spans:
            if s < e:
                y[k, s:e] = 2 + 2 * c
                y[k, s] = 1 + 2 * c
    return x, y


def sample_windows(docs: DataFrame, rows: int = SAMPLE) -> list[str]:
    """Windows of at most ``rows`` texts, those of the smallest hash of row: some by chance, some at base spans."""

    def cut(batches):
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
                places = [int(rng.integers(0, max(1, len(text) - WINDOW))) for _ in range(OF_A_ROW // 2)]
                places += [max(0, s - int(rng.integers(0, WINDOW // 2))) for _, s, _ in base_spans(text)[: OF_A_ROW // 2]]
                out += [text[p : p + WINDOW] for p in places]
            yield pd.DataFrame({"w": out})

    # About twice the rows wanted pass the first filter, whatever the table's size, so that the order has little to sort.
    share = min(1.0, 2 * rows / max(docs.count(), 1))
    some = docs.where("length(text) > 0").select("text", F.xxhash64("doc_id", "text").alias("h")).where(F.col("h") <= int(-(2**63) + share * (2**64 - 1025)))
    chosen = some.orderBy("h", "text").limit(rows)
    return sorted(r["w"] for r in chosen.select("text").mapInPandas(cut, "w string").collect())


def fit(docs: DataFrame, rows: int = SAMPLE, n: int = EXAMPLES) -> Tagger:
    """A tagger trained from n labelled windows of at most ``rows`` texts, in one task (whose numpy keeps to one core) on data of fixed size."""
    windows = sample_windows(docs, rows)

    def train(batches):
        for _ in batches:
            yield pd.DataFrame({"model": [pickle.dumps(Tagger().fit(*examples(windows, n)).p)]})

    model = Tagger()
    model.p = pickle.loads(docs.sparkSession.range(1, numPartitions=1).mapInPandas(train, "model binary").first()["model"])
    return model


# --- Search ---------------------------------------------------------------------------------------------------


def chosen(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of overlapping candidates (start, end, kind, score) the set of the greatest total score; ties to what ends first."""
    found = sorted({(s, e, k): (s, e, k, p) for s, e, k, p in sorted(found, key=lambda f: f[3])}.values(), key=lambda f: (f[1], f[0], f[2]))
    ends, best = [f[1] for f in found], [(0.0, -1, 0)]
    for i, (s, _, _, p) in enumerate(found):
        before = bisect_right(ends, s, 0, i)
        best.append(max(best[-1][0:1] + (-1, i), (best[before][0] + p, i, before), key=lambda b: b[0]))
    out, at = [], len(found)
    while at:
        _, i, before = best[at]
        if i >= 0:
            out.append(found[i])
        at = before
    return out[::-1]


class Search:
    """Spans of many texts: their windows are decoded together."""

    def __init__(self, model: Tagger):
        self.model = model

    def __call__(self, texts: list[str]) -> list[list[tuple]]:
        base = [base_spans(t) for t in texts]
        added: list[list] = [[] for _ in texts]
        waiting: list[tuple[int, int]] = []
        half = WINDOW // 2
        for k, text in enumerate(texts):
            last = -1
            for m in TRIGGER.finditer(text):
                w = m.start() // half
                for start in (w - 1, w):
                    if start > last and start >= 0:
                        waiting.append((k, start * half))
                        last = start
            while len(waiting) >= AT_ONCE:
                self._decode(texts, waiting[:AT_ONCE], added)
                waiting = waiting[AT_ONCE:]
        if waiting:
            self._decode(texts, waiting, added)
        out = []
        for k, text in enumerate(texts):
            taken = sorted((s, e) for _, s, e in base[k])
            reach, starts = [], [s for s, _ in taken]
            for _, e in taken:
                reach.append(max(e, reach[-1] if reach else 0))
            free = []
            for s, e, kind, p in added[k]:
                if kind == "email":
                    a, b = email_in(text[s:e])
                    s, e = s + a, s + b
                i = bisect_right(starts, e - 1)
                if not (i and reach[i - 1] > s) and plausible(kind, text[s:e]):
                    free.append((s, e, kind, p))
            spans = [(kind, s, e, True, 1.0) for kind, s, e in base[k]] + [(kind, s, e, False, p) for s, e, kind, p in chosen(free)]
            out.append(sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))
        return out

    def _decode(self, texts: list[str], windows: list[tuple[int, int]], added: list[list]) -> None:
        pieces = [texts[k][s : s + WINDOW] for k, s in windows]
        tags, sure = self.model.decode(np.stack([characters(p) for p in pieces]))
        for w in np.flatnonzero(tags.any(1)):
            (k, offset), size = windows[w], len(pieces[w])
            begins = np.flatnonzero(tags[w] % 2 == 1)
            for b in begins:
                e = b + 1
                while e < WINDOW and tags[w, e] == tags[w, b] + 1:
                    e += 1
                cut = (b == 0 and offset > 0) or (e >= size and offset + size < len(texts[k]))
                p = float(sure[w, b:e].min())
                if not cut and e <= size and p >= SURE:
                    added[k].append((offset + int(b), offset + int(e), KINDS[tags[w, b] // 2], p))


def find_spans(docs: DataFrame, model: Tagger, redact: bool = False) -> DataFrame:
    """doc_id, spans (by kind, then start) of every row, and with ``redact`` the text with <KIND> in their places."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: str, spans: list[tuple]) -> str:
        out, at = [], 0
        for kind, s, e, *_ in sorted(spans, key=lambda x: (x[1], -x[2])):
            if e > at:
                out += [text[at : max(s, at)], f"<{kind.upper()}>"] if s >= at else []
                at = e
        return "".join(out) + text[at:]

    def work(batches):
        search = Search(shared.value)
        for pdf in batches:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            found = search(texts)
            names = ("kind", "start", "end", "base", "score")
            out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "spans": [[dict(zip(names, s)) for s in f] for f in found]})
            yield out.assign(redacted=list(map(clean, texts, found))) if redact else out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(work, f"doc_id long, spans {SPANS}" + ", redacted string" * redact)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added)."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counted = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(counted, KINDS), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
