"""Personal data: four base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments (digit counts, checksums, shape, what stands
beside them) for each type, and dynamic programming over segments of bounded length picks
boundaries and types together.
"""

from __future__ import annotations

import re
from itertools import chain
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Kinds of the base patterns; the field also knows secrets (keys, tokens, pass words).
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Tokens of the longest segment.
MAX_TOKENS = 24
#: Characters of context on each side of a token that can be part of a segment.
AROUND = 48
#: Start tokens whose segments are scored at once: bounds a decoder's memory in windows of any length.
BLOCK = 4096
#: Training reads at most so many documents, of at most so many characters, and so many windows of at most so many characters.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_WINDOWS, TRAIN_WINDOW = 400, 20_000, 600, 400
#: What a segment's score must exceed for it to be added.
MARGIN = 2.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The leftmost, non-overlapping matches of each kind that pass its test, in linear time."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    done, at = 0, text.find("@")
    while at >= 0:  # the run of local characters before an @ is where a match can start
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found["email"].append((start, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p or "0") < 256 for p in (q.lstrip("0") for q in m.group().split("."))):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found["phone"].append(m.span())
    return found


_TOKEN = re.compile(r"[^\W_]+|\s|.", re.S)
_AT = r"[\[({<] ?at ?[\])}>]"
_SIGNAL = re.compile(rf"[0-9]|@|{_AT}", re.I)
#: What can hold a secret: one token of letters and digits that no word looks like.
_SECRET = re.compile(r"(?<![^\W_])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{20,}(?![^\W_])")
_CUE = re.compile(r"(?:key|token|secret|passw(?:or)?d|pwd|auth|bearer|api)[\w-]*[\"' ]*(?:[:=]+|is)?[\"' ]*$", re.I)
N_FEATURES = 18


def boundaries(text: str, a: int, b: int) -> np.ndarray:
    """Of the tokens of a window, which leave nothing out."""
    return np.fromiter(chain((a,), (m.end() for m in _TOKEN.finditer(text, a, b))), np.int64)


class Tokens:
    """Some tokens of a window with running sums, so that any segment's features take constant time."""

    def __init__(self, text: str, cuts: np.ndarray):
        self.cuts = cuts
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        words = [text[s:e] for s, e in spans]
        n = len(words)
        self.word = np.array([w[0].isalnum() for w in words], bool)
        self.digit = np.array([w.isascii() and w.isdigit() for w in words], bool)
        self.first = np.array([ord(w[0]) for w in words], np.int64)
        self.small = np.array([d and len(w) < 4 and int(w) < 256 for w, d in zip(words, self.digit)], bool)
        mixed = np.array([len(w) if w.isascii() and w.isalnum() and not w.isdigit() and not w.isalpha() else 0 for w in words], np.int64)
        self.mixed = mixed
        turns = [sum(x.isdigit() != y.isdigit() for x, y in zip(w, w[1:])) / len(w) if m else 0.0 for w, m in zip(words, mixed)]
        self.turns = np.array(turns, float)
        self.cue = np.array([bool(m) and bool(_CUE.search(text[max(0, s - 24) : s])) for (s, _), m in zip(spans, mixed >= 8)], bool)
        space = np.array([w.isspace() for w in words], bool)
        self.newline = np.array([w == "\n" for w in words], bool)
        opens, closes = np.isin(self.first, [ord(c) for c in "[({<"]), np.isin(self.first, [ord(c) for c in "])}>"])
        sided = np.zeros(n, bool)
        if n > 2:
            gap = lambda k, to: np.where(space[np.clip(k, 0, n - 1)], to, k)
            k = np.arange(n)
            before, after = gap(k - 1, k - 2), gap(k + 1, k + 2)
            sided = (before >= 0) & (after < n) & opens[np.clip(before, 0, n - 1)] & closes[np.clip(after, 0, n - 1)]
        low = [w.lower() if len(w) < 4 else "" for w in words]
        self.at = self.first == 64
        self.masked = sided & np.array([w == "at" for w in low], bool)
        dot = (self.first == 46) | sided & np.array([w == "dot" for w in low], bool)
        sums = lambda x: np.r_[0, np.cumsum(x, dtype=np.int64)]
        count = np.diff(self.cuts)
        self.digits = sums(np.where(self.digit, count, 0))
        self.ats, self.masks, self.dots, self.spaces = sums(self.at), sums(self.masked), sums(dot), sums(space)
        self.seps = sums(np.where(self.digit, 0, count))
        self.odd = sums(~(self.digit | np.isin(self.first, [ord(c) for c in " ().+-"])))
        address = self.word | dot | self.at | self.masked | space | opens | closes | np.isin(self.first, [ord(c) for c in "_%+-"])
        self.foreign = sums(~address)
        self.plus = sums(self.first == 43)
        self.opens, self.closes = sums(opens), sums(closes)
        self.loose = sums(space & ~np.r_[False, closes[:-1]] & ~np.r_[opens[1:], False])  # blanks that stand beside no bracket
        self.goes_on = np.isin(self.first, [45, 46]) & np.r_[self.word[1:], False] | space & np.r_[opens[1:], False]
        self.lines = sums(self.newline)
        last_at = np.maximum.accumulate(np.r_[-1, np.where(self.at | self.masked, np.arange(n), -1)])
        self.last_at = last_at  # of the tokens before each boundary
        # digits one after the other, summed as Luhn does with every second doubled, from either parity
        run = np.array([int(c) for w, d in zip(words, self.digit) if d for c in w], np.int64)
        twice = run * 2 - 9 * (run > 4)
        even = np.arange(len(run)) % 2 == 0
        self.luhn = sums(np.where(even, run, twice)), sums(np.where(even, twice, run))

    def segments(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidate segments (i, j) of boundary numbers that start at a token of lo to hi - 1, by start, then end."""
        n = len(self.word)
        start = np.arange(lo, hi)[(self.word | np.isin(self.first, [43, 40]))[lo:hi]]
        i = np.repeat(start, MAX_TOKENS)
        j = i + np.tile(np.arange(1, MAX_TOKENS + 1), len(start))
        on = j <= n
        i, j = i[on], j[on]
        at = self.ats[j] - self.ats[i] + self.masks[j] - self.masks[i] > 0
        on = self.word[j - 1] & (self.lines[j] == self.lines[i]) & ((self.digits[j] - self.digits[i] >= 4) | at | (j - i == 1) & (self.mixed[i] >= 8))
        return i[on], j[on]

    def features(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of segments as wholes: shape, digits, checks, and what stands beside them."""
        n = len(self.word)
        between = lambda x: x[j] - x[i]
        count, size = between(self.digits), self.cuts[j] - self.cuts[i]
        only = between(self.odd) == 0
        k = np.minimum(i[:, None] + np.arange(7), n - 1)
        quad = (j - i == 7) & self.small[k[:, ::2]].all(axis=1) & (self.first[k[:, 1::2]] == 46).all(axis=1)
        # the last digit is not doubled: the parity of the place after it says which sum to take
        total = np.where(self.digits[j] % 2 == 1, *(x[self.digits[j]] - x[self.digits[i]] for x in self.luhn))
        long = (count >= 13) & (count <= 19) & only
        host = self.dots[j] - self.dots[np.maximum(self.last_at[j], 0) + 1]
        one = (between(self.ats) == 1) & (between(self.masks) == 0) & (between(self.spaces) == 0)
        shown = (between(self.ats) + between(self.masks) == 1) & (host > 0) & (between(self.foreign) + between(self.loose) == 0) & (between(self.opens) == between(self.closes))
        mail = one & shown
        beside = lambda on, k: np.where(on, self.first[np.clip(k, 0, n - 1)], 0)
        left, right = beside(i > 0, i - 1), beside(j < n, j)
        joined = lambda c, k: (c == 95) | (c == 64) | (c > 0) & self.word[np.clip(k, 0, n - 1)]
        single = (j - i == 1) & (self.mixed[i] > 0)
        return np.stack(
            [
                np.ones(len(i)),
                quad,
                long & (between(self.plus) == 0),
                long & (total % 10 == 0),
                (count >= 9) & (count <= 15) & only,
                self.first[i] == 43,
                mail,
                shown & ~mail,
                joined(left, i - 1) | joined(right, j),
                np.isin(left, [45, 43, 46, 37]),
                (j < n) & self.goes_on[np.minimum(j, n - 1)],
                only & (count > 0) & (2 * between(self.seps) > size),
                ~only & ~shown & ~single,
                np.minimum(size, 60) / 60,
                single & (size >= 20),
                np.where(single, self.turns[i], 0.0),
                single & self.cue[i],
                self.first[i] == 40,
            ],
            axis=1,
        ).astype(float)


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of text around tokens that can be part of a segment: between them nothing is."""
    out: list[list[int]] = []
    for m in _SIGNAL.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    # a window does not begin or end inside a word
    grown: list[tuple[int, int]] = []
    for a, b in out:
        while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        while b < len(text) and text[b - 1].isalnum() and text[b].isalnum():
            b += 1
        if grown and a <= grown[-1][1]:
            grown[-1] = (grown[-1][0], b)
        else:
            grown.append((a, b))
    return grown


def decode(text: str, a: int, b: int, w: np.ndarray) -> list[tuple[str, int, int, float]]:
    """The best segmentation of a window: (kind, start, end, score) of its entities.

    Boundaries are passed from left to right; segments are scored a block of starts at
    a time, so a window of any length keeps a few numbers a token.
    """
    cuts = boundaries(text, a, b)
    n = len(cuts) - 1
    best, back, kind, value = np.zeros(n + 1), np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int8), np.zeros(n + 1)
    for lo in range(0, n, BLOCK):
        hi, from_ = min(n, lo + BLOCK), max(0, lo - 4)
        t = Tokens(text, cuts[from_ : hi + MAX_TOKENS + 5])
        i, j = t.segments(lo - from_, hi - from_)
        if len(i):
            f = t.features(i, j) @ w.T
            top, which = f.max(axis=1), f.argmax(axis=1)
            i, j = i + from_, j + from_
            bounds = np.searchsorted(i, np.arange(lo, hi + 1)).tolist()
        for x in range(lo, hi):
            if x and best[x - 1] >= best[x]:
                best[x], back[x] = best[x - 1], -1
            if len(i) and bounds[x - lo] < bounds[x - lo + 1]:
                k = slice(bounds[x - lo], bounds[x - lo + 1])
                to, v = j[k], best[x] + top[k]
                up = v > best[to]
                best[to[up]], back[to[up]], kind[to[up]], value[to[up]] = v[up], x, which[k][up], top[k][up]
    out, j = [], n
    if n and best[n - 1] >= best[n]:
        back[n] = -1
    while j > 0:
        i = int(back[j])
        if i < 0:
            j -= 1
        else:
            out.append((KINDS[kind[j]], int(cuts[i]), int(cuts[j]), float(value[j])))
            j = i
    return out[::-1]


def disguised(text: str, spans: dict[str, list[tuple[int, int]]]) -> tuple[str, dict[str, list[tuple[int, int]]]]:
    """The text with its addresses and numbers as people hide them from patterns, and where they then stand."""
    out, found, at = [], {k: [] for k in KINDS}, 0
    size = 0
    for a, b, k in sorted((a, b, k) for k, v in spans.items() for a, b in v):
        if a < at:
            continue
        s = text[a:b]
        if k == "email":
            name, _, host = s.partition("@")
            s = f"{name} [at] {host.replace('.', ' [dot] ')}"
        elif k == "phone":
            s = s.lstrip("+0123456789").lstrip(" -.") or s
        elif k == "card":
            d = _digits(s)
            s = "-".join(d[i : i + 4] for i in range(0, len(d), 4))
        piece = text[at:a]
        out += [piece, s]
        found[k].append((size + len(piece), size + len(piece) + len(s)))
        size += len(piece) + len(s)
        at = b
    return "".join([*out, text[at:]]), found


def gold(text: str) -> dict[str, list[tuple[int, int]]]:
    """What the field learns from: the base spans, and tokens that only a secret looks like."""
    spans = dict(base_spans(text))
    spans["secret"] = [m.span() for m in _SECRET.finditer(text)]
    return spans


def examples(texts: list[str]) -> list[tuple]:
    """(boundaries, i, j, features, chosen) of the windows of the texts as they are and in disguise."""
    data = []
    for text in texts:
        spans = gold(text)
        for t, marks in ((text, spans), disguised(text, spans)):
            known = {s: KINDS.index(k) for k, v in marks.items() for s in v}
            for a, b in windows(t):
                if b - a > TRAIN_WINDOW or len(data) >= TRAIN_WINDOWS:
                    continue
                x = Tokens(t, boundaries(t, a, b))
                i, j = x.segments(0, len(x.word))
                if not len(i):
                    continue
                cuts, chosen = x.cuts.tolist(), []
                for k, (p, q) in enumerate(zip(i.tolist(), j.tolist())):  # base kinds may overlap each other; a segmentation may not
                    kind = known.get((cuts[p], cuts[q]))
                    if kind is not None and all(p >= j[c] or q <= i[c] for c, _ in chosen):
                        chosen.append((k, kind))
                data.append((len(cuts), i, j, x.features(i, j), chosen))
    return data


def _log_add(x: float, y: float) -> float:
    return x + log1p(exp(y - x)) if x > y else y + log1p(exp(x - y))


def likelihood(w: np.ndarray, data: list[tuple]) -> tuple[float, np.ndarray]:
    """Mean log-likelihood of the chosen segmentations, and its gradient."""
    total, grad = 0.0, np.zeros_like(w)
    for n, i, j, f, chosen in data:
        s = f @ w.T
        top = np.logaddexp.reduce(s, axis=1)
        fwd, bwd = [0.0] * n, [0.0] * n
        order = np.argsort(j, kind="stable")
        x = 1
        for p, q, v in zip(i[order].tolist(), j[order].tolist(), top[order].tolist()):  # by end
            while x <= q:
                fwd[x] = fwd[x - 1]
                x += 1
            fwd[q] = _log_add(fwd[q], fwd[p] + v)
        for x in range(x, n):
            fwd[x] = fwd[x - 1]
        x = n - 2
        for p, q, v in zip(i[::-1].tolist(), j[::-1].tolist(), top[::-1].tolist()):  # segments come sorted by start
            while x >= p:
                bwd[x] = bwd[x + 1]
                x -= 1
            bwd[p] = _log_add(bwd[p], bwd[q] + v)
        for x in range(x, -1, -1):
            bwd[x] = bwd[x + 1]
        fwd, bwd = np.array(fwd), np.array(bwd)
        prob = np.exp(np.minimum(0, fwd[i][:, None] + s + bwd[j][:, None] - fwd[-1]))
        grad -= prob.T @ f
        total -= fwd[-1]
        for k, t in chosen:
            grad[t] += f[k]
            total += s[k, t]
    return total / max(1, len(data)), grad / max(1, len(data))


def train(texts: list[str], rounds: int = 60) -> np.ndarray:
    """Weights (kind x feature) by regularised maximum likelihood of what :func:`gold` marks, also in disguise."""
    data = examples(texts)
    w = np.zeros((len(KINDS), N_FEATURES))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        grad = likelihood(w, data)[1] - 1e-3 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(text: str, w: np.ndarray | None) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """(base spans, spans that the field adds: they overlap no base span)."""
    base = base_spans(text)
    more: list[tuple[str, int, int]] = []
    if w is not None:
        taken = _merged(sorted(s for v in base.values() for s in v))
        ends, at = [e for _, e in taken], 0
        for a, b in windows(text):
            for kind, s, e, value in decode(text, a, b, w):
                if value <= MARGIN:
                    continue
                while at < len(taken) and ends[at] <= s:
                    at += 1
                if at == len(taken) or taken[at][0] >= e:
                    more.append((kind, s, e))
    return base, more


def fit(docs: DataFrame, most: int = TRAIN_DOCS, text: str = "text") -> np.ndarray | None:
    """Weights from at most ``most`` documents of under TRAIN_CHARS characters with a digit or an @, those with the least hash of their text."""
    t = docs[text].cast("string")
    usable = docs.select(t.alias("t")).where(F.col("t").rlike("[0-9@]") & (F.length("t") < TRAIN_CHARS)).withColumn("h", F.xxhash64("t"))
    # hashes first, so that no task sends the driver more than ``most`` numbers
    edge = usable.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    rows = usable.where(F.col("h") <= edge).select("t", "h").distinct().orderBy("h", "t").collect() if edge is not None else []
    return train([r.t for r in rows]) if rows else None


def find_pii(docs: DataFrame, weights: np.ndarray | None, text: str = "text", out: str = "pii") -> tuple[DataFrame, str]:
    """``docs`` with an array column (its name is returned too) of struct kind, s, e, base.

    Spans are in code points, end exclusive, sorted by kind (as in KINDS) and start; base
    spans are all there, added ones overlap none of them.  Null and empty texts have none;
    texts of any length are read whole, in time and memory in proportion to them; every row
    is handled on its own, so repeated rows and ids have equal spans; an empty table stays
    empty; a column named as ``out`` gets an underscore beside it.
    """
    out = free_name(docs, out)
    d = docs.withColumn(out, F.lit(None).cast("array<struct<kind: string, s: int, e: int, base: boolean>>"))
    at = d.columns.index(text)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("base", pa.bool_())]))
    signal = re.compile(_SIGNAL.pattern.encode(), re.I)

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(at).cast(pa.large_binary()):
                raw = t.as_py()
                if not raw or not signal.search(raw):
                    rows.append([])
                    continue
                base, more = find(raw.decode("utf-8", "replace"), weights)
                spans = [(KINDS.index(k), s, e, True) for k, v in base.items() for s, e in v] + [(KINDS.index(k), s, e, False) for k, s, e in more]
                rows.append([{"kind": KINDS[k], "s": s, "e": e, "base": is_base} for k, s, e, is_base in sorted(spans)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, arrow)], names=b.schema.names)

    return d.mapInArrow(run, d.schema), out
