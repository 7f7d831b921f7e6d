"""Quality classifier: a linear-chain conditional random field over lines, aggregated to documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Labelled documents that training collects at most, and lines beyond which one of them is not trained on.
TRAIN_DOCS = 4000
TRAIN_LINES = 2000
CHUNK_BYTES = 2 << 20
#: How likely a line shares its document's label, as training takes it.
AGREE = 0.9

_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _BANG, _PIPE, _MARK, _STOP, _HIGH = range(10)
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LOWER, _UPPER, _DIGIT, _HIGH
for _chars, _c in ((b" \t\r\x0b\x0c", _SPACE), (b"!", _BANG), (b"|", _PIPE), (b"#$%&*+-/:;<=>@\\^_`{}~[]", _MARK), (b".,?'\"()", _STOP)):
    _CLASS[list(_chars)] = _c
#: Features of a line itself; the chain adds the same of the line before and after where NEAR says so.
NAMES = ["length", "upper", "digit", "space", "bang", "pipe", "mark", "stop", "high", "repeated words", "seen line", "word length", "symbol ends", "short", "blank"]
NEAR = [1, 4, 5, 6, 9, 10, 12]


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every line, lines per text, bytes per line); a text has at least one line, lines end at newlines."""
    whole = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    ends = np.flatnonzero(whole == 10)
    starts = np.r_[0, ends[:-1] + 1]
    size = ends - starts
    n = len(ends)
    text_end = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.r_[0, np.searchsorted(ends, text_end - 1) + 1])
    line = np.repeat(np.arange(n), size + 1)
    count = np.bincount(line * 10 + _CLASS[whole], minlength=n * 10).reshape(n, 10).astype(np.float64)
    safe = np.maximum(size, 1)[:, None]
    # words: runs of bytes that are neither blanks nor newlines, each with a polynomial hash
    solid = (_CLASS[whole] != _SPACE) & (whole != 10)
    first = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
    after = np.flatnonzero(solid & ~np.r_[solid[1:], False]) + 1
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(len(whole), np.uint64(0x9E3779B97F4A7C15)))
        down = np.cumprod(np.full(len(whole), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))))
        total = np.r_[np.uint64(0), np.cumsum((whole.astype(np.uint64) + np.uint64(1)) * up)]
        word = (total[after] - total[first]) * down[first]
        row = (total[ends] - total[starts]) * down[np.minimum(starts, len(whole) - 1)]
        text_of_line = np.repeat(np.arange(len(texts)), per_text)
        word_line = line[first]
        keyed = (word ^ (word >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word_line.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        row_key = row + text_of_line.astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    words = np.bincount(word_line, minlength=n).astype(np.float64)
    # the first of each equal (line, word) key counts towards its line's distinct words
    order = np.argsort(keyed)
    new = np.r_[True, keyed[order[1:]] != keyed[order[:-1]]] if len(order) else np.zeros(0, bool)
    distinct = np.bincount(word_line[order[new]], minlength=n).astype(np.float64)
    by = np.argsort(row_key, kind="stable")
    again = np.zeros(n, bool)
    again[by[1:]] = (row_key[by[1:]] == row_key[by[:-1]]) & (size[by[1:]] > 0)
    mark_end = np.bincount(word_line, weights=np.isin(_CLASS[whole[after - 1]], (_BANG, _MARK)), minlength=n)
    share = count / safe
    x = np.stack(
        [
            np.log1p(size) / 6,
            *(share[:, c] for c in (_UPPER, _DIGIT, _SPACE, _BANG, _PIPE, _MARK, _STOP, _HIGH)),
            1 - distinct / np.maximum(words, 1),
            again.astype(float),
            np.minimum(size / np.maximum(words, 1), 30) / 10,
            mark_end / np.maximum(words, 1),
            (words < 4).astype(float),
            (size == 0).astype(float),
        ],
        axis=1,
    )
    return x, per_text, size


def chain_features(x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Own features, neighbours' features (zero beyond the text's ends) and a constant."""
    first = np.cumsum(per_text) - per_text
    before, after = np.zeros((len(x), len(NEAR))), np.zeros((len(x), len(NEAR)))
    before[1:], after[:-1] = x[:-1, NEAR], x[1:, NEAR]
    before[first], after[first + per_text - 1] = 0, 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


@dataclass
class Model:
    emit: np.ndarray  # weight of each feature for good against bad
    trans: np.ndarray  # score of each pair of neighbouring labels
    scale: float = 1.0
    shift: float = 0.0

    def marginals(self, f: np.ndarray, per_text: np.ndarray, more: np.ndarray | float = 0.0, weight: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line by forward-backward; weighted pair expectations; log partition of each line's text.

        ``more`` is added to the lines' scores for good; ``weight`` is how much each line's pair with the one before it counts.
        """
        score = f @ self.emit + more
        order = np.argsort(-per_text, kind="stable")  # longest first: the texts still running are a prefix
        first = (np.cumsum(per_text) - per_text)[order]
        sizes = per_text[order]
        steps = int(sizes[0]) if len(sizes) else 0
        live = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")
        alpha = np.zeros((len(score), 2))
        beta = np.zeros((len(score), 2))
        for t in range(steps):
            at = first[: live[t]] + t
            if t:
                p = alpha[at - 1]
                a0 = np.logaddexp(p[:, 0] + self.trans[0, 0], p[:, 1] + self.trans[1, 0])
                a1 = np.logaddexp(p[:, 0] + self.trans[0, 1], p[:, 1] + self.trans[1, 1])
                alpha[at, 0], alpha[at, 1] = a0, a1 + score[at]
            else:
                alpha[at, 1] = score[at]
        for t in range(steps - 2, -1, -1):
            at = first[: live[t + 1]] + t
            nb, ns = beta[at + 1], score[at + 1]
            beta[at, 0] = np.logaddexp(nb[:, 0] + self.trans[0, 0], nb[:, 1] + ns + self.trans[0, 1])
            beta[at, 1] = np.logaddexp(nb[:, 0] + self.trans[1, 0], nb[:, 1] + ns + self.trans[1, 1])
        both = alpha + beta
        z = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - z)
        inner = np.ones(len(score), bool)
        inner[np.cumsum(per_text) - per_text] = False
        i = np.flatnonzero(inner)
        pair = np.zeros((2, 2))
        w = np.broadcast_to(weight, len(score))[i]
        for a in (0, 1):
            for b in (0, 1):
                pair[a, b] = np.exp(alpha[i - 1, a] + self.trans[a, b] + (score[i] if b else 0) + beta[i, b] - z[i]) @ w
        return good, pair, z

    def documents(self, good: np.ndarray, per_text: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' marginals, calibrated."""
        w = size + 1.0
        first = np.cumsum(per_text) - per_text
        mean = np.add.reduceat(good * w, first) / np.add.reduceat(w, first) if len(first) else np.zeros(0)
        p = np.clip(mean, 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.scale * np.log(p / (1 - p)) + self.shift)))


def likelihood(theta: np.ndarray, f: np.ndarray, per_text: np.ndarray, label: np.ndarray, w_doc: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Log-likelihood of the documents' labels, weighted and regularised, and its gradient.

    The lines' labels are not known: a line has its document's label with probability
    AGREE.  ``theta`` is the emission weights, then the scores of staying bad and staying good.
    """
    model = Model(theta[:-2], np.array([[theta[-2], 0.0], [0.0, theta[-1]]]))
    known = np.repeat(np.where(label == 1, 1.0, -1.0), per_text) * np.log(AGREE / (1 - AGREE))
    w, first = np.repeat(w_doc, per_text), np.cumsum(per_text) - per_text
    free, free_pair, z = model.marginals(f, per_text, 0.0, w)
    held, held_pair, zk = model.marginals(f, per_text, known, w)
    value = w_doc @ (zk[first] - z[first]) - w @ np.maximum(known, 0) - l2 / 2 * theta @ theta
    pairs = held_pair - free_pair
    return value, np.r_[f.T @ (w * (held - free)), pairs[0, 0], pairs[1, 1]] - l2 * theta


def train(x: np.ndarray, per_text: np.ndarray, size: np.ndarray, label: np.ndarray, rounds: int = 120, l2: float = 1e-3) -> Model:
    """Emissions and transitions by maximum likelihood (see :func:`likelihood`), then a logistic calibration of documents."""
    f = chain_features(x, per_text)
    share = max(1e-9, label.mean()), max(1e-9, 1 - label.mean())
    # a document counts less than its lines together; both classes weigh the same
    w_doc = np.where(label == 1, 0.5 / share[0], 0.5 / share[1]) / len(label) / np.sqrt(per_text)
    theta = np.zeros(f.shape[1] + 2)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        grad = likelihood(theta, f, per_text, label, w_doc, l2)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    model = Model(theta[:-2], np.array([[theta[-2], 0.0], [0.0, theta[-1]]]))
    p = model.documents(model.marginals(f, per_text)[0], per_text, size)
    logit = np.log(p / (1 - p))
    a, b = 1.0, 0.0
    for _ in range(200):
        q = 1 / (1 + np.exp(-(a * logit + b)))
        r = label - q
        s = q * (1 - q) + 1e-6
        h = np.array([[(s * logit**2).mean() + 1e-3, (s * logit).mean()], [(s * logit).mean(), s.mean() + 1e-3]])
        step = np.linalg.solve(h, [(r * logit).mean() - 1e-3 * (a - 1), r.mean()])
        a, b = a + 0.5 * step[0], b + 0.5 * step[1]
    return Model(model.emit, model.trans, float(max(a, 0.05)), float(b))


def held_out(doc_id) -> "F.Column":
    """Whether a document is never learned from: crc32 of its id as text leaves 1 modulo 3 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _chunks(texts):
    first = 0
    while first < len(texts):
        last, size, part = first, 0, []
        while last < len(texts) and (last == first or size < CHUNK_BYTES):
            part.append(texts[last].as_py() or b"")
            size += len(part[-1])
            last += 1
        yield first, last, part
        first = last


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, text: str = "text") -> Model:
    """Train on at most ``most`` labelled documents: those with the least hash of their id among the ones not held out.

    Documents with more than TRAIN_LINES lines are left out of training (not of scoring); of a repeated id the least text counts.
    Without any usable label the model gives every document one half.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_y"), F.min("quality").alias("_y0")).where("_y = _y0")
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(most).select("_id", "_y")
    rows = docs.select(docs["doc_id"].alias("_doc"), docs[text].cast("string").alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    rows = rows.groupBy("_doc", "_y").agg(F.min("_text").alias("_text"))  # of repeated ids one text each, so the bound holds

    def run(batches):
        for b in batches:
            y = b.column(1).to_pylist()
            for first, last, part in _chunks(b.column(2).cast(pa.large_binary())):
                x, per, size = line_features(part)
                end = np.cumsum(per)
                for i, (e, n) in enumerate(zip(end, per)):
                    if n <= TRAIN_LINES:
                        yield pa.RecordBatch.from_pylist([{"id": b.column(0)[first + i].as_py(), "y": y[first + i], "size": size[e - n : e].tolist(), "x": x[e - n : e].astype(np.float32).ravel().tolist()}], schema=schema)

    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("size", pa.list_(pa.int64())), ("x", pa.list_(pa.float32()))])
    got = rows.mapInArrow(run, "id long, y int, size array<long>, x array<float>").toArrow().sort_by("id")
    label = np.array(got["y"].to_pylist(), float)
    if len(label) == 0 or label.min() == label.max():
        return Model(np.zeros(len(NAMES) + 2 * len(NEAR) + 1), np.zeros((2, 2)), 0.0, 0.0 if len(label) == 0 else (3.0 if label[0] else -3.0))
    size = got["size"].combine_chunks()
    per = np.diff(size.offsets.to_numpy())
    x = got["x"].combine_chunks().values.to_numpy().reshape(-1, len(NAMES)).astype(float)
    return train(x, per, size.values.to_numpy(), label)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "quality") -> tuple[DataFrame, str]:
    """``docs`` with a struct column (its name is returned too): score, and ``bad_lines``, the spans of lines labelled bad.

    ``bad_lines`` holds (first line, line after the last) of each run of lines that are
    more likely bad than good.  Null and empty texts are one empty line; texts of any length
    are read whole, a chunk of documents at a time; every row is scored on its own.
    """
    out = free_name(docs, out)
    d = docs.withColumn(out, F.lit(None).cast("struct<score: double, bad_lines: array<struct<s: int, e: int>>>"))
    at = d.columns.index(text)
    arrow = pa.struct([("score", pa.float64()), ("bad_lines", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])

    def run(batches):
        for b in batches:
            for first, last, part in _chunks(b.column(at).cast(pa.large_binary())):
                x, per, size = line_features(part)
                good, _, _ = model.marginals(chain_features(x, per), per)
                value = model.documents(good, per, size)
                end = np.cumsum(per)
                bad = good < 0.5
                rows = []
                whole = bad.any()
                for i, (e, n) in enumerate(zip(end.tolist(), per.tolist())):
                    runs = []
                    if whole and bad[e - n : e].any():
                        k = np.flatnonzero(np.diff(np.r_[0, bad[e - n : e].view(np.int8), 0]))
                        runs = [{"s": s, "e": t} for s, t in zip(k[::2].tolist(), k[1::2].tolist())]
                    rows.append({"score": float(value[i]), "bad_lines": runs})
                yield pa.RecordBatch.from_arrays([*b.slice(first, last - first).columns[:-1], pa.array(rows, arrow)], names=b.schema.names)

    return d.mapInArrow(run, d.schema), out
