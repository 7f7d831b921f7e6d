"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are reduced to lower-case words joined by one blank, so that a window of item
words is a byte string bounded by blanks.  A shift table over hashed blocks skips
positions where no window can end its shortest prefix, the block found there selects
the windows to test, and a direct comparison confirms each occurrence.  The search
runs over many stretches of text at once with numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free_name

WINDOW = 10
#: Bytes of benchmark text searched for in one pass over the documents; a larger benchmark takes more passes.
MAX_PASS_BYTES = 8 << 20
#: Bytes of documents that a task searches at once.
CHUNK_BYTES = 2 << 20
_LANE = 2048
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and bytes over 7F, A-Z lower-cased."""
    return text.translate(_FOLD).split()


class Patterns:
    """Windows of one length class: shift table, buckets by block, and the windows themselves."""

    def __init__(self, windows: list[bytes]):
        self.windows = windows
        self.m = min(map(len, windows))  # all are searched by their first m bytes
        self.b = min(8, self.m)
        self.bits = min(22, max(12, (8 * len(windows) * self.m).bit_length()))
        blocks = np.frombuffer(b"".join(w[: self.m] for w in windows), np.uint8).reshape(len(windows), self.m)
        self.shift = np.full(1 << self.bits, self.m - self.b + 1, np.int32)
        for j in range(self.m - self.b + 1):
            np.minimum.at(self.shift, self.hash(self._pack(blocks[:, j : j + self.b])), self.m - self.b - j)
        last = self._pack(blocks[:, self.m - self.b :])
        self.order = np.argsort(last, kind="stable")
        self.last = last[self.order]

    def _pack(self, rows: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(rows), 8), np.uint8)
        wide[:, : self.b] = rows
        return wide.view(np.uint64).ravel()

    def hash(self, block: np.ndarray) -> np.ndarray:
        return ((block * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, text: bytes) -> list[tuple[int, int]]:
        """(start, window) of every occurrence; ``text`` ends with at least 8 NUL bytes."""
        n = len(text) - 8
        if n < self.m:
            return []
        blocks = np.ndarray((n + 1,), np.uint64, text, strides=(1,))
        mask = np.uint64((1 << (8 * self.b)) - 1)
        starts = np.arange(0, n - self.m + 1, _LANE)
        ends = np.minimum(starts + _LANE, n - self.m + 1)
        hits = []
        while len(starts):
            block = blocks[starts + (self.m - self.b)] & mask
            skip = self.shift[self.hash(block)]
            zero = skip == 0
            if zero.any():
                at, block = starts[zero], block[zero]
                i = np.minimum(np.searchsorted(self.last, block), len(self.last) - 1)
                same = self.last[i] == block
                hits.append(np.stack([at[same], i[same]]))
            starts = starts + np.maximum(skip, 1)
            on = starts < ends
            starts, ends = starts[on], ends[on]
        found = []
        for at, i in (np.concatenate(hits, axis=1).T.tolist() if hits else ()):
            block = self.last[i]
            while i < len(self.last) and self.last[i] == block:
                k = int(self.order[i])
                if text.startswith(self.windows[k], at):
                    found.append((at, k))
                i += 1
        return found


class Searcher:
    """All windows of some benchmark items, in classes of like length."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.owners: dict[bytes, list[str]] = {}
        for item, text in items:
            w = words(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                own = self.owners.setdefault(b" " + b" ".join(w[i : i + window]) + b" ", [])
                if item not in own:
                    own.append(item)
        classes: dict[int, list[bytes]] = {}
        for w in sorted(self.owners):
            classes.setdefault(min(len(w), 32).bit_length(), []).append(w)
        self.classes = [Patterns(ws) for ws in classes.values()]

    def search(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: number of words, hit word spans (merged, end exclusive) and items found."""
        split = [words(t) for t in texts]
        parts = [b" " + b" ".join(w) + b" \x00" for w in split]
        whole = b"".join(parts) + b"\x00" * 8
        begins = np.cumsum([0, *map(len, parts)])
        found = [(at, c.windows[k]) for c in self.classes for at, k in c.find(whole)]
        spans: dict[int, list] = {}
        if found:
            blanks = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
            at = np.array([f[0] for f in found])
            doc = np.searchsorted(begins, at, "right") - 1
            word = np.searchsorted(blanks, at) - np.searchsorted(blanks, begins[doc])
            for d, w, (_, window) in zip(doc.tolist(), word.tolist(), found):
                spans.setdefault(d, []).append((w, w + window.count(b" ") - 1, window))
        out = []
        for d, w in enumerate(split):
            merged: list[tuple[int, int]] = []
            items: set[str] = set()
            for a, b, window in sorted(spans.get(d, ())):
                items.update(self.owners[window])
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            out.append((len(w), merged, sorted(items)))
        return out


def _passes(spark: SparkSession, benchmark: DataFrame, item: str, text: str, most: int):
    """The items in blocks of at most ``most`` bytes (one item at least)."""
    rows = benchmark.select(F.coalesce(benchmark[item].cast("string"), F.lit("")).alias("i"), F.encode(F.coalesce(benchmark[text], F.lit("")), "UTF-8").alias("t")).distinct()
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r.t) > most:
            yield block
            block, size = [], 0
        block.append((r.i, bytes(r.t)))
        size += len(r.t)
    if block:
        yield block


def _merge(a, b):
    spans: list[list[int]] = []
    for s, e in sorted([*a, *b]):
        if spans and s <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], e)
        else:
            spans.append([s, e])
    return [tuple(s) for s in spans]


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, out: str = "hits", text: str = "text", item: str = "item_id", item_text: str = "text", pass_bytes: int = MAX_PASS_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with a struct column (its name is returned too): n_words, spans, items.

    ``spans`` are merged word ranges (end exclusive) inside occurrences of ``window``
    consecutive item words; a shorter item with words is one window.  ``items`` are the
    distinct ids found, as sorted strings (a null id counts as the empty string).
    Null texts have no words.  Repeated documents are searched alike, repeated items
    count once, an empty benchmark finds nothing.  No shuffle: documents stream past
    the windows, which are broadcast in passes of at most ``pass_bytes``.
    """
    spark = docs.sparkSession
    out = free_name(docs, out)
    kind = "struct<n_words: bigint, spans: array<struct<s: int, e: int>>, items: array<string>>"
    d = docs.withColumn(out, F.lit(None).cast(kind))
    at, col = d.columns.index(text), len(d.columns) - 1
    arrow = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("items", pa.list_(pa.string()))])

    def one_pass(df: DataFrame, items) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)

        def search(batches):
            searcher = Searcher(sent.value, window)
            for b in batches:
                texts = b.column(at).cast(pa.large_binary())
                sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.zeros(0, np.int64)
                first = 0
                while first < len(texts):
                    last, size = first, 0
                    while last < len(texts) and (last == first or size + sizes[last] <= CHUNK_BYTES):
                        size += sizes[last]
                        last += 1
                    part = b.slice(first, last - first)
                    got = searcher.search([t or b"" for t in texts.slice(first, last - first).to_pylist()])
                    before = part.column(col).to_pylist()
                    rows = [
                        {"n_words": n, "spans": [{"s": s, "e": e} for s, e in _merge(spans, [(x["s"], x["e"]) for x in old["spans"]] if old else [])], "items": sorted({*found, *(old["items"] if old else ())})}
                        for (n, spans, found), old in zip(got, before)
                    ]
                    yield pa.RecordBatch.from_arrays([*part.columns[:col], pa.array(rows, arrow)], names=part.schema.names)
                    first = last

        return df.mapInArrow(search, d.schema)

    blocks = _passes(spark, benchmark, item, item_text, pass_bytes)
    now, following = next(blocks, []), next(blocks, None)
    d = one_pass(d, now)
    while following is not None:
        d = one_pass(cut(d), following)
        following = next(blocks, None)
    return d, out
