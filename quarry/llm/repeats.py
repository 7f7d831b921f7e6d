"""Repeated byte strings across documents: maximal repeats from the interval tree of enhanced suffix arrays.

A string of MIN_BYTES holds one anchor, the least hash of its ANCHOR-byte pieces, and
equal strings hold equal anchors at equal offsets.  So occurrences are first sorted by
anchor and by the hash of all the text that the anchor answers for: where that is
equal, the text is a repeat as a whole.  What differs (the ends of repeats) is looked at
byte by byte: per anchor an enhanced suffix array of the surrounding texts is built, and a
stack scan over it yields the common-prefix intervals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, cut, release, with_key

MIN_BYTES = 100
ANCHOR = 32
CHUNK_BYTES = 1 << 19
#: Contexts of one anchor beyond which its windows are grouped by hash over the cluster instead of in one task.
GROUP_LIMIT = 20_000
_BATCH_BYTES = 2 << 20
_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 1 << 64)


def _table() -> np.ndarray:
    """A fixed random 64-bit value for each byte."""
    return np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Hashes of any stretch of a byte string, from prefix sums modulo 2^64."""

    def __init__(self, most: int):
        self.table = _table()
        self.up = np.cumprod(np.full(most + 1, np.uint64(_B)))
        self.down = np.cumprod(np.full(most + 1, np.uint64(_INV)))

    def of(self, data: np.ndarray) -> None:
        if len(data) >= len(self.up):
            self.__init__(2 * len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=self.sums[1:])

    def stretch(self, a, b) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.down[a])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def anchors(hasher: Hasher, data: np.ndarray, min_bytes: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, last window, anchor position) of each anchor of one text.

    The anchor of a window is its piece with the least hash, the leftmost of equals;
    windows of one anchor are neighbours, and their joint text is the anchor's context.
    """
    hasher.of(data)
    piece = hasher.all(anchor)
    span = min_bytes - anchor + 1
    # least value over the window by doubling; the low bits hold the place, so equal hashes go to the left
    low = np.uint64((1 << 22) - 1)
    if len(piece) > int(low):
        raise ValueError("text pieces are at most 4 MB")
    best = (piece & ~low) | np.arange(len(piece), dtype=np.uint64)
    width = 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    rest = span - width
    if rest:
        best = np.minimum(best[: len(best) - rest], best[rest:])
    at = (best & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    a = at[first]
    ctx = hasher.stretch(first, last + min_bytes) + _mix(((last - first) * 256 + (a - first)).astype(np.uint64))
    return piece[a], ctx, first, last, a


def pieces(n: int, min_bytes: int, most: int = CHUNK_BYTES):
    """(start, end) of stretches of a text of n bytes that share min_bytes - 1 bytes, so every window is in one."""
    at = 0
    while n - at >= min_bytes:
        end = min(n, at + most)
        yield at, end
        if end == n:
            return
        at = end - min_bytes + 1


def interval_tree(suffixes: list, lcp: list, floor: int):
    """(left, right, common length) of every common-prefix interval of at least ``floor``: a stack scan over the array."""
    stack = []
    for i in range(1, len(lcp) + 1):
        here = lcp[i] if i < len(lcp) else 0
        left = i - 1
        while stack and stack[-1][1] > here:
            left, depth = stack.pop()
            yield left, i - 1, depth
        if here >= floor and (not stack or stack[-1][1] < here):
            stack.append((left, here))


def maximal_repeats(group: np.ndarray, texts: list[bytes], starts: np.ndarray, min_bytes: int, hasher: Hasher):
    """Maximal repeats of at least ``min_bytes`` among texts of the same group: (text numbers, offsets, length) of all occurrences.

    ``starts[i]`` suffixes of text i, from its beginning, can start an occurrence.  An
    interval whose occurrences all follow the same byte is no repeat of its own: the one
    that starts a byte earlier holds it.
    """
    sizes = np.array([len(t) for t in texts])
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    hasher.of(data)
    owner = np.repeat(np.arange(len(texts)), starts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    pos = base[owner] + offset
    key = hasher.stretch(pos, pos + min_bytes) ^ _mix(group[owner].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    same = np.r_[False, sorted_key[1:] == sorted_key[:-1]]
    live = order[same | np.r_[same[1:], False]]  # other suffixes share no long prefix
    if not len(live):
        return
    owner, offset, pos = owner[live], offset[live], pos[live]
    # suffix array: by group, then by bytes up to the end of the text
    longest = int((sizes[owner] - offset).max())
    padded = np.concatenate([data, np.zeros(longest, np.uint8)])
    rank_group = group[owner]
    step = max(1, (16 << 20) // longest)
    for lo, hi in _runs(key[live], step):
        part = np.arange(lo, hi)
        p, room = pos[part], (sizes[owner[part]] - offset[part])
        rows = padded[p[:, None] + np.arange(longest)]
        rows[np.arange(longest) >= room[:, None]] = 0
        by = np.lexsort((rows.view(f"V{longest}").ravel().argsort(kind="stable").argsort(kind="stable"), rank_group[part]))
        rows, o, f, room, g = rows[by], owner[part][by], offset[part][by], room[by], rank_group[part][by]
        differ = rows[1:] != rows[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
        common = np.minimum(common, np.minimum(room[1:], room[:-1]))
        common[g[1:] != g[:-1]] = 0
        before = np.where(f > 0, data[np.maximum(base[o] + f - 1, 0)].astype(np.int64), -1 - np.arange(len(o)))
        changes = np.r_[0, np.cumsum(before[1:] != before[:-1])]
        for left, right, depth in interval_tree(None, [0, *common.tolist()], min_bytes):
            if changes[right] > changes[left]:
                yield o[left : right + 1], f[left : right + 1], depth


def _runs(key: np.ndarray, step: int):
    """Bounds of stretches of about ``step`` entries that part no equal keys."""
    at = 0
    while at < len(key):
        end = min(len(key), at + step)
        while end < len(key) and key[end] == key[end - 1]:
            end += 1
        yield at, end
        at = end


def _union(k: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of the same key merged where they overlap or touch."""
    by = np.lexsort((s, k))
    k, s, e = k[by], s[by], e[by]
    number = np.cumsum(np.r_[True, k[1:] != k[:-1]]).astype(np.int64) << 42
    reach = np.maximum.accumulate(e + number)
    first = np.flatnonzero(np.r_[True, s[1:] + number[1:] > reach[:-1]])
    last = np.r_[first[1:], len(k)] - 1
    return k[first], s[first], reach[last] - number[last]


def _sorted_stream(batches, columns: int, most: int):
    """Blocks of rows sorted by their first column that part no equal values (of any number)."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
            if size > most:
                whole = pa.Table.from_batches(held).combine_chunks()
                k = whole.column(0).to_numpy()
                last = int(np.searchsorted(k, k[-1]))
                if last:
                    yield whole.slice(0, last)
                    held = whole.slice(last).to_batches()
                    size = sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def repeated_spans(docs: DataFrame, key: str, text: str, min_bytes: int = MIN_BYTES, anchor: int = ANCHOR, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(key, s, e): byte ranges of ``text`` whose every ``min_bytes`` window also starts earlier (less key, or same key and less start).

    The union of the ranges of a key is exactly the bytes covered by such windows.
    ``key`` is a unique long.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def anchor_rows(batches):
        hasher = Hasher(CHUNK_BYTES)
        for b in (part for whole in batches for part in byte_slices(whole, 1, 2 << 20)):
            keys = b.column(0).to_numpy()
            out, size = [], 0
            for k, t in zip(keys, b.column(1).cast(pa.large_binary())):
                raw = np.frombuffer(t.as_py(), np.uint8)
                for lo, hi in pieces(len(raw), min_bytes):
                    ak, ctx, s, e, _ = anchors(hasher, raw[lo:hi], min_bytes, anchor)
                    out.append((ak.view(np.int64), ctx.view(np.int64), np.full(len(s), k), ((s + lo) << 8) | (e - s)))
                    size += len(s)
                if size > 50_000:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    def _batch(out):
        """Rows with ``again``: an equal context stands earlier in this very batch, so where the row goes no longer matters."""
        ak, ctx, k, at = (np.concatenate(c) for c in zip(*out))
        by = np.lexsort((at, k, ctx, ak))
        ak, ctx, k, at = ak[by], ctx[by], k[by], at[by]
        again = np.r_[False, (ak[1:] == ak[:-1]) & (ctx[1:] == ctx[:-1])]
        # a text that many documents share is spread by document instead of meeting in one task
        ak = np.where(again, _mix(k.astype(np.uint64)).view(np.int64), ak)
        return pa.RecordBatch.from_arrays([*map(pa.array, (ak, ctx, k, at, again))], names=["ak", "ctx", "k", "at", "again"])

    rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(anchor_rows, "ak long, ctx long, k long, at long, again boolean")
    rows = rows.repartition(n, "ak").sortWithinPartitions("ak", "ctx", "k", "at")

    def equal_contexts(batches):
        """Kind 0: a range that repeats an earlier equal context; kind 1: the first of one of several contexts of an anchor."""
        ak0 = ctx0 = None
        first, number, sent = None, 0, False
        for b in batches:
            ak, ctx, k, at, again = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if again.any():
                zero = np.zeros(int(again.sum()), np.int64)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (zero.astype(np.int32), ak[again], k[again], at[again], zero))], names=["kind", "ak", "k", "at", "nth"])
                ak, ctx, k, at = ak[~again], ctx[~again], k[~again], at[~again]
            if not len(ak):
                continue
            new_ak = np.r_[ak[0] != ak0 if ak0 is not None else True, ak[1:] != ak[:-1]]
            new_ctx = new_ak | np.r_[ctx[0] != ctx0 if ctx0 is not None else True, ctx[1:] != ctx[:-1]]
            rep = ~new_ctx
            # number of each context within its anchor, going on from the batch before
            group = np.cumsum(new_ak)
            nth = np.cumsum(new_ctx)
            start_at = np.r_[0, nth[new_ak]]
            nth = nth - np.where(group > 0, start_at[group], 0) + np.where(group > 0, 1, number)
            firsts = np.flatnonzero(new_ctx)
            several = firsts[nth[firsts] > 1]
            # the first context of an anchor counts too once a second one comes
            second = several[nth[several] == 2]
            lead = np.searchsorted(np.flatnonzero(new_ak), second, "right") - 1
            own = np.flatnonzero(new_ak)[lead[lead >= 0]] if len(second) else np.zeros(0, np.int64)
            carried = [first] if len(second) and (lead < 0).any() and not sent else []
            idx = np.concatenate([own, several])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[np.zeros(rep.sum(), np.int32), np.ones(len(idx) + len(carried), np.int32)]),
                    pa.array(np.r_[ak[rep], ak[idx], np.array([c[0] for c in carried], np.int64)]),
                    pa.array(np.r_[k[rep], k[idx], np.array([c[1] for c in carried], np.int64)]),
                    pa.array(np.r_[at[rep], at[idx], np.array([c[2] for c in carried], np.int64)]),
                    pa.array(np.r_[np.zeros(rep.sum(), np.int64), np.ones(len(own), np.int64), nth[several], np.ones(len(carried), np.int64)]),
                ],
                names=["kind", "ak", "k", "at", "nth"],
            )
            starts_here = np.flatnonzero(new_ak)
            if len(starts_here):
                i = starts_here[-1]
                first, sent = (int(ak[i]), int(k[i]), int(at[i])), bool(nth[-1] > 1)
            else:
                sent = sent or bool(nth[-1] > 1)
            ak0, ctx0, number = ak[-1], ctx[-1], int(nth[-1])

    found = cut(rows.mapInArrow(equal_contexts, "kind int, ak long, k long, at long, nth long"))
    release(spark)
    s = F.shiftright("at", 8)
    whole = found.where("kind = 0").select("k", s.alias("s"), (s + F.col("at").bitwiseAND(F.lit(255).cast("long")) + min_bytes).alias("e"))
    ends = found.where("kind = 1")
    listed = ends.groupBy("k").agg(F.collect_list(F.struct("ak", "at")).alias("list"))
    cases = docs.select(docs[key].alias("k"), docs[text].alias("t")).join(listed, "k")

    def contexts(batches):
        for b in (part for whole in batches for part in byte_slices(whole, 1)):
            out = []
            for k, t, marks in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()), b.column(2)):
                raw = t.as_py()
                for m in marks.as_py():
                    at, more = m["at"] >> 8, m["at"] & 255
                    out.append((m["ak"], k, at, more + 1, raw[at : at + more + min_bytes]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["ak", "k", "at", "starts", "bytes"])

    around = cut(cases.select("k", "t", "list").mapInArrow(contexts, "ak long, k long, at long, starts int, bytes binary"))
    release(spark)
    large = ends.groupBy("ak").agg(F.max("nth").alias("n")).where(F.col("n") > group_limit).select("ak")
    large = cut(large)
    small_groups, spans = around, [whole]
    if not large.isEmpty():
        small_groups = around.join(large, "ak", "left_anti")
        spans.append(_by_hash(around.join(large, "ak", "left_semi"), n, min_bytes))

    def scan(batches):
        hasher = Hasher(_BATCH_BYTES)
        for block in _sorted_stream(batches, 5, _BATCH_BYTES):
            ak, k, at, starts = (block.column(i).to_numpy() for i in range(4))
            texts = block.column(4).to_pylist()
            out = []
            for o, f, depth in maximal_repeats(ak, texts, starts, min_bytes, hasher):
                where = at[o] + f
                least = np.lexsort((where, k[o]))[0]
                others = (k[o] != k[o][least]) | (where != where[least])
                out.append((k[o][others], where[others], where[others] + depth))
            if out:
                # nested repeats hold the same bytes many times: their union says as much
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _union(*(np.concatenate(c) for c in zip(*out)))], names=["k", "s", "e"])

    spans.append(small_groups.select("ak", "k", "at", "starts", "bytes").repartition(n, "ak").sortWithinPartitions("ak").mapInArrow(scan, "k long, s long, e long"))
    every = spans[0]
    for more in spans[1:]:
        every = every.unionByName(more)
    return every.withColumnRenamed("k", key)


def _by_hash(around: DataFrame, n: int, min_bytes: int) -> DataFrame:
    """The same ranges for anchors with very many contexts: every window by its hash, the earliest found by partial aggregation."""

    def windows(batches):
        hasher = Hasher(_BATCH_BYTES)
        for b in batches:
            out = []
            for k, at, starts, raw in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                hasher.of(np.frombuffer(raw, np.uint8))
                p = np.arange(starts)
                out.append((hasher.stretch(p, p + min_bytes).view(np.int64), np.full(starts, k), at + p))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["h", "k", "s"])

    w = cut(around.select("ak", "k", "at", "starts", "bytes").mapInArrow(windows, "h long, k long, s long"))
    least = w.groupBy("h").agg(F.min(F.struct("k", "s")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "least")
    return w.join(least, "h").where(F.struct("k", "s") != F.col("least")).select("k", "s", (F.col("s") + min_bytes).alias("e"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, n_bytes, ``spans`` (removed byte ranges, maximal and sorted) and ``kept`` (the remaining bytes) of every document.

    A byte goes if a ``min_bytes`` string that covers it also starts earlier: in a document
    with a smaller id, or in the same document; matches don't cross documents.  Null texts are empty; nulls
    and repeated ids are put in one fixed order; an empty table gives an empty one.
    """
    d = with_key(docs.select(docs[id_col].alias("doc_id"), F.encode(F.coalesce(docs[text].cast("string"), F.lit("")), "UTF-8").alias("text")))
    spans = repeated_spans(d, "_key", "text", min_bytes)
    # ranges of one document that overlap or touch are merged before they meet its text
    per = spans.groupBy("_key").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("list"))
    both = d.join(per, "_key", "left").select("doc_id", "text", "list")

    def run(batches):
        for b in (part for whole in batches for part in byte_slices(whole, 1)):
            spans_out, kept = [], []
            texts = b.column(1).cast(pa.large_binary())
            for t, marks in zip(texts, b.column(2)):
                raw, merged = t.as_py(), []
                for m in marks.as_py() or ():
                    if merged and m["s"] <= merged[-1]["e"]:
                        merged[-1]["e"] = max(merged[-1]["e"], m["e"])
                    else:
                        merged.append(dict(m))
                spans_out.append(merged)
                at, rest = 0, []
                for m in merged:
                    rest.append(raw[at : m["s"]])
                    at = m["e"]
                kept.append(b"".join([*rest, raw[at:]]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.as_py()) for t in texts], pa.int64()), pa.array(spans_out, pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    return both.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, spans array<struct<s: long, e: long>>, kept binary")
