"""The columns that the queries op1 to op5 return, against plain recomputation over the smallest tables."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quarry.llm import fingerprint, pii, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the smallest tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _rows(spark, name, docs):
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    assert sorted(rows) == sorted(docs)
    return rows


def test_op1(spark, docs):
    rows = _rows(spark, "op1_mix_sources", docs)
    by = defaultdict(list)
    for k, r in rows.items():
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[k].text or "")) and 0 <= r.taken <= 3 * r["size"]
        by[docs[k].source].append(r)
    total = sum(r["size"] for r in rows.values())
    for rs in by.values():
        assert {r.source_size for r in rs} == {sum(r["size"] for r in rs)} and len({r.target for r in rs}) == 1
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 1 and rs[0].target <= 3 * rs[0].source_size + 1e-6
    assert abs(sum(rs[0].target for rs in by.values()) - total) < 1e-3
    free = {s: rs[0].target / (5, 2, 1)[i % 3] for i, (s, rs) in enumerate(sorted(by.items(), key=lambda x: (x[0] is None, x[0]))) if rs[0].target < 3 * rs[0].source_size - 1e-6}
    assert max(free.values()) - min(free.values()) < 1e-6 * max(free.values())


def test_op2(spark, docs):
    rows = _rows(spark, "op2_kd_shards", docs)
    slots, size = defaultdict(list), Counter()
    for k, r in rows.items():
        raw = (docs[k].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in rows.values())


def _like(a, b):
    if a == b:
        return 1.0
    pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8)]
    used = [x == y for x, y in pairs if (x, y) != (f"{fingerprint.EMPTY:08x}",) * 2]
    return sum(used) / max(1, len(used))


def test_op3(spark, docs):
    rows = _rows(spark, "op3_imatch", docs)
    order, same = sorted(docs, reverse=True), defaultdict(set)
    for i, k in enumerate(order):
        n = order[(i + 1) % len(order)]
        t, following = docs[k].text or "", docs[n].text or ""
        edited = t[: len(t) - len(t) // 3] + following[: len(t) // 3]
        r = rows[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(_like(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(_like(r.fingerprint, rows[n].fingerprint))
        assert re.fullmatch("([0-9a-f]{8}){30}", r.fingerprint) and len(r.edited_fingerprint) == 240
        same[t].add(r.fingerprint)
        if edited == t:
            assert r.fingerprint == r.edited_fingerprint
    assert all(len(v) == 1 for v in same.values())


def test_op4(spark, docs):
    rows = _rows(spark, "op4_quality_crf", docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = defaultdict(set)
    for k, r in rows.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        texts[docs[k].text].add(r.score)
    assert all(len(v) == 1 for v in texts.values())
    held = [r.predicted == labels[k] for k, r in rows.items() if r.held_out and k in labels]
    assert sum(held) >= 0.9 * len(held)


def _base(text):
    found = []
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9](?:[\x20-]?[0-9])+", lambda s: 13 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
    ):
        found += [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text) if ok(m.group())]
    return found


def test_op5(spark, docs):
    rows = _rows(spark, "op5_pii_crf", docs)
    some = 0
    for k, r in rows.items():
        base = _base(docs[k].text or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b.startswith(kind) for b in base) for kind in pii.BASE)
        spans = r.spans.split(",") if r.spans else []
        assert set(base) <= set(spans) and all(b.split(":")[0] in pii.KINDS for b in spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))
        some += bool(base)
    assert some
