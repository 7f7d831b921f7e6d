"""What operator 5 finds of planted personal data outside its training texts, by kind; what it misses is named here and in the README."""

import os
import random
import string
from collections import Counter

import pytest

from quarry.llm import pii

DOCS = "/root/testdata/sf0.01/documents.parquet"
WORDS = "the report on our meeting was sent to all of them before noon and nobody answered until friday".split()


def _card(r):
    digits = [r.randint(0, 9) for _ in range(15)]
    return next(t for c in range(10) if pii.luhn(t := "".join(map(str, [*digits, c]))))


def _plants(r):
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    spaced = lambda d: " ".join(d[i : i + 4] for i in range(0, 16, 4))
    return {
        "email": lambda: f"{pick('abcdefgh', 5)}.{pick('ijklmn', 6)}@{pick('opqrst', 5)}.com",
        "email in brackets": lambda: f"{pick('abcdefgh', 5)} [at] {pick('opqrst', 6)} [dot] org",
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: _card(r),
        "card in fours": lambda: spaced(_card(r)),
        "phone": lambda: f"+{r.randint(1, 99)} {r.randint(100, 999)} {r.randint(1000000, 9999999)}",
        "phone in brackets": lambda: f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}",
        "token": lambda: 'token = "' + pick("0123456789abcdef", 40) + '"',
        # not found: no pattern and no training example has this form
        "spelled email": lambda: f"{pick('abcdefgh', 5)} at {pick('opqrst', 6)} dot com",
        "local phone": lambda: f"0{r.randint(20, 99)} {r.randint(1000, 9999)} {r.randint(1000, 9999)}",
        "bare token": lambda: pick(string.ascii_letters + string.digits, 36),
    }


MISSED = ("spelled email", "local phone", "bare token")


@pytest.mark.skipif(not os.path.exists(DOCS), reason="needs the documents table")
def test_recall_by_kind_and_precision(spark):
    weights = pii.fit(spark.read.parquet(DOCS).select("doc_id", "text"))
    r = random.Random(4)
    plants, hit, n, right, added = _plants(r), Counter(), Counter(), 0, 0
    prose = lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(3, 12)))
    for i in range(330):
        kind = list(plants)[i % len(plants)]
        value, head = plants[kind](), prose() + " "
        lo, hi = len(head), len(head) + len(value)
        if kind == "token":
            lo, hi = lo + 9, hi - 1
        base, more = pii.find(head + value + " " + prose(), weights)
        spans = [s for v in base.values() for s in v] + [(s, e) for _, s, e in more]
        n[kind] += 1
        hit[kind] += sum(max(0, min(hi, e) - max(lo, s)) for s, e in spans) >= 0.9 * (hi - lo)
        added += len(more)
        right += sum(min(hi, e) > max(lo, s) for _, s, e in more)
    shares = {k: hit[k] / n[k] for k in n}
    print(shares, right, added)
    assert all(v >= 0.9 for k, v in shares.items() if k not in MISSED), shares
    assert right >= 0.9 * added
