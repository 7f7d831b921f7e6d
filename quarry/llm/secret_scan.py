"""Secret scans: three base patterns, and dictionary-primed zstandard novelty, which adds spans.

Beside a word such as ``key`` or ``password``, a string is reported if a compressor that knows the corpus's
identifiers, and has just read the code around, has to write it out almost byte by byte: names
and words come cheap, generated keys don't.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: Base kinds in their order, and the kind of added spans.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "novel")
# The base patterns, and the characters that a value of each must have at least.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS = 12
#: A candidate: so many characters of keys, tokens and pass words at least, of two classes, with letters.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~!$%&*^-]{12,}")
_CLASSES = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]")]
_CHANGE = re.compile("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[0-9]|(?<=[0-9])[A-Za-z]")
_HEXADECIMAL = re.compile("[0-9A-Fa-f]+")
#: What makes a place sensitive, in the characters before a candidate.
_CUE = re.compile(r"key|token|secret|passw|passphrase|pwd|credential|auth|bearer|private|signature|login|\bpin\b", re.I | re.A)
BEFORE = 48
#: Characters on each side that prime the compressor; bytes of the dictionary at most.
AROUND, DICT_BYTES = 96, 1 << 16
#: A candidate is novel if it costs so many bytes, and such a share of its length, at least: a little under the six bits in eight that
#: random letters and digits need, and what is left of it for hexadecimal digits, which need four.
NOVEL_BYTES, NOVEL_SHARE, HEX_SHARE = 8, 0.7, 0.5
#: Characters to a change between small letters, capitals and digits, at most (a capital before a small letter is none): words with a number have fewer.
CHANGE = 6
# Identifiers of code, known in any corpus.
CODE_WORDS = """access account address admin api app application args array async auth authorization await aws base64 bearer bool bucket byte cache
callback certificate char class client cloud code com config configuration connection const content context cookie create credential credentials
data database date debug default delete description dev dict display domain email enable encoding encrypt endpoint env environment error event example
export expires false field file filter float format from function get github global google group handler hash header host html http https id image import
index input int integer interface interval json key label length level limit link list local localhost log login main manager map max message
method min model module name net new none null number object option options org output page parameter params parse passphrase password path
placeholder plugin port private process prod production profile project property proxy public query queue read refresh region register remote
remove replace request required response result return role root rotation route rsa run schema script search secret secrets self server service session set
setting settings shared sign signature size source ssh ssl staging start state static status storage store stream string sub submit system table
target task template test text time timeout timestamp title tls token tokens true type undefined update upload url user username utf8 validate value var
variable verify version view void web webhook window with worker write www xml yaml your""".split()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the leftmost, non-overlapping matches that pass their test, in linear time."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def words(text: Column) -> Column:
    """The parts of identifiers: runs of 3 to 20 ASCII letters, cut where a capital follows a small letter."""
    parts = F.split(text, r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
    return F.array_distinct(F.filter(parts, lambda w: F.length(w).between(3, 20)))


def dictionary(docs: DataFrame, most: int = DICT_BYTES, text: str = "text") -> bytes:
    """At most ``most`` bytes of words: the code words and those that most documents of ``docs`` hold, the commonest last.

    Every document counts.  Words of one count are taken or left together: the driver first gets how many
    words have each count, and then at most ``most`` / 4 words, however many tasks there are.
    Copies of a secret in many documents bring in only its short runs of letters, which save little.
    """
    each = docs.select(F.explode(words(F.coalesce(docs[text].cast("string"), F.lit("")))).alias("w"))
    counts = cut(each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total, least = 0, None
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).limit(most // 4).toLocalIterator():
        total += r.k
        if total > most // 4:
            break
        least = r.n
    top = counts.where(F.col("n") >= least).collect() if least is not None else []
    known: dict[str, None] = {}
    left = most
    for w in [*CODE_WORDS, *(r.w for r in sorted(top, key=lambda r: (-r.n, r.w)))]:
        if w not in known and len(w) < left:
            known[w] = None
            left -= len(w) + 1
    return " ".join(reversed(known)).encode()


class Novelty:
    """Marginal compressed bytes of strings, primed with a dictionary and with what stands around."""

    def __init__(self, words: bytes):
        primed = zstandard.ZstdCompressionDict(words or b"-", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=9)
        self.zip = zstandard.ZstdCompressor(dict_data=primed, write_content_size=False, write_dict_id=False)

    def cost(self, before: str, value: str, after: str) -> int:
        """Bytes that ``value`` adds between ``before`` and ``after``, which lend it nothing if they only repeat it."""
        before, after = before.replace(value, ""), after.replace(value, "")
        size = lambda s: len(self.zip.compress(s.encode("utf-8", "replace")))
        return size(before + " " + after + " " + value) - size(before + " " + after + " ")

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Novel candidates in sensitive places that overlap no base span; a line right under a reported one is in its place."""
        found, covered, at, last = [], _merged(base), 0, -9
        for m in _CANDIDATE.finditer(text):
            s, e = m.span()
            while s < e and text[s] in "=.-_/*":
                s += 1
            while e > s and text[e - 1] in ".-_/*":
                e -= 1
            named = max(text.find("=", s, e - 2), s - 1) + 1  # name=value
            s = named if e - named >= 12 else s
            while at < len(covered) and covered[at][1] <= s:
                at += 1
            if e - s < 12 or at < len(covered) and covered[at][0] < e:
                continue
            value = text[s:e]
            changes = sum(1 for _ in _CHANGE.finditer(value))
            if sum(bool(c.search(value)) for c in _CLASSES) < 2 or sum(c.isalpha() for c in value) < 2 or changes * CHANGE < len(value):
                continue
            if not _CUE.search(text, max(0, m.start() - BEFORE), s) and m.start() - last > 2:
                continue
            cost = self.cost(text[max(0, s - AROUND) : s], value, text[e : e + AROUND])
            if cost >= max(NOVEL_BYTES, (HEX_SHARE if _HEXADECIMAL.fullmatch(value) else NOVEL_SHARE) * len(value)):
                found.append((s, len(BASE), e))
                last = m.end()
        return found


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))


def find_secrets(docs: DataFrame, words: bytes | None = None, text: str = "text", out: str = "secrets") -> tuple[DataFrame, str]:
    """``docs`` with an array column (its name is returned too) of struct kind, s, e, by s, then kind as in KINDS.

    Spans are in code points, end exclusive.  Base spans are all there; spans of kind ``novel``
    overlap none of them.  ``words`` primes the compressor, by default with the ``dictionary`` of ``docs``.
    Null and empty texts have no spans; texts of any length are read whole, in time and memory in
    proportion to them; every row is handled on its own, so repeated rows and ids have equal spans; an
    empty table stays empty; a column named as ``out`` gets an underscore beside it.
    """
    out = free_name(docs, out)
    primed = docs.sparkSession.sparkContext.broadcast(dictionary(docs, text=text) if words is None else words)

    @F.arrow_udf("array<struct<kind: string, s: int, e: int>>")
    def scan(texts: pa.Array) -> pa.Array:
        novelty = Novelty(primed.value)
        rows = []
        for t in texts:
            t = t.as_py() or ""
            base = base_spans(t)
            rows.append([{"kind": KINDS[k], "s": s, "e": e} for s, k, e in sorted(base + novelty.spans(t, base))])
        return pa.array(rows, _FOUND)

    return docs.withColumn(out, scan(docs[text].cast("string"))), out
