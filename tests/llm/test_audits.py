"""Operators 11 to 13: queries against brute force over a small table with odd rows."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import divergence, merkle, queries, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "0123456789abcdef" * 3


def _rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    rows = []
    for i in range(260):
        t = " ".join(rng.choice(vocab).capitalize() if rng.random() < 0.1 else rng.choice(vocab) for _ in range(rng.randint(0, 40)))
        rows.append((i, t.replace(" ", "\n", 1) if i % 3 else t, rng.choice(["en", "en", "de"]), rng.choice(["hot", "hot", "hot", "a", "b", None]), len(t)))
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (None, "no id\nhere", "en", "b", 3), (302, "lone", "xx", "alone", 4), (303, "again", "en", "a", 5), (303, "again", "en", "a", 5)]
    rows += [(304, "word \n" * 20_000, "en", "hot", 1), (305, f'api_key = "{KEY}" and AKIA1234567890ABCD, token: short é PASSWORD="Zr8/kQp2+Lm0==x"', "de", "a", 9)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("audits"))
    spark.createDataFrame(_rows(), SCHEMA).withColumn("_i", F.lit("clash")).withColumn("leaf", F.lit(1)).repartition(5).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["op11_secret_novelty", "op12_merkle_manifest", "op13_source_divergence"])
def test_empty_table(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


# --- 12


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(row, text):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return _sha("".join(map(one, (row[0], row[3], row[2], row[4], text))))


def _tree(leaves, fanout=3):
    """(top, for each leaf its list of (place, siblings))."""
    level, at, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // fanout * fanout : i // fanout * fanout + fanout]
            paths[k].append((i % fanout, run[: i % fanout] + run[i % fanout + 1 :]))
        level = [_sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        at = [i // fanout for i in at]
    return level[0], paths


def _manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        now = r[1]
        if now is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
            now = now.replace("\n", "")
        groups[r[3]].append((r[0], _leaf(r, r[1]), _leaf(r, now)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        tops[g] = _tree([x[1] for x in groups[g]])
    root, above = _tree([tops[g][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for (ident, leaf, now), path in zip(groups[g], tops[g][1]):
            proof, h = "", now
            for at, others in path + above[n]:
                proof += "".join(others)
                h = _sha("".join(others[:at] + [h] + others[at:]))
            out.append((ident, leaf, tops[g][0], root, _sha(proof), h, h == root))
    return out


def test_manifest_against_brute_force(spark, folder):
    got = queries.op12_merkle_manifest(spark, folder)
    want = _manifest(_rows())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert {v for *_, v in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_trees_of_many_sizes(spark, n):
    rows = [(i, f"t{i}", "en", "s", 1) for i in range(n)] + [(100, "x", "en", "other", 1)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = {w[0]: w for w in _manifest(rows)}
    assert len(got) == n + 1
    for r in got:
        assert (r.leaf, r.subroot, r.root, _sha("".join(r.proof))) == want[r.doc_id][1:5] and r.folded == r.root
        assert r["at"] == [] or max(r["at"]) < 3


@pytest.mark.parametrize("n,block", [(8, 1), (9, 9), (10, 9), (28, 9), (82, 9), (250, 9), (250, 27)])
def test_trees_of_many_supersteps(spark, monkeypatch, n, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = [(i, f"t{i}", "en", "s", 1) for i in range(n)] + [(1000 + i, "x", "en", f"s{i % 11}", 1) for i in range(30)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = {w[0]: w for w in _manifest(rows)}
    assert len(got) == n + 30
    for r in got:
        assert (r.leaf, r.subroot, r.root, _sha("".join(r.proof))) == want[r.doc_id][1:5] and r.folded == r.root


def test_shuffles_are_fewer_than_levels(spark):
    rows = [(i, f"t{i}", "en", "s", 1) for i in range(2200)] + [(-1, "x", "en", "other", 1)]  # 8 levels, and one above the sources
    out = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    sc = spark.sparkContext
    sc.setJobGroup("folding", "")
    got = out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("p"), "folded").collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("folding")]
    assert sorted(map(tuple, got)) == sorted(w[:6] for w in _manifest(rows))
    assert sum(len(j.stageIds) for j in jobs) <= 12


def test_any_change_or_forged_sibling_is_found(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 4}", i) for i in range(40)], SCHEMA)
    rows = merkle.manifest(docs, {"n_chars": F.when(F.col("doc_id") == 7, F.lit(-1)).otherwise(F.col("n_chars"))}).collect()
    assert [r.doc_id for r in rows if r.folded != r.root] == [7]
    r = next(r for r in rows if r.doc_id == 8)
    path = [(a, bytes.fromhex(p)) for a, p in zip(r["at"], r.proof)]
    assert merkle.fold(bytes.fromhex(r.leaf), tuple(path)).hex() == r.root
    path[1] = (path[1][0], bytes([path[1][1][0] ^ 1]) + path[1][1][1:])
    assert merkle.fold(bytes.fromhex(r.leaf), tuple(path)).hex() != r.root


def test_numbers_without_gaps_in_a_hot_group_of_equal_rows(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, "hot").otherwise("cold").alias("g"), F.lit(1).alias("k")).repartition(6)
    rows = merkle.numbered(df, "g", ["k"]).collect()
    for g, n in (("hot", 3000), ("cold", 1000)):
        assert sorted(r._i for r in rows if r.g == g) == list(range(n)) and {r._n for r in rows if r.g == g} == {n}


def test_text_ids(spark):
    d = spark.createDataFrame([("b", "x", "s"), ("a", "y", "s"), (None, "z", "s")], "doc_id string, text string, source string")
    rows = merkle.manifest(d, fields=("doc_id", "text")).collect()
    assert {r.doc_id: r["at"] for r in rows} == {None: [0], "a": [1], "b": [2]}


# --- 13


def _audit(rows):
    terms, docs, groups = defaultdict(Counter), Counter(), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        low = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang].add(source)
        terms[lang, source].update(found)
        docs.update((lang, w) for w in set(found))
    out = []
    for lang, sources in groups.items():
        kept = [w for (g, w), n in docs.items() if g == lang and n >= 30]
        v = len(kept)
        count = {s: {w: terms[lang, s][w] for w in kept} for s in sources}
        total = {s: sum(c.values()) for s, c in count.items()}
        p = {s: {w: 1 + 10**9 * (c + 5) // (total[s] + 5 * v) for w, c in count[s].items()} for s in sources}
        q = {w: 1 + 10**9 * (sum(count[s][w] for s in sources) + 5) // (sum(total.values()) + 5 * v) for w in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in sources if o != s]
            over = [(w, p[s][w] - q[w]) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, 10**9), ("term", over, 50)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked[:most])]
    return out


def test_audit_against_brute_force(spark, folder):
    got = queries.op13_source_divergence(spark, folder)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = _audit(_rows())
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {w[2] for w in want} == {"pair", "term"} and any(w[3] == "é" or "é" in w[3] for w in want)


def test_audit_of_sources_that_share_no_terms_and_counts_beyond_a_long(spark):
    rows = [(i, "only here" if i % 2 else "other words words", "en", "a" if i % 2 else "b", 1) for i in range(80)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect())) == sorted(_audit(rows))
    big = spark.range(1).select(divergence.share(F.lit(10**15), F.lit(3 * 10**15), F.lit(10**6)).alias("p")).first().p
    assert big == 1 + 10**9 * (10**15 + 5) // (3 * 10**15 + 5 * 10**6)


# --- 11


def _base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?:password|passwd|secret|token|api_?key))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16])


def _listed(spans):
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_secrets_query_against_brute_force(spark, folder):
    got = queries.op11_secret_novelty(spark, folder)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]
    texts = Counter()
    for r in _rows():
        base = _base(r[1] or "")
        texts[r[0], *(sum(k == j for _, k, _ in base) for j in range(3)), _sha(_listed(base))] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got.collect()) == texts
    row = got.where("doc_id = 305").first()
    assert (row.n_assign, row.n_access, row.n_hex) == (2, 1, 1) and row.spans.startswith("assign:0:")


def _planted(seed=3, n=60):
    """(text, spans of secrets) beside names, paths and prose in equally sensitive places."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    makers = {
        "prefixed": lambda: ("Authorization: Bearer ", "ghp_" + pick(alnum, 36)),
        "jwt": lambda: ("auth header ", "eyJ" + pick(alnum, 20) + "." + pick(alnum, 40)),
        "upper hex": lambda: ("private key ", pick("0123456789ABCDEF", 40)),
        "base64": lambda: ("the credential is ", pick(b64, 32)),
        "password": lambda: ("login with pwd ", pick(alnum, 16)),
    }
    plain = [
        "the key point is internationalization of documents, see docs.example.com/login/help/index.html",
        "token refresh interval: config.auth.tokenRefreshIntervalSeconds2 and AuthorizationServerEndpointV2",
        "secret santa list for Weihnachtsfeier2024 at key_account_management_2024",
        "login at https://example.com/account/settings/profile?view=public&lang=en",
        "private message 2024-01-01T00:00:00 and +49 30 1234567 call-number 1234-5678-9012",
    ]
    out = []
    for i in range(n):
        kind = list(makers)[i % len(makers)]
        cue, value = makers[kind]()
        head = rng.choice(plain) + ".\nThen " + cue
        out.append((kind, head + value + " and so on " + rng.choice(plain), (len(head), len(head) + len(value))))
    return out, plain


def test_recall_and_precision_on_planted_secrets():
    planted, plain = _planted()
    novelty = secret_scan.Novelty(" ".join(reversed(secret_scan.CODE_WORDS)).encode())
    hit, kinds, extra = Counter(), Counter(), 0
    for kind, text, (s, e) in planted:
        base = secret_scan.base_spans(text)
        spans = base + novelty.spans(text, base)
        kinds[kind] += 1
        covered = sum(max(0, min(e, b) - max(s, a)) for a, _, b in spans)
        hit[kind] += covered >= 0.9 * (e - s)
        extra += sum(b <= s or a >= e for a, _, b in spans)
    assert all(hit[k] >= 0.9 * n for k, n in kinds.items()), (hit, kinds)
    assert extra <= 0.05 * len(planted)
    assert all(not novelty.spans(p, []) for p in plain)


def test_novelty_follows_dictionary_and_context(spark):
    novelty, blank = secret_scan.Novelty(b"tokenRefreshInterval configuration"), secret_scan.Novelty(b"")
    value = "tokenRefreshInterval"
    assert novelty.cost("", value, "") < 8 < blank.cost("", value, "")
    rnd = "q7ZxP0vLk2Rt9WsB4mYc"
    assert novelty.cost("a ", rnd, " b") >= 0.8 * len(rnd) and novelty.cost(f"a {rnd} ", rnd, "") >= 0.8 * len(rnd)
    docs = spark.createDataFrame([(i, "zebraCrossing Widget" if i < 5 else None) for i in range(9)], "doc_id long, text string")
    words = secret_scan.dictionary(docs).decode().split()
    assert {"zebra", "Crossing", "Widget"} <= set(words) and len(secret_scan.dictionary(docs, 40)) <= 40
    long = "key " + "aB3dE6gH9kL2" * 50_000
    assert len(novelty.spans(long, [])) <= 1
