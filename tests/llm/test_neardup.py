import random
from itertools import combinations

import corpus_pipeline
from quarry.llm import simhash


def runs(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def least_ids(rows):
    """Ids of a loop over all pairs: the least of each component."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: runs(t) for i, t in rows}
    for i, j in combinations(sorted(root), 2):
        a, b = sets[i], sets[j]
        if not (a or b) or 5 * len(a & b) >= 4 * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return sorted(i for i in root if find(i) == i)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def near_rows(rng):
    texts = [None, "", " \n", "Two words", "two  WORDS", "one two three four five", "one two three four five six"]
    common = [f"c{i}" for i in range(60)]
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([20, 90, 300]))]
        texts.append(" ".join(base))
        for _ in range(6):
            texts.append(" ".join(edited(rng, base, rng.randrange(1, 1 + max(2, len(base) // 18)))))
        texts += [" ".join(base + common[: len(base) // 6]), " ".join(common + base[:15])]
    chain = [f"k{i}" for i in range(200)]
    for _ in range(8):  # each near to the one before it only
        texts.append(" ".join(chain))
        chain = chain[12:] + [f"k{rng.randrange(10**6)}" for _ in range(12)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_dedup_stage_finds_all_edited_copies(spark, monkeypatch):
    for seed in (1, 2):
        rows = near_rows(random.Random(seed))
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
        want = least_ids(rows)
        assert len(want) < len(rows) - 30
        got = corpus_pipeline.keep_one_of_each(spark, docs, "")
        assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want
        monkeypatch.setattr(simhash, "TRIE_LIMIT", 8)
