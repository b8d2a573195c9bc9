import random
from collections import Counter, defaultdict

import numpy as np

from palisade.llm import jaccard
from palisade.llm.common import components
from tests.llm.common import TEXTS, documents, empty


def shingled(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets, root = [shingled(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in v if x is not None), default=None) for g, v in groups.items()}
    return sorted(((str(r[0]), len(sets[i]), str(least[find(i)])) for i, r in enumerate(rows)))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def copies(seed, n=400, base=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    originals = [[word() for _ in range(rng.randint(3, 120))] for _ in range(base)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(rng.choice(originals))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            at = rng.randrange(len(w))
            w[at:at] = passage
        rows.append((i * 7 % 1009, " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    return rows


def test_edges(spark):
    assert found(jaccard.jaccard_components(documents(spark))) == brute(TEXTS)
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_copies_equal_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        rows = copies(seed)
        assert found(jaccard.jaccard_components(documents(spark, rows))) == brute(rows)
    # tries of a few sets: links between tries must not get lost
    monkeypatch.setattr(jaccard, "TRIE", 8)
    rows = copies(3)
    assert found(jaccard.jaccard_components(documents(spark, rows))) == brute(rows)


def test_trie_search_equals_brute_force():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(200)]
    sizes = [len(s) + int(rng.integers(0, 4)) for s in sets]
    trie = jaccard._Trie(sets, sizes)
    for p, n in zip(sets, sizes):
        want = sorted((i, len(np.intersect1d(p, s))) for i, (s, m) in enumerate(zip(sets, sizes)) if 175 * len(np.intersect1d(p, s)) >= 75 * (n + m))
        assert sorted(trie.search(p, n, 75, 100)) == want


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = Counter(x for a, b in edges if a != b for x in (a, b))
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
