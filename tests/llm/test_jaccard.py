import random

import pytest

from quillon.llm import jaccard as J


def shingles(text, size):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return frozenset(b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((str(r[0]), len(sets[i]), str(least.get(find(i)) if sets[i] else r[0])) for i, r in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(160):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    at = rng.randrange(len(words))
                    words[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
            if rng.random() < 0.2:
                words += rng.choices(vocabulary, k=3)
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 8, 12, 16, 20, 25, 40, 80, 150]))
        rows.append((i, rng.choice([" ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in words), i))
    passage = " ".join(rng.choices(vocabulary, k=55))
    rows += [(200 + i, passage + " " + " ".join(rng.choices(vocabulary, k=10 + i)), i) for i in range(30)]
    rows += [(300, None, 0), (301, "", 0), (302, " \n", 0), (5, rows[5][1], 0), (None, rows[7][1], 0), (400, "long words " * 20_000, 0), (None, "only null here", 0)]
    return rows


@pytest.mark.parametrize("seed,size,percent,cost", [(1, 4, 85, 16), (2, 5, 80, 16), (3, 4, 85, 0), (4, 4, 85, 10**6)])
def test_equals_brute_force(spark, seed, size, percent, cost, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(J, "HOT_LIST", 8)
    if seed in (1, 2):
        monkeypatch.setattr(J, "SHORT_LIST", 2)
        monkeypatch.setattr(J, "MEETINGS", 1)
        monkeypatch.setattr(J, "HUB", 2)
    rows = corpus(seed)
    out = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, n long"), size, percent, list_cost=cost).collect()
    want = brute(rows, size, percent)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == want
    assert len({w[2] for w in want}) < 0.9 * len(rows)


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overlap_is_the_threshold():
    for n in range(1, 60):
        for m in range(n, 60):
            c = J.overlap(n, m, 85)
            assert 100 * c >= 85 * (n + m - c) and not 100 * (c - 1) >= 85 * (n + m - c + 1)


def test_parities_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m in ((5, 9), (700, 600), (5000, 4000), (3000, 2900)):
        pool = np.unique(rng.integers(0, 1 << 62, 9000, dtype=np.uint64))
        x, y = np.sort(rng.choice(pool, n, False)), np.sort(rng.choice(pool, m, False))
        differ = len(np.setxor1d(x, y))
        assert differ * 0.1 < J.apart(J.parities(x), J.parities(y)) <= differ and J.apart(J.parities(x), J.parities(x)) == 0


def test_words_that_a_polynomial_hash_mixes_up(spark):
    a = "a"
    for _ in range(10):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    out = J.jaccard_components(spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (2, 2), (3, 1)]
