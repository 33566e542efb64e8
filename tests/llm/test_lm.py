import math
import random
import zlib
from collections import Counter

import numpy as np

from quillon.llm import lm


def words(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split() + [None]


def corpus():
    rng = random.Random(8)
    vocabulary = ["the", "Of", "été", "and", "x1"] + [f"rare{i}" for i in range(300)]
    weight = [200, 150, 100, 80, 50] + [1] * 300
    rows = [(i, " ".join(rng.choices(vocabulary, weight, k=rng.randint(0, 80))), 1.0) for i in range(300)]
    return rows + [(900, None, 1.0), (901, "", 1.0), (902, "the of " * 20_000, 1.0), (3, rows[3][1], 1.0), (None, "the null", 1.0)]


def brute(rows, share, prior=200.0):
    held = [zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10 == 0 for r in rows]
    count, pairs, after = Counter(), Counter(), Counter()
    for r, h in zip(rows, held):
        if not h:
            t = words(r[1])
            count.update(t)
    total, types = sum(count.values()), len(count)
    states = {w for w, n in count.items() if n >= share * total}
    for r, h in zip(rows, held):
        if not h:
            t = words(r[1])
            for a, b in zip(t, t[1:]):
                if a in states:
                    after[a] += 1
                    pairs[a, b] += b in states
    base = lambda w: (count[w] + 0.1) / (total + 0.1 * (types + 1))

    def p(w, a):
        if a not in states:
            return base(w)
        left = after[a] - sum(n for (x, _), n in pairs.items() if x == a) + prior
        return ((pairs[a, w] if w in states else 0) + left * base(w)) / (after[a] + prior)

    for a in sorted(states, key=str):
        left = after[a] - sum(n for (x, _), n in pairs.items() if x == a) + prior
        assert abs(sum(p(w, a) for w in count) + left / (after[a] + prior) * base("unseen") - 1) < 1e-9
    out = []
    for r, h in zip(rows, held):
        t = words(r[1])
        out.append((str(r[0]), h, len(t), sum(count[w] > 0 for w in t), total, sum(math.log10(base(w)) for w in t), sum(math.log10(p(w, a)) for w, a in zip(t, ["root", *t]))))
    return out


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "RUN_TOKENS", 3000)
    rows = corpus()
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, score double"), state_share=0.01).collect()
    want = brute(rows, 0.01)
    key = lambda x: x[:5]
    a = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    b = sorted(want, key=key)
    assert [key(x) for x in a] == [key(x) for x in b]
    assert np.allclose([x[5:] for x in a], [x[5:] for x in b], rtol=1e-6)


def test_order_helps_where_there_is_order(spark):
    rows = [(i, "one two three four " * (5 + i % 7)) for i in range(100)]
    out = [r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert out and all(r.score > 0.3 * r.base_score for r in out)


def test_empty_table(spark):
    assert lm.score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_all_pairs_of_the_training_part_are_arcs(spark, monkeypatch):
    """The same check by brute force with every word as a state, as the query scores."""
    monkeypatch.setattr(lm, "RUN_TOKENS", 3000)
    rows = corpus()
    got = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string, score double")).collect()
    key = lambda x: x[:5]
    a = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    b = sorted(brute(rows, 0), key=key)
    assert [key(x) for x in a] == [key(x) for x in b]
    assert np.allclose([x[5:] for x in a], [x[5:] for x in b], rtol=1e-6)


def test_rare_words_have_arcs(spark):
    """Pairs of words far under 1/2000 of the tokens are scored by their pair counts."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"a{k} b{k}" for k in (rng.randrange(4000) for _ in range(40)))) for i in range(500)]
    out = [r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert out and sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)
