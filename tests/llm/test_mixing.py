import collections
import random
import re

import numpy as np
import pytest

from quillon.llm.mixing import Plan, mix, mix_digest, permuted, targets
from quillon.llm.registry import op12_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size string, taken string"


def level(sizes, weights, budget, repeats):
    """Targets by bisection of the water level."""
    low, high = 0.0, budget * 10 + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(repeats * s, mid * w) for s, w in zip(sizes, weights)) < budget else (low, mid)
    return [min(repeats * s, high * w) for s, w in zip(sizes, weights)]


def sources(rows):
    size = collections.Counter()
    for _, text, source, *_ in rows:
        size[source] += len(WORD.findall(text or ""))
    names = sorted(s for s in size if s is not None) + [None] * (None in size)
    return names, [size[s] for s in names]


def corpus():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["one", "zwei", "été", "\t4,", "x" * 40], k=int(rng.expovariate(1 / 300)))), rng.choice(["a", "b", "c", "é", "", "big", "big", "big", None]), "s", "t") for i in range(600)]
    return rows + [(9000, None, "a", "s", "t"), (9001, "", "only empty", "s", "t"), (9002, "word " * 60_000, "big", "s", "t"), (None, "no id", None, "s", "t"), (3, rows[3][1], rows[3][2], "s", "t")] + [(7777, "same row again " * 20, "c", "s", "t")] * 500


def check(rows, got):
    names, sizes = sources(rows)
    want = dict(zip(names, level(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)))
    size_of = dict(zip(names, sizes))
    own = collections.Counter((str(k), len(WORD.findall(t or "")), size_of[s]) for k, t, s, *_ in rows)
    assert collections.Counter((str(r.doc_id), r.size, r.source_size) for r in got) == own
    taken, by_target = collections.Counter(), {}
    source_of = collections.defaultdict(set)
    for k, t, s, *_ in rows:
        source_of[k].add(s)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        (s,) = source_of[r.doc_id]
        taken[s] += r.taken
        by_target[s] = r.target
    for s in names:
        assert by_target[s] == pytest.approx(want[s], rel=1e-9) and abs(taken[s] - want[s]) <= 0.5 + 1e-6


def test_quotas_are_exact_and_reruns_agree(spark):
    frame = spark.createDataFrame(corpus(), SCHEMA)
    got = mix_digest(frame).collect()
    check(corpus(), got)
    again = mix_digest(frame.repartition(7, "text")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    check(rows, op12_mixing(spark, sf).collect())


def test_mixed_texts(spark):
    small = {"block_words": 50, "shard_blocks": 64}
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA)
    out, digest = mix(frame, **small).collect(), mix_digest(frame, **small).collect()
    text_of = {k: t for k, t, *_ in rows}
    shards = collections.defaultdict(list)
    spans, taken = collections.Counter(), collections.Counter()
    for r in out:
        words = WORD.findall(text_of[r.doc_id])
        assert WORD.findall(r.text) == words[r.start : r.start + r.words] and r.words > 0
        shards[r.shard].append(r)
        taken[r.doc_id] += r.words
        spans[r.doc_id, r.copy, r.start] += 1
    total = collections.Counter()
    for r in digest:
        total[r.doc_id] += r.taken
    assert taken == +total
    assert all(n == 1 for (k, *_), n in spans.items() if k not in (7777, 3))
    assert len(shards) > 5
    for pieces in shards.values():
        assert sorted(r.position for r in pieces) == list(range(len(pieces)))
    words = [sum(r.words for r in s) for s in shards.values()]
    assert max(words) <= 1.1 * 64 * 50
    share = [sum(r.words for r in s if r.source == "big") / sum(r.words for r in s) for s in shards.values()]
    assert np.std(share) < 0.2 and len({r.source for r in next(iter(shards.values()))}) > 3


def test_permutation_and_tree():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(permuted(np.arange(n), n, 12345)) == list(range(n))
    plan = Plan([10_000_000, 3_000_000, 0, 700], [15_000_000, 3_000_000, 0, 1400], 3)
    counts = np.array([np.bincount(plan.shard_of(i, np.arange(q)), minlength=plan.shards) for i, q in enumerate(plan.quotas)])
    assert (counts.sum(1) == plan.quotas).all() and plan.shards > 10
    assert np.ptp(counts.sum(0)) <= 1
    expected = plan.quotas[0] / plan.draws * counts.sum(0)
    assert (abs(counts[0] - expected) < 6 * np.sqrt(expected)).all()


def test_targets():
    assert targets([], [], 0, 2) == []
    assert targets([10, 100, 50], [3, 1, 2], 240, 2) == [20, pytest.approx(120), 100]
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = rng.integers(0, 1000, 8).tolist()
        weights = [(3, 1, 2)[i % 3] for i in range(8)]
        assert targets(sizes, weights, 1.5 * sum(sizes), 2) == pytest.approx(level(sizes, weights, 1.5 * sum(sizes), 2), abs=1e-6)


def test_empty_tables(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert mix_digest(frame).collect() == [] and mix(frame).collect() == []
    blank = spark.createDataFrame([(1, None, "a", "s", "t"), (2, " ", None, "s", "t")], SCHEMA)
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in mix_digest(blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mix(blank).collect() == []
