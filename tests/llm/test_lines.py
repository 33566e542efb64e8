import random

import numpy as np
import pytest

from quillon.llm import lines as L


def distance(a, b):
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_equals_dynamic_program():
    rng = random.Random(1)
    for _ in range(4000):
        a = "".join(rng.choices("abé", k=rng.randint(0, 14)))
        b = list(a) if rng.random() < 0.7 else rng.choices("abé", k=rng.randint(0, 14))
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choices("abé", k=rng.randint(0, 1))
        most = rng.randint(0, 4)
        assert L.edit_distance(a, "".join(b), most) == min(distance(a, "".join(b)), most + 1)


def test_linked_lines_always_meet():
    rng = random.Random(2)
    for _ in range(300):
        a = "".join(rng.choices("ab", k=rng.randint(6, 30)))
        b = list(a)
        for _ in range(2):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choices("ab", k=rng.randint(0, 1))
        data = np.frombuffer((a + "\n" + "".join(b)).encode(), np.uint8)
        lines = L.Lines(data, np.array([0, len(data)]), 0)
        keys = {(int(k), p, int(w)) for key, which, p in lines.keys(np.arange(2), 2) for k, w in zip(key, which)}
        assert any((k, False, 1 - w) in keys for k, p, w in keys if p)


def corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefgh é", k=rng.randint(4, 60))) for _ in range(40)]
    template = "the template line number %s of the very same text"
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randint(0, len(line))
                line[at : at + rng.randint(0, 1)] = rng.choices("abcdefgh é", k=rng.randint(0, 1))
            lines.append("".join(line) if rng.random() < 0.8 else template % "".join(rng.choices("0123456789", k=3)))
        rows.append((i, "\n".join(lines), "x"))
    return rows + [(500, None, "x"), (501, "", "x"), (502, "\n\n", "x"), (503, base[0] * 2000 + "\n" + "line of its own " * 3, "x"), (3, rows[3][1], "x"), (4, "another text with id four\n" + base[1], "x"), (None, base[2], "x")]


def brute(rows, threshold, least):
    rows = sorted({r[:2] for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    occurrences = [(r, p, x) for r in rows for p, x in enumerate((r[1] or "").split("\n")) if len(x) >= least]
    names = sorted({x for _, _, x in occurrences})
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold:
                parent[find(a)] = find(b)
    return occurrences, {x: find(x) for x in names}


@pytest.mark.parametrize("seed,threshold,pairs", [(1, 2, 4096), (2, 2, 2), (3, 1, 2)])
def test_dropped_lines_equal_brute_force(spark, seed, threshold, pairs, monkeypatch):
    monkeypatch.setattr(L, "LIST_PAIRS", pairs)
    monkeypatch.setattr(L, "BLOCK", 16)
    if seed == 2:
        monkeypatch.setattr(L, "HOT_LIST", 4)
    rows = corpus(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string, dropped string")
    out = L.dedup_lines(frame, threshold).collect()
    assert len(out) == len(rows)
    occurrences, root = brute(rows, threshold, 20)
    kept, total = {}, {}
    for (key, text), place, line in occurrences:
        total.setdefault(root[line], set()).add((key, text, place))
    for r in out:
        text = dict(((x[0], x[1]) for x in rows if x[0] == r.doc_id and (x[1] or "").count("\n") == max(r.n_lines - 1, 0)))
        assert r.n_dropped == len(r.dropped)
    dropped = set()
    by = {}
    for x in rows:
        by.setdefault(x[0], []).append(x[1])
    for r in L.duplicate_lines(frame, threshold).join(L._rows(frame, "doc_id", "text"), "row").collect():
        dropped |= {(r.key, r.text, p) for p in r.dropped}
    for members in total.values():
        assert len(members - dropped) == 1
        first = (members - dropped).pop()
        assert all((first[0] is not None, first[0] or 0) <= (m[0] is not None, m[0] or 0) for m in members)
        assert all(first[2] <= m[2] for m in members if m[:2] == first[:2])
    assert dropped <= set().union(*total.values())
    thin = L.dropped_lines(frame, threshold).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped) for r in thin) == sorted((str(r.doc_id), r.n_lines, r.n_dropped) for r in out)
    for r in out:
        if r.doc_id == 500:
            assert r.text is None and r.n_lines == 0
    whole = {(x[0], x[1]) for x in rows}
    for r in out:
        source = [t for k, t in whole if k == r.doc_id and t is not None and "\n".join(p for i, p in enumerate(t.split("\n")) if i not in set(r.dropped)) == r.text]
        assert r.text is None or source


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_names_and_lines_that_a_polynomial_hash_mixes_up(spark):
    a = "a"
    for _ in range(10):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    names = ["_row", "_dropped", "row", "DROPPED", "place", "check", "line", "key"]
    rows = [(1, a + "\nx", *names), (2, b, *names), (3, a, *names)]
    out = L.dedup_lines(spark.createDataFrame(rows, ["doc_id", "text", *names])).collect()
    assert {r.doc_id: r.text for r in out} == {1: a + "\nx", 2: b, 3: ""}
    assert {(r._row, r.row, r.key) for r in out} == {("_row", "row", "key")} and {tuple(r.dropped) for r in out} == {(), (0,)}


def test_every_text_is_cut_into_lines_in_two_passes(spark):
    """One pass finds places and counts, one sends index entries; a third read fetches the linked lines. It was five reads."""
    reads = spark.sparkContext.accumulator(0)

    def read(text):
        reads.add(1)
        return text

    rows = [(i, f"a line of its own that has the number {i * 7919}\nthe line that all of the documents share") for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = L.dropped_lines(frame.withColumn("text", L.F.udf(read, "string").asNondeterministic()("text"))).collect()
    assert {(r.doc_id, r.n_lines) for r in out} == {(i, 2) for i in range(40)} and all("1" in r.dropped for r in out if r.doc_id)
    assert reads.value <= 3 * len(rows)


def test_entries_are_not_sent_again_as_probes():
    text = np.frombuffer("\n".join("abcdefgh" * 4 + str(i) for i in range(9)).encode(), np.uint8)
    lines = L.Lines(text, np.array([0, len(text)]), 20)
    sent = [(int(k), int(w), p) for key, which, p in lines.keys(np.arange(9), 2, own=False) for k, w in zip(key, which)]
    entries = {(k, w) for k, w, p in sent if not p}
    assert len(entries) == 27 and len(sent) == 9 * 12 and not entries & {(k, w) for k, w, p in sent if p}


def test_signatures_count_characters():
    texts = ["a" * 300 + "bé", "\U0001f600\U0001f601 ab", "é" * 4000 + "x" * 9000, "", "plain", ""]
    for joined in ("\n".join(texts), "a" * 20 + "\n" + "b" * 700):
        data = np.frombuffer(joined.encode(), np.uint8)
        lines = L.Lines(data, np.array([0, len(data)]), 0)
        for found, text in zip(lines.signatures(np.arange(len(lines.row))), joined.split("\n"), strict=True):
            counts = [0] * 15
            for c in text:
                counts[int(L.hashing.mix(np.array([ord(c) + 1], np.uint64))[0] % np.uint64(15))] += 1
            assert int(found) == sum((n % 16) << 4 * k for k, n in enumerate(counts))


def test_line_counts_and_lines_joined_without_broadcast(spark, monkeypatch):
    rows = [r[:2] for r in corpus(4)] + [(501, ""), (502, "\n\n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    ordered = lambda: sorted(map(str, L.dropped_lines(frame).collect()))
    usual = ordered()
    monkeypatch.setattr(L, "BROADCAST_LINES", 0)
    assert ordered() == usual
    assert sorted((str(r.doc_id), r.n_lines) for r in L.dropped_lines(frame).collect()) == sorted((str(k), (x.count("\n") + 1) if x else 0) for k, x in rows)
