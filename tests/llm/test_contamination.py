import random

from quillon.llm.contamination import find_contamination


def shingles(text, size=5):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(docs, items):
    out = []
    for d, text, *_ in docs:
        own = shingles(text)
        for i, t, *_ in items:
            q = shingles(t)
            if q and len(own & q) * 100 >= len(q) * 80:
                out.append((str(d), i, len(q), len(own & q)))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["ab", "Cd", "été", "x", "yz", "q1", "rr"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 60)))) for i in range(30)] + [(40, None), (41, ""), (42, "three word item"), (3, "same id other text of six words")]
    items.append(items[5])
    docs = []
    for i in range(120):
        words = rng.choices([*vocabulary, "w", "v", "u"], k=rng.randint(0, 200))
        if i % 2:
            passage = items[rng.randrange(30)][1].split()
            if i % 3 == 0 and len(passage) > 12:
                passage[rng.randrange(len(passage))] = "changed"
            words[len(words) // 2 : len(words) // 2] = passage
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(words).upper() if i % 5 == 0 else " ".join(words), 1))
    docs += [(500, None, 1), (501, "", 1), (502, "Three word\nitem", 1), (503, "filler " * 30_000 + items[7][1], 1), (None, items[7][1], 1), docs[1]]
    d, b = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 50
    for block in (8 << 20, 500):
        got = find_contamination(d, b, block_bytes=block).collect()
        assert sorted((str(r.doc_id), r.item_id, r.n_item, r.n_shared) for r in got) == want


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(d, b).count() == 0
    assert find_contamination(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), b).count() == 0
