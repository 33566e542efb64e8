import math
import random

import numpy as np

from quillon.llm import language as L

WORDS = {"aa": ["bada", "gado", "dabu", "zag"], "bb": ["xtri", "qetl", "ptix", "kri"], "cc": ["été", "çàé", "êtué", "ôùé"]}


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.randint(3, 30))), lang, "x"))
    return rows


def plain_forward(net, text):
    """The labels of every position, one byte and one unit at a time."""
    hid = range(net.hidden)
    sign = lambda x: x / (1 + abs(x))
    p = {k: v.tolist() for k, v in net.p.items()}
    runs = []
    for d, data in enumerate((text, text[::-1])):
        h, run = [0.0] * net.hidden, []
        for byte in data:
            sums = [[sum(h[i] * p["rec"][g][d][i][j] for i in hid) for j in hid] for g in range(3)]
            update = [(sign(p["in"][0][d][byte][j] + sums[0][j]) + 1) / 2 for j in hid]
            reset = [(sign(p["in"][1][d][byte][j] + sums[1][j]) + 1) / 2 for j in hid]
            new = [sign(p["in"][2][d][byte][j] + reset[j] * sums[2][j]) for j in hid]
            h = [h[j] + update[j] * (new[j] - h[j]) for j in hid]
            run.append(h)
        runs.append(run if d == 0 else run[::-1])
    out = []
    for ahead, back in zip(*runs):
        z = [p["bias"][k] + sum(ahead[j] * p["out"][0][j][k] + back[j] * p["out"][1][j][k] for j in hid) for k in range(len(net.languages))]
        top = max(z)
        e = [math.exp(x - top) for x in z]
        out.append([x / sum(e) for x in e])
    return out


def read(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])


def test_gradients_equal_finite_differences():
    net = L.Network(["a", "b"], 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, lengths, target = np.array([[5, 6, 7], [8, 9, 0], [3, 0, 0]]), np.array([3, 2, 1]), np.array([[1, 0], [0, 1], [0.5, 0.5]])
    _, g = net.gradients(x, lengths, target)
    for k, v in net.p.items():
        for i in (np.unravel_index(j, v.shape) for j in np.argsort(-np.abs(g[k]), axis=None)[:3]):
            v[i] += 1e-4
            up = net.gradients(x, lengths, target)[0]
            v[i] -= 2e-4
            down = net.gradients(x, lengths, target)[0]
            v[i] += 1e-4
            assert abs(g[k][i] - (up - down) / 2e-4) < 1e-5


def test_whole_texts_equal_the_plain_forward_pass():
    net = L.train([(r[1], r[2]) for r in corpus(50)], steps=20)
    texts = ["bada  xtri\tbada été " + "q" * 60 + "\n\n12, gado " * 9, "é", "x", "kri " * 40, "", "77"]
    data, offsets = read(texts)
    for span, run in ((L.SPAN, L.RUN), (7, 20), (16, 1 << 20)):  # the longer texts cross many spans' edges
        mean, has = L.probabilities(net, data, offsets, span, run)
        assert has.tolist() == [True, True, True, True, False, False]
        for text, got in zip(texts[:4], mean):
            raw = text.encode()
            letters = [z for z, b in zip(plain_forward(net, raw), raw) if chr(b).isascii() and chr(b).isalpha() or b > 127]
            assert np.allclose(got, np.mean(letters, axis=0), atol=1e-4)


def test_held_out_accuracy_and_odd_rows(spark):
    rows = [*corpus(), (900, None, "aa", "x"), (901, "", "aa", "x"), (902, "12 34 !!", "bb", "x"), (903, "bada " * 30_000, None, "x"), (3, corpus()[3][1], None, "x"), (None, "bada gado dabu", "aa", "x"), (904, "été", "cc", "x"), (905, "—… ×÷", "cc", "x")]
    out = L.predict_language(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (900, 901, 902, 905)] == ["und"] * 4 and by[903].lang_pred == "aa"
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 300]
    truth = {r[0]: r[2] for r in corpus()}
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_accuracy_on_held_out_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.predict_language(documents).where("held_out").join(documents.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(out) > 100 and sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


def test_empty_and_unlabelled(spark):
    schema = "doc_id long, text string, lang string"
    assert L.predict_language(spark.createDataFrame([], schema)).count() == 0
    out = L.predict_language(spark.createDataFrame([(1, "bada", None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]


def test_clashing_columns_are_kept(spark):
    rows = [(r[0], r[1], r[2], "a", 1, "b") for r in corpus(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, held_out int, lang_pred string")
    out = L.with_language(frame, "told").collect()
    assert sorted(r.doc_id for r in out) == list(range(60)) and {(r.score, r.held_out, r.lang_pred) for r in out} == {("a", 1, "b")}
    assert set(L.predict_language(frame).columns) == {"doc_id", "held_out", "lang_pred", "score"}
