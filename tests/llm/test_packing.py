import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillon.llm.packing import best_pattern, cutting_patterns, pack

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_cover_every_document(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta,", "été", "x" * 30, "don't", "12", "<|endoftext|>", "中文", "\n"]
    rows = [(i, " ".join(rng.choices(words, k=int(rng.expovariate(1 / 300)))), "c") for i in range(400)]
    rows += [(500, None, "c"), (501, "", "c"), (7, rows[7][1], "c"), (502, "word " * 20_000, "c"), (None, "none", "c")] + [(600 + i, "same words here", "c") for i in range(300)]
    out = pack(spark.createDataFrame(rows, "doc_id long, text string, length string"), PATH).toPandas()
    library = Tokenizer.from_file(PATH)
    want = []
    for key, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 2048):
            want.append((str(key), a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()), len(ids)))
    got = [(str(None if k != k else int(k)), *x) for k, *x in out[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False)]
    assert sorted(got) == sorted(want)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        ends = s["length"].cumsum()
        assert ends.iloc[-1] <= 2048 and (s["offset"].to_numpy() == np.concatenate([[0], ends[:-1]])).all()
    total = out["length"].sum()
    assert out["sequence_id"].nunique() <= total / 2048 * 1.03 + 2


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_pricing_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        prices = rng.random(6)
        best = np.zeros(13)
        for room in range(1, 13):
            best[room] = max([best[room - 1]] + [best[room - i - 1] + prices[i] for i in range(6) if i < room])
        value, pattern = best_pattern(prices, 12)
        assert abs(value - best[12]) < 1e-9 and abs(pattern @ prices - value) < 1e-9


def test_patterns_cover_demand_near_the_bound():
    rng = np.random.default_rng(2)
    demand = (3000 * np.exp(-np.arange(64) / 12) * rng.random(64)).astype(int)
    used = cutting_patterns(demand, 64)
    assert (sum(p * t for p, t in used) == demand).all()
    assert all((p @ np.arange(1, 65)) <= 64 for p, _ in used)
    assert sum(t for _, t in used) <= demand @ np.arange(1, 65) / 64 * 1.02 + 5
