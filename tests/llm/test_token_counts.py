import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import pretokens
from quillon.llm.token_counts import count_tokens

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
ALPHABET = [*"ab'stmdrevl  \n\t19.,!?éÉİßñ²½<|>’中", "<|endoftext|>", "'s", "'ll", " '", "́", "\x1c", "\x85"]


def texts():
    rng = random.Random(3)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(3000)] + [None, "", " ", "word " * 40_000, "x" * 50_000]


def test_counts_equal_the_library(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(0, "twice", "c"), (None, "no id", "c")]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH).collect()
    library = Tokenizer.from_file(PATH)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_byte_splitter_equals_the_library(name):
    import numpy as np

    library = Tokenizer.from_file(str(public_tokenizers.path(name)))
    for text in texts()[:3000]:
        data = np.frombuffer(text.encode(), np.uint8)
        codes = pretokens.Codes(data, np.array([0, len(data)]))
        if codes.plain[0]:
            spans = pretokens.split_bytes(codes.codes, codes.rows)
            assert [*zip(*(x.tolist() for x in spans))] == [p[1] for p in library.pre_tokenizer.pre_tokenize_str(text)]
