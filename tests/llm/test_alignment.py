import collections
import hashlib
import random

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm import pretokens
from quillon.llm.alignment import alignment_digest
from quillon.llm.registry import op13_alignment

A, B = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def brute(rows):
    library, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    docs, counts = [], collections.Counter()
    for key, text in rows:
        a, b, groups, links = [], [], [], []
        if text:
            a, b = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            bytes_a = [bytes(pretokens._BYTE_OF[c] for c in library.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                a, b = [], []
        i = j = end_a = end_b = 0
        own_a, own_b = [], []
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                own_a.append(a[i])
                end_a += len(bytes_a[i])
                i += 1
            else:
                own_b.append(b[j])
                end_b += len(bytes_b[j])
                j += 1
            if end_a == end_b:
                groups.append((own_a, own_b))
                links.append((own_a[-1], own_b[-1]))
                own_a, own_b = [], []
        counts.update(links)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((key, len(a), len(b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted((str(k), n, m, g, len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), d) for k, n, m, g, x, d in docs)


def read(frame):
    assert frame.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(r.doc_id), *r[1:]) for r in frame.collect())


def test_alignment_equals_brute_force(spark):
    rng = random.Random(6)
    parts = ["alpha", "Beta,", "don't", " ", "  ", "\n", "\t", "été", "12345", "<s>", "</s>", "<0x41>", "<unk>", "<|endoftext|>", "中文", "▁", "\x00", "\x01", "😀", "ﬁ", "é", " ", "　", "x" * 30]
    rows = [(i, rng.choice([" ", ""]).join(rng.choices(parts, k=int(rng.expovariate(1 / 20))))) for i in range(500)]
    rows += [(600, None), (601, ""), (602, " "), (5, rows[5][1]), (None, "no id"), (None, None), (603, "word " * 30_000), (604, "y" * 20_000)] + [(700 + i, "the same words again") for i in range(300)]
    frame = spark.createDataFrame([(*r, "c", "d") for r in rows], "doc_id long, text string, row string, n_links string")
    got, want = read(alignment_digest(frame, A, B)), brute(rows)
    assert got == want
    assert any(w[1] == 0 for w in want if w[0] not in ("600", "601")) and len({w[7] for w in want}) > 200


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert read(op13_alignment(spark, sf)) == brute(rows)


def test_empty_table(spark):
    assert alignment_digest(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
