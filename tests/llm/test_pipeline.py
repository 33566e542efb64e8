import collections

import corpus_pipeline as P
from quillon.llm.runtime import stored
from tests.llm.test_contamination import brute as contaminated
from tests.llm.test_jaccard import brute as components

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    read = lambda f: {r.doc_id: r for r in f.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stored(stage(spark, docs, SF), "stage")
        assert out.columns == P.COLUMNS
        before, after = read(docs), read(out)
        assert set(after) <= set(before)
        if name == "language ID":
            assert all(any(c.isalpha() for c in before[i].text) for i in after) and len(after) >= 0.97 * len(before)
            assert all(after[i] == before[i] for i in after)
        if name == "line dedup":
            seen = collections.Counter(x for r in after.values() for x in r.text.split("\n") if len(x) >= 20)
            assert max(seen.values()) == 1 and {x for r in before.values() for x in r.text.split("\n") if len(x) < 20} >= {x for r in after.values() for x in r.text.split("\n") if len(x) < 20}
            assert all(r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i].text)
        if name == "n-gram Jaccard join":
            want = {int(i) for i, _, c in components([(r.doc_id, r.text) for r in before.values()], 5, 80) if i == c}
            assert set(after) == want
        if name == "benchmark decontamination":
            gone = {int(x[0]) for x in contaminated([(r.doc_id, r.text) for r in before.values()], benchmark)}
            assert set(after) == set(before) - gone
        docs = out
    pieces = stored(P.STAGES[-1][1](spark, docs, SF), "stage")
    assert {r.doc_id for r in pieces.collect()} == set(read(docs))
    assert P.run(spark, SF).count() == pieces.count()


def test_odd_rows_pass_all_stages(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some words of text here", "en", "s", 3), (3, "x" * 100_000, "de", None, None), (4, "123 456", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() >= 0
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
