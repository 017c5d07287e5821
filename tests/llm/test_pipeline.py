"""The stages on the smallest tables: what each takes away, against plain checks."""

import re

import corpus_pipeline
from spanloom.llm import common, decontamination

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, SF), name)
        kept[name] = (docs.collect(), out.collect(), out.columns)
        docs = out
    for name, (before, after, names) in kept.items():
        if name != "byte_bpe":
            assert names == columns
        assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    before, after, _ = kept["near_duplicates"]
    first = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    assert {r.doc_id for r in after} <= set(first.values())  # exact copies are gone
    before, after, _ = kept["substring_dedup"]
    assert len(before) == len(after) and all(r.n_chars == len(r.text) for r in after)
    seen = {}
    for r in sorted(after, key=lambda r: r.doc_id):
        w = r.text.split()
        for i in range(len(w) - 49):
            assert seen.setdefault(tuple(w[i : i + 50]), r.doc_id) == r.doc_id or not re.search(r"\S", r.text)
    items = [decontamination.words_of(r.text) for r in common.table(spark, SF, "benchmark").collect()]
    before, after, _ = kept["decontamination"]
    holds = lambda t: any(b" ".join(i) in b" ".join(decontamination.words_of(t)) for i in items)
    assert {r.doc_id for r in before if holds(r.text)} <= {r.doc_id for r in before} - {r.doc_id for r in after}
    before, after, _ = kept["byte_bpe"]
    assert len(before) == len(after) and all(len(r.ids) == r.n_tokens for r in after)


def test_stages_on_edges(spark):
    shape = "doc_id long, text string, lang string, source string, n_chars long, component string, h long, content boolean, starts int, text_key int"
    rows = [(None, "a b", None, None, 3, "x", 1, True, 7, 8), (None, None, "en", "s", 0, None, None, None, None, None), (1, None, "en", "s", 0, "x", 1, True, 7, 8), (2, "", "en", "s", 0, "x", 1, True, 7, 8), (3, "one two three", None, "s", 13, "x", 1, True, 7, 8), (3, "one two three", "en", "s", 13, "x", 1, True, 7, 8), (4, "w " * 3000, "en", "s", 6000, "x", 1, True, 7, 8), (5, "漢" * 5000, "zh", "s", 5000, "x", 1, True, 7, 8)]
    whole = spark.createDataFrame(rows, shape)
    for docs, left in ((whole, {None, 1, 3, 4, 5}), (whole.limit(0), set())):
        for name, stage in corpus_pipeline.STAGES:
            out = common.materialize(stage(spark, docs, SF), name)
            if name != "byte_bpe":
                assert out.columns == docs.columns
                docs = out
        assert {r.doc_id for r in docs.collect()} == left
        assert out.count() == docs.count()
