from __future__ import annotations

import pytest

import corpus_pipeline
from tests.llm.conftest import CLASHES, rows
from tickloom.llm import langid


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_empty_tables_and_odd_rows(spark, odd, none, clashing, name, stage):
    last = name == corpus_pipeline.STAGES[-1][0]
    assert stage(spark, none, "").count() == 0
    got = stage(spark, odd, "")
    if last:
        assert got.agg({"length": "sum"}).first()[0] > 0
        return
    assert got.columns == odd.columns
    ids = {r["doc_id"] for r in got.select("doc_id").collect()}
    assert ids <= {r[0] for r in rows()}
    more = stage(spark, clashing, "")
    assert more.columns == [*odd.columns, *CLASHES]
    assert sorted(map(repr, (r["doc_id"] for r in more.select("doc_id").collect()))) == sorted(map(repr, (r["doc_id"] for r in got.select("doc_id").collect())))


def test_what_each_stage_drops(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    texts = {r[0]: r[1] for r in rows()}
    kept = {r["doc_id"] for r in stages["language_id"](spark, odd, "").select("doc_id").collect()}
    assert not kept & {4, 5, 6, 7} and {1, 9, 15} <= kept
    exact = [r["doc_id"] for r in stages["exact_dedup"](spark, odd, "").select("doc_id").collect()]
    assert 3 in exact and not {1, 2, 14, 16} & set(exact) and exact.count(9) == 1  # 3 is the longest writing of its group
    near = {r["doc_id"] for r in stages["near_dedup"](spark, odd, "").select("doc_id").collect()}
    assert 1 in near and not {2, 3, 8, 14, 16} & near and texts.keys() - {None, 2, 3, 8, 14, 16} <= near


def test_the_whole_run_packs_what_the_stages_keep(spark, sf_dir):
    from tickloom.llm import exactdup, mixing, neardup, text

    docs = text.documents(spark, sf_dir)
    step = langid.keep_identified(docs, corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model"))
    step = mixing.sample_documents(neardup.keep_one(exactdup.keep_one(step)))
    want = {r["doc_id"] for r in step.select("doc_id").collect()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == want and want
    for i in want:
        own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in got if r["doc_id"] == i)
        assert sum(o[1] for o in own) == own[0][2]
