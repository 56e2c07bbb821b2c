import os

import pytest

import corpus_pipeline
from corpusflow.llm import chosen_path, line_dedup, mixing, quality, tiling
from corpusflow.llm.common import staged, table
from llm_helpers import FOLDER, needs_tables


@needs_tables
def test_each_stage_on_what_the_one_before_kept(spark):
    docs = table(spark, FOLDER, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs, FOLDER), f"test-{name}")
        assert out.columns == columns
        kept[name] = (docs, out)
        docs = out
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    before, after = kept["quality"]
    scores = quality.quality_scores(before, table(spark, FOLDER, "labels"))
    assert ids(after) == {r.doc_id for r in scores.collect() if r.score >= 0.3}

    before, after = kept["line_dedup"]
    text = {r.doc_id: r.text for r in line_dedup.dedup_lines(before).collect() if r.text.strip() or not r.removed_lines}
    assert {r.doc_id: r.text for r in after.collect()} == text
    assert all(r.n_chars == len(r.text) for r in after.collect())

    before, after = kept["near_duplicates"]
    classes = chosen_path.similar_classes(before).collect()
    assert ids(after) == {r.class_id for r in classes} and after.count() == len(ids(after))

    before, after = kept["decontamination"]
    found = tiling.overlaps(before, table(spark, FOLDER, "benchmark"))
    assert ids(after) == ids(before) - ids(found)

    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    shares = mixing.mixture_shares(docs).collect()
    assert sum(r.n_words for r in mixed.collect()) == sum(r.taken for r in shares)
    assert ids(mixed) == {r.doc_id for r in shares if r.taken}


@needs_tables
def test_run_and_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    for name in ("documents", "labels", "benchmark"):
        table(spark, FOLDER, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@needs_tables
@pytest.mark.parametrize("name", ["op6_chat", "op7_warc", "op11_exact_dedup", "op12_ranked_search", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, name):
    from compare import connect, difference

    from corpusflow.llm.queries import ORACLES, QUERIES

    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None
    assert os.path.isdir(FOLDER)
