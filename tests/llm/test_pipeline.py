import os

import __spark_entry__
import corpus_pipeline
from shelfmark.llm import near_dedup, pii, quality
from shelfmark.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark, small, tmp_path):
    docs = small
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == small.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in docs.collect()})
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    assert kept[0] == {r.doc_id for r in quality.verdicts(small, labels).where("kept").collect()}
    assert kept[1] == {r.doc_id for r in near_dedup.near_duplicates(small.where(small.doc_id.isin(*kept[0]))).where("kept").collect()}
    assert kept[2] == kept[1]
    assert not any(any(pii.base_spans(r.text).values()) for r in docs.collect())
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in pieces} == kept[2]


def test_odd_rows_pass_every_stage(spark, odd, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0


def test_registered():
    found = __spark_entry__.queries()
    assert set(QUERIES) <= set(found) and "pipeline" in found and os.path.exists(corpus_pipeline.__file__)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
