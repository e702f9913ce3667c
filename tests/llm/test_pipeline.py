"""The pipeline's stages against plain-Python decisions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_decide_as_the_plain_versions(spark, docs, tmp_path):
    rows = {r.doc_id: r for r in docs.collect()}
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in held.collect()}
        out = stage(spark, held, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "language_id":
            assert set(after) == set(before)
        elif name == "jaccard_join":
            assert set(after) == {i for i, (g, _) in brute.near_groups(before.items()).items() if g == i} != set(before)
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {i for i, w in brute.contaminated(before.items(), items).items() if not w[4]} != set(before)
        else:
            assert set(after) == set(before)
            for i, t in before.items():
                spans = brute.base_spans(t)
                assert after[i] == t if not spans and after[i] == t else "[" in after[i]
                assert not [s for s in brute.base_spans(after[i])]
        held = out
    packed = corpus_pipeline.STAGES[-1][1](spark, held, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(after) <= set(rows)


def test_stages_take_odd_rows(spark, docs):
    odd = docs.limit(3).unionByName(docs.limit(1))
    odd = odd.unionByName(odd.limit(2).withColumn("doc_id", F.lit(None).cast("bigint"))).withColumns({"_c": F.lit(1), "key": F.lit("x")})
    odd = odd.unionByName(odd.limit(1).withColumns({c: F.lit(None).cast(t) for c, t in odd.dtypes}))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 0 and stage(spark, odd.limit(0), SF).count() == 0
    kept = corpus_pipeline.jaccard_join(spark, odd.where("text is not null"), SF)
    assert kept.count() == odd.select("text").where("text is not null").distinct().count()
