import corpus_pipeline
from tessera.llm.shared import materialize, table

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DIR, "documents")
    columns, before = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, DIR), name)
        now = {r[0] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= before and now
        before = now
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == before


def test_near_duplicates_keep_the_first_of_a_group(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(3, text), (1, text + " more"), (2, None), (5, "apart"), (None, "nothing like it")], "doc_id long, text string")
    assert {r[0] for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect()} == {1, 2, 5, None}
