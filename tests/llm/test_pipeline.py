import corpus_pipeline
from pyspark.sql import functions as F

from stripewise.llm import decontaminate, toxicity
from stripewise.llm.shared import stored

from .test_simhash import shingle_set
from .test_suffix import plain as plain_suffix


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    models = toxicity.learnt(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    one = stored(stages[0](spark, docs, sf), "t")
    scores = {r.doc_id: (r.p_toxic, r.p_severe_toxic) for r in toxicity.scored(docs, models, keep=["doc_id"]).collect()}
    assert {r.doc_id for r in one.collect()} == {i for i, p in scores.items() if max(p) < toxicity.THRESHOLD} and one.columns == docs.columns

    two = stored(stages[1](spark, one, sf), "t")
    kept, gone = two.collect(), one.join(two, "doc_id", "left_anti").collect()
    own = [shingle_set(r.text) for r in kept]
    for r in gone:
        s = shingle_set(r.text)
        assert any(k.doc_id < r.doc_id for k in kept) and any(len(s & o) > 0.3 * len(s | o) or s == o for o in own)
    assert two.columns == docs.columns

    three = stored(stages[2](spark, two, sf), "t")
    texts = [r.text for r in kept]
    want = {r.doc_id: (p[0] - p[1]) for r, p in zip(kept, plain_suffix(texts), strict=True)}
    for r in three.collect():
        assert 0 <= want[r.doc_id] - len(r.text.encode()) <= 6 and r.n_chars == len(r.text)
    assert three.columns == docs.columns and three.count() == two.count()

    four = stored(stages[3](spark, three, sf), "t")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontaminate.Index(items)
    assert {r.doc_id for r in four.collect()} == {r.doc_id for r in three.collect() if not index.search(r.text)}

    five = stages[4](spark, four, sf)
    assert five.agg(F.sum("length")).first()[0] == five.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
    assert {r.doc_id for r in five.select("doc_id").collect()} == {r.doc_id for r in four.collect()}


def test_odd_rows(spark, odd, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "no such item in any of the documents here")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = stored(stage(spark, docs, sf), "t")
            assert name == "packing" or docs.columns == before.columns


def test_run(spark, sf):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf).where("length < 1 or length > 1024").count() == 0
