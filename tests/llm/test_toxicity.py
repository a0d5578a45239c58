import numpy as np

from stripewise.llm import toxicity


def test_finds_toxic_documents(spark, docs, sf):
    big = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    every = spark.read.parquet(f"{big}/documents.parquet")
    models = toxicity.learnt(every, labels.where("doc_id % 2 = 0"))
    got = toxicity.scored(every, models, keep=["doc_id"]).withColumn("hit", toxicity.rejected()).join(labels.where("doc_id % 2 = 1"), "doc_id")
    toxic, clean = got.where("toxic = 1"), got.where("toxic = 0")
    assert toxic.where("hit").count() >= 0.6 * toxic.count()  # learnt from 200 documents
    assert clean.where("hit").count() <= 0.02 * clean.count()


def test_later_models_see_out_of_fold_probabilities_of_earlier_ones():
    rng = np.random.default_rng(0)
    n = 600
    y = rng.integers(0, 2, n)
    lists = [(np.unique(np.r_[rng.integers(100, 200, 5), 7 if v else 8]), np.ones(6)) for v in y]
    lists = [(i, np.ones(i.size)) for i, _ in lists]
    second = np.where(rng.random(n) < 0.9, y, 1 - y)
    models = toxicity.chained(lists, np.zeros((n, 3)), np.stack([y, second], axis=1), np.arange(n) % 5)
    assert models[0].dense.size == 3 and models[1].dense.size == 4
    p = toxicity.probabilities(models, lists, np.zeros((n, 3)))
    assert ((p[:, 0] > 0.5) == y).mean() == 1 and ((p[:, 1] > 0.5) == y).mean() > 0.99


def test_constant_labels_and_empty_input():
    lists = [(np.array([1]), np.ones(1))] * 4
    assert toxicity.fitted(lists, np.zeros((4, 3)), np.zeros(4)).words.size == 0
    assert toxicity.features(None)[0].size == 0 and toxicity.features(" !?")[2] == [0.0, 0.0, 0.0]


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (6, None, 0), (8, 1, 1), (9, 1, 0)], "doc_id bigint, quality int, toxic int")
    models = toxicity.learnt(odd, labels)
    assert len(models) == 3
    got = toxicity.scored(odd, models)
    assert got.columns == [*odd.columns, "p_low_quality", "p_toxic", "p_severe_toxic"] and got.count() == odd.count()
    assert got.where("p_toxic is null or p_toxic < 0 or p_toxic > 1").count() == 0
    assert toxicity.scored(odd.limit(0), models).count() == 0
    assert toxicity.learnt(odd, labels.limit(0)) == []
    assert toxicity.scored(odd, []).where("p_toxic = 0").count() == odd.count()


def test_sample_of_labels():
    assert toxicity.SAMPLE >= 20_000


def test_labels_without_quality_teach_the_toxic_model(spark):
    docs = spark.createDataFrame([(k, f"some plain words number{k} " + ("nasty" if k % 2 else "kind")) for k in range(80)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1 if k % 10 == 0 else None, k % 2) for k in range(80)], "doc_id bigint, quality int, toxic int")
    models = toxicity.learnt(docs, labels)
    got = {r.doc_id: r.p_toxic for r in toxicity.scored(docs, models, keep=["doc_id"]).collect()}
    assert all((p > 0.5) == bool(k % 2) for k, p in got.items())


def test_chain_against_a_plain_version():
    """Each category's model is fitted on its own words, the measurements and the earlier categories' probabilities, by plain gradient steps."""
    rng = np.random.default_rng(2)
    n = 300
    y = rng.integers(0, 2, n)
    second = np.where(rng.random(n) < 0.8, y, 1 - y)
    lists = [(np.unique([7 if v else 8, 20 + k % 5, 11 if w else 12]), np.ones(np.unique([7 if v else 8, 20 + k % 5, 11 if w else 12]).size)) for k, (v, w) in enumerate(zip(y, second, strict=True))]
    measures, folds = rng.random((n, 3)), np.arange(n) % toxicity.FOLDS
    models = toxicity.chained(lists, measures, np.stack([y, second], axis=1), folds)

    def fit(rows, dense, labels):
        words = toxicity._chosen([lists[k] for k in rows], labels[rows].astype(float))
        x = np.array([[float(w in lists[k][0]) for w in words] for k in rows])
        mean, scale = dense[rows].mean(axis=0), dense[rows].std(axis=0) + 1e-6
        full = np.hstack([x, (dense[rows] - mean) / scale, np.ones((len(rows), 1))])
        w, penalty = np.zeros(full.shape[1]), np.r_[np.full(full.shape[1] - 1, toxicity.PENALTY), 1e-3]
        for _ in range(60_000):
            w -= 0.02 * (full.T @ (1 / (1 + np.exp(-full @ w)) - labels[rows]) + penalty * w)
        return lambda k, d: 1 / (1 + np.exp(-(np.r_[[float(v in lists[k][0]) for v in words], (d - mean) / scale, 1.0] @ w)))

    every = np.arange(n)
    first = fit(every, measures, y)
    out = np.zeros(n)
    for f in range(toxicity.FOLDS):
        part = fit(every[folds != f], measures, y)
        out[folds == f] = [part(k, measures[k]) for k in every[folds == f]]
    dense = np.hstack([measures, out[:, None]])
    last = fit(every, dense, second)
    got = toxicity.probabilities(models, lists, measures)
    for k in range(0, n, 10):
        p = first(k, measures[k])
        assert abs(got[k, 0] - p) < 0.01 and abs(got[k, 1] - last(k, np.r_[measures[k], p])) < 0.02


def test_sample_is_bounded_where_an_id_has_many_texts(spark):
    docs = spark.createDataFrame([(1, f"text number {k} of one id") for k in range(2000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert len(toxicity.learnt(docs, labels, sample=50)) == 3
