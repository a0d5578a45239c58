import numpy as np
from pyspark.sql import functions as F

from stripewise.llm import language


def test_accuracy_on_documents_held_out(spark, sf, docs):
    got = language.op2_language_id(spark, sf).join(docs, "doc_id").where("held_out")
    assert got.count() > 20 and got.where("lang = lang_pred").count() >= 0.98 * got.count()
    import zlib

    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in language.op2_language_id(spark, sf).collect())


def test_bundle_is_the_sum_of_bound_vectors():
    space = language._space()
    text = "Äpfel und bananen, 大!"
    grams = space.grams(text)
    want = np.zeros(language.DIMENSIONS)
    for g in grams.tolist():
        a, b, c = g // 4096, g // 64 % 64, g % 64
        want += np.roll(space.at[2][a].astype(int), 2) * np.roll(space.at[2][b].astype(int), 1) * space.at[2][c].astype(int)
    for dense in (np.unique(grams), np.unique(grams)[::2], np.empty(0, np.int64)):
        assert np.allclose(language.Bundler(dense).bundle([text])[0], want)


def test_odd_rows(odd):
    model = language.learnt(odd)
    rows = {(r.doc_id, r.lang_pred, round(r.score, 3)) for r in language.predicted(odd, model).collect()}
    assert all((i, "und", 0.0) in rows for i in (3, 4, 5, 12)) and (None, "und", 0.0) in rows
    assert language.predicted(odd, model).count() == odd.count() and all(0 <= s <= 1 for _, _, s in rows)
    assert {p for i, p, _ in rows if i == 6} == {"de"}
    assert language.predicted(odd.limit(0), model).count() == 0
    none = language.learnt(odd.limit(0))
    assert {r.lang_pred for r in language.predicted(odd, none).collect()} == {"und"}
    assert language.learnt(odd.where(F.col("lang").isNull()))["langs"] == []


def test_learning_and_choice_against_a_plain_version(spark, docs, small):
    """Prototypes as sums of unit vectors of documents, bound and added gram by gram; the choice by cosine."""
    space = language._space()

    def vector(text):
        out = np.zeros(language.DIMENSIONS)
        for g in space.grams(text or "").tolist():
            v = np.ones(language.DIMENSIONS, int)
            for k in range(language.N):
                v *= space.at[k][g // 64 ** (language.N - 1 - k) % 64]
            out += v
        return out

    few = docs.where("n_chars < 1500").limit(60).collect()
    df = spark.createDataFrame(few, docs.schema)
    vectors = {r.text: vector(r.text) for r in few}
    sums = {}
    for lang, text in {(r.lang, r.text) for r in few}:  # repeated texts count once
        if vectors[text].any():
            sums[lang] = sums.get(lang, 0) + vectors[text] / np.linalg.norm(vectors[text])
    langs = sorted(sums)
    model = language.learnt(df)
    assert model["langs"] == langs
    for lang, v in zip(langs, model["vectors"], strict=True):
        np.testing.assert_allclose(v, sums[lang] / np.linalg.norm(sums[lang]), atol=1e-4)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predicted(df, model).collect()}
    for r in few:
        v = vectors[r.text]
        cosines = [float(v @ sums[x]) / np.linalg.norm(sums[x]) / max(1e-9, np.linalg.norm(v)) for x in langs]
        if v.any():
            assert got[r.doc_id][0] == langs[int(np.argmax(cosines))] or np.diff(sorted(cosines)[-2:]) < 1e-4
            assert abs(got[r.doc_id][1] - max(0, max(cosines))) < 1e-3


def test_sample_is_by_text_and_not_by_id(spark):
    """A language whose documents share an id, or are all the same, is learnt and never crowds the sample."""
    rows = [(1, "de", f"der hund und die katze nummer {'x' * (k % 50)} sind {k} im haus") for k in range(3000)]
    rows += [(2, "fr", "le chat est dans la maison avec le chien")] * 3000
    rows += [(k, "en", f"the cat and the dog number {k} are in the house") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    model = language.learnt(df, sample=100)
    assert model["langs"] == ["de", "en", "fr"]
    assert [r.lang_pred for r in language.predicted(spark.createDataFrame([(1, "die katze und der hund"), (2, "le chien et le chat"), (3, "the dog and the cat")], "doc_id bigint, text string"), model).orderBy("doc_id").collect()] == ["de", "fr", "en"]


def test_blocks_of_a_text_have_its_grams(monkeypatch):
    space, text = language._space(), "Ein sehr   langer Text, 123 mit  Zahlen — und Zeichen! "
    want = space.grams(text).tolist()
    for size in (1, 2, 3, 7, 10):
        monkeypatch.setattr(language, "BLOCK", size)
        assert space.grams(text).tolist() == want
