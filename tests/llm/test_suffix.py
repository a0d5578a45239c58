import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stripewise.llm import suffix


def plain(texts, length=200):
    """(n_bytes, n_removed, n_spans, sha of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("most", [16_000, 1])
def test_documents(docs, small, monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST", most)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.deduplicated(docs).collect()}
    assert got == dict(zip([i for i, _ in small], plain([t for _, t in small]), strict=True))


@pytest.mark.parametrize("most", [16_000, 2])
def test_hard_texts(spark, monkeypatch, most):
    """Runs, periods, overlaps, repeats in one text, repeats that begin and end anywhere, and blocks of a long text."""
    monkeypatch.setattr(suffix, "MOST", most)
    monkeypatch.setattr(suffix, "CHUNK", 1000)
    rng = np.random.default_rng(5)
    random = lambda n: "".join(rng.choice(list("abcdefgé "), n))
    shared = random(900)
    texts = ["a" * 500, "a" * 199, "a" * 200, "ab" * 300, random(300) + shared + random(50), shared[100:700] + random(10), random(70) + shared[350:551] + random(200), shared[10:209], random(5000) + shared + random(3000) + shared[200:600], None, "", *[shared[k : k + 230] + random(100) for k in range(0, 600, 37)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.deduplicated(df).collect()}
    assert got == dict(enumerate(plain(texts)))


def test_odd_rows(odd):
    rows = odd.collect()
    want = sorted(((r.doc_id, *p) for r, p in zip(rows, plain([r.text for r in rows]), strict=True)), key=str)
    assert sorted((tuple(r) for r in suffix.deduplicated(odd).collect()), key=str) == want
    assert suffix.deduplicated(odd.limit(0)).count() == 0
    cut = suffix.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count() and cut.where("doc_id = 3 and text is null and key = 'key-value'").count() == 1
    assert cut.where("doc_id = 10").first().text == rows[11].text[:0] + cut.where("doc_id = 10").first().text


@given(st.binary(min_size=1, max_size=60).map(lambda b: bytes(x % 3 for x in b)), st.integers(2, 20))
@settings(max_examples=200, deadline=None)
def test_refinement_tells_strings_apart(data, length):
    if len(data) < length:
        return
    bucket = suffix.refined(np.frombuffer(data, np.uint8), length)
    places = range(len(data) - length + 1)
    assert all((bucket[a] == bucket[b]) == (data[a : a + length] == data[b : b + length]) for a in places for b in places)


def test_sql_agrees(spark, sf):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(map(tuple, suffix.op6_suffix_dedup(spark, sf).collect())) == sorted(db.sql(suffix.OP6_SQL).fetchall())
