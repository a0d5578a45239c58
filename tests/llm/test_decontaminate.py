import random
from collections import Counter

import numpy as np
import pytest

from stripewise.llm import decontaminate as d


def plain(text, items):
    """Items whose best window reaches the similarity."""
    s = d.shingles(d.words_of(text)).tolist()
    out = {}
    for i, t in items:
        own = d.shingles(d.words_of(t)).tolist()
        n = min(len(own), len(s))
        if own and n and n >= d.SIMILARITY * len(own):
            best = max(d.similarity(Counter(s[k : k + n]), Counter(own)) for k in range(len(s) - n + 1))
            if best >= d.SIMILARITY:
                out[i] = best
    return out


def test_documents(spark, sf, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in d.op5_decontaminate(spark, sf).collect()}
    assert got == {(i, k): round(v, 9) for i, t in small for k, v in plain(t, items).items()}


def test_edited_items_are_found():
    rng = random.Random(0)
    words = [f"word{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(20, 60)))) for k in range(60)]
    index = d.Index(items)
    hit = total = 0
    for k, text in items:
        for edits in (0, 1, 1, 1):
            w = text.split()
            for _ in range(edits):
                w[rng.choice([0, len(w) - 1, len(w) // 2])] = "changed"
            doc = " ".join(rng.choices(words, k=100)) + " " + " ".join(w).upper() + ". " + " ".join(rng.choices(words, k=100))
            want = plain(doc, [items[k]])
            if want:
                total += 1
                hit += any(i == k and abs(v - want[k]) < 1e-9 for i, _, _, v in index.search(doc))
    assert total > 100 and hit >= 0.97 * total
    assert not any(index.search(" ".join(rng.choices(words, k=500))) for _ in range(20))


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(0)
    marks = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    own = d._Length(marks, list(range(40)))
    other = np.array([int(m) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 26), replace=False)) for m in marks for _ in range(5)], np.uint64)
    windows, items = own.near(other)
    got = set(zip(windows.tolist(), items.tolist(), strict=True))
    assert got == {(w, k) for w in range(other.size) for k in range(40) if int(np.bitwise_count(other[w] ^ marks[k])) <= d.RADIUS}


def test_short_items(spark):
    items = [(1, "Paris"), (2, "forty two"), (3, "a b c d"), (4, "!!"), (5, None), (6, "forty two")]
    index = d.Index(items)
    assert index.search("He went to PARIS, twice to paris.") == [(1, 3, 1, 1.0)]
    assert index.search("forty-two; a b c") == [(2, 0, 2, 1.0), (6, 0, 2, 1.0)]
    assert index.search("x a b c d y") == [(3, 1, 4, 1.0)]
    assert index.search("forty and two parisian b c d") == [] and index.search("") == [] and index.search(None) == []
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c")], "doc_id bigint, text string")
    bench = spark.createDataFrame([("x-1", "A b C d")], "item_id string, text string")  # ids of any type
    assert [(r.doc_id, r["__leaks"][0].item_id) for r in d.leaks(docs, bench).where("size(__leaks) > 0").collect()] == [(1, "x-1")]
    assert [r.doc_id for r in d.clean(docs, bench).collect()] == [2]


def test_odd_rows(spark, odd):
    from .conftest import PASSAGE

    bench = spark.createDataFrame([(1, PASSAGE, "z"), (2, None, "z"), (3, "", "z"), (4, "too short item", "z"), (1, PASSAGE, "z"), (None, PASSAGE, "z")], "item_id bigint, text string, key string")
    found = d.leaks(odd, bench, name="found")
    assert found.columns == [*odd.columns, "found"] and found.count() == odd.count()
    assert {r.doc_id for r in found.where("size(found) > 0").collect()} == {8, 9}
    clean = d.clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 2
    assert d.clean(odd, bench.limit(0)).count() == odd.count() and d.clean(odd.limit(0), bench).count() == 0


@pytest.mark.parametrize("size", [1, 200])
def test_items_in_several_passes(spark, sf, docs, size, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").limit(9)
    want = sorted((r.doc_id, x.item_id) for r in d.leaks(docs, bench, keep=["doc_id"]).collect() for x in r["__leaks"] or [])
    monkeypatch.setattr(d, "passes", lambda b, i, t, p=d.passes: p(b, i, t, size))
    assert sorted((r.doc_id, x.item_id) for r in d.leaks(docs, bench, keep=["doc_id"]).collect() for x in r["__leaks"] or []) == want


def test_long_document_in_regions(monkeypatch):
    monkeypatch.setattr(d, "SPAN", 50)
    item = " ".join(f"i{k}" for k in range(30))
    text = " ".join([*(f"i{k % 30}" for k in range(400)), "x y z", item])
    assert [(i, round(v, 6)) for i, _, _, v in d.Index([(5, item)]).search(text)] == [(5, 1.0)]
