import itertools
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from stripewise.llm import neardup, simhash
from stripewise.llm.components import components
from stripewise.llm.shared import discard, stored


def plain_fingerprint(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aAbB ÉÄß\n\t\x1f\x85.", max_size=80))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode(), 4) == plain_fingerprint(text, 4)


def classes_of(rows, sets, radius=4):
    """rows of (id, fingerprint): the smallest id of each row's class."""
    for (a, x), (b, y) in itertools.combinations(enumerate(f for _, f in rows), 2):
        if bin(x ^ y).count("1") <= radius:
            sets.join(a, b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[sets.find(k)] = min(low.get(sets.find(k), i), i)
    return [low.get(sets.find(k)) for k in range(len(rows))]


@pytest.mark.parametrize("block", [20_000, 40])
def test_against_plain_version(docs, small, sets, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs, shingle=4, radius=4).collect()}
    rows = [(i, plain_fingerprint(t, 4)) for i, t in small]
    assert {i: (f, c) for (i, f), c in zip(rows, classes_of(rows, sets), strict=True)} == got


def test_odd_rows(spark, odd, sets):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd, shingle=4).collect())
    rows = [(r.doc_id, plain_fingerprint(r.text, 4)) for r in odd.collect()]
    assert got == sorted((i is None, i or 0, f"{f:016x}", c) for (i, f), c in zip(rows, classes_of(rows, sets), strict=True))
    assert simhash.near_duplicates(odd.limit(0)).collect() == []


def test_segments_guarantee_the_radius():
    rng = np.random.default_rng(1)
    for _ in range(300):
        bits = rng.choice(64, 4, replace=False)
        assert any(sum(low <= b < high for b in bits) <= 1 for low, high in simhash.segments(4))


def test_dense_group_gives_no_pairs(spark):
    """3000 fingerprints within 4 bits of each other: links grow with the group, not with its square."""
    rng = np.random.default_rng(2)
    marks = {0} | {sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 3), replace=False)) for _ in range(6000)}
    df = spark.createDataFrame([(m,) for m in marks], "fp bigint")
    links = simhash.links(df, 4)
    assert links.count() < 80 * len(marks)
    assert components(links).select("root").distinct().count() == 1


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=40))
@settings(max_examples=5, deadline=None)
def test_components(spark, links):
    from .conftest import Sets

    s = Sets()
    for a, b in links:
        s.join(a, b)
    low = {}
    for x in {y for p in links if p[0] != p[1] for y in p}:
        low[s.find(x)] = min(low.get(s.find(x), x), x)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: low[s.find(x)] for x in {y for p in links if p[0] != p[1] for y in p}}


def test_long_chain(spark):
    n = 300
    order = np.random.default_rng(3).permutation(n).tolist()
    got = components(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a bigint, b bigint").repartition(7))
    assert got.count() == n and got.select("root").distinct().collect()[0][0] == 0


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or ({b" ".join(words)} if words else set())


def similar(a, b):
    n = len(a & b)
    return n and n >= 0.8 * (len(a) + len(b) - n)


@pytest.mark.parametrize(("block", "members"), [(20_000, 1_000), (30, 2)])
def test_near_copies_at_a_similarity(spark, docs, small, sets, monkeypatch, block, members):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "MEMBERS", members)
    base = [(i, t) for i, t in small]
    words = [t.split() for _, t in base]
    edited = [(10_000 + i, " ".join([*w[: len(w) // 2], "edited", *w[len(w) // 2 + 1 :]])) for (i, _), w in zip(base, words, strict=True) if len(w) > 60][:40]
    df = spark.createDataFrame(base + edited, "doc_id bigint, text string")
    everything = base + edited
    own = [shingle_set(t) for _, t in everything]
    for a, b in itertools.combinations(range(len(own)), 2):
        if everything[a][1] == everything[b][1] or similar(own[a], own[b]):
            sets.join(a, b)
    low = {}
    for k, (i, _) in enumerate(everything):
        low[sets.find(k)] = min(low.get(sets.find(k), i), i)
    assert {r.doc_id for r in neardup.one_of_each(df).collect()} == set(low.values())


def test_near_copies_at_the_threshold(spark):
    """Pairs of all lengths whose similarity is hardly 0.8 are all found, and those hardly below are not."""
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(400):
        n = int(rng.integers(5, 15) if k % 2 else rng.integers(15, 400))
        first = [f"{k}w{j}" for j in range(n)]
        second = list(first)
        while similar(shingle_set(" ".join(first)), shingle_set(" ".join(second))):  # from the front, up to where it ends
            last, second = second, [f"{k}x{len(second)}", *second]
        rows += [(4 * k, " ".join(first)), (4 * k + 1, " ".join(last)), (4 * k + 2, " ".join(f"y{w}" for w in first)), (4 * k + 3, " ".join(f"y{w}" for w in second))]
        want[k] = {4 * k, 4 * k + 2, 4 * k + 3}
    kept = {r.doc_id for r in neardup.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == set().union(*want.values())


def test_rarest_shingles_meet():
    """Of two similar sets the rarest shingles have one in common, whatever the counts."""
    rng = np.random.default_rng(1)
    for _ in range(500):
        n = int(rng.integers(1, 60))
        levels = rng.integers(0, 4, neardup.SLOTS).astype(np.uint8)
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
        common, rest = pool[: max(1, int(0.9 * n))], pool[n:]
        a, b = (np.unique(np.r_[common, rest[rng.random(n) < 0.1]]) for _ in range(2))
        both = np.intersect1d(a, b).size
        if both >= 0.8 * (a.size + b.size - both):
            assert np.intersect1d(neardup.rarest(a, levels, 0.8), neardup.rarest(b, levels, 0.8)).size


def test_near_copies_of_odd_rows(odd):
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns
    got = sorted((r.doc_id, r.key) for r in kept.collect())
    assert got == [(i, "key-value") for i in (1, 3, 5, 6, 8, 10, 11, 12)]
    assert neardup.one_of_each(odd.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    df = spark.createDataFrame([("b", "one two three four five"), ("a", "one two three four five"), ("c", "else")], "doc_id string, text string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_texts_that_are_not_alike_stay_apart(spark):
    """Texts of common words, with shingles of others among them, make no groups of candidates."""
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(3000)]
    texts = [t + " " + " ".join(texts[int(rng.integers(3000))].split()[:12]) for t in texts]  # a tenth of the shingles from another
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    t = F.col("text")
    levels = neardup.rarity(df.select("text"), 5)
    keyed = df.select(F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(1), t).alias("k2"), "text")
    marks = keyed.mapInArrow(neardup._marking(5, levels, 0.8), "k1 bigint, k2 bigint, w0 bigint, w1 bigint, rare array<bigint>")
    assert neardup.candidates(marks).count() < 60
    assert neardup.one_of_each(df).count() == 3000


def test_counts_of_shingles(docs, small):
    """The logarithms come from a count of the shingles of every text."""
    counts = np.zeros(neardup.SLOTS, np.int64)
    for _, text in small:
        for h in neardup._hashes((text or "").encode(), 5):
            counts[int(h) >> (64 - neardup.SLOTS.bit_length() + 1)] += 1
    levels = neardup.rarity(docs.select("text").repartition(5), 5)
    assert (levels == np.ceil(np.log2(counts + 1))).all() and levels.max() > 1


def test_halves_make_the_buckets_of_all_variants(monkeypatch):
    """Fingerprints sent by halves of segments are linked as by all their one-wildcard variants, also where groups and buckets are too large for a task."""
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 1 << 64, (300, 2), dtype=np.uint64)
    for k in range(300):  # near fingerprints of the first
        bits = rng.choice(neardup.BITS, int(rng.integers(0, 25)), replace=False)
        near = marks[k % 100].copy()
        for bit in bits.tolist():
            near[bit // 64] ^= np.uint64(1 << (bit % 64))
        marks = np.r_[marks, [near]]
    w0, w1 = marks[:, 0].copy(), marks[:, 1].copy()
    values = [int(a) | int(b) << 64 for a, b in marks]
    want = set()
    for i, j in itertools.combinations(range(len(values)), 2):
        x = values[i] ^ values[j]
        if x.bit_count() <= neardup.NEAR and any(((x >> low) & ((1 << (high - low)) - 1)).bit_count() <= 1 for low, high in neardup.cuts()):
            want.add((values[i], values[j]))
    assert len(want) > 100
    keys = [((values[k] >> low) & ((1 << (high - low)) - 1)) + (h << 32) for h, (low, high, _) in enumerate(neardup.halves()) for k in range(len(values))]
    order = np.argsort(keys, kind="stable")
    batch = pa.RecordBatch.from_arrays([pa.array(np.array(keys)[order]), *(pa.array(np.tile(w, len(keys) // w.size)[order].view(np.int64)) for w in (w0, w1))], names=["key", "w0", "w1"])
    for group, block in ((neardup.GROUP, neardup.BLOCK), (neardup.GROUP, 1), (1, neardup.BLOCK)):
        monkeypatch.setattr(neardup, "GROUP", group)
        monkeypatch.setattr(neardup, "BLOCK", block)
        found, large = set(), {}
        for out in neardup._candidates(iter([batch.slice(low, 700) for low in range(0, batch.num_rows, 700)])):
            rows = out.to_pydict()
            for a0, a1, b0, b1, key in zip(*(rows[c] for c in ("a0", "a1", "b0", "b1", "key")), strict=True):
                a, b = ((x & (1 << 64) - 1) | (y & (1 << 64) - 1) << 64 for x, y in ((a0, a1), (b0, b1)))
                if key is None:
                    found.add(frozenset((a, b)))
                else:
                    large.setdefault(key, set()).add(a)
        assert bool(large) == (min(group, block) == 1)
        for members in large.values():
            found |= {frozenset(x) for x in itertools.combinations(members, 2) if (x[0] ^ x[1]).bit_count() <= neardup.NEAR}
        assert {x for x in found if len(x) == 2} == {frozenset(x) for x in want if x[0] != x[1]}


def test_candidates_move_few_bytes(spark):
    """Of a fingerprint a few rows are moved, not one for each variant."""
    moved = lambda: sum(x.totalShuffleWrite() for x in [spark._jsc.sc().statusStore().executorList(True).apply(0)])
    marks = spark.range(20_000).select(F.xxhash64("id", F.lit(1)).alias("w0"), F.xxhash64("id", F.lit(2)).alias("w1"), F.array(F.xxhash64("id")).alias("rare"))
    before = moved()
    assert neardup.candidates(marks).count() == 0
    assert moved() - before < 20_000 * 600


def test_shuffle_files_go_when_a_table_is_stored(spark):
    """Else those of all steps of an operator add up on disk until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = blocks.getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    there = shuffles()
    table = stored(spark.range(10_000).repartition(5, "id"), "t")
    for _ in range(50):
        if not shuffles() - there:
            break
        time.sleep(0.2)
    assert not shuffles() - there and table.count() == 10_000
    assert spark.conf.get(key, None) == before
    discard(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(table.stored_path)


def test_keys_are_moved_in_passes(spark, monkeypatch):
    """No pass over the marks has all their keys on disk: the shuffle files of each go before the next."""
    moved = lambda: sum(x.totalShuffleWrite() for x in [spark._jsc.sc().statusStore().executorList(True).apply(0)])
    passes = []

    def put(df, name):
        before = moved()
        out = stored(df, name)
        passes.extend([moved() - before] if name == "candidates" else [])
        return out

    monkeypatch.setattr(neardup, "stored", put)
    rare = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.xxhash64("id", k))
    marks = spark.range(5_000).select(F.xxhash64("id", F.lit(1)).alias("w0"), F.xxhash64("id", F.lit(2)).alias("w1"), rare.alias("rare"))
    assert neardup.candidates(marks).count() == 0
    assert max(passes) < 0.3 * sum(passes)


def test_equal_texts_are_joined_before_they_are_moved(spark, monkeypatch):
    """The marks of a text with very many copies do not all go to one task, and take as many files as there are partitions."""
    plans = {}

    def put(df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        out = stored(df, name)
        plans.setdefault(f"{name} files", len(out.inputFiles()))
        return out

    monkeypatch.setattr(neardup, "stored", put)
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), F.col("id") % 500) for k in range(8)]).alias("text"))
    assert neardup.one_of_each(df).count() == 500
    marks = plans["marks"]
    assert marks.index("partial_first") > marks.index("Exchange hashpartitioning(k1")
    assert plans["marks files"] == int(spark.conf.get("spark.sql.shuffle.partitions"))
