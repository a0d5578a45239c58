"""Token ids, counts and packing, against the tokenizers library."""

import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from stripewise.llm import counting, packing
from stripewise.llm.tokens import _vocabulary, default_path, encoder


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library(ids_of, small):
    encode = encoder(default_path())
    for text in [*(t for _, t in small), None, "", "<|endoftext|> x", "a <|endoftext|> b", "  <|endoftext|><|endoftext|>\n\n <|endoftext", "<|endoftext|>", "  two  blanks\n\n\nlines\t", "大熊 ñandú 😀😀 'll don't 123456 ....", "a" * 5000, " " * 3000 + "x"]:
        assert encode(text).tolist() == ids_of(text)


@pytest.mark.parametrize("block", [counting.BLOCK, 64, 7])
def test_counts(odd, ids_of, block):
    got = sorted(((r.doc_id, r.n_tokens) for r in counting.token_counts(odd, block=block).collect()), key=str)
    assert got == sorted(((r.doc_id, len(ids_of(r.text))) for r in odd.collect()), key=str)
    assert counting.token_counts(odd.limit(0)).count() == 0


def test_unclosed_and_empty_files(spark, tmp_path):
    files = {"a.bin": [1, 2, 9, 9, 3, 9, 4, 5], "b.bin": [], "c.bin": [7] * 10, "d.bin": [9]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    df = spark.createDataFrame([(n,) for n in files], "file string")
    for block in (1, 2, 3, 100):
        got = sorted((r.file, r.ordinal, r.first, r.n_tokens, r.closed) for r in counting.counted(df, f"file://{tmp_path}", end=9, block=block).collect())
        assert got == [("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 0, True), ("a.bin", 2, 4, 1, True), ("a.bin", 3, 6, 2, False), ("c.bin", 0, 0, 10, False), ("d.bin", 0, 0, 0, True)]


def check_pieces(rows, texts, ids_of, shards):
    """rows: pieces; texts: (id, text) with different ids."""
    whole = {i: np.array([*ids_of(t), 0], "<u4") for i, t in texts}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(whole)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == whole[i].size and r.ids_crc32 == zlib.crc32(whole[i][at : at + r.length].tobytes())
            at += r.length
        assert at == whole[i].size
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 1024 - at
    assert padding < 1024 * shards


@pytest.mark.parametrize("tokens", [packing.SHARD_TOKENS, 20_000])
def test_packing(docs, small, ids_of, tokens):
    rows = packing.sequences(docs, shard_tokens=tokens).collect()
    total = sum(len(ids_of(t)) + 1 for _, t in small)
    check_pieces(rows, small, ids_of, 2 * -(-total // tokens))


def test_packing_of_odd_rows(odd, ids_of):
    rows = packing.sequences(odd).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(r.text)) + 1 for r in odd.collect())
    single = odd.where("doc_id not in (2)")
    check_pieces(packing.sequences(single).collect(), [(r.doc_id, r.text) for r in single.collect()], ids_of, 1)
    assert packing.sequences(odd.limit(0)).count() == 0


def test_statistics(docs, small, ids_of):
    df, n_docs, n_tokens = packing.statistics(packing.tokenised(docs))
    sets = [set(ids_of(t)) for _, t in small]
    assert n_docs == len(small) and n_tokens == sum(len(ids_of(t)) for _, t in small)
    for t in (0, 11, 198, 257, 1000):
        assert df[t] == sum(t in s for s in sets)


@pytest.mark.parametrize("tokens", [packing.SHARD_TOKENS, 50_000, 10_000])
def test_near_copies_share_sequences(spark, tokens):
    """Near copies share a sequence, whatever the size of shards: dealt at random, 0.14 and 0.03 of the pairs would be in a shard here."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice([*"abcdefghijklmnopqrstuvwxyz"], 5)) for _ in range(4000)]
    rows = []
    for k in range(600):
        text = rng.choice(words, 100).tolist()
        rows.append((2 * k, " ".join(text)))
        text[int(rng.integers(100))] = "changed"
        rows.append((2 * k + 1, " ".join(text)))
    rng.shuffle(rows)
    got = packing.sequences(spark.createDataFrame([(int(i), str(t)) for i, t in rows], "doc_id bigint, text string"), shard_tokens=tokens).collect()
    where = {}
    for r in got:
        where.setdefault(r.doc_id, set()).add(r.sequence_id)
    # random words are the worst case, as no pivot is much like any text
    assert np.mean([bool(where[2 * k] & where[2 * k + 1]) for k in range(600)]) > (0.85 if tokens == packing.SHARD_TOKENS else 0.65)


def test_signatures_that_fill_ranges_are_spread():
    rng = np.random.default_rng(0)
    marks = np.where(rng.random(30_000) < 0.4, 77, rng.integers(0, 1000, 30_000))
    bounds = packing.ranges(marks, np.ones(marks.size, np.int64), 20)
    for each in (1, 3):
        shard = packing.shard_of(marks, np.arange(marks.size), bounds, each)
        n = np.bincount(shard, minlength=20 * each)
        assert n.sum() == marks.size and shard.max() < 20 * each and n.max() < 2.5 * marks.size / 20 / each


def test_seeds_are_filled_with_their_neighbours():
    rng = np.random.default_rng(1)
    topics = [rng.integers(100 + 50 * t, 150 + 50 * t, (20, 300)).astype(np.uint16) for t in range(5)]
    docs = [d for pair in zip(*topics, strict=True) for d in pair]  # topics take turns
    idf = np.ones(packing.VOCABULARY, np.float32)
    pieces = packing.packed(docs, idf, 300.0)
    by_sequence = {}
    for k, _, _, sequence, _ in pieces:
        by_sequence.setdefault(sequence, set()).add(k % 5)
    assert sum(len(x) for x in by_sequence.values()) < 1.6 * len(by_sequence)


def test_scores_are_bm25():
    docs = [np.array(x, np.uint16) for x in ([1, 1, 2, 3], [1, 2], [4, 4, 4], [1, 3, 5, 5, 6])]
    idf = np.array([0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0] + [0] * (packing.VOCABULARY - 7), np.float32)
    mean = sum(d.size for d in docs) / 4
    score = lambda q, d: sum(idf[t] * (n := (d == t).sum()) * 2.2 / (n + 1.2 * (0.25 + 0.75 * d.size / mean)) for t in set(q.tolist()) if (d == t).any())
    index = packing.Index(docs, idf, mean)
    index.unused[0] = False
    want = sorted((k for k in range(1, 4) if score(docs[0], docs[k]) > 0), key=lambda k: -score(docs[0], docs[k]))
    assert index.neighbours(0) == want


def test_all_terms_of_a_seed_count():
    """The last document shares the seed's light terms only, but so many of them that it is the best."""
    heavy, light = np.arange(1, 41, dtype=np.uint16), np.arange(41, 141, dtype=np.uint16)
    docs = [np.r_[heavy, light], np.r_[heavy[:2], np.arange(200, 298, dtype=np.uint16)], light]
    idf = np.ones(packing.VOCABULARY, np.float32)
    idf[heavy] = 3
    index = packing.Index(docs, idf, 100.0)
    index.unused[0] = False
    assert index.neighbours(0) == [2, 1]


def test_scores_by_matrix_are_those_by_postings(monkeypatch):
    rng = np.random.default_rng(4)
    docs = [(rng.zipf(1.3, rng.integers(0, 400)) % 3000).astype(np.uint16) for _ in range(700)]
    idf = rng.random(packing.VOCABULARY).astype(np.float32)
    both = packing.Index(docs, idf, 200.0)
    monkeypatch.setattr(packing, "TOGETHER", 0)
    plain = packing.Index(docs, idf, 200.0)
    assert both.scores is not None and plain.scores is None
    for k in range(700):
        np.testing.assert_allclose(both._of(k), plain._of(k), rtol=1e-4, atol=1e-4)


@pytest.fixture(scope="module")
def bpe():
    return _vocabulary(default_path())


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n\t", "\u3000"])
def test_very_long_white_space(bpe, blank):
    """The pattern makes of a run of white space before a letter two pieces, its last blank being part of the second or a piece of its own."""
    encode = encoder(default_path())
    run = blank * 1_500_000
    first = bpe._encode_single_piece(run[:-1])
    after = bpe.encode(" word next") if run[-1] == " " else bpe._encode_single_piece(run[-1]) + bpe.encode("word next")
    assert encode("some text" + run + "word next").tolist() == bpe.encode("some text") + first + after
    assert encode("some text" + run).tolist() == bpe.encode("some text") + bpe._encode_single_piece(run)
    assert encode("some text" + run + "<|endoftext|>" + "a").tolist() == bpe.encode("some text") + bpe._encode_single_piece(run) + [50256] + bpe.encode("a")


def test_white_space_runs_have_the_same_ids(monkeypatch, ids_of, bpe):
    import random
    import re

    from stripewise.llm import tokens

    monkeypatch.setattr(tokens, "_RUN", re.compile(tokens._RUN.pattern.replace("1000", "2")))
    rng = random.Random(0)
    for _ in range(3000):
        text = "".join(rng.choice([*" \n\tab1.é\u3000\x85\x1c", "<|endoftext|>"]) for _ in range(rng.randint(1, 30)))
        assert tokens._by_runs(bpe, text).tolist() == ids_of(text)


@pytest.fixture(scope="module")
def hard(spark):
    """Texts that the vocabulary's pattern cannot take in one piece, and strings of special tokens."""
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, " " * 3_000_000), (4, "x" + "\n" * 3_000_000 + "y"), (5, "\t" * 3_000_000 + "z"), (6, " \n\t" * 1_000_000 + "<|endoftext|> end"), (7, "short")]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_hard_texts_are_counted(hard):
    encode = encoder(default_path())
    want = {r.doc_id: encode(r.text).size for r in hard.collect()}
    assert want[1] == 4 and want[2] == 1
    assert {r.doc_id: r.n_tokens for r in counting.token_counts(hard).collect()} == want


def test_hard_texts_are_packed(hard):
    encode = encoder(default_path())
    want = {r.doc_id: encode(r.text).size + 1 for r in hard.collect()}
    got = packing.sequences(hard).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == want and sum(r.length for r in got) == sum(want.values())
