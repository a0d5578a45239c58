import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stripewise.llm import quality


def plain(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)"""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen = Counter(at)
    covered = {k + j for k, w in enumerate(at) if seen[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def check(df):
    rows = df.select("doc_id", "text").collect()
    got = quality.judged(quality.ledger(df)).collect()
    assert sorted((str(r.doc_id), *(r[m] for m in MEASURES)) for r in got) == sorted((str(r.doc_id), *plain(r.text)) for r in rows)
    for r in got:
        assert bool(r.fail_bits & 3) == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (r.fail_bits & quality.mask(quality.POLICIES[quality.CURRENT]) == 0)


def test_documents(docs):
    check(docs)


def test_odd_rows(odd):
    check(odd)
    assert quality.ledger(odd.limit(0)).count() == 0


@given(st.lists(st.text(alphabet="ab#| \n\t\x0b大", max_size=60), min_size=1, max_size=8))
@settings(max_examples=10, deadline=None)
def test_small_texts(spark, texts):
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))


def test_ablations(docs):
    rows = quality.ledger(docs).cache()
    got = {(r.policy, r.rule): r for r in quality.ablations(rows).collect()}
    for version, names in quality.POLICIES.items():
        for name in names:
            r = got[version, name]
            rest = tuple(n for n in names if n != name)
            fails = lambda m: (F.col("fail_bits").bitwiseAND(F.lit(quality.mask(m)))) != 0
            assert r.n_docs == rows.count() and r.n_rejected == rows.where(fails(names)).count() and r.n_failing == rows.where(fails((name,))).count()
            assert r.n_only == r.n_rejected - (rows.where(fails(rest)).count() if rest else 0)
            assert r.n_only == rows.where(quality.decisive(version) == name).count()


def test_no_python_in_the_plan(spark, sf):
    plan = quality.op8_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_clean_documents_stay(spark):
    big = "/root/testdata/sf0.01"
    got = quality.op8_quality_rules(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id")
    good = got.where("quality = 1 and not base_failed")
    assert good.where("kept").count() >= 0.99 * good.count()
    bad = got.where("quality = 0")
    assert bad.where("not kept").count() >= 0.9 * bad.count()


@pytest.mark.parametrize("version", [1, 2, 3])
def test_versions_need_no_new_measuring(docs, version):
    rows = quality.ledger(docs)
    assert quality.judged(rows, version).where("kept").count() >= quality.judged(rows, 3).where("kept").count()
