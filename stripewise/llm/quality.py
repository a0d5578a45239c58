"""Quality rules as a ledger of bitmasks: measure once, store, judge by any version of a policy, ablate by bits.

Everything here is DataFrame functions. Arrays that are needed more than once are bound as lambda variables
(``_let``), so that no rewriting of projections computes them again for each element.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table

# Fixed values of the contract: white space between words, and the symbols counted.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = "[^\\x20\\x09-\\x0D]"
WINDOW = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _count_of(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("bigint")


def _covered(at: Column) -> Column:
    """Words that windows starting at the sorted positions ``at`` cover."""
    own = F.transform(at, lambda p, i: F.coalesce(F.least(F.lit(WINDOW), F.get(at, i + 1) - p), F.lit(WINDOW)))
    return F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def positions(s: Column) -> Column:
        kept = F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]))
        return F.sort_array(F.filter(kept, lambda p: p.isNotNull()))

    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    spread = _let(_let(by_hash, positions), _covered)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(spread)


def _repeat_words(words: Column) -> Column:
    """Words in 8-word windows found twice or more. A window's hash is built from those of its halves."""

    def paired(x: Column, step: int) -> Column:
        n = F.size(x) - step
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))

    ones = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(ones, lambda a: _let(paired(a, 1), lambda b: _let(paired(b, 2), lambda c: _let(paired(c, 4), _repeated))))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("bigint")).otherwise(windows)


def _dup_lines(lines: Column) -> Column:
    return _let(F.filter(lines, lambda x: x.rlike(WORD)), lambda k: F.struct(F.size(k).cast("bigint").alias("n_lines"), (F.size(k) - F.size(F.array_distinct(k))).cast("bigint").alias("n_dup_lines")))


def measured(docs: DataFrame, text: Column, **keep: Column) -> DataFrame:
    """The columns of ``keep`` (name=expression) and the measurements of each text; null counts as empty."""
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], F.coalesce(text, F.lit("")).alias("__text"))
    t = F.col("__text")
    words = F.filter(F.split(t, f"{WORD.replace('^', '')}+"), lambda w: w != "")
    by_words = _let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    rows = rows.select("*", by_words.alias("__w"), _dup_lines(F.split(t, "\n")).alias("__l"))
    return rows.select(
        *keep,
        F.col("__w.n_words"),
        F.char_length(F.translate(t, SPACE, "")).cast("bigint").alias("word_chars"),
        _count_of(t, SYMBOLS).alias("n_symbols"),
        F.col("__l.n_lines"),
        F.col("__l.n_dup_lines"),
        F.col("__w.n_repeat_words"),
        _count_of(t, CAPITALS).alias("n_capitals"),
    )


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition (SQL over the measurements) holds."""

    name: str
    fails: str


#: The position of a rule is its bit and never changes; new rules are appended.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    Rule("capitals", "2 * n_capitals > word_chars"),
)
BASE = ("few_words", "repeated_words")
#: Versions of the policy: the rules that a document must not fail.
POLICIES = {1: BASE, 2: (*BASE, "symbols", "capitals"), 3: (*BASE, "symbols", "duplicate_lines", "capitals")}
CURRENT = 3


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    at = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << at[n] for n in names)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of docs: doc_id, the measurements and ``fail_bits``, a bit for each rule that fails.

    Null and empty texts have no words and fail few_words. Null ids and repeated rows are kept as they are; other
    columns of docs are not looked at, whatever their names. An empty table gives an empty ledger."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint") for k, r in enumerate(rules)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured(docs, F.col(text_col), doc_id=F.col(id_col)).select("*", total.alias("fail_bits"))


def judged(rows: DataFrame, version: int = CURRENT, policies: dict = POLICIES) -> DataFrame:
    """A ledger with the verdict of one version of the policy; nothing is measured again."""
    return rows.select("*", F.lit(version).alias("policy"), (F.col("fail_bits").bitwiseAND(F.lit(mask(policies[version]))) == 0).alias("kept"))


def decisive(version: int = CURRENT, policies: dict = POLICIES, rules: tuple[Rule, ...] = RULES) -> Column:
    """The rule without which a version of the policy would keep a row that it rejects; null where there is none or no single one."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask(policies[version], rules)))
    out = F.lit(None).cast("string")
    for k, r in enumerate(rules):
        out = F.when(failed == (1 << k), F.lit(r.name)).otherwise(out)
    return out


def ablations(rows: DataFrame, policies: dict = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each version and each of its rules: documents, those the version rejects, those that fail the rule, and those that it would
    keep without the rule. One aggregation over the ledger by its bits; the groups are at most 2 ** len(rules)."""
    counts = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    out = []
    for version, names in sorted(policies.items()):
        whole = mask(names)
        for name in names:
            bit, rest = mask((name,)), whole & ~mask((name,))
            fails = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m)) != 0
            out.append(F.struct(F.lit(version).alias("policy"), F.lit(name).alias("rule"), F.sum("n").alias("n_docs"), F.sum(F.when(fails(whole), F.col("n")).otherwise(0)).alias("n_rejected"), F.sum(F.when(fails(bit), F.col("n")).otherwise(0)).alias("n_failing"), F.sum(F.when(fails(bit) & ~fails(rest), F.col("n")).otherwise(0)).alias("n_only")))
    return counts.agg(F.array(*out).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(stored(ledger(table(spark, sf_dir, "documents")), "ledger"))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits", "policy", decisive().alias("decisive_rule"))


# DuckDB. The rules are the same integer comparisons; the windows are compared as lists of words.
OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), starts AS (
  SELECT rid, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM d
), windows AS (
  SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM starts
), twice AS (
  SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS gap
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT rid, sum(least(8, coalesce(gap, 8))) AS n FROM twice GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(translate(t, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals
  FROM d LEFT JOIN repeats r USING (rid)
), b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_capitals > word_chars THEN 16 ELSE 0 END)::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
       fail_bits & 31 = 0 AS kept, fail_bits, 3::INTEGER AS policy,
       CASE fail_bits & 31 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines' WHEN 16 THEN 'capitals' END AS decisive_rule FROM b
"""
