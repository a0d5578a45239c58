"""Toxicity by a chain of classifiers.

Categories are predicted one after the other. Each has a linear (logistic) model over the words of a text that
tell it apart best, some measurements, and the probabilities of all categories before it. For learning, those
come from models that did not see the document (out-of-fold); for predicting, from the final models.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import column, released, sliced, table, unpacked, whole

#: Labelled documents to learn from, on average: those whose hashed id is below a bound.
SAMPLE = 20_000
FOLDS = 5
#: Hash buckets of words; words of a category's model, and how far (in standard errors) a word's mean shares must be apart.
BUCKETS = 1 << 20
WORDS = 128
LEAST_DOCS = 3
APART = 5.0
PENALTY = 0.03
#: Beginnings of words that count as features, and the share of a text's words at which a feature is full.
HEADS = (4, 5)
RATE = 0.02
THRESHOLD = 0.5
#: The chain over the columns of labels: name, and SQL that is 1 where the category holds.
CHAIN = (("low_quality", "1 - quality"), ("toxic", "toxic"), ("severe_toxic", "toxic * (1 - quality)"))

_WORD = re.compile(r"\w+")
_SYMBOL = re.compile(r"[#*$%&|<>!]")
_MEASURES = 3


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets of the different words of a text in lower case and of their first letters, their shares of all words
    (held at 1 from RATE on), and measurements. Nothing and zeros for a null or empty text."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.int64), np.empty(0), [0.0] * _MEASURES
    whole, heads = Counter(words), {}
    for w, c in whole.items():
        for k in HEADS:
            if len(w) > k:
                head = "^" + w[:k]
                heads[head] = heads.get(head, 0) + c
    n = len(whole) + len(heads)
    ids = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for x in (whole, heads) for w in x), np.int64, n) & (BUCKETS - 1)
    counts = np.fromiter((c for x in (whole, heads) for c in x.values()), np.float64, n)
    return ids, np.minimum(1.0, counts / (RATE * len(words))), [np.log1p(len(words)), len(whole) / len(words), min(10.0, len(_SYMBOL.findall(text)) / len(words))]


@dataclass
class Linear:
    """A logistic model over chosen word buckets and dense columns."""

    words: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def probability(self, lists: list[tuple], dense: np.ndarray) -> np.ndarray:
        logits = _matrix(lists, self.words) @ self.weights + dense @ self.dense + self.bias
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


#: Documents whose features are put together at a time.
TOGETHER = 4_000


def _matrix(lists: list[tuple], words: np.ndarray) -> np.ndarray:
    """Values of some word buckets, sorted, in each document (ids, values); the larger where words share a bucket."""
    out = np.zeros((len(lists), words.size), np.float64)
    for low in range(0, len(lists) if words.size else 0, TOGETHER):
        part = lists[low : low + TOGETHER]
        ids = np.concatenate([x[0] for x in part])
        at = np.minimum(np.searchsorted(words, ids), words.size - 1)
        there = np.flatnonzero(words[at] == ids)
        rows = np.searchsorted(np.cumsum([x[0].size for x in part]), there, side="right")
        np.maximum.at(out, (low + rows, at[there]), np.concatenate([x[1] for x in part])[there])
    return out


def _chosen(lists: list[tuple], y: np.ndarray) -> np.ndarray:
    """The word buckets whose mean values differ most between the classes, in standard errors."""
    n1, n0 = y.sum(), (1 - y).sum()

    def sums(c):
        out = np.zeros((3, BUCKETS))
        own = [x for x, v in zip(lists, y, strict=True) if v == c]
        for low in range(0, len(own), TOGETHER):
            ids, values = (np.concatenate([x[k] for x in own[low : low + TOGETHER]]) for k in (0, 1))
            for k in range(3):
                out[k] += np.bincount(ids, values.astype(np.float64) ** k, BUCKETS)
        return out

    (d1, s1, q1), (d0, s0, q0) = sums(1), sums(0)
    spread = (q1 + q0) / (n1 + n0) - ((s1 + s0) / (n1 + n0)) ** 2
    z = np.abs(s1 / n1 - s0 / n0) / np.sqrt(np.maximum(spread * (1 / n1 + 1 / n0), 1e-12))
    z[(d1 + d0 < LEAST_DOCS) | (z < APART)] = 0
    top = np.argsort(-z, kind="stable")[:WORDS]
    return np.sort(top[z[top] > 0])


def fitted(lists: list[tuple], dense: np.ndarray, y: np.ndarray) -> Linear:
    """Penalised logistic regression by Newton's method. With fewer than 5 documents of a class, the class's share alone."""
    n1 = int(y.sum())
    if not len(y):  # nothing is known, so nothing is found
        return Linear(np.empty(0, np.int64), np.empty(0), np.zeros(dense.shape[1]), -30.0)
    if min(n1, len(y) - n1) < 5:
        return Linear(np.empty(0, np.int64), np.empty(0), np.zeros(dense.shape[1]), float(np.log((n1 + 0.5) / (len(y) - n1 + 0.5))))
    words = _chosen(lists, y)
    mean, scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
    x = np.hstack([_matrix(lists, words), (dense - mean) / scale, np.ones((len(y), 1))])
    penalty = np.full(x.shape[1], PENALTY)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    k = words.size
    own = w[k : k + dense.shape[1]] / scale
    return Linear(words, w[:k], own, float(w[-1] - own @ mean))


def chained(lists: list[tuple], measures: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """A model for each column of labels, of the rows whose own label is known (not -1); each sees the out-of-fold probabilities of those before."""
    dense, models = measures, []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(np.float64)
        known = y >= 0
        out = np.zeros(len(y))
        for f in np.unique(folds):
            inside, outside = np.flatnonzero((folds != f) & known), np.flatnonzero(folds == f)
            if inside.size:
                part = fitted([lists[k] for k in inside], dense[inside], y[inside])
                out[outside] = part.probability([lists[k] for k in outside], dense[outside])
        own = np.flatnonzero(known)
        models.append(fitted(lists if known.all() else [lists[k] for k in own], dense[own], y[own]))
        dense = np.hstack([dense, out[:, None]])
    return models


def probabilities(models: list[Linear], lists: list[tuple], measures: np.ndarray) -> np.ndarray:
    dense, out = measures, []
    for m in models:
        out.append(m.probability(lists, dense))
        dense = np.hstack([dense, out[-1][:, None]])
    return np.stack(out, axis=1) if out else np.zeros((len(lists), 0))


def _extract(batches):
    for batch in sliced(batches):
        got = [features(x) for x in batch.column("text").to_pylist()]  # of the sample only
        arrays = [batch.column("h"), batch.column("y"), pa.array([x[0].astype(np.int32) for x in got], pa.list_(pa.int32())), pa.array([x[1].astype(np.float32) for x in got], pa.list_(pa.float32())), pa.array([x[2] for x in got], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["h", "y", "ids", "shares", "measures"])


def _rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    flat = column.combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    ends = np.asarray(flat.offsets)
    values = np.asarray(flat.values)
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _train(batches):
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    whole = pa.Table.from_batches(rows).sort_by([("h", "ascending")])
    lists = list(zip(_rows(whole["ids"]), _rows(whole["shares"]), strict=True))
    labels = np.array(whole["y"].to_pylist(), np.int64)
    folds = np.asarray(whole["h"]) % FOLDS
    for m in chained(lists, np.array(whole["measures"].to_pylist()), labels, folds):
        yield pa.RecordBatch.from_arrays([pa.array([m.words.tolist()], pa.list_(pa.int64())), pa.array([m.weights.tolist()], pa.list_(pa.float64())), pa.array([m.dense.tolist()], pa.list_(pa.float64())), pa.array([m.bias])], names=["words", "weights", "dense", "bias"])


def learnt(docs: DataFrame, labels: DataFrame, chain=CHAIN, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[Linear]:
    """The models of the chain, fitted in one task on about ``sample`` labelled documents at most, those whose hashed id and text are below bounds.

    Of several labels of an id each column's largest counts; where that is null, its category doesn't learn
    from the document; rows with a null id or without any label are left out. An id that has several texts is learnt with
    each of them, rows equal in id and text once. Null and empty texts have no words. No labels: no models. Texts of any length count whole."""
    columns = [F.max(F.expr(e)).cast("int").alias(f"y{k}") for k, (_, e) in enumerate(chain)]
    known = labels.where(column(id_col).isNotNull()).groupBy(column(id_col).cast("string").alias("id")).agg(*columns).dropna("all", subset=[f"y{k}" for k in range(len(chain))])
    low = lambda n: int(min(1.0, sample / max(1, n)) * (1 << 30))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) <= low(known.count())).select("id", F.array(*[F.coalesce(f"y{k}", F.lit(-1)) for k in range(len(chain))]).alias("y"))
    texts = docs.select(column(id_col).cast("string").alias("id"), column(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("y", "text", "id", F.pmod(F.xxhash64(F.lit(1), "id", "text"), F.lit(1 << 30)).alias("h"))  # chosen is bounded by sample
    few = rows.where(F.col("h") <= low(rows.select("id", "h").distinct().count())).groupBy("id", "h").agg(F.first("y").alias("y"), F.first("text").alias("text"))
    got = few.select("h", "y", "text").mapInArrow(released(_extract), "h bigint, y array<int>, ids array<int>, shares array<float>, measures array<double>").repartition(1).mapInArrow(released(_train), "words array<bigint>, weights array<double>, dense array<double>, bias double").collect()
    return [Linear(np.asarray(r["words"], np.int64), np.asarray(r["weights"], np.float64), np.asarray(r["dense"], np.float64), r["bias"]) for r in got]


def _probabilities(models: list[Linear], names: list[str]):
    """A function of a text column; the other columns stay where they are."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for low in range(0, len(batch), 1024):
                got = [features(x) for x in batch.slice(low, 1024).to_pylist()]
                out.append(probabilities(models, [x[:2] for x in got], np.array([x[2] for x in got]).reshape(-1, _MEASURES)))
            scores = np.concatenate(out) if out else np.zeros((0, len(models)))
            yield pa.StructArray.from_arrays([pa.array(scores[:, k] if models else np.zeros(len(batch))) for k in range(len(names))], names=names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, T.StructType([T.StructField(n, T.DoubleType()) for n in names])).asNondeterministic()  # runs once for each row


def _with_scores(docs: DataFrame, models: list[Linear], names: list[str], text_col: str, keep: list[str]) -> DataFrame:
    """row (the columns ``keep``) and the probabilities."""
    taken = docs.select(whole(docs, keep).alias("row"), _probabilities(models, names)(column(text_col).cast("string")).alias("p"))
    return taken.select("row", *[F.col("p").getField(n).alias(n) for n in names])


def scored(docs: DataFrame, models: list[Linear], chain=CHAIN, text_col: str = "text", keep: list[str] | None = None, prefix: str = "p_") -> DataFrame:
    """Columns ``keep`` of docs (all where None) with a probability p_<category> for each category of the chain.

    Null and empty texts have no words; their probabilities follow from the models' constants. Texts of any length count whole. Without models all are 0.
    Rows, repeated ones and those with null ids too, come out as they come in, whatever the names of their columns."""
    names = [f"{prefix}{n}" for n, _ in chain]
    kept = docs.columns if keep is None else keep
    return _with_scores(docs, models, names, text_col, kept).select(*unpacked(kept), *names)


def rejected(prefix: str = "p_"):
    """Whether a scored row is toxic, in general or severely."""
    return F.greatest(f"{prefix}toxic", f"{prefix}severe_toxic") >= THRESHOLD


def clean(docs: DataFrame, models: list[Linear], chain=CHAIN, text_col: str = "text") -> DataFrame:
    """The rows of docs that the chain doesn't reject, with all their columns. See ``scored``."""
    return _with_scores(docs, models, [f"p_{n}" for n, _ in chain], text_col, docs.columns).where(~rejected()).select(*unpacked(docs.columns))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = learnt(docs, table(spark, sf_dir, "labels"))
    rows = scored(docs, models, keep=["doc_id"])
    return rows.select("*", rejected().alias("toxic"))
