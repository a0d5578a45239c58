"""Packing documents into sequences with lexical neighbours.

Documents are dealt to shards of bounded size by lexical likeness: a document's signature is its best pivots, the best first,
by BM25 against a bounded sample of the corpus, and a shard is a range of signatures. Each shard has a BM25 inverted index over
token ids (document frequencies and the mean length are those of the whole corpus). A seed document opens a window; while there is
room, the best unused neighbours of the seed fill it. What does not fit of the last one opens the next window as its seed,
so all sequences but a shard's last are full.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import released, shuffle_partitions, sliced, stored, table
from .tokens import default_path, encoder

WINDOW = 1024
#: The id after each document.
END = 0
#: Tokens and documents of a shard, on average; a task holds one shard, or so much of a larger one at a time.
SHARD_TOKENS, SHARD_DOCS = 4_000_000, 3072
#: Partitions that the shuffle to shards may have even where Spark's setting is lower.
PARTITIONS = 1 << 14
#: BM25's parameters; neighbours that a search returns.
K1, B = 1.2, 0.75
NEIGHBOURS = 8
VOCABULARY = 1 << 16
#: Documents that all are compared with, and those of a signature; both are bounded samples by hash of the row.
PIVOTS, BEST = 128, 4
#: Tokens of a pivot.
PIVOT_TOKENS = (64, 4096)
#: Documents, on average, whose signatures tell the ranges of shards, and ranges at most; beyond, a range has several shards by hash of the signature.
SAMPLE, RANGES = 1 << 16, 1 << 12
#: Documents of a shard up to which all scores are computed together, so many seeds at a time; ids in a share of its documents above RARE go by matrix.
TOGETHER, SEEDS, RARE = 2 * SHARD_DOCS, 512, 1 / 128


def _tokenised(path: str):
    """Ids of each row; a last row for each task has the document frequencies of the task's ids."""

    def run(batches):
        encode = encoder(path)
        df, kind = np.zeros(VOCABULARY, np.int64), pa.null()
        for batch in sliced(batches):
            found = [encode(x) for x in batch.column(2).to_pylist()]
            for ids in found:
                df[np.unique(ids)] += 1
            kind = batch.column(0).type
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.size for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), pa.nulls(len(found), pa.list_(pa.int64()))], names=["doc_id", "row", "n", "ids", "df"])
        at = np.flatnonzero(df)
        if at.size:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([(df[at] << 16) | at], pa.list_(pa.int64()))], names=["doc_id", "row", "n", "ids", "df"])

    return run


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, row (a number of its own for each row), n and ids (16 bits each) of each row of docs, stored; where row is
    null, df has document frequencies of a part of the rows, each with its id in the lowest 16 bits."""
    taken = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return stored(taken.mapInArrow(released(_tokenised(path or default_path())), f"doc_id {taken.schema[0].dataType.simpleString()}, row bigint, n bigint, ids binary, df array<bigint>"), "tokens")


def statistics(tokens: DataFrame) -> tuple[np.ndarray, int, int]:
    """Document frequency of each id, documents and tokens, of the whole corpus; the driver gets a row for each id at most."""
    parts = tokens.where("df is not null").select(F.explode("df").alias("x"))
    df = np.zeros(VOCABULARY, np.int64)
    for r in parts.groupBy(F.col("x").bitwiseAND(F.lit(0xFFFF)).alias("token")).agg(F.sum(F.shiftright("x", 16)).alias("n")).collect():
        df[r["token"]] = r["n"]
    whole = tokens.where("row is not null").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).first()
    return df, whole["docs"], whole["tokens"] or 0


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """BM25's weight of each id; ids in more than half of all documents say nothing."""
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5)).astype(np.float32)
    idf[(df == 0) | (2 * df > n_docs)] = 0
    return idf


class Pivots:
    """Signatures of documents by their best pivots. Only the ids that a pivot has are looked at."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.place = np.full(VOCABULARY, -1, np.int64)
        counted = [np.unique(d, return_counts=True) for d in docs]
        terms = np.unique(np.concatenate([t[idf[t] > 0] for t, _ in counted])) if docs else np.empty(0, np.int64)
        self.place[terms] = np.arange(terms.size)
        self.of = np.zeros((terms.size, len(docs)), np.float32)
        for k, (d, (t, n)) in enumerate(zip(docs, counted, strict=True)):
            t, n = t[idf[t] > 0], n[idf[t] > 0]
            w = idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * d.size / mean))
            self.of[self.place[t], k] = w / max(1e-9, float(np.linalg.norm(w)))
        self.best = min(BEST, len(docs))

    def signature(self, ids: np.ndarray) -> int:
        """The numbers of the best pivots, the best in the highest bits; ties go to the first pivot. Below the signatures of documents that share an id with a pivot are those that share none."""
        at = self.place[np.unique(ids)]
        at = at[at >= 0]
        if not at.size or not self.best:
            return -1
        scores = self.of[at].sum(axis=0)
        top = np.argpartition(-scores, self.best - 1)[: self.best] if self.best < scores.size else np.arange(scores.size)
        out = 0
        for k in top[np.lexsort((top, -scores[top]))].tolist():
            out = (out << 8) | k
        return out


def _signed(pivots: Pivots):
    """(n, signature) of (n, ids)."""

    def run(batches):
        for batch in batches:
            marks = [pivots.signature(np.frombuffer(x, np.uint16)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], names=["n", "signature"])

    return run


def shard_of(signature: np.ndarray, row: np.ndarray, bounds: np.ndarray, each: int) -> np.ndarray:
    """The shard of each row: the range of its signature, or one of those that the signature fills, by row; then one of
    ``each`` shards of the range, by signature, or by row where the signature fills ranges."""
    low, high = np.searchsorted(bounds, signature, "left"), np.searchsorted(bounds, signature, "right")
    filled = np.maximum(1, high - low)
    by_row, by_signature = (((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) for x in (row, signature))
    return (high - by_row % filled) * each + np.where(filled > 1, by_row // filled, by_signature) % each


def _dealing(pivots: Pivots, bounds: np.ndarray, each: int):
    def run(batches):
        for batch in batches:
            marks = np.array([pivots.signature(np.frombuffer(x, np.uint16)) for x in batch.column("ids").to_pylist()], np.int64)
            shard = shard_of(marks, np.asarray(batch.column("row")), bounds, each)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(marks), *batch.columns], names=["shard", "signature", *batch.schema.names])

    return run


def ranges(marks: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Lowest signatures of ``n`` ranges with about as many tokens each; one that fills several ranges is repeated."""
    if n < 2 or not marks.size:
        return np.empty(0, np.int64)
    order = np.argsort(marks, kind="stable")
    total = np.cumsum(sizes[order])
    return marks[order][np.minimum(np.searchsorted(total, total[-1] * np.arange(1, n) / n, side="right"), marks.size - 1)]


class Index:
    """BM25 over the documents of a shard: postings by token id."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        tokens, owners, weights, self.queries = [], [], [], []
        for k, ids in enumerate(docs):
            t, n = np.unique(ids, return_counts=True)
            good = idf[t] > 0
            t, n = t[good], n[good]
            w = idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * ids.size / mean))
            self.queries.append(t.astype(np.int64))
            tokens.append(t)
            owners.append(np.full(t.size, k, np.int32))
            weights.append(w.astype(np.float32))
        token = np.concatenate(tokens) if tokens else np.empty(0, np.uint16)
        order = np.argsort(token, kind="stable")
        self.docs = np.concatenate(owners)[order] if tokens else np.empty(0, np.int32)
        self.weights = np.concatenate(weights)[order] if tokens else np.empty(0, np.float32)
        self.bounds = np.searchsorted(token[order], np.arange(VOCABULARY + 1))
        self.unused = np.ones(len(docs), bool)
        self.scores = self._all() if 0 < len(docs) <= TOGETHER else None

    def _all(self) -> np.ndarray:
        """Scores of all documents for all seeds: ids that many documents have by a product of matrices, the others by postings."""
        n, df = self.unused.size, np.diff(self.bounds)
        often = np.flatnonzero(df > RARE * n)
        often = np.sort(often[np.argsort(-df[often], kind="stable")[: (1 << 24) // n]])
        place = np.full(VOCABULARY, -1, np.int64)
        place[often] = np.arange(often.size)
        at = np.repeat(place, df)
        there = at >= 0
        weights = np.zeros((often.size, n), np.float32)
        weights[at[there], self.docs[there]] = self.weights[there]
        out = np.empty((n, n), np.float32)
        for low in range(0, n, SEEDS):
            own = self.queries[low : low + SEEDS]
            seed, term = np.repeat(np.arange(len(own)), [t.size for t in own]), np.concatenate(own)
            column = place[term]
            asked = np.zeros((len(own), often.size), np.float32)
            asked[seed[column >= 0], column[column >= 0]] = 1
            part = asked @ weights
            seed, term = seed[column < 0], term[column < 0]
            size = df[term]
            posting = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.bounds[term], size)
            np.add.at(part, (np.repeat(seed, size), self.docs[posting]), self.weights[posting])
            out[low : low + SEEDS] = part
        return out

    def _of(self, seed: int) -> np.ndarray:
        if self.scores is not None:
            return self.scores[seed].copy()
        spans = [(self.bounds[t], self.bounds[t + 1]) for t in self.queries[seed].tolist()]
        if not spans:
            return np.zeros(self.unused.size)
        return np.bincount(np.concatenate([self.docs[a:b] for a, b in spans]), np.concatenate([self.weights[a:b] for a, b in spans]), self.unused.size)

    def neighbours(self, seed: int) -> list[int]:
        """Unused documents that share terms with the seed, the best first (ties: the first in the shard)."""
        scores = self._of(seed)
        scores[~self.unused] = 0
        k = min(NEIGHBOURS, scores.size)
        top = np.argpartition(-scores, k - 1)[:k]
        top = top[scores[top] > 0]
        return top[np.lexsort((top, -scores[top]))].tolist()


def packed(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of the documents of a shard; END is part of each document."""
    index = Index(docs, idf, mean)
    out: list[tuple[int, int, int, int, int]] = []
    sequence, used, queue, seed, next_ = 0, 0, [], None, 0
    current, start = None, 0
    while True:
        if current is None:
            if used and seed is not None:  # room in the seed's window
                queue = [k for k in queue if index.unused[k]] or index.neighbours(seed)
            else:
                queue = []
            if queue:
                current = queue.pop(0)
            else:
                while next_ < len(docs) and not index.unused[next_]:
                    next_ += 1
                if next_ == len(docs):
                    return out
                current = next_
            index.unused[current] = False
            start = 0
            if not used:
                seed, queue = current, []
        n = min(docs[current].size + 1 - start, window - used)
        out.append((current, start, n, sequence, used))
        start, used = start + n, used + n
        done = start == docs[current].size + 1
        if used == window:
            sequence, used, queue = sequence + 1, 0, []
            seed = None if done else current  # its rest opens the next window
        if done:
            current = None


def _packing(idf: np.ndarray, mean: float, window: int, shard_tokens: int):
    """Packs sorted rows (shard, doc_id, ids) shard by shard; one of more than twice the mean size, in parts of that."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def flush(shard, held, base):
        docs = [np.frombuffer(x[1].as_py(), np.uint16) for x in held]
        pieces = packed(docs, idf, mean, window)
        owner, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        whole, marks = {}, []
        for k, a, n in zip(owner.tolist(), start.tolist(), length.tolist(), strict=True):
            if k not in whole:
                whole = {k: np.append(docs[k].astype("<u4"), np.uint32(END))}  # pieces of a document come one after the other
            marks.append(zlib.crc32(whole[k][a : a + n].tobytes()))
        sizes = np.array([d.size + 1 for d in docs], np.int64)
        ids = pa.array([held[k][0].as_py() for k in owner.tolist()], held[0][0].type)
        arrays = [ids, pa.array(start), pa.array(length), pa.array(marks, pa.int64()), pa.array(sizes[owner]), pa.array((shard << 32) + base + sequence), pa.array(offset)]
        return pa.RecordBatch.from_arrays(arrays, names=names), base + int(sequence[-1]) + 1

    def run(batches):
        held, size, now, base = [], 0, None, 0
        for batch in batches:
            for shard, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if held and (shard != now or size >= 2 * shard_tokens or len(held) >= TOGETHER):
                    out, base = flush(now, held, base)
                    yield out
                    held, size = [], 0
                if shard != now:
                    now, base = shard, 0
                held.append((doc, ids))
                size += len(ids.as_buffer()) // 2 + 1
        if held:
            yield flush(now, held, base)[0]

    return run


def dealt(tokens: DataFrame, idf: np.ndarray, n_docs: int, mean: float, shards: int) -> DataFrame:
    """(shard, signature, doc_id, row, ids) of each row of tokens. Ranges of signatures are set by a bounded sample, and every row is dealt.
    What comes to the driver is at most PIVOTS documents and about SAMPLE signatures."""
    rows = tokens.where("row is not null")
    hashed = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    pivots, bounds, groups = Pivots([], idf, mean), np.empty(0, np.int64), min(shards, RANGES)
    if shards > 1:
        able = rows.where(F.col("n").between(*PIVOT_TOKENS))
        few = int(min(1.0, 4 * PIVOTS / max(1, able.count())) * (1 << 30))  # so that no task sends many to the driver
        able = able.where(hashed <= few).select(hashed.alias("h"), "row", "ids").orderBy("h", "row").limit(PIVOTS)
        pivots = Pivots([np.frombuffer(r["ids"], np.uint16) for r in able.collect()], idf, mean)
        share = int(min(1.0, SAMPLE / n_docs) * (1 << 30))
        drawn = rows.where(hashed <= share).select("n", "ids").mapInArrow(released(_signed(pivots)), "n bigint, signature bigint").collect()
        bounds = ranges(np.array([r["signature"] for r in drawn], np.int64), np.array([r["n"] + 1 for r in drawn], np.int64), groups)
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "row", "ids").mapInArrow(released(_dealing(pivots, bounds, max(1, round(shards / groups)))), f"shard bigint, signature bigint, doc_id {kind}, row bigint, ids binary")


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts count as empty; an empty document is its END alone. Each row of docs is packed on its own, with null or repeated ids and
    equal texts too; ties go to the first in the shard. Texts of any length are tokenised whole, and those longer than a window take
    several pieces. Other columns are not looked at. An empty table gives no pieces."""
    tokens = tokenised(docs, id_col, text_col, path)
    df, n_docs, n_tokens = statistics(tokens)
    shards = max(1, -(-(n_tokens + n_docs) // shard_tokens), -(-n_docs // SHARD_DOCS))
    idf, mean = weights(df, n_docs), max(1.0, n_tokens / max(1, n_docs))
    kind = tokens.schema["doc_id"].dataType.simpleString()
    # a partition for each shard, so that a task's share doesn't grow with the corpus, as far as a shuffle can have so many
    parts = dealt(tokens, idf, n_docs, mean, shards).repartitionById(min(shards, max(PARTITIONS, shuffle_partitions(docs.sparkSession))), F.col("shard").cast("int")).sortWithinPartitions("shard", "signature", "row").select("shard", "doc_id", "ids")
    return parts.mapInArrow(released(_packing(idf, mean, window, shard_tokens)), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def op10_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(table(spark, sf_dir, "documents"))
