"""Language identification with hyperdimensional profiles.

Every symbol has a random vector of +1 and -1. An n-gram's vector binds the vectors of its symbols, each
permuted (rotated) by its place: elementwise product. A text's vector bundles (adds) those of its n-grams; a language's prototype
bundles its documents. A document gets the language whose prototype has the largest cosine with it.

Bundling is linear, so a block of texts is one product of n-gram counts and n-gram vectors: the n-grams that
are frequent in the learning texts have a dense table, all others are bound on the fly.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import column, released, table

DIMENSIONS = 1024
SEED = 7
N = 3
#: Symbols: word boundary, a-z, and buckets for all other letters.
SYMBOLS = 64
#: n-grams with a dense table of vectors.
DENSE = 3072
#: Texts of a language that prototypes are learnt from, on average.
SAMPLE = 4000
#: Languages that can be learnt; their prototypes come to the driver.
MOST_LANGUAGES = 2000
#: Characters that are handled at a time.
BLOCK = 1 << 20


def _symbol_table() -> np.ndarray:
    """Code point to symbol for the Basic Multilingual Plane: 0 for all that is no letter, 1-26 for a-z and A-Z,
    a bucket for any other letter in lower case."""
    out = np.zeros(0x10000, np.uint8)
    for c in range(0x10000):
        x = chr(c)
        if unicodedata.category(x)[0] == "L":
            low = x.lower()[0]
            out[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + zlib.crc32(low.encode("utf-8", "surrogatepass")) % (SYMBOLS - 27)
    return out


class Space:
    """The vectors of one seed."""

    def __init__(self):
        self.table = _symbol_table()
        draw = np.random.default_rng(SEED)
        letters = draw.choice(np.array([-1, 1], np.int8), (SYMBOLS, DIMENSIONS))
        # the vector of a symbol at place k of an n-gram is rotated n - 1 - k times
        self.at = [np.roll(letters, N - 1 - k, axis=1) for k in range(N)]

    def grams(self, text: str) -> np.ndarray:
        """Numbers of the n-grams of a text: runs of non-letters count as one boundary, as do both ends."""
        return np.concatenate([np.empty(0, np.int64), *self.blocks(text)])

    def blocks(self, text: str | None) -> Iterator[np.ndarray]:
        """The n-grams of a text, BLOCK characters at a time; the last symbols of a block go with the next."""
        held = np.zeros(1, np.uint8)  # the boundary before the text
        for low in range(0, len(text or ""), BLOCK):
            s = self._symbols(text[low : low + BLOCK])
            s = np.concatenate((held, s, [0] if low + BLOCK >= len(text) else [])).astype(np.uint8)
            s = s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]]
            if s.size >= N:
                out = s[: s.size - N + 1].astype(np.int64)
                for k in range(1, N):
                    out = out * SYMBOLS + s[k : s.size - N + 1 + k]
                yield out
            held = s[-(N - 1) :]

    def _symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if points.max() > 0xFFFF:
            beyond = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in points[points > 0xFFFF].tolist()), bool)
            points = points.copy()
            high = points > 0xFFFF
            points[high] = np.where(beyond, 0x4E00 + points[high] % 64, 0)
        return self.table[points]

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of n-grams."""
        out = np.ones((grams.size, DIMENSIONS), np.int8)
        for k in range(N):
            out *= self.at[k][grams // SYMBOLS ** (N - 1 - k) % SYMBOLS]
        return out


_KEPT: dict = {}


def _space() -> Space:
    if "space" not in _KEPT:
        _KEPT["space"] = Space()
    return _KEPT["space"]


class Bundler:
    """Bundles texts; the n-grams in ``dense`` have a table."""

    def __init__(self, dense: np.ndarray):
        self.space = _space()
        self.dense = dense
        self.vectors = self.space.bound(dense).astype(np.float32)
        self.where = np.full(SYMBOLS**N, -1, np.int32)
        self.where[dense] = np.arange(dense.size)

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        counts = np.zeros((len(texts), max(1, self.dense.size)), np.float32)
        rest = np.zeros((len(texts), DIMENSIONS), np.float32)
        for k, text in enumerate(texts):
            for found in self.space.blocks(text):
                at = self.where[found]
                inside = at >= 0
                counts[k] += np.bincount(at[inside], minlength=counts.shape[1])[: counts.shape[1]]
                if not inside.all():
                    grams, n = np.unique(found[~inside], return_counts=True)
                    for a in range(0, grams.size, 4096):
                        rest[k] += n[a : a + 4096].astype(np.float32) @ self.space.bound(grams[a : a + 4096]).astype(np.float32)
        return counts @ self.vectors + rest if self.dense.size else rest


def _learning(batches):
    """Sums of the unit vectors of a partition's documents, for each language."""
    space, sums, seen = _space(), {}, {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            grams, n = np.unique(space.grams(text), return_counts=True)  # few, however long the text is
            if not grams.size:
                continue
            vector = np.zeros(DIMENSIONS, np.float32)
            for a in range(0, grams.size, 4096):
                vector += n[a : a + 4096].astype(np.float32) @ space.bound(grams[a : a + 4096]).astype(np.float32)
            size = np.linalg.norm(vector)
            if size > 0:
                sums[lang] = sums.get(lang, 0) + vector / size
                own = seen.setdefault(lang, {})
                for g, c in zip(grams.tolist(), n.tolist(), strict=True):
                    own[g] = own.get(g, 0) + c
    for lang, vector in sums.items():
        dims = np.arange(DIMENSIONS)
        yield _rows(lang, "v", dims, vector)
        yield _rows(lang, "g", np.fromiter(seen[lang], np.int64), np.fromiter(seen[lang].values(), np.float64))


def _rows(lang, kind, keys, values):
    n = len(keys)
    return pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([kind] * n, pa.string()), pa.array(keys, pa.int64()), pa.array(np.asarray(values, np.float64))], names=["lang", "kind", "key", "value"])


def learnt(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """The model: languages, unit prototypes and the frequent n-grams.

    Learns from about ``sample`` different texts of each language, those with the smallest hashes, and all where there are no
    more (rows with a null language or no letter teach nothing, repeated rows once). Vectors are summed on the executors; the driver gets one of DIMENSIONS
    numbers for each language and the DENSE most frequent n-grams of at most SYMBOLS ** N. More than MOST_LANGUAGES languages are an error."""
    hashed = F.xxhash64(column(lang_col).cast("string"), column(text_col).cast("string"))
    rows = docs.where(column(lang_col).isNotNull()).select(column(lang_col).cast("string").alias("lang"), hashed.alias("h"), column(text_col).cast("string").alias("text"))
    n = rows.groupBy("lang", "h").agg(F.lit(1)).groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(n) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; the prototypes are kept on the driver")
    # of a language with n texts those below this share of all hashes: sample on average, so none is sorted
    share = {r["lang"]: min(1.0, sample / r["n"]) for r in n}
    if not share:
        return {"langs": [], "vectors": [], "dense": []}
    limits = F.element_at(F.from_json(F.lit(json.dumps(share)), "map<string, double>"), F.col("lang"))
    chosen = rows.where(F.pmod("h", F.lit(1 << 30)) < limits * (1 << 30)).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")
    got = chosen.mapInArrow(released(_learning), "lang string, kind string, key bigint, value double").groupBy("lang", "kind", "key").agg(F.sum("value").alias("value"))
    vectors = got.where("kind = 'v'").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("v")).select("lang", F.col("v.value").alias("v")).orderBy("lang").collect()
    # each language weighs alike in the choice of frequent n-grams
    totals = got.where("kind = 'g'").groupBy("lang").agg(F.sum("value").alias("all"))
    dense = got.where("kind = 'g'").join(F.broadcast(totals), "lang").groupBy("key").agg(F.sum(F.col("value") / F.col("all")).alias("w")).orderBy(F.desc("w"), "key").limit(DENSE).collect()
    unit = [np.asarray(r["v"]) / np.linalg.norm(r["v"]) for r in vectors]
    return {"langs": [r["lang"] for r in vectors], "vectors": [u.astype(np.float32) for u in unit], "dense": sorted(r["key"] for r in dense)}


def _predicting(model: dict):
    def run(batches):
        bundler = Bundler(np.array(model["dense"], np.int64))
        prototypes = np.stack(model["vectors"]).astype(np.float32) if model["langs"] else np.zeros((0, DIMENSIONS), np.float32)
        names = np.array([*model["langs"], "und"], dtype=object)
        for batch in batches:
            texts, best, score = batch.column(batch.num_columns - 1), [], []
            for low in range(0, batch.num_rows, 256):
                vectors = bundler.bundle(texts.slice(low, 256).to_pylist())
                size = np.linalg.norm(vectors, axis=1)
                if not len(prototypes):
                    best.append(np.full(len(vectors), -1))
                    score.append(np.zeros(len(vectors)))
                    continue
                cosine = vectors @ prototypes.T / np.maximum(size, 1e-9)[:, None]
                k = cosine.argmax(axis=1)
                score.append(np.where(size > 0, np.clip(cosine[np.arange(len(k)), k], 0, 1), 0).astype(np.float64))
                best.append(np.where(size > 0, k, -1))
            best, score = np.concatenate(best), np.concatenate(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def predicted(docs: DataFrame, model: dict, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) of each row: score is the cosine with the chosen prototype, held between 0 and 1.

    ``und`` with score 0 where the text is null, empty or has no letter, or where no language was learnt. Ties
    go to the first language by name. Texts of any length are bundled whole, in blocks. Null and repeated ids stay as they are; other columns are not looked at."""
    taken = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return taken.mapInArrow(released(_predicting(model)), f"doc_id {taken.schema[0].dataType.simpleString()}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))
    model = learnt(docs.where(~held_out))
    return predicted(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
