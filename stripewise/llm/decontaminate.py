"""Benchmark decontamination: documents that contain a benchmark item, word for word or nearly.

Of a document, windows of as many words as an item has get SimHash fingerprints (from prefix sums of their
shingles' bits). Items' fingerprints within the radius are found through blocks of bits: of two fingerprints
within RADIUS, one of BLOCKS blocks differs in at most RADIUS // BLOCKS bits, and every block value has a list of the
items that near. What is found is verified by the weighted similarity of the shingles, counted with repeats.
Windows without any shingle of any item have similarity 0 and get no fingerprint.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import column, sliced, stored, table, unpacked, whole
from .shingles import Known, hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Bits that may differ. Shingles similar to 0.8 differ in 9.7 bits on average, with deviation 2.9.
RADIUS = 18
BLOCKS = 7
#: Bytes of items that documents are searched for in one pass over the documents; more items take more passes.
PASS_BYTES = 16 << 20
#: Shingles of a document that are handled together.
SPAN = 50_000

_WORD = re.compile(r"\w+")
_KNOWN = Known(400_000)


def words_of(text: str | None) -> list[str]:
    """Letters, digits and underscores, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list[str]) -> np.ndarray:
    """Hashes of the runs of five words."""
    return hashes(words, SHINGLE, _KNOWN) if len(words) >= SHINGLE else np.empty(0, np.uint64)


def _signs(s: np.ndarray) -> np.ndarray:
    """Sums of the shingles' bits, +1 or -1 each, before each place."""
    bits = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    out = np.zeros((s.size + 1, 64), np.int32)
    np.cumsum(2 * bits - 1, axis=0, out=out[1:])
    return out


def _marks(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted: what both have, by what either has, with repeats."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / max(1, a.total() + b.total() - both)


class _Length:
    """Items of one number of shingles, by blocks of their fingerprints."""

    def __init__(self, marks: np.ndarray, items: list[int]):
        self.marks, self.items = marks, items
        cuts = [round(64 * k / BLOCKS) for k in range(BLOCKS + 1)]
        self.blocks = []
        for low, high in zip(cuts, cuts[1:], strict=False):
            mask = np.uint64((1 << (high - low)) - 1)
            own = (marks >> np.uint64(low)) & mask
            near = np.bitwise_count(np.arange(1 << (high - low), dtype=np.uint64)[:, None] ^ own[None, :]) <= RADIUS // BLOCKS
            value, item = np.nonzero(near)
            self.blocks.append((np.uint64(low), mask, np.searchsorted(value, np.arange(near.shape[0] + 1)), item))

    def near(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) within the radius: all of them, each once."""
        found = []
        for low, mask, bounds, item in self.blocks:
            value = ((marks >> low) & mask).astype(np.int64)
            n = bounds[value + 1] - bounds[value]
            window = np.repeat(np.arange(marks.size), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[value], n)
            other = item[at]
            ok = np.bitwise_count(marks[window] ^ self.marks[other]) <= RADIUS
            found.append(window[ok] * len(self.items) + other[ok])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.items), pairs % len(self.items)


class Index:
    """The items of one pass. An item of fewer than five words is a single shingle of them all, found where a document has
    those words in a row. Items without a word are in no document."""

    def __init__(self, items: list[tuple]):
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        self.counts: list[Counter] = []
        self.ids: list = []
        self.short: dict[int, dict[int, list]] = {}
        for item, text in items:
            words = words_of(text)
            s = shingles(words)
            if 0 < len(words) < SHINGLE:
                self.short.setdefault(len(words), {}).setdefault(int(hashes(words, SHINGLE)[0]), []).append(item)
            if s.size:
                by_length.setdefault(s.size, []).append((len(self.ids), s))
                self.ids.append(item)
                self.counts.append(Counter(s.tolist()))
        self.lengths = {m: _Length(np.concatenate([_marks(_signs(s)[-1:]) for _, s in own]), [k for k, _ in own]) for m, own in sorted(by_length.items())}
        every = [s for own in by_length.values() for _, s in own]
        self.all = np.unique(np.concatenate(every)) if every else np.empty(0, np.uint64)
        self.map = np.zeros(1 << 22, bool)
        self.map[(self.all >> np.uint64(42)).astype(np.int64)] = True

    def search(self, text: str | None) -> list[tuple]:
        """(item, first word, words, similarity) of the best window for each item found in a text."""
        words = words_of(text)
        return self._short(words) + self._long(shingles(words))

    def _short(self, words: list[str]) -> list[tuple]:
        out = []
        for m, items in self.short.items():
            if len(words) >= m:
                h = hashes(words, m)
                at = np.flatnonzero(np.isin(h, np.fromiter(items, np.uint64, len(items))))
                for x, k in zip(*np.unique(h[at], return_index=True), strict=True):
                    out += [(item, int(at[k]), m, 1.0) for item in items[int(x)]]
        return out

    def _long(self, s: np.ndarray) -> list[tuple]:
        if not s.size or not self.all.size:
            return []
        hit = np.flatnonzero(self.map[(s >> np.uint64(42)).astype(np.int64)])
        hit = hit[self.all[np.minimum(np.searchsorted(self.all, s[hit]), self.all.size - 1)] == s[hit]]
        best: dict[int, tuple[float, int, int]] = {}
        widest = max(self.lengths)
        low = 0
        while low < hit.size:  # hits that windows can share, up to SPAN
            high = low + 1
            while high < hit.size and hit[high] - hit[high - 1] < widest and hit[high] - hit[low] < SPAN:
                high += 1
            self._region(s, hit[low:high], widest, best)
            low = high
        return [(self.ids[k], at, n + SHINGLE - 1, float(v)) for k, (v, at, n) in sorted(best.items())]

    def _region(self, s, hits, widest, best) -> None:
        first, end = max(0, int(hits[0]) - widest), min(s.size, int(hits[-1]) + widest + 1)
        sums = _signs(s[first:end])
        marked = np.zeros(end - first + 1, np.int64)
        marked[hits - first + 1] = 1
        marked = np.cumsum(marked)
        for m, own in self.lengths.items():
            n = min(m, s.size)  # a document shorter than the item is one window
            if n < SIMILARITY * m or end - first < n:
                continue
            starts = np.flatnonzero(marked[n:] > marked[:-n])
            if not starts.size:
                continue
            windows, items = own.near(_marks(sums[starts + n] - sums[starts]))
            counted: dict[int, Counter] = {}
            for w, k in zip(windows.tolist(), items.tolist(), strict=True):
                at = first + int(starts[w])
                if at not in counted:
                    counted[at] = Counter(s[at : at + n].tolist())
                item = own.items[k]
                v = similarity(counted[at], self.counts[item])
                if v >= SIMILARITY and (item not in best or (-v, at) < (-best[item][0], best[item][1])):
                    best[item] = (v, at, n)


_KEPT: dict = {}


def _index(items, name: str) -> Index:
    """The index of broadcast items, made once for each worker; of other passes none is kept."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Index(items.value)
    return _KEPT[name]


def _searching(items, name: str, kind: T.DataType):
    """A function of a text column: what is found in each text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        arrow = to_arrow_type(kind)
        for batch in batches:
            index = _index(items, name)
            parts = []
            for low in range(0, len(batch), 1000):
                found = [[{"item_id": a, "first_word": b, "n_words": c, "similarity": d} for a, b, c, d in index.search(text)] for text in batch.slice(low, 1000).to_pylist()]
                parts.append(pa.array(found, arrow))
            yield pa.concat_arrays(parts) if parts else pa.array([], arrow)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()  # else Catalyst may run it once for a filter and again for the rows that pass


def passes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", bytes_: int = PASS_BYTES):
    """Lists of (item, text), each of at most ``bytes_`` bytes of text (or one item); of the whole table in turn."""
    held, size = [], 0
    for r in benchmark.select(column(id_col).alias("i"), column(text_col).cast("string").alias("t")).toLocalIterator():
        n = len((r["t"] or "").encode("utf-8", "surrogatepass")) + 16
        if held and size + n > bytes_:
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += n
    if held:
        yield held


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, keep: list[str], item_col: str, item_text: str) -> DataFrame:
    """row (the columns ``keep``), text, and leaks."""
    spark = docs.sparkSession
    fields = [T.StructField("item_id", benchmark.schema[item_col].dataType), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())]
    kind = T.ArrayType(T.StructType(fields))
    out = docs.select(whole(docs, keep).alias("row"), column(text_col).cast("string").alias("text"), F.lit(None).cast(kind).alias("leaks"))
    for k, items in enumerate(passes(benchmark, item_col, item_text)):
        if k % 8 == 7:
            out = stored(out, "leaks")
        search = _searching(spark.sparkContext.broadcast(items), uuid.uuid4().hex, kind)  # at most PASS_BYTES
        out = out.select("row", "text", (F.concat(F.col("leaks"), search("text")) if k else search("text")).alias("leaks"))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, item_col: str = "item_id", item_text: str = "text", name: str = "__leaks") -> DataFrame:
    """Columns ``keep`` of docs (all where None) and one called ``name``: for each item found its id (of any type), the window's first word, its
    number of words, and the similarity, at least SIMILARITY; of equally similar windows the first.

    One pass over docs for each block of items. Null and empty texts have no leaks, nor has anything where the
    benchmark is empty; null items are in no document. Texts are searched whole, very long ones by regions of hits. Rows
    come out as they come in, repeated ones and those with null ids too. Names of columns don't matter, but for ``name``."""
    kept = docs.columns if keep is None else keep
    return _found(docs, benchmark, text_col, kept, item_col, item_text).select(*unpacked(kept), F.col("leaks").alias(name))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that contain no benchmark item, with all their columns, whatever their names. See ``leaks``."""
    found = _found(docs, benchmark, text_col, docs.columns, item_col, item_text)
    return found.where(F.col("leaks").isNull() | (F.size("leaks") == 0)).select(*unpacked(docs.columns))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.explode("__leaks").alias("x")).select("doc_id", "x.item_id", "x.first_word", "x.n_words", "x.similarity")
