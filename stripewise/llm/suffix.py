"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts at another place of the corpus. Places
are told apart by refinement, coarse to fine, and only those still in a shared bucket go on:

1. Every place belongs to an anchor: the q-gram with the smallest hash among those that start in its string's
   first bytes. Equal strings have equal anchors at equal distances, so the initial buckets are
   those of anchors' q-grams; an anchor stands for all places between two changes of the minimum. About one
   position in 85 is an anchor. Anchors alone in their bucket are done: nothing of theirs repeats.
2. Shared buckets are split by 128 bits of hash of the whole region that the anchor's places cover. A
   region found twice repeats as a whole, and counts as one from here on, however many copies it has.
3. What is left (ends of matches, edits) is refined by place: buckets of 8-grams are sorted by the bucket of
   the places 8 and 16 bytes later, those of 24-grams by the buckets 24 and 48 bytes later and so on up to ``length``; each
   round reuses the bucket identifiers of the round before.

Buckets with more members than one task should hold are counted by place instead (``_by_place``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import passing_shuffles, released, shared_path, shuffle_partitions, sliced, stored, table, unpacked, whole

LENGTH = 200
#: Places whose anchor can be one position: the window of q-gram starts.
WINDOW = 168
#: Bytes of a text that are hashed at a time.
CHUNK = 1 << 18
#: Bytes of contexts that are refined together, and contexts of one bucket that one task refines.
TOGETHER = 1 << 20
MOST = 16_000

_POS = (1 << 20) - 1
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Rolling:
    """Polynomial hashes of substrings, modulo 2 ** 64, over a random table of byte values."""

    def __init__(self, seed: int, size: int = CHUNK + 4096):
        draw = np.random.default_rng(seed)
        self.of = draw.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + draw.integers(0, 2, 256, dtype=np.uint64)
        base = int(draw.integers(1 << 40, 1 << 62)) * 8 + 5
        back = pow(base, -1, 1 << 64)
        self.up, self.down = self._powers(base, size), self._powers(back, size)

    @staticmethod
    def _powers(x: int, size: int) -> np.ndarray:
        out = np.empty(size, np.uint64)
        out[0], n = 1, 1
        while n < size:
            m = min(n, size - n)
            out[n : n + m] = out[:m] * _U(pow(x, n, 1 << 64))
            n += m
        return out

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(data.size + 1, np.uint64)
        np.cumsum(self.of[data] * self.up[: data.size], out=out[1:])
        return out

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


_KEPT: dict = {}


def _rolling(seed: int) -> Rolling:
    if seed not in _KEPT:
        _KEPT[seed] = Rolling(seed)
    return _KEPT[seed]


def _gram(length: int) -> int:
    return max(8, length // 6, length - WINDOW)


def anchors(data: bytes, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (anchor, first place, last place, bucket, region, region): places first..last have this anchor; bucket is the
    q-gram's hash and the regions two of the bytes from the first place to the end of the last place's string."""
    q = _gram(length)
    window = length - q + 1
    hashes = _rolling(1)
    whole = np.frombuffer(data, np.uint8)
    places = whole.size - length + 1
    for low in range(0, places, CHUNK):
        n = min(CHUNK, places - low)
        sums = hashes.sums(whole[low : low + n + length - 1])
        grams = _mix((sums[q:] - sums[:-q]) * hashes.down[: sums.size - q])
        least = (grams & ~_U(_POS)) | np.arange(grams.size, dtype=np.uint64)
        size = 1
        while 2 * size <= window:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < window:
            least = np.minimum(least[: n], least[window - size : window - size + n])
        at = (least[:n] & _U(_POS)).astype(np.int64)
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        first, last = np.r_[0, cut], np.r_[cut - 1, n - 1]
        own = at[first]
        place = ((own - first).astype(np.uint64) << _U(20)) ^ ((last - first).astype(np.uint64) << _U(40))
        other = _rolling(2)
        regions = [_mix(r.between(x, first, last + length) ^ place) for r, x in ((hashes, sums), (other, other.sums(whole[low : low + n + length - 1])))]
        yield own + low, first + low, last + low, grams[own], *regions


_ANCHORS = "kh bigint, rh bigint, rh2 bigint, k1 bigint, k2 bigint, a int, back short, span short"


def _find_anchors(length: int):
    schema = ["kh", "rh", "rh2", "k1", "k2", "a", "back", "span"]

    def out(parts):
        k1, k2, at, first, last, bucket, region, other = (np.concatenate(x) for x in zip(*parts, strict=True))
        columns = [bucket.view(np.int64), region.view(np.int64), other.view(np.int64), k1, k2, at.astype(np.int32), (at - first).astype(np.int16), (last - first).astype(np.int16)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema)

    def run(batches):
        parts, size = [], 0
        for batch in sliced(batches):
            keys = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for row, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                for block in anchors(text, length):
                    n = block[0].size
                    parts.append((np.full(n, keys[0][row]), np.full(n, keys[1][row]), *block))
                    size += n
                    if size > 200_000:
                        yield out(parts)
                        parts, size = [], 0
        if parts:
            yield out(parts)

    return run


def _contexts(length: int):
    """Regions of the wanted anchors of each text."""

    def run(batches):
        for batch in sliced(batches, 100):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for row, wanted in enumerate(batch.column("wanted").to_pylist()):
                k1, k2, data = batch.column("k1")[row].as_py(), batch.column("k2")[row].as_py(), texts[row]
                for low in range(0, len(wanted), 10_000):
                    part = wanted[low : low + 10_000]
                    firsts = [x["a"] - x["back"] for x in part]
                    arrays = [pa.array([x[c] for x in part], t) for c, t in (("kh", pa.int64()), ("many", pa.bool_()), ("n", pa.int64()))]
                    arrays += [pa.array([k] * len(part), pa.int64()) for k in (k1, k2)]
                    arrays += [pa.array(firsts, pa.int32()), pa.array([x["span"] for x in part], pa.int16()), pa.array([data[f : f + x["span"] + length] for f, x in zip(firsts, part, strict=True)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["kh", "many", "n", "k1", "k2", "first", "span", "context"])

    return run


def _bucket_numbers(keys: np.ndarray) -> np.ndarray:
    """Places sorted by key; each gets the number of its bucket."""
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(keys.size, np.int64)
    out[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
    return out


def refined(data: np.ndarray, length: int) -> np.ndarray:
    """The bucket of each place of data by its ``length`` bytes: equal numbers, equal bytes."""
    grams, size = data.astype(np.uint64), 1
    while size < min(8, length) and 2 * size <= length:
        grams = (grams[:-size] << _U(8 * size)) | grams[size:]
        size *= 2
    bucket = _bucket_numbers(grams)
    while size < length:
        width = int(bucket.max()).bit_length()
        parts = 3 if 3 * width <= 63 and length > 2 * size else 2  # as many identifiers as fit a key
        whole = min(length, parts * size)
        steps = [min(k * size, whole - size) for k in range(1, parts)]
        n = bucket.size - steps[-1]
        key = bucket[:n]
        for s in steps:
            key = (key << width) | bucket[s : s + n]
        bucket, size = _bucket_numbers(key), whole
    return bucket


def _runs(k1, k2, first, span, hit) -> tuple[list, ...]:
    """Runs of places that repeat, from the marks of all places of some contexts, in order."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
    starts, ends = edge[::2], edge[1::2] - 1
    owner = np.searchsorted(np.cumsum(span + 1), starts, side="right")
    base = np.cumsum(span + 1) - (span + 1)
    return k1[owner], k2[owner], first[owner] + starts - base[owner], first[owner] + ends - base[owner]


def _refine(length: int):
    """Refines the contexts of each bucket; those of buckets with too many come out as they are (context not null)."""
    names = ["k1", "k2", "first", "last", "n", "context"]

    def flush(held):
        data = b"".join(x[5] for x in held)
        sizes = np.array([len(x[5]) for x in held], np.int64)
        bucket = refined(np.frombuffer(data, np.uint8), length)
        span = np.array([x[4] for x in held], np.int64)
        base = np.cumsum(sizes) - sizes
        own = np.repeat(base - (np.cumsum(span + 1) - (span + 1)), span + 1) + np.arange(int((span + 1).sum()))
        numbers = bucket[own]
        hit = np.bincount(numbers)[numbers] > 1
        open_ = np.array([x[0] == 1 for x in held])
        found = []
        k1, k2, first = (np.array([x[c] for x in held], np.int64) for c in (1, 2, 3))
        bounds = np.r_[0, np.cumsum(span + 1)]
        for k in np.flatnonzero(open_ & (np.add.reduceat(hit.astype(np.int64), bounds[:-1]) > 0)):
            found.append(_runs(k1[k : k + 1], k2[k : k + 1], first[k : k + 1], span[k : k + 1], hit[bounds[k] : bounds[k + 1]].astype(np.int8)))
        if found:
            a, b, c, d = (np.concatenate(x) for x in zip(*found, strict=True))
            n = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(d), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)

    def raw(rows):
        columns = list(zip(*rows, strict=True))
        first = np.array(columns[3], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(first), pa.array(first + np.array(columns[4], np.int64)), pa.array(columns[0], pa.int64()), pa.array(columns[5], pa.binary())], names=names)

    def run(batches):
        held, key, size, many = [], None, 0, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("kh", "many", "n", "k1", "k2", "first", "span", "context")]
            for kh, hot, *row in zip(*columns, strict=True):
                if hot:
                    many.append(row)
                    if len(many) == 1000:
                        yield raw(many)
                        many = []
                    continue
                if kh != key and size > TOGETHER:
                    yield from flush(held)
                    held, size = [], 0
                key = kh
                held.append(row)
                size += len(row[5])
        if many:
            yield raw(many)
        if held:
            yield from flush(held)

    return run


def _place_hashes(length: int):
    def run(batches):
        for batch in batches:
            for k1, k2, first, n, context in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "first", "n", "context")), strict=True):
                data = np.frombuffer(context, np.uint8)
                m = data.size - length + 1
                at = np.arange(m)
                marks = [r.between(r.sums(data), at, at + length).view(np.int64) for r in (_rolling(1), _rolling(2))]
                yield pa.RecordBatch.from_arrays([pa.array(marks[0]), pa.array(marks[1]), pa.array([k1] * m, pa.int64()), pa.array([k2] * m, pa.int64()), pa.array(at + first), pa.array([n] * m, pa.int64())], names=["h1", "h2", "k1", "k2", "place", "n"])

    return run


def _by_place(rows: DataFrame, length: int) -> DataFrame:
    """Repeated places of contexts in buckets too large for a task: counted by 128 bits of hash, combined before the shuffle."""
    places = stored(rows.mapInArrow(released(_place_hashes(length)), "h1 bigint, h2 bigint, k1 bigint, k2 bigint, place bigint, n bigint"), "places")
    twice = places.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    return places.where("n = 1").join(twice, ["h1", "h2"]).select("k1", "k2", F.col("place").alias("first"), F.col("place").alias("last"))


def _cut(length: int, with_text: bool):
    """What is left of each text, from its runs of repeated places; as text without characters cut in two."""

    def run(batches):
        for batch in sliced(batches):
            out = [[] for _ in range(4)]
            for data, copies, runs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("copies").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                spans: list[list[int]] = []
                for x in [{"first": 0, "last": len(data) - length}] if copies > 1 else sorted(runs or [], key=lambda x: x["first"]):
                    if spans and x["first"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x["last"] + length)
                    else:
                        spans.append([x["first"], x["last"] + length])
                ends = [0, *(y for x in spans for y in x), len(data)]
                left = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if spans else data
                for k, v in enumerate((len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if with_text else None)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["k1", "k2", "n_removed", "n_spans", "kept_sha256", "left"])

    return run


def keys(text) -> list:
    """128 bits that stand for a text: two columns k1 and k2."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def _bucketed(texts: DataFrame) -> DataFrame:
    """Texts stored in buckets of their keys, so that no later join moves them again."""
    spark = texts.sparkSession
    name = shared_path(spark, "texts")
    n = shuffle_partitions(spark)
    own = "texts_" + name.rpartition("-")[2]
    try:
        with passing_shuffles(spark):
            texts.write.bucketBy(n, "k1", "k2").option("path", name).option("compression", "zstd").format("parquet").saveAsTable(own)
        return spark.table(own)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {own}")  # the catalog's entry alone; the files at ``path`` stay


def repeats(docs: DataFrame, text, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept_sha256, left) of each different text of at least ``length`` bytes; left is what
    remains as text, null unless asked for."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select(text.cast("string").alias("text")).where(F.octet_length("text") >= length)
    texts = _bucketed(rows.select(*keys(F.col("text")), "text").groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies")))
    found = texts.select("k1", "k2", "text").mapInArrow(released(_find_anchors(length)), _ANCHORS)
    # stored, so that the join below reads plain shuffles, whose skewed partitions Spark can split
    shared = stored(found.select("kh").groupBy("kh").agg(F.count("*").alias("c")).where("c > 1").select("kh"), "shared")
    anchors_ = stored(found.join(shared, "kh", "left_semi"), "anchors")
    regions = stored(anchors_.groupBy("kh", "rh", "rh2").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "a", "back", "span")).alias("x")), "regions")
    mixed = regions.groupBy("kh").agg(F.count("*").alias("c"), F.min("n").alias("least")).where("c > 1 and least = 1").select("kh", (F.col("c") > MOST).alias("many"))
    wanted = regions.join(mixed, "kh").select("x.k1", "x.k2", F.struct("kh", "many", "n", "x.a", "x.back", "x.span").alias("w")).groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted"))
    contexts = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted").mapInArrow(released(_contexts(length)), "kh bigint, many boolean, n bigint, k1 bigint, k2 bigint, first int, span short, context binary")
    # members of too large buckets are counted elsewhere, so they are dealt out over all tasks
    dealt = contexts.repartition(n, "kh", F.when(F.col("many"), F.xxhash64("k1", "k2", "first")))
    refined_ = stored(dealt.sortWithinPartitions("kh").mapInArrow(released(_refine(length)), "k1 bigint, k2 bigint, first bigint, last bigint, n bigint, context binary"), "refined")
    ends = refined_.where("context is null").select("k1", "k2", "first", "last")
    hot = refined_.where("context is not null")
    whole = anchors_.join(regions.where("n > 1").select("kh", "rh", "rh2"), ["kh", "rh", "rh2"]).select("k1", "k2", (F.col("a") - F.col("back")).cast("bigint").alias("first"), (F.col("a") - F.col("back") + F.col("span")).cast("bigint").alias("last"))
    runs = whole.unionByName(ends)
    if not hot.isEmpty():
        runs = runs.unionByName(_by_place(hot, length))
    gathered = runs.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    return texts.join(gathered, ["k1", "k2"], "left").select("k1", "k2", "text", "copies", "runs").mapInArrow(released(_cut(length, with_text)), "k1 bigint, k2 bigint, n_removed bigint, n_spans bigint, kept_sha256 string, left string")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row (doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs.

    Null texts count as empty. Of equal rows and equal texts of ``length`` bytes or more all is removed, from
    the first as well, as each is found elsewhere. Shorter texts stay. Null and repeated ids are kept as they are; other columns
    are not looked at. An empty table gives an empty result."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = repeats(docs, t, length).drop("left")
    rows = docs.select(F.col(id_col).alias("doc_id"), *keys(t), F.octet_length(t).cast("bigint").alias("n_bytes"), F.when(F.octet_length(t) < length, F.sha2(F.encode(t, "UTF-8"), 256)).alias("own"))
    return rows.join(cut, ["k1", "k2"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"), F.coalesce("kept_sha256", "own").alias("kept_sha256"))


def without_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """All rows and columns of docs, ``text_col`` without its repeated bytes. Characters cut in two go. A null text stays
    null; a text of nothing but repeats is left empty. Other columns stay as they are, whatever their names."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    cut = repeats(docs, t, length, with_text=True).select("k1", "k2", "left")
    others = [c for c in docs.columns if c != text_col]
    short = F.when(F.octet_length(t) < length, F.col(text_col)).alias("short")
    rows = docs.select(*keys(t), whole(docs, others).alias("row"), short)
    columns = dict(zip(others, unpacked(others), strict=True)) | {text_col: F.coalesce("left", "short").alias(text_col)}
    return rows.join(cut, ["k1", "k2"], "left").select(*[columns[c] for c in docs.columns])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


# DuckDB: the 200-byte strings of every text by their checksums, then islands of places whose string starts anywhere else too.
OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT rid, i, md5(b[i + 1 : i + 200]) AS h FROM (SELECT rid, b, unnest(range(0, octet_length(b) - 199)) AS i FROM d WHERE octet_length(b) >= 200)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1
), edges AS (
  SELECT rid, i, i - lag(i) OVER (PARTITION BY rid ORDER BY i) AS gap FROM twice
), runs AS (
  SELECT rid, i, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM edges
), spans AS (
  SELECT rid, run, min(i) AS a, max(i) + 200 AS z FROM runs GROUP BY rid, run
), gone AS (
  SELECT rid, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM spans GROUP BY rid
), cut AS (
  SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, b,
         list_concat([0], coalesce(ends, [])) AS low, list_concat(coalesce(starts, []), [octet_length(b)]) AS high FROM d LEFT JOIN gone USING (rid)
)
SELECT doc_id, n_bytes, n_removed, n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(low) + 1), lambda k: CASE WHEN high[k] > low[k] THEN hex(b[low[k] + 1 : high[k]]) ELSE '' END), ''))) AS kept_sha256 FROM cut
"""
