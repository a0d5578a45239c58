"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into so few segments that of two fingerprints within the radius at least one
segment differs in at most one bit: ``radius // 2 + 1`` segments. Of every segment all one-wildcard variants
(the segment without one of its bits) are indexed; fingerprints that share a variant are compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import column, released, shuffle_partitions, sliced, stored, table

SEED = 42
#: Buckets up to this size are compared lag by lag, larger ones by search trees.
SMALL = 48
#: Members of a bucket that are compared in one task; larger buckets are cut into blocks.
BLOCK = 20_000

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_AT = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles with repeats.
    A text with fewer words is one shingle; without a word the fingerprint is 0."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    whole = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # blocks, as a text can be very long
        part = [digest(whole[a:b], SEED) for a, b in zip(first[k : k + (1 << 16)], last[k : k + (1 << 16)], strict=True)]
        octets = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        counts += np.einsum("kv,vb->kb", np.bincount((octets + _AT).ravel(), minlength=2048).reshape(8, 256), _BITS).ravel()
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in sliced(batches):
            texts = batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()
            marks = np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(marks)], names=[*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(df: DataFrame, text, shingle: int = 5, **keep) -> DataFrame:
    """The columns of ``keep`` (name=expression) and ``fp``, the fingerprint as a bigint, of each row."""
    taken = df.select(*[c.alias(k) for k, c in keep.items()], text.cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-1])
    return taken.mapInArrow(released(_fingerprints(shingle)), (schema + ", " if schema else "") + "fp bigint")


def segments(radius: int) -> list[tuple[int, int]]:
    """Bounds of the segments of 64 bits of which one differs in at most one bit."""
    m = radius // 2 + 1
    cuts = [round(64 * k / m) for k in range(m + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _variants(fp, radius: int):
    """An array of 64 keys, one for each bit taken out: the bit's number and what its segment has besides."""
    keys = []
    for low, high in segments(radius):
        for bit in range(low, high):
            mask = ((1 << high) - (1 << low)) & ~(1 << bit)
            keys.append(F.shiftrightunsigned(fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)), low) + F.lit(bit << 56))
    return F.array(*keys)


def _tree(marks: np.ndarray, radius: int):
    """Links that connect what links within the radius connect, a forest: each mark searches those not yet reached."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rest = marks
    while rest.size:
        open_, rest = [rest[0]], rest[1:]
        while open_ and rest.size:
            at = open_.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                new = rest[near]
                found.append((np.full(new.size, at), new))
                open_.extend(new)
                rest = rest[~near]
    return found


def _first_variant(differ: np.ndarray, radius: int) -> np.ndarray:
    """The lowest variant that two fingerprints share, from their difference; 64 if none."""
    out = np.full(differ.size, 64, np.int64)
    for low, high in reversed(segments(radius)):
        part = (differ >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        n = np.bitwise_count(part)
        out[n == 0] = low
        one = n == 1
        out[one] = low + np.log2(part[one].astype(np.float64)).astype(np.int64)
    return out


def _compare(keys: np.ndarray, marks: np.ndarray, radius: int, once: bool):
    """Links within the buckets of sorted keys. once: a pair of a small bucket counts at its first variant only."""
    if not keys.size:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(bounds)
    found = []
    for k in np.flatnonzero(sizes > SMALL):
        found += _tree(marks[bounds[k] : bounds[k + 1]], radius)
    small = np.repeat(sizes <= SMALL, sizes)
    if not small.all():
        keys, marks = keys[small], marks[small]
    for lag in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        here = np.flatnonzero(keys[lag:] == keys[:-lag])
        if not here.size:
            break
        a, b = marks[here], marks[here + lag]
        near = np.bitwise_count(a ^ b) <= radius
        here, a, b = here[near], a[near], b[near]
        if once:
            first = _first_variant(a ^ b, radius) == keys[here] >> 56
            a, b = a[first], b[first]
        found.append((a, b))
    return tuple(np.concatenate(x) if x else np.empty(0, np.uint64) for x in (zip(*found, strict=True) if found else ((), ())))


def _bucket_links(radius: int):
    """Links of sorted (key, fp); members of buckets above BLOCK come out as they are (key not null)."""

    def out(a, b, key=None):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(key, pa.int64()) if key is not None else pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])

    def run(batches):
        hot, hot_key = False, None
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(keys, marks):
            a, b = _compare(keys, marks, radius, True)
            if a.size:
                yield out(a, b)

        for batch in batches:
            keys, marks = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
            while keys.size:
                if hot:
                    n = int(np.searchsorted(keys, hot_key, "right"))
                    if n:
                        yield out(marks[:n], marks[:n], keys[:n])
                    keys, marks = keys[n:], marks[n:]
                    hot = not keys.size
                    continue
                held.append((keys, marks))
                keys, marks = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(keys, keys[-1]))
                yield from flush(keys[:cut], marks[:cut])
                held = [(keys[cut:], marks[cut:])]
                if keys.size - cut > BLOCK:
                    hot, hot_key = True, keys[-1]
                    yield out(marks[cut:], marks[cut:], keys[cut:])
                    held = []
                keys = keys[:0]
        for keys, marks in held:
            yield from flush(keys, marks)

    return run


def _block_links(radius: int):
    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            if batch.num_rows:
                held.append(tuple(np.asarray(batch.column(k)) for k in range(4)))
            if held:
                got = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = (got[0] == got[0][-1]) & (got[1] == got[1][-1]) & (got[2] == got[2][-1])
                cut = int(np.argmax(last))
                yield from trees([x[:cut] for x in got])
                held = [tuple(x[cut:] for x in got)]
        if held:
            yield from trees([np.concatenate(x) for x in zip(*held, strict=True)])

    def trees(got):
        if not got[0].size:
            return
        new = np.flatnonzero(np.r_[True, (got[0][1:] != got[0][:-1]) | (got[1][1:] != got[1][:-1]) | (got[2][1:] != got[2][:-1]), True])
        for low, high in zip(new, new[1:], strict=False):
            for a, b in _tree(got[3][low:high].view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def links(marks: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) between the different fingerprints of marks(fp) that connect all within the radius.

    Every pair within the radius is connected by links, though in large buckets only through others: a bucket
    yields a forest and never all its pairs. A bucket above BLOCK members is cut into blocks, and each pair
    of blocks is compared in a task of its own."""
    spark = marks.sparkSession
    n = shuffle_partitions(spark)
    # marks may be few files; each row becomes 64
    keyed = marks.repartition(n).select("fp", F.explode(_variants(F.col("fp"), radius)).alias("key"))
    sorted_ = keyed.select("key", "fp").repartition(n, "key").sortWithinPartitions("key", "fp")
    got = stored(sorted_.mapInArrow(released(_bucket_links(radius)), "a bigint, b bigint, key bigint"), "buckets")
    plain = got.where("key is null").select("a", "b")
    hot = got.where("key is not null").select("key", F.col("a").alias("fp"))
    counts = hot.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    if counts.isEmpty():
        return plain
    placed = hot.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    paired = placed.select("key", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))).alias("p"), "fp")
    blocks = paired.select("key", "p.i", "p.j", "fp").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return plain.unionByName(blocks.mapInArrow(released(_block_links(radius)), "a bigint, b bigint"))


def classes(rows: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, component_id, n) of each fingerprint of rows(id, fp): component_id is the smallest id of all rows
    whose fingerprints are connected by steps of at most ``radius`` bits, n the rows with that fingerprint."""
    own = stored(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "marks")
    roots = components(links(own.select("fp"), radius))
    named = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return named.join(lowest, "root").select("fp", "component_id", "n")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 4) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) for each row of docs. Ids may be of any type that has an order.

    A null text and a text without words have fingerprint zero and link like any other. Null ids are kept; a
    component of null ids only has a null component_id. Repeated rows come out as often as they come in. Texts of any
    length count whole. Other columns of docs, whatever their names, play no part. An empty table gives an empty table."""
    rows = stored(fingerprints(docs, column(text_col), shingle, id=column(id_col)), "fingerprints")
    named = classes(rows, radius)
    return rows.join(named, "fp").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
