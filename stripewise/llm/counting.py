"""Token counts of documents in flat token files.

A flat file is nothing but token ids of 16 bits, little endian, with an end-of-document id after each document: no
index, no header. That id is outside of the vocabulary, so no text can hold it, not even one with the string of a special token. Blocks of files are searched for that id as arrays, each in any task. A block knows where its separators
are but not what came before; a prefix scan over the blocks' few numbers (separators so far, the last separator)
stitches documents that cross blocks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import released, shared_path, shuffle_partitions, sliced, stored, table
from .tokens import default_path, encoder

#: End-of-document id: 16 bits hold it, the vocabulary doesn't.
END = 0xFFFF
#: Tokens of a block, and bytes after which a writer begins another file.
BLOCK = 4 << 20
FILE_BYTES = 1 << 30


def _writing(path: str, folder: str):
    def run(batches):
        encode = encoder(path)
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        out, name, ordinal = None, None, 0
        for batch in sliced(batches):
            rows = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                if out is None or out.tell() >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, ordinal = f"tokens-{uuid.uuid4().hex}.bin", 0  # another name for each attempt of a task
                    out = system.open_output_stream(f"{base}/{name}")
                out.write(np.append(encode(text), np.uint16(END)).astype("<u2").tobytes())
                rows.append((name, ordinal))
                ordinal += 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=[*batch.schema.names[:-1], "file", "ordinal"])
        if out is not None:
            out.close()

    return run


def write_flat(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Write the tokens of docs (null text: none) as flat files in folder, a URI; returns doc_id, file and ordinal of each row.

    The returned table is stored by Spark's commit protocol and names the files of attempts that counted; files of
    lost attempts are in no row of it."""
    taken = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    return stored(taken.mapInArrow(released(_writing(path or default_path(), folder)), f"doc_id {taken.schema[0].dataType.simpleString()}, file string, ordinal bigint"), "manifest")


def _blocks(folder: str, size: int):
    def run(batches):
        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                n = system.get_file_info(f"{base}/{name}").size // 2
                starts = np.arange(0, max(n, 1), size)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(starts)), pa.array(np.arange(len(starts))), pa.array(starts), pa.array(np.minimum(size, n - starts))], names=["file", "block", "start", "n"])

    return run


def _separators(folder: str, end: int):
    def run(batches):
        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, block, start, n in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                with system.open_input_file(f"{base}/{name}") as file:
                    data = np.frombuffer(file.read_at(2 * n, 2 * start), "<u2")
                at = np.flatnonzero(data == end) + start
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block]), pa.array([start + n]), pa.array([at], pa.list_(pa.int64()))], names=["file", "block", "stop", "at"])

    return run


def counted(files: DataFrame, folder: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, first, n_tokens, closed) of every document of the flat files(file) in folder.

    Two separators in a row enclose an empty document. Tokens after the last separator are one more document,
    with closed false. An empty file has none."""
    parts = files.select("file").distinct().mapInArrow(released(_blocks(folder, block)), "file string, block bigint, start bigint, n bigint")
    dealt = parts.repartition(shuffle_partitions(files.sparkSession), "file", "block")
    found = dealt.mapInArrow(released(_separators(folder, end)), "file string, block bigint, stop bigint, at array<bigint>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select(
        "file",
        "at",
        "stop",
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("ends"),
        F.coalesce(F.sum(F.size("at")).over(before), F.lit(0)).alias("seen"),
        F.coalesce(F.max(F.element_at(F.when(F.size("at") > 0, F.col("at")), -1)).over(before), F.lit(-1)).alias("last"),
    )
    inside = scanned.select("file", "seen", "last", "at", F.posexplode("at").alias("i", "p"))
    first = F.when(F.col("i") == 0, F.col("last")).otherwise(F.get("at", F.col("i") - 1)) + 1
    closed = inside.select("file", (F.col("seen") + F.col("i")).alias("ordinal"), first.alias("first"), (F.col("p") - first).alias("n_tokens"), F.lit(True).alias("closed"))
    last = F.greatest(F.col("last"), F.coalesce(F.array_max("at"), F.lit(-1)))
    rest = scanned.where("ends").select("file", (F.col("seen") + F.size("at")).alias("ordinal"), (last + 1).alias("first"), (F.col("stop") - last - 1).alias("n_tokens"), F.lit(False).alias("closed")).where("n_tokens > 0")
    return closed.unionByName(rest)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id and n_tokens of each row of docs, counted in flat files that are written first. Null and empty texts have
    0 tokens; null and repeated ids stay as they are; other columns are not looked at. An empty table has no rows. Very long
    texts, with white space of any length too, are tokenised whole, as the ``tokenizers`` library does; they may span blocks."""
    folder = shared_path(docs.sparkSession, "flat")
    folder = folder if "://" in folder else "file://" + folder
    manifest = write_flat(docs, folder, id_col, text_col, path)
    # the manifest packs so well that its files look small enough to broadcast; its rows are not
    return manifest.hint("merge").join(counted(manifest, folder, block=block), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
