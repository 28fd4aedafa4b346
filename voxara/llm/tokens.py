"""Token counts from flat token files by a separator scan (operator 1).

A flat file holds fixed-width token ids of many documents, each closed by an
end-of-document id, with no index. Blocks of the files are scanned on their
own: a vectorised search gives each block's separators and the lengths between
them. An exclusive prefix sum of the separator counts then numbers every piece
of a document, and pieces at block edges are added up by that number.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxara.llm.common import fresh_folder, lean, own_columns, stored

# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
BLOCK_BYTES = 4 << 20
#: Blocks per group of the two-level prefix sum.
GROUP = 1024


def rank_encoder(path: str) -> Callable[[str], list[int]]:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def write_token_files(docs: DataFrame, folder: str, make_encoder: Callable[[], Callable[[str], list[int]]], end: int = END, dtype: str = "<u2") -> DataFrame:
    """Writes one flat file per partition and returns what it wrote: file, doc_no, doc_id.

    A null or empty text is a lone separator. An id that the type can't hold
    raises an error. A file appears under its name
    only when it is whole, so a task that runs again replaces it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encode, (store, root) = make_encoder(), fs.FileSystem.from_uri(folder)
        name = f"part-{context.partitionId():06d}.bin"
        store.create_dir(root, recursive=True)
        mine, at = f"{root}/.{name}.{context.taskAttemptId()}", 0
        with store.open_output_stream(mine) as out:
            for b in batches:
                texts = b.column(1).to_pylist()
                for text in texts:
                    ids = np.array([*encode(text or ""), end], np.int64)
                    if ids.max() > np.iinfo(dtype).max or (ids[:-1] == end).any():
                        raise ValueError(f"a token's id doesn't fit into {dtype}, or is the separator's")
                    out.write(ids.astype(dtype).tobytes())
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(at, at + n), pa.int64()), b.column(0).cast(pa.int64())], names=["file", "doc_no", "doc_id"])
                at += n
        store.move(mine, f"{root}/{name}")

    return own_columns(docs, "doc_id", "text").mapInArrow(lean(run), "file string, doc_no long, doc_id long")


def token_blocks(spark: SparkSession, folder: str, block_bytes: int, width: int) -> DataFrame:
    """(file, block, at, size) of all flat files in a folder."""
    store, root = fs.FileSystem.from_uri(folder)
    files = [(f.base_name, f.size) for f in store.get_file_info(fs.FileSelector(root)) if f.is_file and not re.match(r"[._]", f.base_name)]
    if any(size % width for _, size in files):
        raise ValueError("a file's size is not a multiple of the token width")
    step = max(width, block_bytes // width * width)
    listed = spark.createDataFrame([(f, s) for f, s in files if s], "file string, bytes long")
    cut = listed.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(bytes - 1) div {step}"))).alias("block"))
    return cut.select("file", "block", (F.col("block") * step).alias("at"), F.least(F.lit(step), F.col("bytes") - F.col("block") * step).alias("size"))


def separator_scan(spark: SparkSession, folder: str, end: int = END, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Tokens of every document in the flat files: file, doc_no (from 0), n_tokens, closed.

    Separators don't count. Tokens after a file's last separator are a document
    that isn't closed; nothing after it is no document. Empty files have none.
    """
    width = np.dtype(dtype).itemsize
    blocks = token_blocks(spark, folder, block_bytes, width)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            lengths = []
            for name, at, size in zip(b.column("file").to_pylist(), b.column("at").to_pylist(), b.column("size").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    tokens = np.frombuffer(f.read_at(size, at), dtype)
                ends = np.flatnonzero(tokens == end)
                lengths.append(np.diff(np.concatenate([[-1], ends, [len(tokens)]])) - 1)
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array(lengths, pa.list_(pa.int64()))], names=["file", "block", "pieces"])

    n = spark.sparkContext.defaultParallelism
    scanned = stored(blocks.repartition(max(n, 4 * n), "file", "block").mapInArrow(lean(scan), "file string, block long, pieces array<bigint>"), "pieces")
    counts = scanned.select("file", "block", (F.col("block") / GROUP).cast("long").alias("group"), (F.size("pieces") - 1).cast("long").alias("ends"))
    # Exclusive prefix sums: over groups of blocks, then within each group.
    sums = counts.groupBy("file", "group").agg(F.sum("ends").alias("in_group"))
    offsets = sums.select("file", "group", (F.sum("in_group").over(W.partitionBy("file").orderBy("group")) - F.col("in_group")).alias("before_group"))
    within = F.sum("ends").over(W.partitionBy("file", "group").orderBy("block")) - F.col("ends")
    numbered = counts.withColumn("before", within).join(offsets, ["file", "group"]).select("file", "block", (F.col("before") + F.col("before_group")).alias("first"))
    piece = scanned.join(numbered, ["file", "block"]).select("file", "first", F.size("pieces").alias("n"), F.posexplode("pieces").alias("k", "tokens"))
    each = piece.select("file", (F.col("first") + F.col("k")).alias("doc_no"), "tokens", (F.col("k") < F.col("n") - 1).alias("closed"), ((F.col("k") > 0) & (F.col("k") < F.col("n") - 1)).alias("whole"))
    stitched = each.where("not whole").groupBy("file", "doc_no").agg(F.sum("tokens").alias("n_tokens"), F.max("closed").alias("closed"))
    return each.where("whole").select("file", "doc_no", F.col("tokens").alias("n_tokens"), "closed").union(stitched.where("closed or n_tokens > 0"))


def count_tokens(docs: DataFrame, ranks_path: str, end: int = END, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Tokens of every document: written to flat files, then counted from the files alone.

    Returns doc_id, n_tokens; a row per row of the table.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "tokens")
    wrote = stored(write_token_files(docs, folder, lambda: rank_encoder(ranks_path), end), "manifest")
    if wrote.isEmpty():
        return wrote.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    return separator_scan(spark, folder, end, block_bytes=block_bytes).join(wrote, ["file", "doc_no"]).select("doc_id", "n_tokens")
