"""Token counts of documents in flat token files that have no index.

A flat token file is one run of 16-bit ids in which an end-of-document id follows each document. Files
are read in blocks that know nothing of documents. In each block all separators are found at once;
documents that lie within a block are counted there. What runs over a block's borders is stitched with a
prefix scan: the tokens before each block and the last separator before it, first over groups of blocks,
then over the blocks of each group.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_bytes, slices, written

#: Tokens of a block, and blocks of a group in the prefix scan.
BLOCK_TOKENS, GROUP_BLOCKS = 1 << 19, 1024
#: Blocks of files that a task reads, one after the other.
TASK_BLOCKS = 128
BLOCKS = "file string, block long, tokens binary, ends array<long>"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(ranks_bc, pattern: str, separator: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_bc.value, special_tokens={})
        name, block = f"part-{TaskContext.get().partitionId():06d}", 0
        held, size, ends = [], 0, []

        def cut(tokens: np.ndarray, done: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, block, tokens.astype("<u2").tobytes(), done), kinds, strict=True)], ["file", "block", "tokens", "ends"])

        for piece in slices(batches):
            for doc, raw in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                ids = np.array([*coder.encode_ordinary(raw.decode("utf-8", "replace")), separator], np.uint16)
                held.append(ids)
                size += len(ids)
                ends.append((size, doc))
                while size >= block_tokens:
                    flat = np.concatenate(held)
                    yield cut(flat[:block_tokens], [d for at, d in ends if at <= block_tokens])
                    block += 1
                    held, size = [flat[block_tokens:]], size - block_tokens
                    ends = [(at - block_tokens, d) for at, d in ends if at > block_tokens]
        if size:
            yield cut(np.concatenate(held), [d for _, d in ends])

    return run


def token_stream(df: DataFrame, ranks_path: str, pattern: str, separator: int, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode rows into one flat token stream for each partition, cut into blocks at any token.

    Returns file, block (from 0), tokens (packed little-endian unsigned 16-bit ids) and ends: the ids of
    the rows whose separator lies in the block, in order; the scan does not need them. Null and empty
    texts are documents of no tokens; a null id stays null; repeated rows repeat; texts of any length
    run over as many blocks as they need; an empty table gives no blocks.
    """
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    rows = id_and_bytes(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(encoding(ranks, pattern, separator, block_tokens), BLOCKS)


def reading(step: int):
    """Read each range (path, block) of ``step`` bytes, in the task that it was dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
                scheme, _, place = name.partition(":")
                system, place = (fs.LocalFileSystem(), "/" + place.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(name)
                with system.open_input_file(place) as file:
                    file.seek(block * step)
                    part = file.read(step)
                kinds = (pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((name, block, part, None), kinds, strict=True)], ["file", "block", "tokens", "ends"])

    return run


def read_token_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of flat token files of any size.

    Spark lists the files and deals ranges of them out; a task opens a file and reads its own ranges, one block
    at a time, so a file of any length is spread over many tasks. Files must lie where executors can
    open them: a shared mount, or a store that ``pyarrow.fs`` knows by its address. An empty file has no blocks.
    """
    step = 2 * block_tokens
    files = spark.read.format("binaryFile").load(path).select("path", F.ceil(F.col("length") / step).alias("n")).filter("n > 0")
    total = files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # two steps, so that no file makes one huge array
    groups = files.select("path", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / GROUP_BLOCKS))).alias("group"))
    first = F.col("group") * GROUP_BLOCKS
    blocks = groups.select("path", F.explode(F.sequence(first, F.least(first + GROUP_BLOCKS, F.col("n")) - 1)).alias("block"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BLOCKS))
    return blocks.repartition(tasks, "path", "block").mapInArrow(reading(step), BLOCKS)


def separators(separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, count, head, last, inner = [], [], [], [], []
            for content in batch.column("tokens"):
                ids = np.frombuffer(content.as_buffer(), "<u2")
                at = np.flatnonzero(ids == separator)
                size.append(len(ids))
                count.append(len(at))
                head.append(int(at[0]) if len(at) else None)
                last.append(int(at[-1]) if len(at) else None)
                inner.append((np.diff(at) - 1).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), batch.column("ends"), *[pa.array(c, pa.int64()) for c in (size, count, head, last)], pa.array(inner, pa.list_(pa.int64()))], ["file", "block", "ends", "size", "n", "head", "last", "inner"])

    return run


def count_documents(blocks: DataFrame, separator: int) -> DataFrame:
    """Token counts of all documents of blocked token files.

    ``blocks`` has file, block (in order within a file), tokens and ends. Returns file, ordinal (from 0
    within the file), n_tokens without the separator, closed, and doc_id where ends names it. Tokens
    after a file's last separator are one document that is not closed. Two separators in a row enclose a
    document of no tokens; empty files and tables give no rows.
    """
    scanned = written(blocks.mapInArrow(separators(separator), "file string, block long, ends array<long>, size long, n long, head long, last long, inner array<long>"))
    grouped = scanned.withColumn("part", F.floor(F.col("block") / GROUP_BLOCKS))
    # last separators as distances from a group's start, then from the file's start
    inside = Window.partitionBy("file", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = grouped.withColumns({"start": F.coalesce(F.sum("size").over(inside), F.lit(0)), "before": F.coalesce(F.sum("n").over(inside), F.lit(0))})
    local = local.withColumn("seen", F.max(F.col("start") + F.col("last")).over(inside))
    parts = local.groupBy("file", "part").agg(F.sum("size").alias("p_size"), F.sum("n").alias("p_n"), F.max(F.col("start") + F.col("last")).alias("p_last"))
    over = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"p_start": F.coalesce(F.sum("p_size").over(over), F.lit(0)), "p_before": F.coalesce(F.sum("p_n").over(over), F.lit(0))})
    parts = parts.withColumns({"p_seen": F.max(F.col("p_start") + F.col("p_last")).over(over), "is_last": F.col("part") == F.max("part").over(Window.partitionBy("file"))})
    whole = local.join(parts.select("file", "part", "p_start", "p_before", "p_seen", "is_last"), ["file", "part"])
    at = F.col("p_start") + F.col("start")
    carried = at - (F.coalesce(F.col("p_start") + F.col("seen"), F.col("p_seen"), F.lit(-1)) + 1)
    whole = whole.withColumns({"carried": carried, "ordinal": F.col("p_before") + F.col("before")})
    ended = whole.filter("n > 0").select("file", "ordinal", "ends", F.posexplode(F.concat(F.array(F.col("carried") + F.col("head")), "inner")).alias("i", "n_tokens"))
    closed = ended.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), F.get("ends", F.col("i")).alias("doc_id"), "n_tokens", F.lit(True).alias("closed"))
    final = whole.withColumn("is_end", F.col("is_last") & (F.col("block") == F.max("block").over(Window.partitionBy("file", "part"))))
    rest = F.when(F.col("n") > 0, F.col("size") - F.col("last") - 1).otherwise(F.col("carried") + F.col("size"))
    open_ = final.filter("is_end").select("file", (F.col("ordinal") + F.col("n")).alias("ordinal"), F.lit(None).cast("long").alias("doc_id"), rest.alias("n_tokens"), F.lit(False).alias("closed")).filter("n_tokens > 0")
    return closed.union(open_)
