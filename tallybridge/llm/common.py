"""Helpers shared by the training-data operators: reading tables and walking Arrow batches.

Every operator takes a DataFrame, selects the columns it needs by name and ignores all others, so
extra columns with any names are harmless. A null text counts as the empty text.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task handles at once; bounds the numpy scratch space of every operator.
SLICE_BYTES = 2 << 20
#: Numbers from here on stand for rows without an id inside operators that link or compare rows.
NO_ID = 1 << 62


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the text as UTF-8 bytes (null: empty)."""
    return df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"),
    )


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about ``limit`` bytes (or one longer row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the session names in spark.checkpoint.dir.

    A temporary one is set only where that setting is absent and all tasks run in the driver's own
    process, as in local tests; on a cluster without the setting this is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            configured = tempfile.mkdtemp(prefix="spark-ckpt-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` made and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks_for(rows: int, rows_per_task: int = 250_000) -> int:
    """So many tasks for a table of small rows; few rows in many tasks cost more files than data."""
    return max(1, -(-rows // rows_per_task))


def node_of(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A row's whole-number id; rows without one get a number beyond 2**62 that their text decides.

    Rows that repeat an id are one document; rows without id are documents of their own, one for each text.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text), 3))
