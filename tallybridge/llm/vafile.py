"""Exact top-k inner products with vector-approximation files.

Vectors are dealt into shards, and each shard is written once as a row: the cell number of every component on a
grid over that component's range, a byte each, and apart from these the exact vectors. Shards stay where they
are; queries pass over them in broadcast blocks of bounded size. A block scans the cells for an upper and a lower
bound of each score; exact vectors are read in the order of their bounds, until the kth best exact score
cannot be beaten by any vector not read. The shards' best k are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Most vectors of a shard on average, and most queries of a broadcast block; both hold at most so many components.
SHARD_ROWS, QUERY_ROWS, COMPONENTS = 16384, 8192, 1 << 20
#: Queries whose bounds stand in memory at a time.
BOUNDED = 128
#: Cells of a component's range: as many as a byte tells apart.
CELLS = 256
#: Exact vectors read at a time.
READ = 64
SCALE = 1024
#: Scores beyond these stop there.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and its vector as whole numbers floor(scale * x); odd vectors are left out.

    Left out: null ids, null vectors, and vectors that hold null, NaN or an infinity. Components beyond 2**62
    stop there. Vectors without components take part, among themselves.
    """
    top = float(1 << 62)
    x = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (v != float("inf")) & (v != float("-inf")))
    return (
        df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), x.alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
        .select("vec_id", F.transform("x", lambda v: F.floor(F.greatest(F.lit(-top), F.least(F.lit(top), v * float(scale)))).cast("long")).alias("v"))
    )


def packing(shard: pd.DataFrame) -> pd.DataFrame:
    """One row for a shard: ids, cells with their grid, and exact vectors."""
    vectors = np.stack(list(shard["v"])).astype(np.int64)
    low = vectors.min(axis=0).astype(float)
    width = np.maximum((vectors.max(axis=0).astype(float) - low) / CELLS, 1e-9)
    cells = np.clip((vectors - low) / width, 0, CELLS - 1).astype(np.uint8)
    most = max(abs(int(vectors.min())), abs(int(vectors.max()))) if vectors.size else 0
    return pd.DataFrame({"dim": [vectors.shape[1]], "most": [most], "ids": [shard["vec_id"].to_numpy(np.int64).tobytes()], "low": [low.tolist()], "width": [width.tolist()], "cells": [cells.tobytes()], "exact": [vectors.tobytes()]})


SHARD = "dim int, most long, ids binary, low array<double>, width array<double>, cells binary, exact binary"


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of queries with all vectors of a shard's cells.

    The product over cells is taken in single precision where components are ``small``.
    """
    kind, unit = (np.float32, 2.0**-23) if small else (np.float64, 2.0**-52)
    steps = queries * width
    centre = (steps.astype(kind) @ cells.T.astype(kind)).astype(float) + (queries @ (low + 0.5 * width))[:, None]
    # half a cell in every component, and room for rounding
    size = np.abs(queries) @ (np.abs(low) + CELLS * width)
    reach = 0.5 * np.abs(steps).sum(axis=1) + (queries.shape[1] + 8) * (unit * CELLS * np.abs(steps).sum(axis=1) + 2.0**-50 * size) + 1e-6 * (1 + np.abs(queries).sum(axis=1))
    return centre - reach[:, None], centre + reach[:, None]


def best(vectors: np.ndarray, query: np.ndarray, upper: np.ndarray, floor: float, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) for one query, reading exact vectors by falling upper bound."""
    order = np.flatnonzero((upper >= floor) & (ids != own))
    order = order[np.argsort(-upper[order], kind="stable")]
    found: list[tuple[int, int]] = []
    for at in range(0, len(order), READ):
        if len(found) >= k and upper[order[at]] < -found[k - 1][0] < MOST:
            break
        part = order[at : at + READ]
        exact = vectors[part] @ query
        found = sorted({*found, *((-min(max(int(s), LEAST), MOST), int(i)) for s, i in zip(exact, ids[part], strict=True))})[:k]
    return [(-s, i) for s, i in found]


def search(block, k: int):
    """Meet every shard with a broadcast block: for each dimension the queries' ids and vectors."""

    def one(shard: dict, own: np.ndarray, asked: np.ndarray) -> Iterator[tuple[int, int, int]]:
        dim = shard["dim"]
        ids = np.frombuffer(shard["ids"], np.int64)
        cells = np.frombuffer(shard["cells"], np.uint8).reshape(len(ids), dim)
        exact = np.frombuffer(shard["exact"], np.int64).reshape(len(ids), dim)
        low, width = np.array(shard["low"]), np.array(shard["width"])
        # doubles where every sum of products is exact in them, else Python's whole numbers
        most = max(abs(int(asked.min())), abs(int(asked.max())), 1) if asked.size else 1
        small = max(shard["most"], most) ** 2 * dim < 1 << 52
        kind = np.float64 if small else object
        vectors, queries = exact.astype(kind), asked.astype(kind)
        for at in range(0, len(own), BOUNDED):
            lower, upper = bounds(asked[at : at + BOUNDED].astype(float), cells, low, width, small)
            lower[ids[None, :] == own[at : at + BOUNDED, None]] = -np.inf
            floor = np.partition(lower, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(lower), -np.inf)
            for q in range(len(lower)):
                for score, i in best(vectors, queries[at + q], upper[q], floor[q], ids, own[at + q], k):
                    yield int(own[at + q]), i, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard = batch.slice(row, 1).to_pylist()[0]
                if shard["dim"] in block.value:
                    found = np.array(list(one(shard, *block.value[shard["dim"]])), np.int64).reshape(-1, 3)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(found.T)], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k rows of ``vectors`` with the largest inner product with each row of ``queries``.

    Both have vec_id (whole number) and v (whole numbers). Returns query_id, rank (from 1), vec_id and
    score; of equal scores the smaller vec_id comes first; a query with fewer candidates gets all. A row
    with the query's own vec_id is no candidate, and only vectors with as many components are. Rows that
    repeat an id and its vector count once. Empty tables give no rows. Sums are exact; a score beyond the range of
    a long stops at its end, and such ties go to the smaller vec_id as well.
    """
    spark = vectors.sparkSession
    queries = written(queries.dropDuplicates(["vec_id", "v"]))
    asked = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    stored = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    fit = lambda row, most: max(1, -(-row.n // max(1, min(most, COMPONENTS // (row.dim or 1)))))
    shards, blocks = fit(stored, shard_rows), fit(asked, query_rows)
    dealt = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")
    rows = vectors.dropDuplicates(["vec_id", "v"]).select("vec_id", "v", F.size("v").alias("dim"), dealt(shards).alias("shard"))
    # one file for some shards: enough for all cores in a small table, not too small ones in a large table
    parts = max(min(shards, 2 * spark.sparkContext.defaultParallelism), -(-shards // 16))
    files = written(rows.repartition(parts, "dim", "shard").groupBy("dim", "shard").applyInPandas(packing, SHARD))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = []
    for number in range(blocks):
        block = queries.filter(dealt(blocks) == number).toPandas()
        held = {int(d): (g["vec_id"].to_numpy(np.int64), np.stack(list(g["v"])).astype(np.int64)) for d, g in block.groupby(block["v"].map(len))}
        held_bc = spark.sparkContext.broadcast(held)
        found = files.mapInArrow(search(held_bc, k), "query_id long, vec_id long, score long").distinct()
        ranked.append(written(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)))
        held_bc.destroy()  # its rows are written, so no task reads the block again
    # an id with several vectors may stand in several blocks
    last = reduce(DataFrame.union, ranked).drop("rank").distinct().withColumn("rank", F.row_number().over(order))
    return last.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(embeddings: DataFrame, k: int = 10) -> DataFrame:
    """Search all vectors for every hundredth one."""
    vectors = quantised(embeddings)
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"), k)


SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
