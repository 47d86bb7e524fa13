"""Near-duplicate documents by MinHash: many universal hash minima, bands, checks, components.

Texts with one and the same shingle set form a class, by a 128-bit digest of the sorted set, and only the
class's first document goes on. Bands of signature values bring similar documents together. Within a
band's bucket no list of all pairs is made: every member is tried against one member, the lead, which is
that of most weight in all buckets, and the links that hold up join documents into components. Where a
bucket's other members still lie in several components, these are tried against each other: all members
of such buckets with one lead, whatever their number, form a group, which is compared block by block within
tasks. A try compares signatures first and full sets last.

With 40 bands of 5 minima a pair at similarity 0.8 shares no band with a chance of 1e-7, and at 0.9 of
1e-16. The signature check (at least 0.6 of the minima agree) passes a pair at 0.8 but for 1e-11.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, discard, id_and_bytes, node_of, slices, written
from .components import components
from .shingles import mix, shingle_sets

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
AGREE = int(0.6 * HASHES)
#: Shingles of the sets that a block of a group holds, about; bounds a task's memory.
BLOCK_SHINGLES = 1_000_000
_RND = np.random.default_rng(1729)
FACTOR = _RND.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSET = _RND.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of the universal hashes (a * x + b) >> 32 of 32 bits of each shingle's hash."""
    best = np.full(HASHES, np.uint64(2**64 - 1), np.uint64)
    x = shingles >> np.uint64(32)
    for at in range(0, len(x), 512):
        part = FACTOR[:, None] * x[None, at : at + 512]
        part += OFFSET[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best >> np.uint64(32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.arange(BANDS, dtype=np.uint64)
    for value in sig.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + value + np.uint64(1))
    return key.view(np.int64)


def signing(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            n, digest, sigs, keys = [], [], [], []
            for s in shingle_sets(piece.column("text").to_pylist(), width):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig = signature(s) if len(s) else np.zeros(HASHES, np.uint64)
                sigs.append(sig.astype(np.uint8).tobytes())
                keys.append(band_keys(sig).tobytes())
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(np.frombuffer(b"".join(keys), np.int64)))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sigs, pa.binary()), bands], ["id", "n", "digest", "sig", "bands"])

    return run


def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            yield batch.filter(pa.array((x == y).sum(axis=1) >= AGREE)).select(["a", "b"])


def set_maker(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(piece.column("text").to_pylist(), width)], pa.binary())], ["id", "shingles"])

    return run


def confirming(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def in_blocks(percent: int):
    """One block of a group against another: links between components that are not joined yet."""

    def run(left, right):
        import pandas as pd

        out = []
        if len(left) and len(right):
            (xs, ys), (xb, yb) = ([np.frombuffer(b"".join(s[c]), kind).reshape(len(s), -1) for s in (left, right)] for c, kind in (("sig", np.uint8), ("bands", np.int64)))
            flat = np.frombuffer(b"".join(right["shingles"]), np.uint64)
            ids, comp, n = right["id"].to_numpy(), right["comp"].to_numpy().copy(), right["n"].to_numpy()
            begin = np.cumsum(n) - n
            joined = left["comp"].to_numpy().copy()
            for k, (own_id, own_n, raw) in enumerate(zip(left["id"], left["n"], left["shingles"], strict=True)):
                near = np.flatnonzero((comp != joined[k]) & (np.minimum(n, own_n) * 100 >= np.maximum(n, own_n) * percent))
                near = near[(ys[near] == xs[k]).sum(axis=1) >= AGREE]
                near = near[(yb[near] == xb[k]).any(axis=1)]
                if not len(near):
                    continue
                # how many of each near set's shingles are in the own set
                own, size = np.frombuffer(raw, np.uint64), n[near]
                first = np.cumsum(size) - size
                x = flat[np.arange(size.sum()) + np.repeat(begin[near] - first, size)]
                shared = np.add.reduceat((own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x).astype(np.int64), first)
                for i in near[100 * shared >= percent * (len(own) + size - shared)].tolist():
                    if comp[i] != joined[k]:
                        out.append((min(own_id, ids[i]), max(own_id, ids[i])))
                        gone = comp[i]
                        comp[comp == gone], joined[joined == gone] = joined[k], joined[k]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


class NearDuplicates:
    """The steps over one table; each heavy intermediate is written to the shared folder once, and deleted
    when nothing needs it any more."""

    def __init__(self, df: DataFrame, width: int, percent: int, id_col: str, text_col: str):
        self.width, self.percent = width, percent
        self.texts = id_and_bytes(df.withColumn(id_col, node_of(id_col, text_col)), id_col, text_col)
        signed = written(self.texts.mapInArrow(signing(width), "id long, n long, digest binary, sig binary, bands array<long>"))
        classes = signed.filter("n > 0").groupBy("digest").agg(F.min("id").alias("rep"))
        same = (F.col("s.id") == F.col("c.rep")) & (F.col("s.digest") == F.col("c.digest"))
        self.reps = written(signed.alias("s").join(classes.alias("c"), same, "left_semi").select("id", "n", "sig", "bands").dropDuplicates(["id", "n", "sig", "bands"]))
        #: each row's id, size of set and class; no class without shingles
        self.rows = written(signed.select("id", "n", "digest").join(classes, "digest", "left").select("id", "n", "rep"))
        discard(signed)

    def tried(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b), those that agree in signature and then on their full sets."""
        sigs = self.reps.select("id", "n", "sig")
        a, b = (sigs.toDF(x, f"n_{x}", f"sig_{x}") for x in "ab")
        close = (F.least("n_a", "n_b") * 100) >= (F.greatest("n_a", "n_b") * self.percent)
        pairs = written(pairs.join(a, "a").join(b, "b").filter(close).select("a", "b", "sig_a", "sig_b").mapInArrow(agreeing, "a long, b long"))
        a, b = (self.sets.toDF(x, f"set_{x}") for x in "ab")
        out = written(pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b").mapInArrow(confirming(self.percent), "a long, b long"))
        discard(pairs)
        return out

    def links(self) -> DataFrame:
        """Links between class representatives that join all that is linked at all."""
        members = self.reps.select("id", F.explode("bands").alias("key")).distinct()
        sizes = members.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        met = written(members.join(sizes, "key").select("key", "id", "size"))
        # what is in many large buckets is the likeliest to be the text that others were made from
        weight = met.groupBy("id").agg(F.sum("size").alias("weight"))
        lead = met.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", F.xxhash64("id"))).alias("lead"))
        shared = written(met.join(lead, "key").filter("id <> lead").select("key", "id", "lead"))
        discard(met)
        ids = shared.select(F.col("id").alias("doc_id")).union(shared.select("lead")).distinct()
        self.sets = written(self.texts.join(ids, "doc_id", "left_semi").mapInArrow(set_maker(self.width), "id long, shingles binary").dropDuplicates())
        stars = shared.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
        first = self.tried(stars)
        second = self.within_groups(shared, first)
        discard(shared, self.sets)
        return first.union(second).union(self.several_texts())

    def within_groups(self, shared: DataFrame, first: DataFrame) -> DataFrame:
        """Links between members, other than the lead, of buckets in which several components are left.

        All such buckets with one lead form a group. The members outside its largest component meet all
        its members, block by block; full sets are at hand there, so that only links leave a block.
        """
        comp = components(first).select(F.col("node").alias("id"), "component")
        known = written(shared.join(comp, "id", "left").select("key", "id", "lead", F.coalesce("component", "id").alias("comp")))
        mixed = known.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
        rows = written(known.join(mixed, "key", "left_semi").select("lead", "id", "comp").distinct().join(self.reps.select("id", "n"), "id"))
        discard(known)
        counts = rows.groupBy("lead", "comp").agg(F.sum("n").alias("own"))
        main = counts.groupBy("lead").agg(F.max_by("comp", F.struct("own", "comp")).alias("main"), F.sum("own").alias("all"), (F.sum("own") - F.max("own")).alias("rest"))
        blocks = lambda total: F.ceil(F.col(total) / BLOCK_SHINGLES).cast("int")
        bands = F.expr("unhex(array_join(transform(bands, b -> lpad(hex(b), 16, '0')), ''))")
        sized = rows.join(main, "lead").filter("rest > 0").withColumns({"left": blocks("rest"), "right": blocks("all")})
        dealt = written(sized.select("lead", "id", "comp", "main", "left", "right").join(self.reps.select("id", "n", "sig", bands.alias("bands")), "id").join(self.sets, "id"))
        place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
        left = dealt.filter("comp <> main").withColumn("i", (place % F.col("left")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("right") - 1)))
        right = dealt.withColumn("j", (place % F.col("right")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("left") - 1)))
        columns = ["lead", "i", "j", "id", "comp", "n", "sig", "bands", "shingles"]
        left, right = left.select(columns).toDF(*columns), right.select(columns).toDF(*columns)
        out = written(left.groupBy("lead", "i", "j").cogroup(right.groupBy("lead", "i", "j")).applyInPandas(in_blocks(self.percent), "a long, b long"))
        discard(rows, dealt)
        return out

    def several_texts(self) -> DataFrame:
        """Links between the classes of one doc_id that stands for several texts."""
        of = self.rows.filter("rep is not null").select("id", "rep")
        split = of.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("id", "a")
        return of.join(split, "id").filter("rep <> a").select("a", F.col("rep").alias("b"))

    def result(self) -> DataFrame:
        """A row per input row: node (its number, see node_of), n, component."""
        joined = components(self.links()).withColumnRenamed("node", "rep")
        discard(self.reps)
        return self.rows.join(joined, "rep", "left").select(F.col("id").alias("node"), "n", F.coalesce("component", "rep", "id").alias("component"))


def near_duplicate_rows(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like :func:`near_duplicates`, but rows without an id keep the number that stands for them."""
    return NearDuplicates(df, width, percent, id_col, text_col).result()


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group rows whose shingle sets have a Jaccard similarity of at least ``percent`` hundredths.

    Words are runs of what is no ASCII white space, A-Z in lower case; a shingle is ``width`` words in a
    row, and a shorter text is one shingle. Returns a row per input row: doc_id (a whole number),
    n_shingles, component_id (the least doc_id that links reach) and kept (whether that is the row's
    own). Null and blank texts have no shingles, link with nothing and are kept. Rows that repeat a
    doc_id are one document with several texts, and all of them carry its result. Each text without a
    doc_id is a document of its own that comes after all others; its component_id is null where it links to
    no document with an id. Texts of any length are read whole; an empty table gives
    no rows; columns other than the two named are not looked at.
    """
    out = near_duplicate_rows(df, width, percent, id_col, text_col)
    back = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return out.select(back("node").alias("doc_id"), F.col("n").alias("n_shingles"), back("component").alias("component_id"), (F.col("node") == F.col("component")).alias("kept"))


def first_of_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text, and any others) without near duplicates.

    One row of each group stays: that of the least doc_id, or, in a group without ids, of the least
    number that stands for a text. Of rows that repeat a doc_id, or a text without one, the least by all columns stays.
    """
    found = near_duplicate_rows(docs, width, percent)
    of = found.groupBy("node").agg(F.count("*").alias("copies"), F.min("component").alias("component"))
    odd = written(of.filter("copies > 1 or node <> component"))
    name = f"node_{uuid.uuid4().hex}"
    marked = docs.withColumn(name, node_of()).join(odd.toDF(name, f"{name}_copies", f"{name}_component"), name, "left")
    marked = marked.filter(f"{name}_component is null or {name}_component = {name}")
    once = marked.filter(f"{name}_copies is null or {name}_copies = 1").select(docs.columns)
    again = marked.filter(f"{name}_copies > 1").groupBy(name).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return once.union(again)


#: The same groups for shingles of four words, in DuckDB; it joins all documents that share a shingle.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3]))) END AS s FROM words
), shingles AS (SELECT doc_id, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
  JOIN sets sa ON sa.doc_id = a.doc_id JOIN sets sb ON sb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(len(sa.s)) + any_value(len(sb.s)) - count(*))
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id, doc_id AS low FROM sets UNION SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.doc_id WHERE r.low < e.b
), least AS (SELECT doc_id, min(low) AS low FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, low AS component_id, doc_id = low AS kept FROM sets JOIN least USING (doc_id)
"""
