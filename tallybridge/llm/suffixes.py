"""Exact removal of repeated byte strings with a distributed, sparse suffix array.

Only some suffixes are sorted. A string of MATCH bytes holds MATCH - GRAM + 1 grams; the one with the least
hash (the leftmost of equals) is its anchor, which depends on the string alone, so equal strings have
their anchors at equal places. A suffix is kept for each anchor. Its leading tokens are the GRAM bytes there,
as three words in the order of the text; the next two tokens are a 128-bit digest of all bytes that the strings
with this anchor cover.

Spark's sampled splitters range-partition the suffixes by leading tokens and, within these, by document, so that
tokens of any frequency spread over several buckets. Each bucket sorts its suffixes by multikey quicksort.
A suffix whose tokens all came before repeats all its strings. Suffixes that share the leading tokens alone
are compared string by string, on bytes; a bucket's first and last leading tokens may go on in its
neighbours and are compared across the border.

Suffixes are equal when their leading bytes and the digest are: a wrong match among n suffixes has a chance
of about n * n / 2**129, 1e-14 for the suffixes of 100 TB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import node_of, slices, written
from .shingles import BASE, BYTE, INVERSE, mix, powers

MATCH, GRAM = 100, 24
GRAMS = MATCH - GRAM + 1
#: Bytes hashed at a time; a longer document is cut into stretches whose strings overlap.
STRETCH = 1 << 20
#: Bits for a place in a slice, which holds less than twice a stretch and the strings' overlap.
PLACE_BITS = 22
#: Suffixes that a bucket should hold.
BUCKET_ROWS = 500_000
#: Suffixes compared in one task; a context that more of them share is grouped by strings instead.
COMPARED_ROWS = 25_000
#: Strings that start up to here before their anchor share what follows it, the others what precedes it.
HALF = 38
NO_ID = (1 << 63) - 1


_RND = np.random.default_rng(20240301)
#: A second hash of its own bytes and base; with the first one it makes 128 bits.
BYTE_2 = _RND.integers(1, 1 << 63, 256, dtype=np.uint64)
BASE_2 = np.uint64(0xD1342543DE82EF95)
INVERSE_2 = np.uint64(pow(int(BASE_2), -1, 1 << 64))
TOKENS = ["a", "b", "c", "one", "two"]
SUFFIX = ", ".join(f"{t} long" for t in [*TOKENS, "doc", "place"])


class RangeHash:
    """Hashes of any stretch of a byte array, from prefix sums."""

    def __init__(self, raw: np.ndarray, table: np.ndarray = BYTE, base: np.uint64 = BASE, inverse: np.uint64 = INVERSE):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[raw] * powers(base, len(raw))[:-1], dtype=np.uint64)])
        self.back = powers(inverse, len(raw))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def second_hash(raw: np.ndarray) -> RangeHash:
    return RangeHash(raw, BYTE_2, BASE_2, INVERSE_2)


def leading(raw: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """The GRAM bytes from each place as whole numbers that sort as the bytes do."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, GRAM)[place]).view(">u8").astype(np.uint64)
    return [np.ascontiguousarray(w) for w in (words ^ np.uint64(1 << 63)).view(np.int64).T]


def anchors(raw: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings that start at ``first`` (rising): tokens, place, first and last start."""
    hashed = RangeHash(raw)
    at = np.arange(len(raw) - GRAM + 1)
    gram = mix((hashed.sums[GRAM:] - hashed.sums[:-GRAM]) * hashed.back[: len(at)])
    bits = np.uint64(PLACE_BITS)  # the same in every slice, so that equal strings have equal anchors
    least = ((gram >> bits) << bits) | at.astype(np.uint64)
    del gram
    span = 1
    while 2 * span <= GRAMS:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (GRAMS - span)], least[GRAMS - span :])
    place = (least[first] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)]))
    last = np.concatenate([new[1:] - 1, [len(first) - 1]])
    place, low, high = place[new], first[new], first[last]
    shape = (place - low).astype(np.uint64) << np.uint64(8) | (high - low).astype(np.uint64)
    digest = [mix(h(low, high + MATCH) ^ shape * np.uint64(0x9E3779B97F4A7C15)).view(np.int64) for h in (hashed, second_hash(raw))]
    return [*leading(raw, place), *digest], place, low, high


def suffixes_of(ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(tokens, document, packed place) of all anchors.

    The packed place is place << 14 | (place - first start) << 7 | (place - last start).
    """
    out: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if group:
            lengths = np.array([len(t) for *_, t in group])
            at = np.concatenate([[0], np.cumsum(lengths)])
            first = np.concatenate([np.arange(a, a + n - MATCH + 1) for a, n in zip(at.tolist(), lengths.tolist(), strict=False)])
            tokens, place, low, high = anchors(np.frombuffer(b"".join([t for *_, t in group]), np.uint8), first)
            owner = np.searchsorted(at, place, side="right") - 1
            shift = np.array([s for _, s, _ in group])[owner] - at[owner]
            out.append((*tokens, np.array([d for d, *_ in group], np.int64)[owner], (place + shift) << 14 | (place - low) << 7 | (place - high)))
        group.clear()
        held = 0

    for doc, text in zip(ids.tolist(), texts, strict=True):
        for start in range(0, len(text) - MATCH + 1, STRETCH):
            part = text[start : start + STRETCH + MATCH - 1]
            group.append((doc, start, part))
            held += len(part)
            if held >= STRETCH:
                flush()
    flush()
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 7


def dealing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        columns = suffixes_of(piece.column("doc_id").to_numpy(), piece.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*TOKENS, "doc", "place"])


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several keys, by multikey quicksort.

    Every open segment is split by the pivot of its current key into less, equal and greater rows; the equal
    ones go on with the next key. All segments take a step together, so that a step is a few array passes.
    """
    keys = np.stack(columns)
    order = np.arange(keys.shape[1])
    start, size, depth = np.array([0]), np.array([len(order)]), np.array([0])
    while True:
        open_ = (size > 1) & (depth < len(keys))
        start, size, depth = start[open_], size[open_], depth[open_]
        if not len(start):
            return order
        ends = np.cumsum(size)
        begins = ends - size
        segment = np.repeat(np.arange(len(start)), size)
        at = np.arange(ends[-1]) + (start - begins)[segment]
        rows = order[at]
        key = keys[depth[segment], rows]
        low, middle, high = key[begins], key[begins + size // 2], key[ends - 1]
        pivot = np.maximum(np.minimum(low, middle), np.minimum(np.maximum(low, middle), high))[segment]
        target, counts, shift = np.empty_like(at), [], start.copy()
        for part in (key < pivot, key == pivot, key > pivot):
            seen = np.concatenate([[0], np.cumsum(part)])
            counts.append(seen[ends] - seen[begins])
            target[part] = ((shift - seen[begins])[segment] + seen[:-1])[part]
            shift += counts[-1]
        order[target] = rows
        less, equal, more = counts
        start, size, depth = np.concatenate([start, start + less, start + less + equal]), np.concatenate([less, equal, more]), np.concatenate([depth, depth + 1, depth])


#: What became of a suffix: all its strings came before; some may have; a neighbouring bucket may hold its equals.
REPEATED, PARTLY, OPEN = 0, 1, 2


def sorting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort a bucket and judge its suffixes; tokens stay only on those that are compared across a border."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    names = [*TOKENS, "doc", "place"]
    columns = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in names]
    del held
    order = multikey_order(columns)
    columns = [c[order] for c in columns]
    fresh = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])  # repeated rows of a table
    columns = [c[fresh] for c in columns]
    doc, place = columns[5:]
    new = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)])
    first = new | np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns[3:5]], axis=0)])
    group = np.cumsum(new) - 1
    border = (group == 0) | (group == group[-1])
    kind = np.where(~first, REPEATED, np.where(border, OPEN, np.where(np.bincount(group, first)[group] > 1, PARTLY, -1)))
    keep = kind >= 0
    kind, inside = kind[keep].astype(np.int32), kind[keep] != OPEN
    arrays = [pa.array(kind), *[pa.array(c[keep], mask=inside) for c in columns[:5]], pa.array(doc[keep]), pa.array(place[keep])]
    yield pa.RecordBatch.from_arrays(arrays, ["kind", *names])


def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For suffixes to compare: the bytes of their strings, under a key of what half of these share."""
    for piece in slices(batches):
        rows = []
        for doc, text, own in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), piece.column("own").to_pylist(), strict=True):
            for packed in own:
                at, back, low = packed >> 14, packed >> 7 & 127, packed & 127
                if low <= HALF:
                    # all strings of this half reach from the anchor to MATCH - HALF bytes beyond
                    rows.append((text[at : at + MATCH - HALF], doc, at, min(back, HALF), low, text[at - min(back, HALF) : at - low + MATCH]))
                if back > HALF:
                    low = max(low, HALF + 1)
                    rows.append((text[at - HALF - 1 : at + GRAM], doc, at, back, low, text[at - back : at - low + MATCH]))
        columns = zip(*rows, strict=True) if rows else ((),) * 6
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["common", "doc", "at", "back", "low", "bytes"])


def comparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings that stand earlier too, among suffixes with one leading token and one common half."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    doc, at, back, low = (np.concatenate([b.column(c).to_numpy() for b in held]).astype(np.int64) for c in ("doc", "at", "back", "low"))
    parts = [x for b in held for x in b.column("bytes").to_pylist()]
    del held
    begin = np.concatenate([[0], np.cumsum([len(x) for x in parts])])[:-1]
    raw = np.frombuffer(b"".join(parts), np.uint8)
    hashed, window = RangeHash(raw), np.arange(MATCH)
    out = []
    for offset in range(GRAMS):
        rows = np.flatnonzero((low <= offset) & (offset <= back))
        if len(rows) < 2:
            continue
        start = begin[rows] + back[rows] - offset
        key = hashed(start, start + MATCH)
        order = np.lexsort((at[rows], doc[rows], key))
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        if any((raw[start[order[s], None] + window] != raw[start[order[s + 1], None] + window]).any() for s in np.array_split(same, len(same) // 4096 + 1)):
            key = np.unique(raw[start[:, None] + window], axis=0, return_inverse=True)[1].ravel()  # two strings of one hash
            order = np.lexsort((at[rows], doc[rows], key))
        key, rows = key[order], rows[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        # the same place listed twice is no earlier place
        group = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]))
        head = rows[np.searchsorted(group, group[same + 1])]
        hit = rows[same + 1]
        hit = hit[(doc[hit] != doc[head]) | (at[hit] != at[head])]
        out.append((doc[hit], at[hit] - offset))
    if out:
        docs, starts = (np.concatenate(c) for c in zip(*out, strict=True))
        order = np.lexsort((starts, docs))
        docs, starts = docs[order], starts[order]
        new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + 1)])) if len(docs) else np.zeros(0, np.int64)
        last = np.concatenate([new[1:] - 1, [len(docs) - 1]]) if len(docs) else new
        yield pa.RecordBatch.from_arrays([pa.array(docs[new]), pa.array(starts[new]), pa.array(starts[last] + MATCH)], ["doc", "start", "stop"])


def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each single string of the suffixes to compare: its bytes, document and start."""
    for piece in slices(batches, "bytes", 1 << 18):
        doc, at, back, low = (piece.column(c).to_numpy().astype(np.int64) for c in ("doc", "at", "back", "low"))
        parts = piece.column("bytes").to_pylist()
        begin = np.concatenate([[0], np.cumsum([len(x) for x in parts])])[:-1]
        raw = np.frombuffer(b"".join(parts), np.uint8)
        count = back - low + 1
        row = np.repeat(np.arange(len(doc)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        own = np.lib.stride_tricks.sliding_window_view(raw, MATCH)[begin[row] + step].tobytes()
        each = pa.FixedSizeBinaryArray.from_buffers(pa.binary(MATCH), len(row), [None, pa.py_buffer(own)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([each, pa.array(doc[row]), pa.array((at - back)[row] + step)], ["string", "doc", "start"])


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[list[int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def cutting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for piece in slices(batches):
        rows, kept = [], []
        for text, own in zip(piece.column("text").to_pylist(), piece.column("spans").to_pylist(), strict=True):
            spans, parts, at = merged(own or []), [], 0
            for start, stop in spans:
                parts.append(text[at:start])
                at = stop
            kept.append(b"".join([*parts, text[at:]]))
            rows.append([{"start": a, "stop": b} for a, b in spans])
        n = [len(t) for t in piece.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([piece.column("given"), pa.array(n, pa.int64()), pa.array(rows, pair), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])


def compared(around: DataFrame, rows: int) -> DataFrame:
    """Spans of strings that stand earlier too, of suffixes that meet under a common context.

    A context of more than ``rows`` suffixes is not held by one task: its strings are grouped by their bytes,
    and all but the earliest of each are repetitions. Either way strings are compared whole.
    """
    spark = around.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * around.count() // rows))
    large = around.groupBy("common").agg(F.count("*").alias("n")).filter(F.col("n") > rows).select("common")
    few = around.join(large, "common", "left_anti").repartition(tasks, "common").drop("common")
    many = around.join(large, "common", "left_semi").select("doc", "at", "back", "low", "bytes").mapInArrow(strings, "string binary, doc long, start long")
    lead = many.groupBy("string").agg(F.min(F.struct("doc", "start")).alias("lead"))
    later = many.join(lead, "string").filter((F.col("doc") != F.col("lead.doc")) | (F.col("start") != F.col("lead.start")))
    return few.mapInArrow(comparing, "doc long, start long, stop long").union(later.select("doc", "start", (F.col("start") + MATCH).alias("stop")))


def find_repeats(texts: DataFrame, bucket_rows: int = BUCKET_ROWS, compared_rows: int = COMPARED_ROWS) -> DataFrame:
    """Spans (doc, start, stop) of strings that also start earlier; ``texts`` has doc_id and text bytes."""
    spark = texts.sparkSession
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // (GRAMS * bucket_rows)))
    dealt = texts.select("doc_id", "text").mapInArrow(dealing, SUFFIX)
    judged = written(dealt.repartitionByRange(buckets, "a", "b", "c", "doc", "place").mapInArrow(sorting, f"kind int, {SUFFIX}"))
    # leading tokens at a border: of equal suffixes in several buckets the earliest is no repetition
    open_ = judged.filter(F.col("kind") == OPEN)
    lead = open_.groupBy(*TOKENS).agg(F.min(F.struct("doc", "place")).alias("lead"))
    across = open_.join(lead, TOKENS).withColumn("is_lead", (F.col("doc") == F.col("lead.doc")) & (F.col("place") == F.col("lead.place")))
    whole = judged.filter(F.col("kind") == REPEATED).select("doc", "place").union(across.filter(~F.col("is_lead")).select("doc", "place"))
    at, back, low = F.shiftright("place", 14), F.shiftright("place", 7).bitwiseAND(F.lit(127)), F.col("place").bitwiseAND(F.lit(127))
    whole = whole.select("doc", (at - back).alias("start"), (at - low + MATCH).alias("stop"))
    partly = judged.filter(F.col("kind") == PARTLY).select("doc", "place").union(across.filter("is_lead").select("doc", "place"))
    own = partly.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("place").alias("own"))
    around = texts.join(own, "doc_id").select("doc_id", "text", "own").mapInArrow(surroundings, "common binary, doc long, at long, back int, low int, bytes binary")
    return whole.union(compared(written(around), compared_rows))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS, compared_rows: int = COMPARED_ROWS) -> DataFrame:
    """Cut from each row's whole text every string of MATCH bytes that also starts earlier.

    Earlier means in a row of smaller doc_id, or earlier in the same text; strings are judged on the
    input and may overlap. Returns a row per input row: doc_id (a whole number), n_bytes, removed
    (spans start, stop in bytes, none touching) and kept (the other bytes). Null texts are empty, and an empty
    table gives no rows. Texts of any length are taken whole, in stretches. Rows without doc_id come after all
    others, each text as a document of its own. Rows that repeat a doc_id are one document: the same text
    gives the same result again; of differing texts each loses what any of them loses at that place.
    Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    texts = df.select(node_of(id_col, text_col).alias("doc_id"), F.col(f"`{id_col}`").cast("long").alias("given"), text.alias("text"))
    spans = find_repeats(texts, bucket_rows, compared_rows).groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = texts.join(spans, "doc_id", "left").select("given", "text", "spans")
    return joined.mapInArrow(cutting, "doc_id long, n_bytes long, removed array<struct<start: long, stop: long>>, kept binary")


def digests(cut: DataFrame) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


