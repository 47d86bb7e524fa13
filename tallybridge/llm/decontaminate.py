"""Benchmark decontamination by pigeonhole edit matching over words.

A benchmark item of m words may differ from a passage by a budget of k word edits. Cut into k + 1 pieces,
at least one piece stands unchanged in any such passage. Each exact piece hit names a stretch of the
document where the item could be; Myers' bit-parallel algorithm finds the least edit distance of the
whole item to any part of that stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_bytes, slices, written
from .licenses import words_of as ascii_words

#: Word edits allowed, as a share of the item's words.
BUDGET = 0.2
#: Items of fewer words match nothing; by default all are searched.
LEAST_WORDS = 1
#: Bytes of benchmark text searched at once; larger benchmarks are searched block by block.
BLOCK_BYTES = 16 << 20


def words_of(raw: bytes) -> list[bytes]:
    """Words without case, in any script."""
    return ascii_words(raw if raw.isascii() else raw.decode("utf-8", "replace").lower().encode())


def best_match(pattern: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text``, and where the first such part ends.

    Myers' bit vectors: bit i tells whether the distance grows or falls from pattern row i to i + 1.
    """
    m = len(pattern)
    equal: dict[bytes, int] = {}
    for i, w in enumerate(pattern):
        equal[w] = equal.get(w, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, at = m, 0
    for j, w in enumerate(text, 1):
        eq = equal.get(w, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        grow, fall = minus | (full & ~(d0 | plus)), plus & d0
        if grow & high:
            score += 1
        elif fall & high:
            score -= 1
        grow, fall = grow << 1 & full, fall << 1 & full
        plus, minus = (fall | (full & ~(d0 | grow))) & full, grow & d0
        if score < best:
            best, at = score, j
    return best, at


def allowed(budget: float, words: int) -> int:
    """Edits allowed in so many words (0.29 of 100 are 29, though the float product is less)."""
    return int(budget * words + 1e-9)


class Items:
    def __init__(self, items: list[tuple[int, bytes]], budget: float, least_words: int):
        self.items: list[tuple[int, list[bytes], int]] = []
        #: (item, offset) by the whole piece, and the lengths of pieces by their first one or two words
        self.pieces: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        self.lengths: dict[tuple[bytes, ...], set[int]] = {}
        self.single = False
        for item_id, raw in sorted(items):
            words = words_of(raw)
            if len(words) < max(1, least_words):
                continue
            k = allowed(budget, len(words))
            number = len(self.items)
            self.items.append((item_id, words, k))
            cuts = [i * len(words) // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                self.pieces.setdefault(tuple(words[a:b]), []).append((number, a))
                self.lengths.setdefault(tuple(words[a : min(b, a + 2)]), set()).add(b - a)
                self.single |= b - a == 1

    def places(self, words: list[bytes], number: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int]]:
        """The item's nearest place in words[low:high], and those beside it that do not overlap it."""
        item_id, pattern, k = self.items[number]
        if high - low < len(pattern) - k:
            return
        distance, end = best_match(pattern, words[low:high])
        if distance <= k:
            stretch = words[low : low + end]
            start = low + end - best_match(pattern[::-1], stretch[::-1])[1]
            yield item_id, len(pattern), distance, start, low + end - 1
            yield from self.places(words, number, low, start)
            yield from self.places(words, number, low + end, high)

    def find(self, words: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(item, words of the item, distance, first word, last word) of each place, without overlaps."""
        lengths, found, done = self.lengths, [], set()
        heads = [(i, pair) for i, pair in enumerate(zip(words, words[1:], strict=False)) if pair in lengths]
        if self.single:
            heads += [(i, (w,)) for i, w in enumerate(words) if (w,) in lengths]
        for at, head in heads:
            for n in lengths[head]:
                for number, offset in self.pieces.get(tuple(words[at : at + n]), ()):
                    # hits on one line through document and item name one stretch
                    if (number, at - offset) in done:
                        continue
                    done.add((number, at - offset))
                    _, pattern, k = self.items[number]
                    found += self.places(words, number, max(0, at - offset - k), min(len(words), at - offset + len(pattern) + k))
        kept: list[tuple[int, int, int, int, int]] = []
        last: dict[int, int] = {}
        for f in sorted(found, key=lambda f: (f[0], f[3], f[2], f[4])):
            if last.get(f[0], -1) < f[3]:
                kept.append(f)
                last[f[0]] = f[4]
            elif f[2] < kept[-1][2]:
                kept[-1] = f
                last[f[0]] = f[4]
        return kept


def searching(items_bc, budget: float, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(items_bc.value, budget, least_words)
        for piece in slices(batches):
            rows, of = [], []
            for i, raw in enumerate(piece.column("text").to_pylist()):
                got = items.find(words_of(raw))
                rows += got
                of += [i] * len(got)
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(of, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "item_id", "item_words", "distance", "first_word", "last_word"])

    return run


def dropping(items_bc, budget: float, least_words: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(items_bc.value, budget, least_words)
        for piece in slices(batches):
            texts = piece.column("text").cast(pa.binary()).to_pylist()
            yield piece.filter(pa.array([raw is None or not items.find(words_of(raw)) for raw in texts], pa.bool_())).select(names)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, least_words: int = LEAST_WORDS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find benchmark items, up to the edit budget, in each row's whole text.

    ``benchmark`` has item_id and text. Returns a row per place: the document's id, item_id,
    item_words, distance (in words), first_word and last_word; of overlapping places of one item the
    nearest stays. Words are those of ASCII letters and digits and of other characters, without case.
    The budget is the share of the item's words, rounded down, at every length. Items of fewer than
    ``least_words`` words match nothing; by default all are searched, those too short for an edit as
    exact word runs. Of places at equal distance the first stays. Texts of any length are searched whole,
    within one row; an empty table or benchmark gives no rows. Null or empty items match nothing; null
    and empty texts hold nothing; items and rows that repeat repeat. The benchmark
    goes to the tasks in blocks of ``block_bytes`` of text, each searched by a scan of its own, so that
    no more than that is broadcast at once.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    out = None
    for items_bc in benchmark_blocks(benchmark, budget, block_bytes):
        got = id_and_bytes(docs, id_col, text_col).mapInArrow(searching(items_bc, budget, least_words), f"doc_id {kind}, item_id long, item_words long, distance long, first_word long, last_word long")
        out = got if out is None else out.unionByName(got)
    return out


def benchmark_blocks(benchmark: DataFrame, budget: float, block_bytes: int) -> Iterator[Broadcast]:
    """The items (item_id, text) in broadcasts of about ``block_bytes`` of text, one after the other."""
    if not 0 <= budget < 1:
        raise ValueError("the budget must be at least 0 and less than 1: an item may not lose all its words")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).filter("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    for b in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        yield benchmark.sparkSession.sparkContext.broadcast([(r.item_id, bytes(r.text)) for r in block.collect()])


def without_leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, least_words: int = LEAST_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` (with text, and any others) that hold no benchmark item, as find_leaks sees it.

    Each row is judged by its own text, whatever its id; null and empty texts stay; repeated rows stay or
    go together; an empty benchmark drops nothing. Between two blocks of the benchmark the rows left are
    written to the shared folder, so that a task holds one block at a time.
    """
    for i, items_bc in enumerate(benchmark_blocks(benchmark, budget, block_bytes)):
        docs = (written(docs) if i else docs).mapInArrow(dropping(items_bc, budget, least_words, docs.columns), docs.schema)
    return docs
