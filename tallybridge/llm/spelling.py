"""Group spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all distinct words that one deletion, replacement or insertion over
the observed alphabet makes of it. A candidate that is itself a word of the vocabulary is near by
construction, so a join on equality is all that is needed and no distance is computed.

Nearly all candidates are no words. Tasks hash each candidate without building it, from sums over the
word's ends, and ask a Bloom filter of the vocabulary; what passes is built, pre-aggregated and joined.
The filter has a bound on its size: a vocabulary too large for it lets more candidates pass to the join,
and no near word is ever lost. Being near is symmetric, so a candidate's emitters are its near words and
one exchange on the candidate serves both the join and the grouping.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_and_bytes, slices, tasks_for, written

#: Runs of letters, once A-Z is in lower case.
find_runs = re.compile("[a-zÀ-ÿ]+").findall
#: Words that a task counts before it hands the counts on.
COUNTED_WORDS = 200_000
#: Candidates that a task hashes at once.
PASS_CANDIDATES = 1 << 19
#: Bits of the filter for each word, most bits at all (128 MB to each executor), and bits of a block that tasks fill.
WORD_BITS, FILTER_BITS, BLOCK_BITS = 32, 1 << 30, 1 << 18
#: Words whose candidates one task makes.
TASK_WORDS = 20_000
#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WORD_COUNTS = "word string, n long"


def counting(modulus: int, least_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for piece in slices(batches):
            for doc, raw in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                start = zlib.crc32(b"" if doc is None else b"%d" % doc if isinstance(doc, int) else str(doc).encode(), 0)
                start = zlib.crc32(b":", start)
                for run, n in Counter(find_runs(raw.lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(run.encode(), start)
                    if modulus and h % modulus == 0:
                        run = run[: (at := h % len(run))] + run[at + 1 :]
                    if len(run) >= least_length:
                        words[run] += n
            if len(words) > COUNTED_WORDS:
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])
                words = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])

    return run


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, modulus: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of all texts with their counts: ``word``, ``n``.

    Words are runs of a-z and U+00C0 to U+00FF once A-Z is in lower case, of at least ``least_length``
    code points and ``least_count`` occurrences. Where ``modulus`` divides h, the crc32 of id, colon and
    run, the run loses its code point h modulo its length (0: none does). Null and empty texts
    have no words; a null id counts as the empty text; repeated rows count again; runs of any length count whole.
    """
    counted = id_and_bytes(docs, id_col, text_col).mapInArrow(counting(modulus, least_length), WORD_COUNTS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def code_values(codes: np.ndarray) -> np.ndarray:
    """A 64-bit number for each code point."""
    return mixed(mixed(codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)))


def powers(length: int) -> np.ndarray:
    out = np.full(length, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def filter_words(vocabulary_size: int) -> int:
    """64-bit words of the filter: a power of two, within the bound."""
    bits = min(FILTER_BITS, max(BLOCK_BITS, vocabulary_size * WORD_BITS))
    return 1 << max(0, (bits // 64 - 1).bit_length())


#: Two bits of a 64-bit word for each number of twelve bits.
TWO_BITS = (np.uint64(1) << (np.arange(4096, dtype=np.uint64) & np.uint64(63))) | (np.uint64(1) << (np.arange(4096, dtype=np.uint64) >> np.uint64(6)))


def filter_places(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The filter's word for each hash, and the four bits to look for there."""
    h = mixed(h)
    bits = TWO_BITS[((h >> np.uint64(40)) & np.uint64(4095)).astype(np.int64)] | TWO_BITS[(h >> np.uint64(52)).astype(np.int64)]
    return (h & np.uint64(size - 1)).astype(np.int64), bits


def by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Words of one length: their places, and their code points as a matrix."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, rows in groups.items():
        flat = np.frombuffer("".join(words[i] for i in rows).encode("utf-32-le"), np.uint32)
        yield rows, flat.reshape(len(rows), length)


def whole_hashes(codes: np.ndarray) -> np.ndarray:
    return (code_values(codes) * powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def filling(size: int):
    """Places and bits of the filter for batches of words, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            if not words:
                continue
            at, bits = filter_places(np.concatenate([whole_hashes(codes) for _, codes in by_length(words)]), size)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bits.view(np.int64))], ["at", "bits"])

    return run


def packing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block of the filter as bytes."""
    for batch in batches:
        packed = []
        for places in batch.column("places").to_pylist():
            block = np.zeros(BLOCK_BITS // 64, np.uint64)
            block[[p["at"] % len(block) for p in places]] = np.array([p["bits"] for p in places], np.int64).view(np.uint64)
            packed.append(block.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(packed, pa.binary())], ["block", "bits"])


def word_filter(words: DataFrame, rows: int) -> np.ndarray:
    """A Bloom filter of all words: each word sets four bits in one 64-bit place.

    Tasks fill its blocks; the driver gathers these, at most FILTER_BITS in all.
    """
    size, per = filter_words(rows), BLOCK_BITS // 64
    places = words.select("word").mapInArrow(filling(size), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits"))
    blocks = places.groupBy((F.col("at") / per).cast("long").alias("block")).agg(F.collect_list(F.struct("at", "bits")).alias("places"))
    out = np.zeros((size // per, per), np.uint64)
    for part in blocks.mapInArrow(packing, "block long, bits binary").toArrow().to_batches():
        for block, bits in zip(part.column("block").to_pylist(), part.column("bits").to_pylist(), strict=True):
            out[block] = np.frombuffer(bits, np.uint64)
    return out.ravel()


def neighbours(words: list[str], alphabet: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Distinct words one edit away that may be in the filter: places of their words, and the candidates.

    Of deletions in a run of one letter only the first counts, and of insertions beside an equal letter
    only the one before it, so each candidate of a word comes once.
    """
    values, size = code_values(alphabet), len(known)

    def passing(h: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where a candidate is valid and the filter may hold it."""
        at, bits = filter_places(h.ravel(), size)
        return np.nonzero((((known[at] & bits) == bits).reshape(h.shape)) & valid)

    for rows, codes in by_length(words):
        length = codes.shape[1]
        pow_ = powers(length + 1)
        step = max(1, PASS_CANDIDATES // max(1, (length + 1) * len(alphabet)))
        for base in range(0, len(rows), step):
            part, ids = codes[base : base + step], np.array(rows[base : base + step])
            texts = [words[i] for i in ids]
            weighted = code_values(part) * pow_[:length]
            before = np.concatenate([np.zeros((len(part), 1), np.uint64), np.cumsum(weighted, axis=1, dtype=np.uint64)], axis=1)
            whole = before[:, -1:]
            first = np.ones(part.shape, bool)
            first[:, 1:] = part[:, 1:] != part[:, :-1]
            found = passing(before[:, :-1] + (whole - before[:, 1:]) * np.uint64(INVERSE), first)
            yield ids[found[0]], [texts[r][:i] + texts[r][i + 1 :] for r, i in zip(*(x.tolist() for x in found), strict=True)]
            # the places of a very long word are taken a few at a time
            span = max(1, PASS_CANDIDATES // max(1, len(part) * len(alphabet)))
            for lo in range(0, length, span):
                own = part[:, lo : lo + span]
                h = whole[:, :, None] + (values - code_values(own)[:, :, None]) * pow_[lo : lo + own.shape[1], None]
                found = passing(h, own[:, :, None] != alphabet)
                yield ids[found[0]], [texts[r][: lo + i] + chr(c) + texts[r][lo + i + 1 :] for r, i, c in zip(found[0].tolist(), found[1].tolist(), alphabet[found[2]].tolist(), strict=True)]
            for lo in range(0, length + 1, span):
                upto = min(length + 1, lo + span)
                head = before[:, lo:upto]
                h = (head + (whole - head) * np.uint64(BASE))[:, :, None] + values * pow_[lo:upto, None]
                valid = np.ones(h.shape, bool)
                own = part[:, max(0, lo - 1) : upto - 1]
                valid[:, upto - lo - own.shape[1] :] = own[:, :, None] != alphabet
                found = passing(h, valid)
                yield ids[found[0]], [texts[r][: lo + i] + chr(c) + texts[r][lo + i :] for r, i, c in zip(found[0].tolist(), found[1].tolist(), alphabet[found[2]].tolist(), strict=True)]


def emitting(alphabet: list[int], known_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, known = np.array(alphabet, np.uint32), known_bc.value
        for batch in batches:
            words, n = batch.column("word"), batch.column("n")
            for rows, candidates in neighbours(words.to_pylist(), codes, known):
                if candidates:
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(candidates, pa.string()), words.take(at), n.take(at)], ["word", "near", "near_n"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """For each word its near words' number and its largest near word: ``word``, ``n``, ``n_near``, ``near``, ``near_n``.

    Two words are near if one inserted, deleted or replaced code point parts them. Of near words with
    equal counts the first in code-point order is taken; a word without near words has 0 and nulls.
    """
    alphabet = sorted(ord(r.c) for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect() if r.c)
    rows = words.count()
    known = words.sparkSession.sparkContext.broadcast(word_filter(words, rows))
    # a word has hundreds of candidates, so a small table is work for many tasks
    emitted = words.repartition(tasks_for(rows, TASK_WORDS)).mapInArrow(emitting(alphabet, known), "word string, near string, near_n long")
    # the smallest struct: largest count first, then the smallest word
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    candidates = emitted.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(candidates, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def variant_groups(words: DataFrame, factor: int = 2) -> DataFrame:
    """Group the words of a vocabulary (``word``, ``n``) by the word that each is most likely a variant of.

    Returns a row per word: ``word``, ``form`` (its largest near word, if that occurs at least ``factor``
    times as often; else null), ``root`` (the end of the chain of forms; the word itself if it has no
    form), ``n``, ``n_near`` and ``form_n``. Of equally frequent near words the first in code-point order is the
    form. An empty vocabulary gives no rows. Words of any length are handled, a few of their candidates at a time.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, so that chains of forms end")
    words = written(words)
    near = near_words(words)
    is_form = F.col("near_n") >= factor * F.col("n")
    found = written(near.select("word", F.when(is_form, F.col("near")).alias("form"), "n", "n_near", F.when(is_form, F.col("near_n")).alias("form_n")))
    roots = chain_ends(found.filter("form is not null").select("word", F.col("form").alias("to")))
    out = found.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def chain_ends(links: DataFrame) -> DataFrame:
    """Where the chain of links ``word`` -> ``to`` ends for each word, by doubling the links' reach.

    A link is open until its end is known to have no link of its own. Counts at least double along a chain
    of forms, so no chain has more than 62 links and seven rounds do.
    """
    links = written(links.select("word", "to", F.lit(True).alias("open")))
    while not links.filter("open").isEmpty():
        ahead = links.select(F.col("word").alias("to"), F.col("to").alias("next"), F.col("open").alias("next_open"))
        stepped = links.filter("open").select("word", "to").join(ahead, "to", "left")
        stepped = stepped.select("word", F.coalesce("next", "to").alias("to"), F.coalesce("next_open", F.lit(False)).alias("open"))
        before, links = links, written(links.filter("not open").unionByName(stepped))
        discard(before)
    return links.select("word", "to")


def report(docs: DataFrame) -> DataFrame:
    return variant_groups(vocabulary(docs))


#: The whole query in DuckDB. CRC-32 is linear: a key's value is the exclusive or of what each of its characters
#: contributes at its distance from the end. Near words meet on patterns with one place open, or on deletions.
SQL = """
WITH RECURSIVE runs AS (
  SELECT key, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run,
      concat(doc, ':', run) AS key
    FROM documents) GROUP BY key, run),
steps AS (
  SELECT b, 0 AS bit, b AS c FROM (SELECT CAST(range AS UBIGINT) AS b FROM range(256))
  UNION ALL SELECT b, bit + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END FROM steps WHERE bit < 8),
bytes AS (SELECT b, c FROM steps WHERE bit = 8),
longest AS (SELECT max(strlen(key)) AS most FROM runs),
shifted AS (
  SELECT b, 0 AS k, c FROM bytes
  UNION ALL SELECT s.b, s.k + 1, xor(s.c >> 8, t.c) FROM shifted s JOIN bytes t ON t.b = s.c & 255 WHERE s.k < (SELECT most FROM longest)),
begun AS (
  SELECT 0 AS k, CAST(4294967295 AS UBIGINT) AS c
  UNION ALL SELECT s.k + 1, xor(s.c >> 8, t.c) FROM begun s JOIN bytes t ON t.b = s.c & 255 WHERE s.k < (SELECT most FROM longest)),
signs AS (
  SELECT b AS sign, k, c FROM shifted WHERE b < 128
  UNION ALL SELECT a.b + 64, a.k, xor(a.c, l.c) FROM shifted a JOIN shifted l ON l.b = 195 AND l.k = a.k + 1 WHERE a.b BETWEEN 128 AND 191),
placed AS (SELECT key, unicode(substr(key, i, 1)) AS sign, strlen(substr(key, i + 1)) AS k FROM (SELECT key, unnest(range(1, length(key) + 1)) AS i FROM runs)),
hashed AS (SELECT key, bit_xor(c) AS c FROM placed JOIN signs USING (sign, k) GROUP BY key),
drawn AS (SELECT run, r.n, xor(xor(h.c, b.c), CAST(4294967295 AS UBIGINT)) AS h FROM runs r JOIN hashed h USING (key) JOIN begun b ON b.k = strlen(r.key)),
made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM drawn),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT p.word, q.word AS other FROM cuts p JOIN cuts q ON p.a = q.a AND p.z = q.z AND p.word <> q.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.a || c.z
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.a || c.z),
ranked AS (SELECT e.word, e.other, o.n, row_number() OVER (PARTITION BY e.word ORDER BY o.n DESC, e.other) AS place, count(*) OVER (PARTITION BY e.word) AS n_near FROM near e JOIN words o ON o.word = e.other),
formed AS (
  SELECT w.word, CASE WHEN r.n >= 2 * w.n THEN r.other END AS form, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chain AS (
  SELECT word, word AS root, 0 AS step FROM formed
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM formed f JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) c USING (word)"""
