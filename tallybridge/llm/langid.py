"""Language identification with unigrams over pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The likelihood of a word
is the sum over all ways to cut it into pieces of the product of their probabilities; a forward pass
from left to right gives it. The probabilities are learned by expectation maximisation: a forward and a
backward pass give the expected number of uses of every piece, from uniform ones at first.

A trie over the letter pieces, of any length, finds all pieces in many words at once. Runs of letters are
never cut: every sixteen letters the passes scale their sums and keep the logarithm of the scale.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import pair_hash, slots
from .common import id_and_bytes, slices

#: Letters after which a pass scales its sums.
SCALED = 16
#: Letters (with padding) that a pass takes at once; bounds its arrays.
PASS_LETTERS = 1 << 18
#: Probability of a letter that the vocabulary lacks, alike in all languages.
UNKNOWN = 1e-9
MEMO_WORDS = 250_000
#: Training reads the whole texts of at most so many labelled documents of a language.
TRAIN_DOCS = 400
#: Parts in which the rows of a language are ranked for the sample.
PARTS = 256
EM_ROUNDS = 4


def read_pieces(path: str) -> list[str]:
    """The lower-cased letter pieces of a sentencepiece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).strip("▁").lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if p.isalpha())


class Lattice:
    """A trie of pieces, and passes over all pieces of many words for all languages at once."""

    def __init__(self, pieces: list[str]):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.unknown = len(pieces)
        child: dict[int, int] = {}
        piece_of = [-1]
        for piece, number in self.index.items():
            node = 0
            for c in piece:
                key = node << 21 | ord(c)
                if (below := child.get(key)) is None:
                    below = child[key] = len(piece_of)
                    piece_of.append(-1)
                node = below
            piece_of[node] = number
        self.piece_of = np.array(piece_of, np.int64)
        keys = np.fromiter(child, np.int64, len(child))
        self.hash = pair_hash(keys, np.fromiter(child.values(), np.int32, len(child)), bits=max(4, (2 * len(child)).bit_length()))

    def below(self, keys: np.ndarray) -> np.ndarray:
        """The trie node for each key (node and letter), or -1."""
        table, bits = self.hash, self.hash["bits"]
        slot, out, left = slots(keys, bits), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for probe in range(table["probes"]):
            s = (slot[left] + probe) & ((1 << bits) - 1)
            hit = table["keys"][s] == keys[left]
            out[left[hit]] = table["ranks"][s[hit]]
            left = left[~hit & (table["keys"][s] >= 0)]
            if not len(left):
                break
        return out

    def found(self, words: list[str], width: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Groups (start, end, words, pieces) of all pieces in words, by end; a letter that is no piece is unknown."""
        codes = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width).astype(np.int64)
        row, at = np.nonzero(codes)
        node, hits = np.zeros(len(row), np.int64), []
        for length in range(1, min(self.longest, width) + 1):
            key = node << 21 | codes[row, at + length - 1]
            node = self.below(key)
            piece = np.where(node >= 0, self.piece_of[node], -1)
            if length == 1:
                piece = np.where(piece < 0, self.unknown, piece)
            hit = piece >= 0
            hits.append(np.stack([at[hit] + length, at[hit], row[hit], piece[hit]]))
            go = (node >= 0) & (at + length < width)
            row, at, node = row[go], at[go], node[go]
            inside = codes[row, at + length] > 0 if len(row) else go[:0]
            row, at, node = row[inside], at[inside], node[inside]
        end, start, row, piece = np.concatenate(hits, axis=1)
        group = end * (width + 1) + start
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        return [(int(start[g[0]]), int(end[g[0]]), row[g], piece[g]) for g in np.split(order, cuts) if len(g)]

    def scaled(self, sums: np.ndarray, scale: np.ndarray, low: int, high: int) -> None:
        """Bring the sums that later steps read to a largest one of 1."""
        most = sums[low:high].max(axis=0)
        most[most == 0] = 1
        sums[low:high] /= most
        scale[low:high] += np.log(most)

    def forward(self, groups: list, n: int, probs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place of each word, the sum over all segmentations up to it, and the logarithm of its scale."""
        sums, scale = np.zeros((width + 1, n, probs.shape[1])), np.zeros((width + 1, n, probs.shape[1]))
        sums[0], done = 1, 0
        for start, end, row, piece in groups:
            if end > done and end > SCALED and (end - 1) % SCALED == 0:
                self.scaled(sums, scale, max(0, end - self.longest), end)
                scale[end:] = scale[end - 1]
            done = end
            sums[end, row] += sums[start, row] * probs[piece]
        return sums, scale

    def backward(self, groups: list, lengths: np.ndarray, probs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(lengths)
        sums, scale = np.zeros((width + 1, n, probs.shape[1])), np.zeros((width + 1, n, probs.shape[1]))
        sums[lengths, np.arange(n)], done = 1, width
        for start, end, row, piece in sorted(groups, key=lambda g: (-g[0], g[1])):
            if start < done and (start + 1) % SCALED == 0:
                # words that end further left have not begun: their scale stays 0
                self.scaled(sums, scale, start + 1, min(width, start + self.longest) + 1)
                scale[: start + 1] = np.where(lengths[None, :, None] > start, scale[start + 1][None], 0)
            done = start
            sums[start, row] += probs[piece] * sums[end, row]
        return sums, scale

    def log_likelihood(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), probs.shape[1]))
        for rows, width, lengths in by_width(words):
            sums, scale = self.forward(self.found([words[i] for i in rows], width), len(rows), probs, width)
            each = np.arange(len(rows))
            out[rows] = np.log(sums[lengths, each]) + scale[lengths, each]
        return out

    def train(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Piece probabilities of each language; the last row is for unknown letters."""
        langs = counts.shape[1]
        probs = np.full((self.unknown + 1, langs), 1.0 / max(1, self.unknown))
        probs[self.unknown] = UNKNOWN
        for _ in range(EM_ROUNDS):
            used = np.full((self.unknown + 1, langs), 0.01)
            for rows, width, lengths in by_width(words):
                groups = self.found([words[i] for i in rows], width)
                (alpha, up), (beta, down) = self.forward(groups, len(rows), probs, width), self.backward(groups, lengths, probs, width)
                each = np.arange(len(rows))
                whole = np.log(alpha[lengths, each]) + up[lengths, each]
                for start, end, row, piece in groups:
                    share = alpha[start, row] * probs[piece] * beta[end, row] * np.exp(up[start, row] + down[end, row] - whole[row]) * counts[rows[row]]
                    for k in range(langs):
                        used[:, k] += np.bincount(piece, share[:, k], len(used))
            probs[: self.unknown] = used[: self.unknown] / used[: self.unknown].sum(axis=0)
        return probs


def by_width(words: list[str]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Words of about one length in parts, each as wide as its longest word."""
    lengths = np.array([len(w) for w in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    at = int(np.searchsorted(lengths[order], 1))
    while at < len(order):
        width = int(lengths[order[at]])
        upto = int(np.searchsorted(lengths[order], max(width + 3, width * 9 // 8), side="right"))
        upto = min(upto, at + max(1, PASS_LETTERS // int(lengths[order[upto - 1]])))
        part = order[at:upto]
        yield part, int(lengths[part[-1]]), lengths[part]
        at = upto


find_words = re.compile(r"[^\W\d_]+").findall


def letters(text: str) -> list[str]:
    """The runs of letters of a text; signs such as a raised two are no letters."""
    words = find_words(text.lower())
    return words if text.isascii() else [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in words]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in slices(batches):
        counts: dict[str, Counter] = {}
        for lang, raw in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist(), strict=True):
            own = counts.setdefault(lang, Counter())
            own.update(letters(raw.decode("utf-8", "replace")))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])


def train(df: DataFrame, vocabulary_path: str, per_language: int = TRAIN_DOCS) -> dict:
    """Learn from at most ``per_language`` labelled rows of each language, taken by a hash of doc_id.

    ``df`` has doc_id, text and lang; rows without lang are no examples. The whole texts of the sample
    count; its words, with their numbers, are what reaches the driver.
    """
    chosen = df.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).filter("lang is not null and doc_id is not null").distinct()
    # by language and part first, so that no task ranks all rows of one language
    for keys in (["lang", F.pmod("hash", F.lit(PARTS))], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("hash", "doc_id"))
        chosen = chosen.withColumn("place", place).filter(F.col("place") <= per_language).drop("place")
    chosen = chosen.select("doc_id", "lang")
    texts = df.select("doc_id", "lang", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    # at most per_language ids of each language, so the hint has a fixed bound
    sample = texts.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", "text")
    counted = sample.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique().tolist())
    counted = counted.sort_values(["word", "lang"])
    words = counted["word"].drop_duplicates().tolist()
    row, counts = {w: i for i, w in enumerate(words)}, np.zeros((len(words), len(langs)))
    counts[counted["word"].map(row), counted["lang"].map({k: i for i, k in enumerate(langs)})] = counted["n"]
    lattice = Lattice(read_pieces(vocabulary_path))
    return {"langs": langs, "lattice": lattice, "probs": lattice.train(words, counts) if langs else None}


def predictor(model_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_bc.value
        langs, lattice, probs = model["langs"], model["lattice"], model["probs"]
        memo: dict[str, int] = {}
        scores = np.zeros((0, len(langs) + 1))
        for piece in slices(batches):
            if len(memo) > MEMO_WORDS:
                memo, scores = {}, scores[:0]
            docs = [letters(raw.decode("utf-8", "replace")) for raw in piece.column("text").to_pylist()]
            new = list(set().union(*docs).difference(memo))
            if new and langs:
                own = np.column_stack([lattice.log_likelihood(new, probs), [len(w) for w in new]])
                memo |= {w: len(scores) + i for i, w in enumerate(new)}
                scores = np.concatenate([scores, own])
            pred, score, fit = [], [], []
            for words in docs:
                total = scores[np.fromiter(map(memo.__getitem__, words), np.int64, len(words))].sum(axis=0) if words and langs else np.zeros(len(langs) + 1)
                if total[-1] == 0:
                    pred, score, fit = [*pred, "und"], [*score, 0.0], [*fit, None]
                    continue
                best = int(np.argmax(total[:-1]))
                pred.append(langs[best])
                score.append(float(1 / np.exp(total[:-1] - total[best]).sum()))
                fit.append(float(total[best] / total[-1]))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(fit, pa.float64())], ["doc_id", "lang_pred", "score", "log_per_letter"])

    return run


def predict(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predict the language of each row's whole text.

    Returns a row per input row: the id, ``lang_pred``, ``score`` (the language's share of the
    likelihood, all languages being equally likely beforehand) and ``log_per_letter``. Texts and runs
    of letters of any length are read whole. An empty table gives no rows. A null or empty text, one without letters, and any text when nothing was learned give ``und`` and 0. Of languages
    with equal likelihood the first by name wins. A null id stays null; repeated rows repeat.
    """
    kind = df.schema[id_col].dataType.simpleString()
    bc = df.sparkSession.sparkContext.broadcast(model)
    return id_and_bytes(df, id_col, text_col).mapInArrow(predictor(bc), f"doc_id {kind}, lang_pred string, score double, log_per_letter double")


def tagging(model_bc, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predicted = predictor(model_bc)
        for piece in slices(batches):
            texts = piece.column("text").cast(pa.binary()).fill_null(b"")
            doc = pa.RecordBatch.from_arrays([pa.array(range(piece.num_rows)), texts], ["doc_id", "text"])
            found = pa.Table.from_batches(predicted([doc])).column("lang_pred").combine_chunks()
            lang = pc.coalesce(piece.column("lang"), found)
            out = pa.RecordBatch.from_arrays([lang if n == "lang" else piece.column(n) for n in names], names)
            yield out.filter(pc.not_equal(found, "und"))

    return run


def keep_identified(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` (with text and lang, and any others) whose language can be told.

    Rows that the model answers with ``und`` go: null and empty texts, those without letters, and all where
    nothing was learned. A null lang becomes the predicted one. Repeated rows stay or go together, a null
    doc_id plays no part, an empty table stays empty, and other columns come through whatever their names.
    """
    bc = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(tagging(bc, docs.columns), docs.schema)


def fold() -> F.Column:
    """The remainder that decides whether a document is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def identify(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Learn from documents that are not held out, then predict all: a row for each row, as predict gives it.

    A null doc_id is not held out, but no example either.
    """
    model = train(docs.filter(fold() != 2), vocabulary_path)
    return predict(docs, model).withColumn("held_out", F.coalesce(fold() == 2, F.lit(False)))
