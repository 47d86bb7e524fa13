"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages: its text in windows of 512 bytes. Each passage is encoded by counts of
its pairs of character classes and of its hashed byte triples, and by how often its words repeat the words
just before them; a small network makes a vector of these. Labels exist for documents only: gated
attention learns from them how much each passage tells, and the document's score is that of the passages'
weighted mean. The weights of a bad document lie on its bad passages, whatever else it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, id_and_bytes, slices, written

#: Bytes of a passage, and of the parts in which a longer text is encoded; a part begins a new passage.
PASSAGE, PART = 512, 1 << 20
#: Character classes: none, space, line end, letter by case, digit, marks of six kinds, bytes beyond ASCII.
CLASSES = 16
#: Labelled documents of each label to learn from, at most, and their passages in all.
TRAIN_DOCS, TRAIN_PASSAGES = 1500, 24_000
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 32, 16, 40, 64, 3e-3, 1e-4
#: A document is called good from this score on.
THRESHOLD = 0.3


def class_table() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[128:192], out[192:] = 14, 15
    out[1:128] = 13
    for k, signs in enumerate((" \t", "\n\r", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "'\"`", "()[]{}<>", "|/\\_", "#$%&*@", "-+=~^"), start=1):
        out[[ord(s) for s in signs]] = k
    return out


CLASS = class_table()
PAIRS, TRIPLES, SHAPE = CLASSES * CLASSES, 256, 5
FEATURES = PAIRS + TRIPLES + SHAPE
#: Odd multiplier of the word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def running(base: int, length: int) -> np.ndarray:
    out = np.full(length, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def passages_of(n_bytes: np.ndarray) -> np.ndarray:
    """Passages of texts of so many bytes; the empty text has one."""
    whole, rest = n_bytes // PART, n_bytes % PART
    return np.maximum(1, whole * (PART // PASSAGE) + -(-rest // PASSAGE))


class Encoder:
    """Features of passages; every array here is bounded by the bytes of one group of parts."""

    def __init__(self) -> None:
        self.forth, self.back = running(BASE, 1), running(INVERSE, 1)

    def groups(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Feature rows of all passages of all texts, in order, a few megabytes of text at a time."""
        parts, size = [], 0
        for text in texts:
            for at in range(0, max(1, len(text)), PART):
                parts.append(text[at : at + PART])
                size += len(parts[-1]) + PASSAGE
                if size >= SLICE_BYTES:
                    yield self.encode(parts)
                    parts, size = [], 0
        if parts:
            yield self.encode(parts)

    def encode(self, parts: list[bytes]) -> np.ndarray:
        lengths = np.array([len(p) for p in parts], np.int64)
        counts = np.maximum(1, -(-lengths // PASSAGE))
        total = int(counts.sum())
        starts = (np.cumsum(counts) - counts) * PASSAGE
        raw = b"".join(p.ljust(n * PASSAGE, b"\0") for p, n in zip(parts, counts.tolist(), strict=True))
        text = np.frombuffer(raw, np.uint8)
        ends = (starts + lengths)[lengths > 0]
        bytes_of = np.bincount(np.arange(total), minlength=total) * PASSAGE
        last = starts // PASSAGE + counts - 1
        bytes_of[last] = lengths - (counts - 1) * PASSAGE
        size = np.maximum(bytes_of, 1)[:, None]
        home = np.arange(len(text), dtype=np.int64) // PASSAGE
        one, two = np.append(text[1:], np.uint8(0)), np.append(text[2:], np.zeros(2, np.uint8))
        # nothing follows the end of a part
        one[ends - 1], two[ends - 1], one[starts[1:] - 1] = 0, 0, 0
        two[np.maximum(ends - 2, 0)] = 0
        pairs = np.bincount(home * PAIRS + CLASS[text] * np.int64(CLASSES) + CLASS[one], minlength=total * PAIRS).reshape(total, PAIRS)
        pairs[:, 0] = 0
        triple = (text.astype(np.uint32) * np.uint32(0x9E3779B1) + one.astype(np.uint32) * np.uint32(0x85EBCA77) + two.astype(np.uint32) * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        triples = np.bincount((home * TRIPLES + (triple >> np.uint32(24)).astype(np.int64))[text > 0], minlength=total * TRIPLES).reshape(total, TRIPLES)
        return np.concatenate([np.sqrt(pairs / size), np.sqrt(triples / size), self.shape(text, starts[lengths > 0], bytes_of)], axis=1, dtype=np.float32)

    def shape(self, text: np.ndarray, starts: np.ndarray, bytes_of: np.ndarray) -> np.ndarray:
        """Share of words that equal the word before, or one of the four before; words a byte; length of words; bytes."""
        out, total = np.zeros((len(bytes_of), SHAPE)), len(bytes_of)
        out[:, 4] = bytes_of / PASSAGE
        solid = CLASS[text] > 2
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        begins[starts] |= solid[starts]
        begin = np.flatnonzero(begins)
        if not len(begin):
            return out
        if len(self.forth) < len(text):
            self.forth, self.back = running(BASE, len(text)), running(INVERSE, len(text))
        summed = np.add.reduceat(np.where(solid, (text + np.uint64(1)) * self.forth[: len(text)], np.uint64(0)), begin)
        word = summed * self.back[begin]
        # a word is compared with words of its own part alone
        part = np.searchsorted(starts, begin, side="right")
        home = begin // PASSAGE
        words = np.bincount(home, minlength=total)
        near = np.zeros(len(word), bool)
        for lag in range(1, 5):
            same = (word[lag:] == word[:-lag]) & (part[lag:] == part[:-lag])
            near[lag:] |= same
            if lag == 1:
                out[:, 0] = np.bincount(home[1:], same, minlength=total)
        out[:, 1] = np.bincount(home, near, minlength=total)
        out[:, :2] /= np.maximum(words, 1)[:, None]
        out[:, 2] = words / np.maximum(bytes_of, 1)
        out[:, 3] = np.minimum(np.bincount(np.flatnonzero(solid) // PASSAGE, minlength=total) / np.maximum(words, 1), 100) / 10
        return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """Passage encoder, gated attention and the document's score, with gradients."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 7) -> None:
        if weights is not None:
            self.w = weights
            return
        rnd = np.random.default_rng(seed)
        scaled = lambda *shape: (rnd.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {
            "encode": scaled(FEATURES, HIDDEN) * 3, "encode0": np.zeros(HIDDEN, np.float32), "tanh": scaled(HIDDEN, ATTENTION), "gate": scaled(HIDDEN, ATTENTION),
            "attend": scaled(ATTENTION, 1)[:, 0], "score": scaled(HIDDEN, 1)[:, 0], "score0": np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Attention and value of each passage, and what the gradients need."""
        w = self.w
        h = np.maximum(x @ w["encode"] + w["encode0"], 0)
        t, g = np.tanh(h @ w["tanh"]), logistic(h @ w["gate"])
        return (t * g) @ w["attend"], h @ w["score"], h, t, g

    def pooled(self, logit: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's score before the logistic, and each passage's attention weight."""
        counts = np.diff(np.append(starts, len(logit)))
        share = np.exp(logit - np.repeat(np.maximum.reduceat(logit, starts), counts))
        share /= np.repeat(np.add.reduceat(share, starts), counts)
        return np.add.reduceat(share * value, starts) + self.w["score0"], share

    def gradients(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        logit, value, h, t, g = self.forward(x)
        raw, share = self.pooled(logit, value, starts)
        counts = np.diff(np.append(starts, len(logit)))
        slope = (logistic(raw) - label) * weight / weight.sum()
        each = np.repeat(slope, counts) * share
        d_logit = each * (value - np.repeat(raw - w["score0"], counts))
        d_tg = d_logit[:, None] * w["attend"]
        d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
        d_h = (each[:, None] * w["score"] + d_t @ w["tanh"].T + d_g @ w["gate"].T) * (h > 0)
        return {
            "encode": x.T @ d_h, "encode0": d_h.sum(axis=0), "tanh": h.T @ d_t, "gate": h.T @ d_g,
            "attend": (t * g).T @ d_logit, "score": h.T @ each, "score0": slope.sum(keepdims=True),
        }

    def fit(self, bags: list[np.ndarray], label: np.ndarray, weight: np.ndarray) -> Network:
        rnd = np.random.default_rng(11)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rnd.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                counts = np.array([len(bags[i]) for i in chosen])
                grads = self.gradients(np.concatenate([bags[i] for i in chosen]), np.cumsum(counts) - counts, label[chosen], weight[chosen])
                step += 1
                for k, g in grads.items():
                    g = g + DECAY * self.w[k]
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.001 * (g * g - square[k])
                    self.w[k] -= (RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def fold(id_col: str = "doc_id") -> Column:
    """The remainder that decides whether a document is held out."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5


def encoding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder()
    for piece in slices(batches):
        for i, raw in enumerate(piece.column("text").to_pylist()):
            rows = np.concatenate(list(encoder.groups([raw]))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id").slice(i, 1), piece.column("label").slice(i, 1), pa.array([rows.tobytes()], pa.binary())], ["doc_id", "label", "bag"])


def chosen(labels: DataFrame, per_label: int) -> tuple[list, dict[int, int]]:
    """At most ``per_label`` rows of each label, by a hash of doc_id, and how many there are of each.

    A share of the hashes is taken first, so that the ordering sees about that many rows at any size.
    """
    found = {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    rows = []
    for label, n in sorted(found.items()):
        share = min(1.0, 1.5 * per_label / n + 50 / n)
        taken = labels.filter((F.col("label") == label) & (F.shiftrightunsigned("hash", 32) <= F.lit(int(share * ((1 << 32) - 1)))))
        rows += taken.orderBy("hash", "doc_id").limit(per_label).collect()
    return rows, found


def train(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_DOCS, most_passages: int = TRAIN_PASSAGES) -> dict:
    """Learn from labelled documents: ``labels`` has doc_id and quality (1 is good), ``docs`` doc_id and text.

    At most ``per_label`` documents of each label are taken by a hash of doc_id, and of these, in hash order, the
    whole texts of as many as have ``most_passages`` passages in all (the first is always taken). Examples are
    weighted so that both labels keep their shares among all labelled rows. Rows whose doc_id or quality is null
    are no examples; repeated rows are several. With no example of one label the model is a constant: the
    share of label 1, with one example of each label added.
    """
    kept = labels.filter("doc_id is not null and quality is not null").select("doc_id", (F.col("quality") == 1).cast("int").alias("label"), F.xxhash64("doc_id").alias("hash"))
    rows, found = chosen(kept, per_label)
    constant = {"weights": None, "constant": (found.get(1, 0) + 1) / (sum(found.values()) + 2)}
    if len({r.label for r in rows}) < 2:
        return constant
    sample = docs.sparkSession.createDataFrame([(r.doc_id, r.label) for r in rows], f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, label int")
    # at most per_label ids of each label, so the hint has a fixed bound
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = written(texts.withColumn("hash", F.xxhash64("doc_id")))
    sizes = texts.select("doc_id", "label", "hash", F.octet_length("text").alias("n_bytes")).toPandas().sort_values(["hash", "doc_id", "label", "n_bytes"])
    passages = np.cumsum(passages_of(sizes["n_bytes"].to_numpy(np.int64)))
    inside = sizes[(passages <= most_passages) | (np.arange(len(sizes)) == 0)]
    if inside["label"].nunique() < 2:
        return constant
    ids = docs.sparkSession.createDataFrame([(i,) for i in inside["doc_id"].drop_duplicates().tolist()], f"doc_id {kept.schema['doc_id'].dataType.simpleString()}")
    bags = texts.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "label", "text").mapInArrow(encoding, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, label int, bag binary").toPandas()
    bags = bags.sort_values(["doc_id", "label", "bag"])
    label = bags["label"].to_numpy(np.float32)
    share = {k: found[k] / max(1, int((label == k).sum())) for k in (0, 1)}
    weight = np.where(label == 1, share[1], share[0]).astype(np.float32)
    features = [np.frombuffer(b, np.float16).reshape(-1, FEATURES).astype(np.float32) for b in bags["bag"]]
    return {"weights": Network().fit(features, label, weight / weight.mean()).w, "constant": constant["constant"]}


def scorer(model_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, encoder = model_bc.value, Encoder()
        network = Network(model["weights"]) if model["weights"] else None
        for piece in slices(batches):
            texts = piece.column("text").to_pylist()
            counts = passages_of(np.array([len(t) for t in texts], np.int64))
            if network is None:
                score, top = np.full(len(texts), model["constant"]), np.zeros(len(texts), np.int64)
            else:
                both = [network.forward(x)[:2] for x in encoder.groups(texts)]
                starts = np.cumsum(counts) - counts
                raw, share = network.pooled(*(np.concatenate(v).astype(np.float64) for v in zip(*both, strict=True)), starts)
                score = logistic(raw)
                top = np.array([int(np.argmax(share[s : s + n])) for s, n in zip(starts.tolist(), counts.tolist(), strict=True)], np.int64)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score, pa.float64()), pa.array(counts), pa.array(top)], ["doc_id", "score", "n_passages", "top_passage"])

    return run


def score_quality(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score each row's whole text: the id, ``score`` (0 to 1), ``n_passages`` and ``top_passage``.

    ``top_passage`` is the passage with most attention (from 0; of equal ones the first). Null and empty
    texts are one empty passage, scored like any other. A null id stays null; repeated rows repeat; an empty
    table gives no rows. A text of any length is encoded in parts of a megabyte.
    """
    kind = df.schema[id_col].dataType.simpleString()
    bc = df.sparkSession.sparkContext.broadcast(model)
    return id_and_bytes(df, id_col, text_col).mapInArrow(scorer(bc), f"doc_id {kind}, score double, n_passages long, top_passage long")


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled documents that are not held out, then score all."""
    model = train(docs, labels.filter(fold() != 0))
    scored = score_quality(docs, model)
    return scored.withColumns({"held_out": F.coalesce(fold() == 0, F.lit(False)), "predicted": (F.col("score") >= THRESHOLD).cast("int")})
