"""Secret scans: fixed rules, and a character convolutional network over further candidates.

Candidates are all findings of the rules, private key blocks, passwords in addresses, and every token of eight
characters with a letter that has a digit or a capital after a small letter, or is very long. A network with one layer of
convolutions over the candidate and its surroundings scores each. It is trained, in numpy, on labelled
findings: a bounded sample of the corpus (rule findings against other candidates there) and findings made
from a seed, as the same rule cuts them out of made texts (keys in many notations against versions, dates,
identifiers, addresses, paths and words). A long
candidate is seen in overlapping windows from end to end, and its highest score counts. One held-out part of
the findings calibrates the score and sets the threshold: half way between the score that keeps the wanted recall of secrets
that no rule finds, as these are what it decides, and the best score of anything else below it. A third part, used for nothing
else, measures the result, and so do kinds of findings that training never sees.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_bytes, slices

KINDS = ("assign", "access", "hex", "model")
#: Bytes of a window before, in and after a candidate or, of a longer candidate, a stretch of it.
BEFORE, INSIDE, AFTER = 24, 40, 8
SEEN = BEFORE + INSIDE + AFTER
FILTERS, SPAN = 24, 5
#: Training reads at most so many documents, by a hash of their id, and keeps so many of their findings.
TRAIN_DOCS, TRAIN_FINDINGS = 1000, 3000
RECALL = 0.98
#: Logit of a first network from which a candidate of the corpus is not taken for an ordinary token.
DOUBTFUL = 2.0

ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
TOKEN = re.compile(rb"[A-Za-z0-9+/_][A-Za-z0-9+/_.~-]{7,}(?<![.~-])={0,2}")
#: Tokens that may be secrets: with a digit, or a capital after a small letter, or of 16 and more.
MIXED, LETTER, VERY_LONG = re.compile(rb"[0-9]|[a-z][A-Z]"), re.compile(rb"[A-Za-z]"), 16
BLOCK_OR_ADDRESS = re.compile(rb"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z0-9 ]*PRIVATE KEY-----|(?<=://)[^\s/:@]+:[^\s/@]+(?=@)")


def byte_classes() -> np.ndarray:
    """A class for each byte: single digits, letters by case and group, common signs, the rest."""
    out = np.full(256, 63, np.int64)
    out[0] = 0
    for i, c in enumerate(b"0123456789"):
        out[c] = 1 + i
    for i, c in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
        out[c], out[c - 32] = 11 + i, 37 + (i % 8)
    for i, c in enumerate(b"=:\"'+/_-. \n@#(){}"):
        out[c] = 45 + i
    return out


CLASSES = byte_classes()


def base_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """Byte spans of the rules' findings: (start, end, kind)."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(raw.lower()) if m.end(1) - m.start(1) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def other_candidates(raw: bytes, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Whatever else may be a secret (see TOKEN and BLOCK_OR_ADDRESS) and touches no base finding."""
    tokens = (m for m in TOKEN.finditer(raw) if (m.end() - m.start() >= VERY_LONG or MIXED.search(m[0])) and LETTER.search(m[0]))
    wide = [(m.start(), m.end(), "model") for m in untouched(BLOCK_OR_ADDRESS.finditer(raw), base)]
    taken = sorted(base + wide) if wide else base
    return wide + [(m.start(), m.end(), "model") for m in untouched(tokens, taken)]


def windows(raw: bytes, start: int, end: int) -> list[bytes]:
    """What the network sees of a candidate: all of it, in stretches that overlap by half, each with its surroundings."""
    stops = [end] if end - start <= INSIDE else [*range(start + INSIDE, end, INSIDE // 2), end]
    out = []
    for stop in stops:
        first = max(start, stop - INSIDE)
        out.append(raw[max(0, first - BEFORE) : first].rjust(BEFORE, b"\0") + raw[first:stop].ljust(INSIDE, b"\0") + raw[stop : stop + AFTER].ljust(AFTER, b"\0"))
    return out


def untouched(matches: Iterator[re.Match], base: list[tuple[int, int, str]]) -> Iterator[re.Match]:
    """The matches that no base finding touches; both come in order."""
    at, latest = 0, -1
    for m in matches:
        while at < len(base) and base[at][0] < m.end():
            latest = max(latest, base[at][1])
            at += 1
        if latest <= m.start():
            yield m


class CharNet:
    """Embedding, one convolution, maximum over places, one output; trained by Adam."""

    def __init__(self, seed: int = 7, width: int = 12):
        rnd = np.random.default_rng(seed)
        self.w = {
            "embed": rnd.normal(0, 0.3, (64, width)),
            "place": rnd.normal(0, 0.1, (SEEN, width)),
            "conv": rnd.normal(0, (2 / (SPAN * width)) ** 0.5, (SPAN * width, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": rnd.normal(0, 0.2, FILTERS),
            "shift": np.zeros(1),
        }

    def forward(self, codes: np.ndarray) -> tuple:
        x = self.w["embed"][codes] + self.w["place"]
        n, length, width = x.shape
        unfolded = np.lib.stride_tricks.sliding_window_view(x, SPAN, axis=1).swapaxes(2, 3).reshape(n, length - SPAN + 1, SPAN * width)
        maps = unfolded @ self.w["conv"] + self.w["bias"]
        best = maps.argmax(axis=1)
        top = np.maximum(np.take_along_axis(maps, best[:, None, :], 1)[:, 0, :], 0)
        return top @ self.w["out"] + self.w["shift"][0], top, best, unfolded

    def logits(self, windows: list[bytes]) -> np.ndarray:
        codes = CLASSES[np.frombuffer(b"".join(windows), np.uint8)].reshape(-1, SEEN)
        return np.concatenate([self.forward(codes[i : i + 256])[0] for i in range(0, len(codes), 256)] or [np.zeros(0)])

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> dict:
        logit, top, best, unfolded = self.forward(codes)
        n = len(codes)
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels) / n
        back = error[:, None] * self.w["out"][None, :] * (top > 0)
        seen = unfolded[np.arange(n)[:, None], best]
        grad = {"out": top.T @ error, "shift": np.array([error.sum()]), "bias": back.sum(0), "conv": np.einsum("nfk,nf->kf", seen, back)}
        into = np.einsum("nf,kf->nfk", back, self.w["conv"]).reshape(n, FILTERS, SPAN, -1)
        places = best[:, :, None] + np.arange(SPAN)
        grad["place"], grad["embed"] = np.zeros_like(self.w["place"]), np.zeros_like(self.w["embed"])
        np.add.at(grad["place"], places, into)
        np.add.at(grad["embed"], codes[np.arange(n)[:, None, None], places], into)
        return grad

    def fit(self, windows: list[bytes], labels: np.ndarray, rounds: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11) -> CharNet:
        codes = CLASSES[np.frombuffer(b"".join(windows), np.uint8)].reshape(-1, SEEN)
        rnd, step = np.random.default_rng(seed), 0
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        for _ in range(rounds):
            order = rnd.permutation(len(codes))
            for at in range(0, len(order), batch):
                step += 1
                part = order[at : at + batch]
                for k, g in self.gradients(codes[part], labels[part]).items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.w[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return self


#: Kinds of made findings that training never sees.
UNSEEN = ("jwt", "slack", "host", "stamp")


def made_findings(n: int = 4800, seed: int = 3) -> list[tuple[bytes, int, int, int, str]]:
    """Labelled findings from a seed: (text, start, end, label, kind), half of them secrets."""
    rnd, out = random.Random(seed), []
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    signs = small + small.upper() + digits
    draw = lambda alphabet, low, high: "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(low, high)))
    known = lambda: rnd.choice(["the", "on", "er", "re", "tion", "ment", "eau", "ung", "keit", "ción", "os", "in", "ha"])
    spoken = lambda: rnd.choice("bcdfghjklmnpqrstvwz") + rnd.choice(["a", "e", "i", "o", "u", "ea", "ou"]) + rnd.choice(["", "", "n", "r", "s", "t", "l", "st", "ng"])
    word = lambda: "".join(known() if rnd.random() < 0.5 else spoken() for _ in range(rnd.randrange(1, 7)))
    prose = lambda: " ".join(word() for _ in range(rnd.randrange(2, 6)))
    number = lambda low, high: str(rnd.randrange(low, high))
    secrets = {
        "plain": lambda: draw(signs, 20, 44),
        "base64": lambda: draw(signs + "+/", 30, 60) + rnd.choice(["", "=", "=="]),
        "upper_hex": lambda: draw("0123456789ABCDEF", 32, 41),
        "live": lambda: "sk_live_" + draw(signs, 20, 30),
        "ghp": lambda: "ghp_" + draw(signs, 30, 40),
        "letters": lambda: draw(small + small.upper(), 20, 40),
        "short": lambda: draw(signs, 5, 9) + rnd.choice(digits) + rnd.choice(small) + rnd.choice(small.upper()) + draw(signs, 3, 6),
        "address": lambda: word() + ":" + draw(signs, 8, 20),
        "block": lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(draw(signs + "+/", 64, 65) for _ in range(rnd.randrange(2, 6))) + "\n-----END RSA PRIVATE KEY-----",
        "jwt": lambda: "eyJ" + draw(signs, 17, 34) + ".eyJ" + draw(signs, 30, 80) + "." + draw(signs + "_-", 43, 44),
        "slack": lambda: "xoxb-" + draw(digits, 10, 13) + "-" + draw(signs, 24, 25),
    }
    others = {
        "numbers": lambda: "-".join(draw(digits, 2, 5) for _ in range(4)) + "T",
        "snake": lambda: word() + "_" + word() + "_" + number(1900, 2100),
        "release": lambda: f"release-{number(0, 20)}.{number(0, 20)}-build-{number(0, 99)}",
        "version": lambda: rnd.choice(["v", "version-", word() + "-"]) + ".".join(number(0, 40) for _ in range(rnd.randrange(2, 5))) + rnd.choice(["", "-rc" + number(1, 9), "-beta." + number(1, 9), "-SNAPSHOT"]),
        "words": lambda: "".join(word() for _ in range(rnd.randrange(2, 6))),
        "camel": lambda: word() + "".join(word().title() for _ in range(rnd.randrange(1, 4))),
        "date": lambda: f"{number(1990, 2030)}-{number(10, 13)}-{number(10, 29)}T10-30-00Z",
        "path": lambda: "/".join([word(), word(), f"page{number(0, 100)}"]),
        "link": lambda: rnd.choice(["https://", "http://www.", "s3://"]) + "/".join([f"{word()}.{rnd.choice(['com', 'org', 'net'])}", *(word() + rnd.choice(["", number(0, 3000)]) for _ in range(rnd.randrange(1, 5)))]),
        "dotted": lambda: ".".join([word(), word(), *(word() for _ in range(rnd.randrange(0, 3))), word().title() + word().title()]),
        "upper": lambda: (word() + word() + word()).upper(),
        "uuid": lambda: "-".join(draw(digits + "abcdef", k, k + 1) for k in (8, 4, 4, 4, 12)),
        "file": lambda: word() + number(0, 100) + rnd.choice([".parquet", ".py", ".tar.gz", ".html"]),
        "host": lambda: f"{word()}{number(0, 20)}.example.{rnd.choice(['com', 'org'])}",
        "stamp": lambda: f"{number(1990, 2030)}-{number(10, 13)}-{number(10, 29)}T{number(10, 24)}",
    }
    for i in range(n):
        label = i % 2
        kinds = secrets if label else others
        kind = rnd.choice(sorted(kinds))
        value = kinds[kind]()
        # a short one is told by what stands before it; plain identifiers follow such words too
        leads = ["key: ", "auth=", "Bearer ", "credential = '", "secret is ", 'pwd: "', "x-api-token: "] if label else ["see ", "version ", "", "on ", "at ", "id: ", "key: "]
        head, tail = f"{prose()} {rnd.choice(leads + ([''] if label and kind != 'short' else []))}", " "
        if kind == "address":
            head, tail = head + rnd.choice(["postgres", "https", "amqp"]) + "://", f"@{word()}.{word()}.{rnd.choice(['com', 'org', 'net'])}/{word()} "
        text = f"{head}{value}{tail}{prose()}".encode()
        start = len(head.encode())
        out.append((text, start, start + len(value.encode()), label, kind))
    return out


def made_windows(findings: list[tuple[bytes, int, int, int, str]]) -> list[tuple[bytes, int, str, int]]:
    """Windows of all candidates that made texts give: (window, label, kind, number of the finding). What stands
    beside a secret is none. A secret that gives no candidate is an empty window, which no score can find."""
    out = []
    for i, (text, start, end, label, kind) in enumerate(findings):
        base = base_spans(text)
        spans = other_candidates(text, base)
        for s, e, _ in spans:
            held = s < end and start < e
            # the parts of one secret are one finding, whose best score counts; made texts are short
            number = i << 20 | (0 if held else s + 1)
            out += [(seen, label if held else 0, kind, number) for seen in windows(text, s, e)]
        if label and not any(s < end and start < e for s, e, _ in base + spans):
            out.append((b"\0" * SEEN, label, kind, i << 20))
    return out


def sample_findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows and labels of a document's rule findings, and of all its other candidates."""
    for piece in slices(batches):
        rows = []
        for doc, raw in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
            base = base_spans(raw)
            rows += [(doc, s, seen, 1) for s, e, _ in base for seen in windows(raw, s, e)]
            rows += [(doc, s, seen, 0) for s, e, _ in other_candidates(raw, base) for seen in windows(raw, s, e)]
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int32()), strict=True)], ["doc_id", "start", "seen", "label"])


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs: int = TRAIN_DOCS, findings: int = TRAIN_FINDINGS, recall: float = RECALL) -> dict:
    """Fit network, calibration and threshold. Reads whole texts of at most ``docs`` rows."""
    rows = id_and_bytes(df, id_col, text_col).filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    # at most ``docs`` ids, so the hint has a fixed bound
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs)
    sample = rows.join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(sample_findings, "doc_id long, start long, seen binary, label int")
    got = sample.orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(findings).collect()
    seen, labels, kinds, owner = [bytes(r.seen) for r in got], [r.label for r in got], ["rule"] * len(got), list(range(len(got)))
    for one, label, kind, i in made_windows(made_findings()):
        seen.append(one)
        labels.append(label)
        kinds.append(kind)
        owner.append(len(got) + i)
    labels, kinds, owner = np.array(labels, float), np.array(kinds), np.unique(np.array(owner), return_inverse=True)[1]
    new = np.isin(kinds, UNSEEN)
    # all windows of one finding fall into one part: 60 % train, 20 % calibrate and set the threshold, 20 % measure
    part = np.where(new, 3, np.digitize(np.random.default_rng(5).random(owner.max() + 1), [0.6, 0.8])[owner])
    # other candidates of the corpus may be secrets; those that a network without them takes for secrets are left out
    corpus = (kinds == "rule") & (labels == 0)
    fitted = lambda chosen, rounds: CharNet().fit([w for w, k in zip(seen, chosen, strict=True) if k], labels[chosen], rounds)
    if corpus.any():
        first_view = np.full(owner.max() + 1, -np.inf)
        np.maximum.at(first_view, owner, fitted((part == 0) & ~corpus, 3).logits(seen))
        part = np.where(corpus & (first_view[owner] > DOUBTFUL), 4, part)
    net = fitted(part == 0, 6)
    whole = np.full(owner.max() + 1, -np.inf)
    np.maximum.at(whole, owner, net.logits(seen))
    first = np.unique(owner, return_index=True)[1]
    labels, kinds, part = labels[first], kinds[first], part[first]
    a, b = calibrate(whole[part == 1], labels[part == 1])
    chance = 1 / (1 + np.exp(-np.clip(a * whole + b, -40, 40)))
    wanted = np.sort(whole[(part == 1) & (labels == 1) & (kinds != "rule")])
    least = wanted[int((1 - recall) * len(wanted))]
    below = whole[(part == 1) & (labels == 0) & (whole < least)]
    threshold = float(1 / (1 + np.exp(-(a * (least + max(below, default=least)) / 2 + b))))
    last, unseen, hit = part == 2, part == 3, chance >= threshold
    share = lambda rows, of: float(of[rows].mean()) if rows.any() else None
    measured = {
        "recall": share(last & (labels == 1), hit), "recall_made": share(last & (labels == 1) & (kinds != "rule"), hit), "precision": share(last & hit, labels), "n": int(last.sum()),
        "recall_new": share(unseen & (labels == 1), hit), "precision_new": share(unseen & hit, labels), "n_new": int(unseen.sum()),
    }
    return {"w": net.w, "a": a, "b": b, "threshold": threshold, "held_out": measured}


def calibrate(logits: np.ndarray, truth: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift that make the logits chances, by Newton steps with a small penalty.

    The wanted chances are as far from 0 and 1 as so many findings can tell, so scores do not saturate."""
    x, theta = np.stack([logits, np.ones_like(logits)], 1), np.array([1.0, 0.0])
    truth = np.where(truth == 1, (truth.sum() + 1) / (truth.sum() + 2), 1 / ((1 - truth).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        slope = x.T @ (p - truth) + 0.01 * (theta - [1, 0])
        theta -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.01 * np.eye(2), slope)
        theta[0] = max(theta[0], 0.05)
    return float(theta[0]), float(theta[1])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))


def byte_spans(model: dict):
    """A function from texts to their findings: (start, end, kind, chance), in bytes."""
    net = CharNet()
    net.w = model["w"]

    def find(texts: list[bytes]) -> list[list[tuple[int, int, str, float]]]:
        spans = []
        for raw in texts:
            base = base_spans(raw)
            spans.append(base + other_candidates(raw, base))
        flat = [(i, *s) for i, own in enumerate(spans) for s in own]
        seen = [windows(texts[i], s, e) for i, s, e, _ in flat]
        best = np.full(len(flat), -np.inf)
        np.maximum.at(best, np.repeat(np.arange(len(flat)), [len(w) for w in seen]), net.logits([w for own in seen for w in own]))
        chance = 1 / (1 + np.exp(-np.clip(model["a"] * best + model["b"], -40, 40)))
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        for (i, start, end, kind), p in zip(flat, chance.tolist(), strict=True):
            if kind != "model" or p >= model["threshold"]:
                out[i].append((start, end, kind, p))
        return out

    return find


def scanning(model_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = byte_spans(model_bc.value)
        for piece in slices(batches):
            texts = piece.column("text").to_pylist()
            out = [[{"kind": k, "start": s, "end": e, "chance": p} for s, e, k, p in own] for own in scan(texts)]
            for raw, own in zip(texts, out, strict=True):
                if own and not raw.isascii():
                    in_code_points(raw, own)
                own.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(out, SPANS)], ["doc_id", "findings"])

    return run


def masking(model_bc, names: list[str], mark: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = byte_spans(model_bc.value)
        for piece in slices(batches):
            raws = piece.column("text").cast(pa.binary()).to_pylist()
            clean = []
            for raw, own in zip(raws, scan([r or b"" for r in raws]), strict=True):
                parts, at = [], 0
                for start, end, *_ in sorted(own):
                    if end > at:
                        parts += [raw[at : max(at, start)], mark if start >= at else b""]
                        at = end
                clean.append(b"".join([*parts, raw[at:]]) if own else raw)
            text = pa.array(clean, pa.binary()).cast(pa.string())
            columns = {"text": text, "n_chars": pc.if_else(pc.fill_null(pc.equal(text, piece.column("text")), True), piece.column("n_chars"), pc.utf8_length(text)) if "n_chars" in names else None}
            yield pa.RecordBatch.from_arrays([piece.column(n) if columns.get(n) is None else columns[n] for n in names], names)

    return run


def mask(docs: DataFrame, model: dict, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with every finding in text replaced by ``mark``; overlapping ones share one.

    n_chars, where there is one, is counted anew for texts that change. All other columns stay, as do null
    texts; repeated rows repeat; an empty table gives no rows.
    """
    bc = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(masking(bc, docs.columns, mark.encode()), docs.schema)


def in_code_points(raw: bytes, spans: list[dict]) -> None:
    """Turn byte offsets into code points."""
    before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    for s in spans:
        s["start"], s["end"] = int(before[s["start"]]), int(before[s["end"]])


def scan_secrets(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find secrets in each row's whole text.

    Returns a row per input row: the id and ``findings`` (kind, start and end in code points, end
    exclusive, and the calibrated chance), by start and then by kind. All findings of the rules stay,
    whatever the network says; of other candidates those at or above the threshold. Null and empty
    texts give an empty list, empty tables no rows; a null id stays null; repeated rows repeat. Texts and
    candidates of any length are read whole. Findings of several kinds at one place all stay, in the order above.
    """
    kind = df.schema[id_col].dataType.simpleString()
    run = scanning(df.sparkSession.sparkContext.broadcast(model))
    return id_and_bytes(df, id_col, text_col).mapInArrow(run, f"doc_id {kind}, findings array<struct<kind: string, start: long, end: long, chance: double>>")


def digests(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("findings", lambda s: s["kind"] != "model")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("findings")).alias("spans"),
    )
