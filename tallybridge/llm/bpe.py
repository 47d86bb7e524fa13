"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word starts as one symbol per byte. The leaves of a binary tree hold, for each symbol that is still
alive, ``rank * width + position`` of the pair it forms with its right neighbour; inner nodes hold the
minimum of their children. The root is therefore always the leftmost pair of lowest rank. A merge
changes three leaves and their ancestors, and ends when the root is "none".

Many words are merged side by side: the trees of all words up to one width form one numpy array, and
each round does one merge in every word that has one left. Words are looked up in a per-task memo
first, since the same words come again and again.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import id_and_bytes, slices

NONE = np.int32(2**31 - 1)
#: Words kept in a task's memo before it starts anew; bounds a worker's memory.
MEMO_WORDS = 250_000
#: Ends of the ranges of characters that have word patterns of their own.
PLANES = (0x80, 0x10000, 0x110000)
#: The inside of a character class that matches nothing.
NOTHING = "^\\0-\U0010ffff"
beyond_basic = re.compile("[\U00010000-\U0010ffff]").search
#: Longest word merged side by side with others; longer ones get a tree of their own.
WIDEST = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def load_tables(path: str) -> dict:
    """The arrays a task needs, from a tokenizers JSON file of a byte-level BPE with word ends."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    ranks: dict[int, tuple[int, int]] = {}
    for rank, (a, b) in enumerate(merges):
        # a pair listed twice keeps its last rank, as in a map that is filled in order
        ranks[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
    pairs = np.fromiter(ranks, np.int64, len(ranks))
    rank, merged = (np.array(x, np.int64) for x in zip(*ranks.values(), strict=True))
    letters = byte_alphabet()
    by_rank = np.zeros(len(merges), np.int64)
    by_rank[rank] = merged
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    names = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
    return {
        "first": np.array([vocab[c] for c in letters], np.int64),
        "last": np.array([vocab[c + suffix] for c in letters], np.int64),
        "by_rank": by_rank,
        "names": [names.get(i, "").encode() for i in range(max(names) + 1)],
        "special": special,
        "patterns": word_patterns(path),
        "capitals": newer_capitals(path),
        **pair_hash(pairs, rank),
    }


def pair_hash(pairs: np.ndarray, rank: np.ndarray, bits: int = 19) -> dict:
    """An open-addressing table from a pair of ids to its rank, filled in parallel rounds."""
    keys, ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
    left, probe = np.arange(len(pairs)), 0
    while len(left):
        slot = (slots(pairs[left], bits) + probe) & ((1 << bits) - 1)
        free = keys[slot] < 0
        _, chosen = np.unique(slot[free], return_index=True)
        took = np.flatnonzero(free)[chosen]
        keys[slot[took]], ranks[slot[took]] = pairs[left[took]], rank[left[took]]
        left, probe = np.delete(left, took), probe + 1
    return {"keys": keys, "ranks": ranks, "probes": probe, "bits": bits}


def slots(pairs: np.ndarray, bits: int) -> np.ndarray:
    mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


class Merger:
    def __init__(self, tables: dict):
        self.__dict__.update(tables)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs = a << 32 | b
        slot, mask = slots(pairs, self.bits), (1 << self.bits) - 1
        found = np.where(self.keys[slot] == pairs, self.ranks[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != pairs) & (self.keys[slot] >= 0))
        for probe in range(1, self.probes):
            if not len(open_):
                break
            s = (slot[open_] + probe) & mask
            found[open_] = np.where(self.keys[s] == pairs[open_], self.ranks[s], NONE)
            open_ = open_[(self.keys[s] != pairs[open_]) & (self.keys[s] >= 0)]
        return found

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.array([len(w) for w in words])
        low = 0
        for width in (8, 16, 32, WIDEST):
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for at in range(0, len(rows), 65536 // (width // 8)):
                part = rows[at : at + 65536 // (width // 8)]
                for i, ids in zip(part.tolist(), self.side_by_side([words[i] for i in part], lengths[part], width), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(lengths > WIDEST).tolist():
            out[i] = self.alone(words[i])
        return out

    def side_by_side(self, words: list[bytes], lengths: np.ndarray, width: int) -> list[bytes]:
        n, shift = len(words), width.bit_length() - 1
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        each = np.arange(n)
        sym = self.first[raw]
        sym[each, lengths - 1] = self.last[raw[each, lengths - 1]]
        places = np.arange(width)
        sym[places[None, :] >= lengths[:, None]] = -1
        tree = np.full((n, 2 * width), NONE, np.int32)
        has = places[None, : width - 1] < lengths[:, None] - 1
        rank = self.rank_of(sym[:, :-1][has], sym[:, 1:][has])
        leaf = np.full((n, width - 1), NONE, np.int32)
        leaf[has] = np.where(rank == NONE, NONE, (rank << shift) + np.broadcast_to(places[: width - 1], has.shape)[has])
        tree[:, width : 2 * width - 1] = leaf
        for half in (width >> k for k in range(1, shift + 1)):
            np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2], out=tree[:, half : 2 * half])
        after = np.where(places[None, :] + 1 < lengths[:, None], places[None, :] + 1, -1)
        before = np.broadcast_to(places - 1, (n, width)).copy()
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            root = tree[live, 1]
            at, new = (root & (width - 1)).astype(np.int64), self.by_rank[root >> shift]
            gone = after[live, at]
            right, left = after[live, gone], before[live, at]
            sym[live, at], sym[live, gone] = new, -1
            after[live, at] = right
            r, lft = right >= 0, left >= 0
            before[live[r], right[r]] = at[r]
            key = np.full(len(live), NONE, np.int32)
            rank = self.rank_of(new[r], sym[live[r], right[r]])
            key[r] = np.where(rank == NONE, NONE, (rank << shift) + at[r])
            tree[live, width + gone] = NONE
            tree[live, width + at] = key
            rank = self.rank_of(sym[live[lft], left[lft]], new[lft])
            tree[live[lft], width + left[lft]] = np.where(rank == NONE, NONE, (rank << shift) + left[lft])
            up = [width + gone, width + at, width + np.where(lft, left, at)]
            for _ in range(shift):
                up = [u >> 1 for u in up]
                for u in up:
                    tree[live, u] = np.minimum(tree[live, 2 * u], tree[live, 2 * u + 1])
            live = live[tree[live, 1] != NONE]
        alive = sym >= 0
        flat, ends = sym[alive].astype("<u4").tobytes(), (np.cumsum(alive.sum(axis=1)) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def alone(self, word: bytes) -> bytes:
        """One long word: the same tree in flat lists."""
        raw = np.frombuffer(word, np.uint8)
        symbols = self.first[raw]
        symbols[-1] = self.last[raw[-1]]
        n, none = len(symbols), int(NONE)
        width = 1 << (n - 1).bit_length()
        found = self.rank_of(symbols[:-1], symbols[1:]).astype(np.int64)
        tree = np.full(2 * width, 1 << 62, np.int64)
        tree[width : width + n - 1] = np.where(found == none, 1 << 62, found * width + np.arange(n - 1))
        half = width
        while half > 1:
            half >>= 1
            tree[half : 2 * half] = np.minimum(tree[2 * half : 4 * half : 2], tree[2 * half + 1 : 4 * half : 2])
        tree, sym, memo = tree.tolist(), symbols.tolist(), {}
        after, before = [*range(1, n), -1], list(range(-1, n - 1))

        def put(leaf: int, a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                if (r := memo.get((a, b))) is None:
                    r = memo[a, b] = int(self.rank_of(np.array([a]), np.array([b]))[0])
                value = 1 << 62 if r == none else r * width + leaf
            else:
                value = 1 << 62
            node = width + leaf
            tree[node] = value
            while node > 1:
                node >>= 1
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    break
                tree[node] = best

        while tree[1] < 1 << 62:
            rank, at = divmod(tree[1], width)
            gone, left = after[at], before[at]
            right = after[gone]
            sym[at], sym[gone], after[at] = int(self.by_rank[rank]), -1, right
            if right >= 0:
                before[right] = at
            put(gone, -1, -1)
            put(at, sym[at], sym[right] if right >= 0 else -1)
            if left >= 0:
                put(left, sym[left], sym[at])
        return np.array([s for s in sym if s >= 0], "<u4").tobytes()


def char_class(codes: list[int]) -> str:
    """The inside of a character class, as ranges."""
    hits = np.zeros(0x110001, np.int8)
    hits[codes] = 1
    starts, ends = (np.flatnonzero(np.diff(hits, prepend=0) == d) for d in (1, -1))
    return "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


def newer_capitals(path: str) -> dict[int, str]:
    """Lower-case forms, by the file's own normaliser, of letters that Python's tables do not know."""
    unknown = [chr(c) for c in range(0x34000) if unicodedata.category(chr(c)) == "Cn"]
    forms = Tokenizer.from_file(path).normalizer.normalize_str(" ".join(unknown)).split(" ")
    return {ord(c): f for c, f in zip(unknown, forms, strict=True) if f != c}


def word_patterns(path: str) -> list[str]:
    """Cut lower-cased text into words: contractions, letters, single digits, other signs.

    One pattern for texts of each plane: the classes of a plane hold its own characters alone, so that
    ASCII is not looked up in long lists of ranges.

    Letters and numbers are those of Python's Unicode tables; characters that these do not know yet
    are classed by how the file's own splitting rule treats them twice after an "a".
    """
    kinds: dict[str, list[int]] = {"L": [], "N": []}
    unknown = []
    for c in range(0x34000):
        if (kind := unicodedata.category(chr(c))) == "Cn":
            unknown.append(c)
        elif kind[0] in kinds:
            kinds[kind[0]].append(c)
    cut = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str(" ".join(f"a{chr(c) * 2}" for c in unknown))
    pieces: dict[int, int] = {}
    for _, (start, _end) in cut:
        pieces[start // 4] = pieces.get(start // 4, 0) + 1
    kinds["L"] += [c for i, c in enumerate(unknown) if pieces[i] == 1]
    kinds["N"] += [c for i, c in enumerate(unknown) if pieces[i] == 3]
    blank = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    out = []
    for end in PLANES:
        letter, number, space = (char_class([c for c in codes if c < end]) for codes in (kinds["L"], kinds["N"], blank))
        out.append(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")
    return out


def plane_of(text: str) -> int:
    """The first of PLANES that holds all of a text's characters."""
    return 0 if text.isascii() else 1 if beyond_basic(text) is None else 2


def lowered(text: str, capitals: dict[int, str], has_capital) -> str:
    """Composed (NFC) and lower-cased letter by letter, without the rule for a word's last sigma."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
    return text.translate(capitals) if has_capital(text) else text


def encoder(tables_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(tables_bc.value)
        names, special, capitals = merger.names, merger.special, merger.capitals
        finders = [re.compile(p).findall for p in merger.patterns]
        marks = [re.compile(f"[{''.join(chr(c) for c in capitals if c < end) or NOTHING}]").search for end in PLANES]
        cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        ids_of: dict[str, bytes] = {}
        tokens_of: dict[str, bytes] = {}

        def words_of(text: str) -> list[str]:
            text = lowered(text, capitals, marks[plane_of(text)])
            return finders[plane_of(text)](text)

        for piece in slices(batches):
            if len(ids_of) > MEMO_WORDS:
                ids_of, tokens_of = {}, {}
            for token, i in special.items():
                ids_of[token], tokens_of[token] = np.array([i], "<u4").tobytes(), token.encode()
            docs = []
            for raw in piece.column("text").to_pylist():
                text = raw.decode("utf-8", "replace")
                if cut is not None and cut.search(text):
                    docs.append([w for part in cut.split(text) for w in ([part] if part in special else words_of(part))])
                else:
                    docs.append(words_of(text))
            new = list(set().union(*docs).difference(ids_of))
            for w, ids in zip(new, merger.merge([w.encode() for w in new]), strict=True):
                ids_of[w] = ids
                tokens_of[w] = names[int.from_bytes(ids, "little")] if len(ids) == 4 else b" ".join([names[i] for i in np.frombuffer(ids, "<u4").tolist()])
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array([b"".join(map(ids_of.__getitem__, doc)) for doc in docs], pa.binary()),
                    pa.array([b" ".join(map(tokens_of.__getitem__, doc)) for doc in docs], pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "ids", "decoded"],
            )

    return run


def bpe_encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each row's whole text.

    Returns a row per input row: ``doc_id``, ``ids`` (little-endian unsigned 32-bit integers, packed)
    and ``decoded`` (the tokens of these ids, joined by a space; a decoder is not part of these files).
    Strings of special tokens become their ids. Null and empty texts, and texts of white space, give
    no ids and the empty string. Repeated rows give repeated results; a null id stays null. There is
    no limit on a text or a word: a word beyond 64 bytes is merged in its own tree in n log n steps. An
    empty table gives no rows.
    """
    tables = df.sparkSession.sparkContext.broadcast(load_tables(tokenizer_path))
    kind = df.schema[id_col].dataType.simpleString()
    return id_and_bytes(df, id_col, text_col).mapInArrow(encoder(tables), f"doc_id {kind}, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Token counts and SHA-256 digests of ids and decoded texts."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
