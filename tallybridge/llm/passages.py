"""Near-duplicate passages between documents with compact windows.

The tokens are shingles of five words, under several hash functions. A passage's min-hash is its least
token hash. All passages whose least token is the one at place b, reaching from no earlier than a to no
later than c, share that min-hash: the compact window (a, b, c). The windows of a text are the nodes of
the Cartesian tree of its hashes, and those that hold a passage of MIN_TOKENS tokens are the nodes that are
least in some run of so many tokens, about 2 n / MIN_TOKENS of n, which one sliding minimum finds.

Windows with one hash function and min-hash meet in a bucket. Passages this alike share a run of at least
20 tokens: of 46, at most five may be without partner, and every break costs four or more. A centre in such a
run has ten equal tokens on one of its sides at least. So a bucket is parted by what stands left of its
centres, and once more by what stands right of them; a short line that many documents share joins none.
Each window is joined with its part's first document, so a part of any size gives as many pairs as it has windows. For two documents, overlapping
windows of enough hash functions along one alignment name a candidate passage. Candidates are verified
on the words of both texts.

Each centre has a class: the first document of those whose passages found so hold it, or its own document.
Like passages of one class are linked by that document. Where a part has centres of several classes, those of
another class than its first document's are open, and each must meet all centres of other classes. The tokens
around them meet block by block inside tasks. Two centres are compared only if they share one of their rarer
tokens, as any like pair does, and no longer once links join their classes, so every like pair is joined by
links while copies make few. Only a pair that passes leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, discard, id_and_bytes, node_of, settle, slices, written
from .shingles import BLANK, LOWER, mix, run_hashes, word_bounds, word_hashes

WIDTH, MIN_WORDS, MIN_TOKENS, PERCENT = 5, 50, 40, 80
#: Hash functions, and how many of them must agree on a candidate.
FUNCTIONS, ENOUGH = 4, 2
#: Tokens by which an alignment may shift, or that may differ in a row, within one passage.
SLACK = 16
#: Passages of one document that are fetched with one copy of its text.
FETCHED = 2048
#: Equal tokens beside a centre that part a bucket, and tokens on each side that are compared.
BESIDE, AROUND = 10, 45
#: Centres of one block of a bucket's part.
BLOCK = 8192
#: Pairs of centres that are compared at once, and tokens met in both of a pair that are listed at once.
PAIRED, MET = 8192, 1 << 21
SEEDS = np.random.default_rng(77).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64)


def text_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes of the texts' words in one array, and where each text's words start.

    The last WIDTH - 1 places of a text run into the next one; they start no shingle.
    """
    words, at = word_hashes(texts)
    return run_hashes(words, WIDTH), at


def centres(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places that are least in some run of MIN_TOKENS tokens within one text (the leftmost of equals)."""
    bits = np.uint64(max(1, len(values).bit_length()))
    least, span = ((values >> bits) << bits) | np.arange(len(values), dtype=np.uint64), 1
    while 2 * span <= MIN_TOKENS:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (MIN_TOKENS - span)], least[MIN_TOKENS - span :]) if span < MIN_TOKENS else least
    starts = np.concatenate([np.arange(a, b - MIN_TOKENS + 1) for a, b in zip(first.tolist(), last.tolist(), strict=True) if b - a >= MIN_TOKENS] or [np.zeros(0, np.int64)])
    place = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place


def smaller_before(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each value the place of the last smaller one before it in its text, or -1.

    All values between a place and the one it points to are larger, so a place that points to a larger value
    may point where that value points: all of them jump at once, and few rounds settle a whole slice of texts.
    """
    out = np.where(begins, -1, np.arange(-1, len(values) - 1))
    ended = np.append(values, -1)
    todo = np.flatnonzero(ended[out] > values)
    while len(todo):
        out[todo] = out[out[todo]]
        todo = todo[ended[out[todo]] > values[todo]]
    return out


def reaches(places: np.ndarray, values: np.ndarray, first: np.ndarray | int, last: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """How far each centre's window reaches to the left and right: up to the next smaller token.

    These are the parents' sides in the Cartesian tree of the centres; the next smaller token of a window
    this wide is a centre too. ``values`` are different numbers from 0; ``first`` and ``last`` bound each centre's text.
    """
    places, values = np.asarray(places, np.int64), np.asarray(values, np.int64)
    first, last = np.broadcast_to(first, places.shape), np.broadcast_to(last, places.shape)
    if not len(places):
        return places, places
    new = np.concatenate([[True], first[1:] != first[:-1]])
    before = smaller_before(values, new)
    after = len(values) - 1 - smaller_before(values[::-1], np.append(new[1:], True)[::-1])[::-1]
    begin = np.where(before < 0, first, places[before] + 1)
    end = np.where(after >= len(values), last, places[np.minimum(after, len(values) - 1)])
    return places - begin, end - 1 - places


def centred(tokens: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By hash function: its number, values and places of the centres, their texts, bucket hashes, and which to keep."""
    for function in range(FUNCTIONS):
        values = mix(tokens ^ SEEDS[function])
        place = centres(values, first, last)
        owner = np.searchsorted(at, place, side="right") - 1
        # of a run of equal tokens, as repeated words give, the first alone stands for the others
        keep = (place == first[owner]) | (tokens[place - 1] != tokens[place])
        yield function, values[place], place, owner, mix(values[place] + SEEDS[function]).view(np.int64), keep


def tokens_and_bounds(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    tokens, at = text_tokens(piece.column("text").to_pylist())
    return tokens, at, at[:-1], np.maximum(at[:-1], at[1:] - WIDTH + 1)


def windowing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compact windows: hash (of function and min-hash), doc, place, function and reaches packed, and 32 bits
    each of the hashes of what stands left and right of the centre."""
    for piece in slices(batches):
        tokens, at, first, last = tokens_and_bounds(piece)
        if len(tokens) < MIN_TOKENS:
            continue
        docs, edge = piece.column("doc_id").to_numpy(), np.zeros(BESIDE, np.uint64)
        beside = run_hashes(np.concatenate([edge, tokens, edge, edge]), BESIDE)
        for function, values, place, owner, hashes, keep in centred(tokens, at, first, last):
            # equal tokens compare by place, as in the sliding minimum
            rank = np.empty(len(place), np.int64)
            rank[np.argsort(values, kind="stable")] = np.arange(len(place))
            left, right = reaches(place, rank, first[owner], last[owner])
            packed = np.int64(function) << 60 | left << 30 | right
            sides = (beside[place] & np.uint64(0xFFFFFFFF00000000) | beside[place + BESIDE + 1] >> np.uint64(32)).view(np.int64)
            columns = [hashes, docs[owner], place - first[owner], packed, sides]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep].astype(np.int64)) for c in columns], ["hash", "doc", "at", "reach", "beside"])


def shared_keys(batches: Iterator[pa.RecordBatch], key: str, order: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of key those whose key several documents have, with the key's first values of the columns
    in ``order``. Of a key no more is held than rows of one document, until another one comes."""
    held: list[pa.RecordBatch] = []
    # the last key and its first values, if several documents of it have come
    known: tuple[int, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        keys, doc = (rows.column(c).to_numpy() for c in (key, "doc"))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        first = [rows.column(c).to_numpy()[starts] for c in (key, *order)]
        met = np.maximum.reduceat(doc, starts) > np.minimum.reduceat(doc, starts)
        if known and known[0] == keys[0]:
            met[0] = True
            for c, v in zip(first, known, strict=True):
                c[0] = v
        known = tuple(int(c[-1]) for c in first) if met[-1] else None
        held = [] if known else rows.slice(int(starts[-1])).to_batches()
        size = np.diff(np.append(starts, len(keys)))
        keep = np.repeat(met, size)
        columns = [*(rows.column(c).to_numpy()[keep] for c in rows.column_names), *(np.repeat(c[met], size[met]) for c in first[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*rows.column_names, *("lead" if c == "doc" else f"l_{c}" for c in order)])


def candidates(owner: np.ndarray, at: np.ndarray, l_at: np.ndarray, reach: np.ndarray, l_reach: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places where windows of enough hash functions overlap along one alignment: the pair of documents (by
    its number in ``owner``), token ranges of both, and by how much the first window's places differ."""
    if not len(at):
        return (np.zeros(0, np.int64),) * 6
    order = np.lexsort((at - l_at, owner))
    owner, at, l_at, reach, l_reach = (c[order] for c in (owner, at, l_at, reach, l_reach))
    slip = at - l_at
    line = np.cumsum(np.concatenate([[0], (owner[1:] != owner[:-1]) | (slip[1:] - slip[:-1] > SLACK)]))
    order = np.lexsort((at, line))
    owner, at, l_at, reach, l_reach = (c[order] for c in (owner, at, l_at, reach, l_reach))
    mask, apart = (1 << 30) - 1, 1 << 32
    lo, hi = at - (reach >> 30 & mask), at + (reach & mask)
    l_lo, l_hi = l_at - (l_reach >> 30 & mask), l_at + (l_reach & mask)
    far = np.maximum.accumulate(hi + line * apart)
    starts = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (lo[1:] + line[1:] * apart > far[:-1] + SLACK)]))
    functions = np.bitwise_or.reduceat(np.left_shift(1, reach >> 60), starts)
    enough = np.bitwise_count(functions) >= ENOUGH
    least, most = (lambda c: np.minimum.reduceat(c, starts)), (lambda c: np.maximum.reduceat(c, starts))
    return tuple(c[enough] for c in (owner[starts], least(lo), most(hi), least(l_lo), most(l_hi), (l_at - at)[starts]))


PAIRS = "doc long, lead long, lo long, hi long, l_lo long, l_hi long, shift long"


def pair_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "lead", "lo", "hi", "l_lo", "l_hi", "shift"])


def in_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come in order of ``keys``, as tables of whole groups and where each group begins, with the end.
    A group is held whole, but no more."""

    def table(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held)
        at = np.stack([rows.column(c).to_numpy() for c in keys])
        new = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1
        return rows, np.concatenate([[0], new, [rows.num_rows]])

    held: list[pa.RecordBatch] = []
    last = np.zeros((len(keys), 1))
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(c).to_numpy() for c in keys])
        new = np.flatnonzero((at != np.concatenate([last if held else at[:, :1], at[:, :-1]], axis=1)).any(axis=0))
        last = at[:, -1:]
        if len(new):
            # the last group may go on in the next batch
            yield table([*held, batch.slice(0, int(new[-1]))])
            held = [batch.slice(int(new[-1]))]
        else:
            held.append(batch)
    if held:
        yield table(held)


def pairing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates, with some room, as windows of a part see no further than its centres' surroundings."""
    for rows, cuts in in_groups(batches, "doc", "lead"):
        owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        owner, lo, hi, l_lo, l_hi, shift = candidates(owner, *(rows.column(c).to_numpy() for c in ("at", "l_at", "reach", "l_reach")))
        doc, lead = (rows.column(c).to_numpy()[cuts[owner]] for c in ("doc", "lead"))
        columns = [doc, lead, np.maximum(0, lo - SLACK), hi + SLACK, np.maximum(0, l_lo - SLACK), l_hi + SLACK, shift]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "lead", "lo", "hi", "l_lo", "l_hi", "shift"])


def merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The surroundings of centres that are alike in two documents; those along one alignment that overlap are one."""
    for batch in batches:
        rows = []
        for doc, lead, places in zip(*[batch.column(c).to_pylist() for c in ("doc", "lead", "places")], strict=True):
            run: list[int] = []
            for shift, at in sorted((p["l_at"] - p["at"], p["at"]) for p in places):
                # sorted by alignment: a small change of it goes on with the passage
                if run and abs(shift - run[2]) <= SLACK and run[0] - 2 * AROUND <= at <= run[1] + 2 * AROUND:
                    run[:3] = [min(run[0], at), max(run[1], at), shift]
                else:
                    if run:
                        rows.append((doc, lead, run[0], run[1], run[3]))
                    run = [at, at, shift, shift]
            rows.append((doc, lead, run[0], run[1], run[3]))
        room = AROUND + SLACK
        yield pair_rows([(d, e, max(0, lo - room), hi + room, max(0, lo + shift - room), hi + shift + room, shift) for d, e, lo, hi, shift in rows])


def fetching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the asked token ranges of each text, in lower case."""
    for piece in slices(batches):
        keys, parts = [], []
        for text, asks in zip(piece.column("text").to_pylist(), piece.column("asks").to_pylist(), strict=True):
            low = text.translate(LOWER)
            starts, ends = word_bounds(np.frombuffer(low, np.uint8))
            for ask in asks:
                last = min(ask["hi"] + WIDTH, len(ends)) - 1
                keys.append(ask["key"])
                parts.append(low[starts[ask["lo"]] : ends[last]] if ask["lo"] <= last else b"")
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(parts, pa.binary())], ["key", "words"])


def tokens_of(*texts: bytes) -> list[np.ndarray]:
    """Numbers of all runs of WIDTH words of some texts; words are told by their bytes, runs by 64 bits."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, stops = word_bounds(raw)
    if len(starts) < WIDTH:
        return [np.zeros(0, np.int64) for _ in texts]
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(stops - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw[~BLANK[raw]])])
    flat = words.dictionary_encode().indices.to_numpy().astype(np.uint64) + np.uint64(1)
    _, runs = np.unique(run_hashes(mix(flat), WIDTH), return_inverse=True)
    at = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])).tolist()
    return [runs[a : max(a, b - WIDTH + 1)] for a, b in zip(at[:-1], at[1:], strict=True)]


def matches(x: np.ndarray, y: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of x whose token y has too, and where in y: of several places the one nearest to the alignment."""
    if not len(x) or not len(y):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    span = len(x) + len(y) + abs(shift) + 2
    wide = 4 * span
    places = np.sort(y * wide + np.arange(len(y)) + span)
    want = x * wide + np.clip(np.arange(len(x)) + shift, -span, 2 * span) + span
    after = np.minimum(np.searchsorted(places, want), len(places) - 1)
    before = np.maximum(after - 1, 0)
    far = [np.where(places[i] // wide == x, np.abs(places[i] - want), 8 * span) for i in (before, after)]
    best = np.where(far[1] < far[0], after, before)
    p = np.flatnonzero(np.minimum(*far) < 8 * span)
    return p, places[best[p]] % wide - span


def longest(p: np.ndarray, q: np.ndarray) -> tuple[int, int]:
    """Of matches p in x and q in y the longest stretch that is alike, if each match is a token of its own:
    s matches over n and m tokens give s / (n + m - s), so prefix sums show where a stretch may begin."""
    score = (100 + PERCENT) * np.arange(len(p)) - PERCENT * (p + q)
    begin = np.searchsorted(-np.minimum.accumulate(score), -(score + 100 - PERCENT), side="left")
    end = int(np.argmax(p - p[begin]))
    return int(begin[end]), end + 1


def place_before(tokens: np.ndarray) -> np.ndarray:
    """Where each token stands last before its place, or -1."""
    order, out = np.argsort(tokens, kind="stable"), np.full(len(tokens), -1)
    again = np.flatnonzero(tokens[order[1:]] == tokens[order[:-1]])
    out[order[again + 1]] = order[again]
    return out


def passages_of(x: np.ndarray, y: np.ndarray, shift: int = 0) -> list[tuple[int, int, int, int, float]]:
    """Passages that x and y share: first and last token in x, in y, and the similarity of their token sets.

    ``shift`` is the difference of places in y and in x where passages are expected to match.
    """
    p, q = matches(x, y, shift)
    out = []
    wide, slip = np.diff(p), np.abs(np.diff(q - p))
    apart, rising = wide + slip, np.diff(q) > 0
    x_before, y_before = place_before(x), place_before(y)
    once = bool((x_before < 0).all() and (y_before < 0).all())

    def long(a: int, b: int) -> bool:
        return b - a > 1 and p[b - 1] - p[a] + WIDTH >= MIN_WORDS

    def accept(a: int, b: int) -> tuple[bool, bool]:
        """Whether matches a..b-1 are a passage, and whether all tokens there are different and in order."""
        low, high = int(q[a:b].min()), int(q[a:b].max())
        n, m = int(p[b - 1] - p[a]) + 1, high - low + 1
        # each shared token is that of a match here; where none repeats, each match is one
        shared, differ, both = b - a, True, n + m
        if not once:
            in_x, in_y = (int(np.count_nonzero(c)) for c in (x_before[p[a] : p[b - 1] + 1] < p[a], y_before[low : high + 1] < low))
            shared, differ, both = int(np.count_nonzero(x_before[p[a:b]] < p[a])), in_x == n and in_y == m, in_x + in_y
            if 100 * shared >= PERCENT * (both - shared):
                shared = len(np.intersect1d(x[p[a] : p[b - 1] + 1], y[low : high + 1]))
        union = both - shared
        good = 100 * shared >= PERCENT * union and m - 1 + WIDTH >= MIN_WORDS
        if good:
            out.append((int(p[a]), int(p[b - 1]), low, high, shared / union))
        return good, differ and bool(rising[a : b - 1].all())

    def judge(a: int, b: int) -> None:
        """Matches a..b-1: all of them, the longest stretch that is alike and what is beside it, or cut at the widest gap."""
        good, plain = accept(a, b)
        if good:
            return
        lo, hi = (a + i for i in longest(p[a:b], q[a:b]))
        if long(lo, hi) and (lo, hi) != (a, b) and accept(lo, hi)[0]:
            todo.extend([(hi, b), (a, lo)])
            return
        gaps = apart[a : b - 1]
        if gaps.max() > 1 and not (plain and not long(lo, hi)):
            cut = a + 1 + int(np.argmax(gaps))
            todo.extend([(cut, b), (a, cut)])

    breaks = np.flatnonzero((wide > SLACK) | (slip > SLACK)) + 1
    todo = list(zip([0, *breaks.tolist()], [*breaks.tolist(), len(p)], strict=True))
    while todo:
        a, b = todo.pop()
        if long(a, b):
            judge(a, b)
    return sorted(out)


def verifying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "own"):
        rows, n = [], batch.num_rows
        tokens = tokens_of(*batch.column("own").to_pylist(), *batch.column("other").to_pylist())
        for i, (doc, lead, lo, l_lo, shift) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("doc", "lead", "lo", "l_lo", "shift")], strict=True)):
            for a, b, c, d, alike in passages_of(tokens[i], tokens[n + i], shift + lo - l_lo):
                rows.append((doc, lo + a, lo + b + WIDTH - 1, lead, l_lo + c, l_lo + d + WIDTH - 1, alike))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:6]], pa.array(columns[6], pa.float64())], ["doc_id", "first_word", "last_word", "match_doc_id", "match_first", "match_last", "similarity"])


def fetched(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """Words by key; a document with many asks is fetched in several groups of them."""
    groups = asked.groupBy("doc_id").agg(F.ceil(F.count("*") / FETCHED).alias("groups"))
    dealt = asked.join(groups, "doc_id").withColumn("group", F.pmod(F.col("key"), F.col("groups")))
    lists = dealt.groupBy("doc_id", "group").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("asks"))
    return texts.join(lists, "doc_id").select("text", "asks").mapInArrow(fetching, "key long, words binary")


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The passages that candidates (see PAIRS) hold."""
    # an even key for the later document's words, and the next odd one for the earlier document's
    asked = written(pairs.withColumn("key", F.xxhash64(*pairs.columns).bitwiseAND(F.lit(-2))))
    own = asked.select(F.col("doc").alias("doc_id"), "key", "lo", "hi")
    other = asked.select(F.col("lead").alias("doc_id"), F.col("key").bitwiseOR(F.lit(1)).alias("key"), F.col("l_lo").alias("lo"), F.col("l_hi").alias("hi"))
    words = fetched(texts, own.union(other))
    odd = F.col("key") % 2 != 0
    both = words.groupBy(F.col("key").bitwiseAND(F.lit(-2)).alias("key")).agg(F.max(F.when(~odd, F.col("words"))).alias("own"), F.max(F.when(odd, F.col("words"))).alias("other"))
    checked = asked.join(both, "key").select("doc", "lead", "lo", "l_lo", "shift", "own", "other")
    return checked.mapInArrow(verifying, "doc_id long, first_word long, last_word long, match_doc_id long, match_first long, match_last long, similarity double")


def opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The class of each centre: the first document that shares a found passage around it, or else its own; as
    ``base`` too where the document is the first of its part."""
    for rows, cuts in in_groups(batches, "doc"):
        key, at, lead, last, match = (rows.column(c).to_numpy() for c in ("key", "at", "lead", "last", "match"))
        doc = rows.column("doc").to_numpy()
        # a text's place in the table and a place in the text, as one number
        where = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)) << 32 | at
        held = np.flatnonzero(last >= 0)
        first, end, match = where[held], where[held] - at[held] + last[held] - WIDTH + 2, match[held]
        own = np.flatnonzero(last < 0)
        own = own[np.argsort(where[own], kind="stable")]
        key, doc, at, lead, where = (c[own] for c in (key, doc, at, lead, where))
        root = doc.copy()
        begins, ends = np.searchsorted(where, first), np.searchsorted(where, end)
        for k in np.argsort(-match, kind="stable").tolist():
            root[begins[k] : ends[k]] = match[k]
        yield pa.RecordBatch.from_arrays([*map(pa.array, (key, doc, at, root)), pa.array(root, mask=lead == 0)], ["key", "doc", "at", "root", "base"])


def contents(around: np.ndarray) -> np.ndarray:
    """A number for each row of tokens, the same for equal rows."""
    return mix(around.astype(np.uint64) @ mix(np.arange(1, around.shape[1] + 1, dtype=np.uint64)))


def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens around each asked centre, 32 bits of each, and a number of them all; zeros stand beyond the text."""
    for piece in slices(batches):
        tokens, first = text_tokens(piece.column("text").to_pylist())
        edge = np.zeros(AROUND, np.uint32)
        near = np.concatenate([edge, (tokens >> np.uint64(32)).astype(np.uint32) | np.uint32(1), edge])
        for doc, asks, begin, end in zip(piece.column("doc_id").to_pylist(), piece.column("asks").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
            at = np.array(asks, np.int64)
            seen = (at + begin)[:, None] + np.arange(2 * AROUND + 1)
            around = np.where((seen >= begin + AROUND) & (seen < end - WIDTH + 1 + AROUND), near[seen], 0).astype("<u4")
            columns = [pa.array(np.full(len(at), doc)), pa.array(at), pa.array(contents(around).view(np.int64)), pa.array([r.tobytes() for r in around], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "at", "content", "around"])


def long_enough(shared: np.ndarray, slip: np.ndarray | None = None) -> np.ndarray:
    """Which rows of a table of shared tokens have a stretch of MIN_WORDS words, from one shared token to
    another, in which enough tokens are shared.

    By ``slip``, how far each shared token stands from its place in the other text, the other text's stretch is
    as long as its ends say: s shared tokens of stretches of n and m must be enough of n + m - s.
    """
    least, width = MIN_WORDS - WIDTH + 1, shared.shape[1]
    hit = (shared.sum(axis=1) * 100 >= PERCENT * least) & (width - shared[:, ::-1].argmax(axis=1) - shared.argmax(axis=1) >= least)
    rows = np.flatnonzero(hit)
    part, worth, cost = shared[rows], np.int32(100 if slip is None else 100 + PERCENT), np.int32(PERCENT if slip is None else 2 * PERCENT)
    sums = np.zeros((len(rows), width + 1), np.int32)
    np.cumsum(part * worth - cost, axis=1, dtype=np.int32, out=sums[:, 1:])
    begin, end = sums[:, :-1], sums[:, 1:]
    if slip is not None:
        moved = slip[rows] * np.int32(PERCENT)
        begin, end = begin - moved, end - moved
    least_begin = np.minimum.accumulate(np.where(part, begin, np.int32(1 << 30)), axis=1)[:, : width - least + 1]
    hit[rows] = ((end[:, least - 1 :] >= least_begin) & part[:, least - 1 :]).any(axis=1)
    return hit


def may_be_alike(x: np.ndarray, y: np.ndarray, once: np.ndarray) -> np.ndarray:
    """Which pairs of surroundings may hold a like passage: no other pair does.

    Each side must have a stretch in which PERCENT of the tokens are shared. Where no text repeats a token
    (``once``), each shared one has one partner, so the lengths of both stretches count.
    """
    own = (x == y) & (x > 0)
    other, slip = own.copy(), np.zeros(x.shape, np.int8)
    for shift in range(1, SLACK + 1):
        later, sooner = (x[:, shift:] == y[:, :-shift]) & (x[:, shift:] > 0), (x[:, :-shift] == y[:, shift:]) & (x[:, :-shift] > 0)
        own[:, shift:] |= later
        other[:, :-shift] |= later
        own[:, :-shift] |= sooner
        other[:, shift:] |= sooner
        slip[:, shift:] -= later.view(np.int8) * np.int8(shift)
        slip[:, :-shift] += sooner.view(np.int8) * np.int8(shift)
    out, one = np.zeros(len(x), bool), np.flatnonzero(once)
    out[one] = long_enough(own[one], slip[one])
    rest = np.flatnonzero(~once)
    rest = rest[long_enough(own[rest])]
    out[rest[long_enough(other[rest])]] = True
    return out


def overlapping(block: np.ndarray, around: np.ndarray, once: np.ndarray, mine: np.ndarray, others: np.ndarray, wanted: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of ``mine``, of ``others``) in one block that may share enough different tokens, of different documents.

    Where either text repeats no token around its centre, a like passage has MIN_WORDS - WIDTH + 1 different
    tokens there, and PERCENT of these are shared. With tokens in one order for all, the rarest first, two such
    centres share one of all tokens but the last so many; a line that many documents share comes last.
    """
    need = -(-(MIN_WORDS - WIDTH + 1) * PERCENT // 100)
    rows = np.concatenate([mine, others])
    coded = np.sort(block[rows].astype(np.uint64)[:, None] << np.uint64(32) | around[rows].astype(np.uint64), axis=1)
    fresh = (coded & np.uint64(0xFFFFFFFF)) > 0
    fresh[:, 1:] &= coded[:, 1:] != coded[:, :-1]
    size = fresh.sum(axis=1)
    row = np.repeat(np.arange(len(rows)), size)
    _, token, times = np.unique(coded[fresh], return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    token = rank[token.ravel()]
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    begins = np.cumsum(size) - size
    early = np.arange(len(row)) - begins[row] < (size - need + 1)[row]
    row, token = row[early], token[early]
    ours = row < len(mine)
    x_row, x_token = row[ours], token[ours]
    y_row, y_token = row[~ours] - len(mine), token[~ours]
    order = np.argsort(y_token, kind="stable")
    y_token, y_row = y_token[order], y_row[order]
    start = np.searchsorted(y_token, x_token)
    count = np.searchsorted(y_token, x_token, side="right") - start
    total, out, a = np.cumsum(count), [], 0
    ends = np.flatnonzero(np.concatenate([x_row[1:] != x_row[:-1], [True]])) + 1 if len(x_row) else np.zeros(0, np.int64)
    while a < len(x_row):
        base = total[a - 1] if a else 0
        cut = ends[np.searchsorted(total[ends - 1], base + MET, side="right") - 1] if total[ends[np.searchsorted(ends, a, side="right")] - 1] <= base + MET else ends[np.searchsorted(ends, a, side="right")]
        of = np.repeat(np.arange(a, cut), count[a:cut])
        at = start[of] + np.arange(len(of)) - (total[of] - count[of] - base)
        x, y = x_row[of], y_row[at]
        fit = wanted(mine[x], others[y])
        both = np.unique(x[fit].astype(np.int64) * len(others) + y[fit])
        x, y = both // max(1, len(others)), both % max(1, len(others))
        keep = once[mine[x]] | once[others[y]]
        out.append((x[keep], y[keep]))
        a = int(cut)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def links(block: np.ndarray, own: np.ndarray, is_open: np.ndarray, doc: np.ndarray, at: np.ndarray, root: np.ndarray, around: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Blocks of open centres (where ``own``) and of all centres, each of one part of a bucket: links of like
    surroundings that join all classes of a block which have any, as later and earlier document and their places."""
    out: list[tuple[int, int, int, int]] = []
    order = np.lexsort((at, doc, own, block))
    block, own, is_open, doc, at, root, around = (c[order] for c in (block, own, is_open, doc, at, root, around))
    ranked = np.sort(around, axis=1)
    once = ~((ranked[:, 1:] == ranked[:, :-1]) & (ranked[:, 1:] > 0)).any(axis=1)
    # repeated lines give the same surroundings again and again; each two contents are judged once
    _, content = np.unique(contents(around), return_inverse=True)
    judged: dict[tuple[int, int], bool] = {}
    _, number = np.unique(root, return_inverse=True)
    _, group = np.unique(block * len(doc) + number, return_inverse=True)
    joined = np.arange(int(group.max()) + 1)

    def last_of(g: int) -> int:
        while joined[g] != g:
            joined[g] = joined[joined[g]]
            g = int(joined[g])
        return g

    def judge(k: int, i: int) -> None:
        """Link two rows of different documents if their surroundings are alike and nothing joins their classes yet."""
        one, two = last_of(int(group[k])), last_of(int(group[i]))
        if one == two or doc[k] == doc[i]:
            return
        both = int(content[k]), int(content[i])
        if both not in judged:
            x, y = (around[j].astype(np.int64) for j in (k, i))
            judged[both] = bool(passages_of(x[x > 0], y[y > 0], int((y[:AROUND] > 0).sum() - (x[:AROUND] > 0).sum())))
        if judged[both]:
            joined[max(one, two)] = min(one, two)
            k, i = (k, i) if doc[k] > doc[i] else (i, k)
            out.append((int(doc[k]), int(doc[i]), int(at[k]), int(at[i])))

    def wanted(k: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Of two open centres the later tries the earlier; those that are not open try nothing, and are tried by all."""
        return (group[k] != group[i]) & (doc[k] != doc[i]) & ((doc[i] < doc[k]) | ~is_open[i])

    def in_order(rows: np.ndarray, begin: np.ndarray, count: np.ndarray, listed: np.ndarray) -> None:
        """Try each row's candidates listed[begin: begin + count], a few at a time."""
        active, tried, step = np.flatnonzero(count > 0), np.zeros(len(rows), np.int64), 8
        while len(active):
            take = np.minimum(count[active] - tried[active], step)
            total, a = np.cumsum(take), 0
            while a < len(active):
                base = total[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(total, base + PAIRED, side="right")))
                of = np.repeat(np.arange(a, b), take[a:b])
                next_one = begin[active[of]] + tried[active[of]] + np.arange(len(of)) - (total[of] - take[of] - base)
                k, i = rows[active[of]], listed[next_one]
                while (joined[joined] != joined).any():
                    joined[:] = joined[joined]
                fit = np.flatnonzero((joined[group[k]] != joined[group[i]]) & wanted(k, i))
                k, i = k[fit], i[fit]
                for p in np.flatnonzero(may_be_alike(around[k], around[i], once[k] & once[i])).tolist():
                    judge(int(k[p]), int(i[p]))
                a = b
            tried[active] += take
            active = active[tried[active] < count[active]]
            step = min(2 * step, BLOCK)

    # of equal contents in a block the first stands for all; the open ones among the others are linked with it
    kind = block * 4 + own * 2 + is_open
    order = np.lexsort((np.arange(len(doc)), content, kind))
    fresh = np.concatenate([[True], (kind[order][1:] != kind[order][:-1]) | (content[order][1:] != content[order][:-1])])
    lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    for k, i in zip(order[~fresh & own[order]].tolist(), lead[~fresh & own[order]].tolist(), strict=True):
        judge(k, i)
    stands = np.sort(order[fresh])
    mine, others = stands[own[stands]], stands[~own[stands]]
    x, y = overlapping(block, around, once, mine, others, wanted)
    count = np.bincount(x, minlength=len(mine))
    in_order(mine, np.cumsum(count) - count, count, others[y])
    # surroundings that repeat tokens are tried against all others that do so too, by document
    mine, others = mine[~once[mine]], others[~once[others]]
    begin = np.searchsorted(block[others], block[mine])
    in_order(mine, begin, np.searchsorted(block[others], block[mine], side="right") - begin, others)
    return out


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blocks of a task, which come in order of key, i and j."""
    for rows, cuts in in_groups(batches, "key", "i", "j"):
        own, is_open, doc, at, root = (rows.column(c).to_numpy() for c in ("own", "open", "doc", "at", "root"))
        around = np.frombuffer(b"".join(rows.column("around").to_pylist()), "<u4").reshape(len(doc), -1)
        out = links(np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)), own.astype(bool), is_open.astype(bool), doc, at, root, around)
        columns = zip(*out, strict=True) if out else ((),) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "lead", "at", "l_at"])


def in_blocks(met: DataFrame, around: DataFrame) -> DataFrame:
    """The centres of parts with several classes, dealt to blocks of open ones (i) and of all of a part (j)."""
    part = Window.partitionBy("key")
    # centres that are not open have one class in their part; of those with equal surroundings one stands for all
    told = met.join(around.groupBy("doc", "at").agg(F.min("content").alias("content")), ["doc", "at"]).repartition("key")
    each = [F.when(F.col("open"), F.col(c)).alias(f"open_{c}") for c in ("doc", "at")]
    kept = told.groupBy("key", "root", "open", "content", *each).agg(F.min(F.struct("doc", "at")).alias("m")).select("key", "root", "open", "content", "m.doc", "m.at")
    blocks = lambda n: F.ceil(n.over(part) / BLOCK).cast("int")
    sized = kept.withColumns({"rows": blocks(F.count_if("open")), "columns": blocks(F.count("*"))})
    place = F.pmod(F.xxhash64("doc", "at"), F.lit(1 << 30))
    i, j = (place % F.col("rows")).cast("int"), (place % F.col("columns")).cast("int")
    as_own = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda n: F.struct(F.lit(1).alias("own"), i.alias("i"), n.alias("j")))
    as_other = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda n: F.struct(F.lit(0).alias("own"), n.alias("i"), j.alias("j")))
    full = sized.join(around.dropDuplicates(["doc", "at", "content"]), ["doc", "at", "content"])
    dealt = full.withColumn("block", F.explode(F.when(F.col("open"), F.concat(as_own, as_other)).otherwise(as_other)))
    return dealt.select("key", "block.i", "block.j", "block.own", "open", "doc", "at", "root", "around")


def open_pairs(texts: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """Candidates between documents of one part whose centres there no found passages bring into one class."""
    spark, none = texts.sparkSession, F.lit(-1).cast("long")
    centres = members.select("doc", "key", "at", (F.col("doc") == F.col("lead")).cast("long").alias("lead"), none.alias("last"), none.alias("match"))
    spans = found.select(F.col("doc_id").alias("doc"), none.alias("key"), F.col("first_word").alias("at"), none.alias("lead"), F.col("last_word").alias("last"), F.col("match_doc_id").alias("match"))
    rooted = centres.union(spans).repartition("doc").sortWithinPartitions("doc").mapInArrow(opening, "key long, doc long, at long, root long, base long")
    part = Window.partitionBy("key")
    classes = rooted.withColumns({"base": F.min("base").over(part), "least": F.min("root").over(part), "most": F.max("root").over(part)}).filter("least < most")
    met = written(classes.select("key", "doc", "at", "root", (F.col("root") != F.col("base")).alias("open")))
    settle(spark)
    asks = met.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("at").alias("asks"))
    around = written(texts.join(asks, "doc_id").select("doc_id", "text", "asks").mapInArrow(surroundings, "doc long, at long, content long, around binary"))
    settle(spark)
    both = in_blocks(met, around)
    pairs = both.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(alike, "doc long, lead long, at long, l_at long")
    out = written(pairs.groupBy("doc", "lead").agg(F.collect_set(F.struct("at", "l_at")).alias("places")).mapInArrow(merging, PAIRS))
    discard(met, around)
    return out


def several(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows whose key more than one document has; in an order, with the key's first values as lead and l_<name>."""
    # by one column Spark sorts its rows several times as fast as by more
    kinds = ", ".join(f"{c} long" for c in rows.columns + ["lead" if c == "doc" else f"l_{c}" for c in order])
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(partial(shared_keys, key=key, order=order), kinds)


def unheld(later: DataFrame, first: DataFrame) -> DataFrame:
    """Of later findings, those that no first finding of the same two documents holds."""
    same = (F.col("n.doc_id") == F.col("f.doc_id")) & (F.col("n.match_doc_id") == F.col("f.match_doc_id"))
    held = same & (F.col("f.first_word") <= F.col("n.first_word")) & (F.col("n.last_word") <= F.col("f.last_word"))
    return later.alias("n").join(first.alias("f"), held, "left_anti")


def near_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of at least 50 words that nearly stand in an earlier document as well.

    Words are runs of what is no ASCII white space, A-Z in lower case; two passages are alike if the sets
    of their five-word shingles have a Jaccard similarity of at least 0.8. Returns doc_id, first_word,
    last_word (from 0), an earlier document as match_doc_id with match_first and match_last, and
    similarity. Copies of a passage that match one document are not matched with each other. Any other
    passage is tried against all documents that share min-hashes of it, until rows join them: two documents with like
    passages have a row or are joined by rows of others, so the classes of documents are the components of the
    rows. A passage within a longer one of the same two documents gives no row. Of several places of one token in the other text, the one nearest to the
    alignment is taken, so repeated words match in order. Null, empty and short texts, and empty tables, give
    nothing; texts of any length are read whole; other columns are not looked at. Rows that repeat a
    doc_id count as one document, whose texts are not compared with each other; each text without
    a doc_id is a document of its own after all others, and null stands for it.
    """
    spark = df.sparkSession
    texts = id_and_bytes(df.withColumn(id_col, node_of(id_col, text_col)), id_col, text_col)
    windows = texts.mapInArrow(windowing, "hash long, doc long, at long, reach long, beside long")
    shared = written(several(windows, "hash"))
    settle(spark)
    sides = F.array(F.xxhash64("hash", F.lit(1), F.shiftright("beside", 32)), F.xxhash64("hash", F.lit(2), F.col("beside").bitwiseAND(F.lit(0xFFFFFFFF))))
    members = written(several(shared.select("doc", "at", "reach", F.explode(sides).alias("key")), "key", "doc", "at", "reach"))
    discard(shared)
    settle(spark)
    hits = members.filter("doc <> lead").select("doc", "lead", "at", "l_at", "reach", "l_reach")
    pairs = hits.repartition("doc", "lead").sortWithinPartitions("doc", "lead").mapInArrow(pairing, PAIRS)
    first = written(verified(texts, pairs))
    settle(spark)
    later = open_pairs(texts, members, first)
    discard(members)
    settle(spark)
    found = first.union(unheld(verified(texts, later), first))
    # of overlapping findings of one passage that share their ends, one row
    best = found.groupBy("doc_id", "first_word", "last_word", "match_doc_id").agg(F.max_by(F.struct("match_first", "match_last", "similarity"), F.struct("similarity", -F.col("match_first"))).alias("m"))
    back = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    return best.select(back("doc_id"), "first_word", "last_word", back("match_doc_id"), "m.match_first", "m.match_last", "m.similarity")
