"""The dialect of CSV files, from all of their bytes, by states of byte ranges that merge in order.

A range does not know whether it begins inside a quoted value, so it is scanned for both cases. Its state
holds, for each way to quote and each delimiter: whether the range changes the case, how many records of
each width lie in it, the loose ends before its first and after its last line end (delimiters, and whether
there is anything at all), and how many line ends stand in quotes. Two neighbouring states merge into the state of both ranges; the merged state of a
whole file tells its delimiter, quote and escape signs, and whether a reader may split it at line ends.
"""

from __future__ import annotations

import codecs
import csv
import io
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybridge.errors import CompareError

#: Bytes of a range that one task scans, and of the pieces that it holds at once.
RANGE, PIECE = 64 << 20, 4 << 20
DELIMITERS = (",", ";", "\t", "|")
#: Ways to quote, as pairs of quote and escape sign, the likeliest first.
QUOTING = (('"', '"'), ('"', "\\"), ("'", "'"))
CR, LF = 13, 10


def candidates(options: dict) -> list[tuple[str, str, str]]:
    """Quote, escape and delimiter signs to try; those that ``options`` names are fixed."""
    quote, escape = options.get("quote"), options.get("escape")
    ways = [(q, e) for q, e in QUOTING if quote in (None, q) and escape in (None, e)] or [(quote or '"', escape or quote or '"')]
    return [(q, e, d) for q, e in ways for d in ([options["delimiter"]] if "delimiter" in options else DELIMITERS)]


def piece_state(raw: bytes, before: int, after: int, quote: str, escape: str, delimiters: list[str], slashes: int) -> dict[str, list[dict]]:
    """States of one piece by delimiter, each for a start outside and inside quotes.

    ``before`` and ``after`` are the bytes around the piece, line ends at the ends of a file; ``slashes`` is the
    number of escape signs right before the piece.
    """
    a = np.frombuffer(raw, np.uint8)
    quotes = np.flatnonzero(a == ord(quote))
    if escape != quote and len(quotes) and (slashes or escape.encode() in raw):
        quotes = np.array([i for i in quotes.tolist() if not escaped(raw, i, ord(escape), slashes)], np.int64)
    behind = np.concatenate([np.array([before], np.uint8), a[:-1]])
    following = np.concatenate([a[1:], np.array([after], np.uint8)])
    ends = np.flatnonzero((a == LF) | ((a == CR) & (following != LF)))
    inside = np.searchsorted(quotes, ends, side="left") & 1
    trailing = (behind[ends] == CR) & (a[ends] == LF) & (ends > 0)
    out = {}
    for delimiter in delimiters:
        marks = np.flatnonzero(a == ord(delimiter))
        parity = np.searchsorted(quotes, marks, side="left") & 1
        out[delimiter] = []
        for start in (0, 1):
            own, free = ends[inside == start], marks[parity == start]
            opening = quotes[(np.arange(len(quotes)) & 1) == start]
            regular = np.isin(behind[opening], np.array([ord(delimiter), CR, LF, ord(quote)], np.uint8))
            state = {"flips": len(quotes) & 1, "quoted": int((inside != start).sum()), "stray": int((~regular).sum()), "ends": len(own) > 0, "inner": None, "widths": {}}
            # a line end of two bytes may begin in this piece and end in the next
            rest = len(a) - int(len(a) > 0 and a[-1] == CR and after == LF)
            if not len(own):
                state |= {"first": [len(free), int(rest > 0)], "last": [0, 0]}
            else:
                counts, cut = np.searchsorted(free, own), trailing[inside == start]
                sizes = np.diff(own) - 1 - cut[1:]
                widths = (np.diff(counts) + 1)[sizes > 0]
                kinds, n = np.unique(widths, return_counts=True)
                state["widths"] = dict(zip(map(str, kinds.tolist()), n.tolist(), strict=True))
                state["inner"] = int(widths[0]) if len(widths) else None
                state |= {"first": [int(counts[0]), int(own[0] > cut[0])], "last": [int(len(free) - counts[-1]), int(rest > own[-1] + 1)]}
            out[delimiter].append(state)
    return out


def escaped(raw: bytes, at: int, sign: int, slashes: int) -> bool:
    """Whether an odd number of escape signs stands before a byte."""
    n = 0
    while at - n > 0 and raw[at - n - 1] == sign:
        n += 1
    return (n + (slashes if n == at else 0)) % 2 == 1


def merged(a: list[dict], b: list[dict]) -> list[dict]:
    """The states of two neighbouring stretches as the states of both together."""
    out = []
    for x in a:
        y = b[len(out) ^ x["flips"]]
        loose = x["last" if x["ends"] else "first"]
        joint = [loose[0] + y["first"][0], loose[1] | y["first"][1]]
        state = {"flips": x["flips"] ^ y["flips"], "quoted": x["quoted"] + y["quoted"], "stray": x["stray"] + y["stray"], "ends": x["ends"] or y["ends"]}
        widths, inner = dict(x["widths"]), x["inner"]
        if x["ends"] and y["ends"] and joint[1] > 0:
            widths[str(joint[0] + 1)] = widths.get(str(joint[0] + 1), 0) + 1
            inner = inner or joint[0] + 1
        for w, n in y["widths"].items():
            widths[w] = widths.get(w, 0) + n
        first = x["first"] if x["ends"] else joint
        last = y["last"] if y["ends"] else joint if x["ends"] else [0, 0]
        out.append(state | {"widths": widths, "inner": inner or y["inner"], "first": first, "last": last})
    return out


def judged(states: dict[tuple[str, str, str], dict]) -> dict:
    """The dialect of a whole file from its merged states, each begun outside quotes at the file's start."""
    best, found = None, {}
    for (quote, escape, delimiter), state in states.items():
        widths = {int(w): n for w, n in state["widths"].items()}
        loose = [state["first"]] + ([state["last"]] if state["ends"] else [])
        for count, size in loose:
            if size > 0:
                widths[count + 1] = widths.get(count + 1, 0) + 1
        first = state["first"][0] + 1 if state["first"][1] > 0 else state["inner"] or (state["last"][0] + 1 if state["ends"] else 0)
        total = sum(widths.values())
        width, n = max(widths.items(), key=lambda w: (w[1], w[0]), default=(0, 0))
        share = n / total if total and width > 1 else 0.0
        key = (not state["flips"], share == 1.0, share >= 0.5, share, width)
        if best is None or key > best:
            best = key
            found = {"quote": quote, "escape": escape, "delimiter": delimiter, "records": total, "width": width, "uniform": n == total, "first_width": first, "multiline": bool(state["quoted"] or state["stray"] or state["flips"])}
    return found


def range_states(path: str, start: int, stop: int, size: int, tried: list[tuple[str, str, str]]) -> tuple[dict, bool]:
    """The merged states of one byte range, read a piece at a time, and whether its bytes are UTF-8."""
    decoder, valid = codecs.getincrementaldecoder("utf-8")("strict"), True
    states: dict[tuple[str, str, str], list[dict]] = {}
    ways = list(dict.fromkeys((q, e) for q, e, _ in tried))
    with open(path, "rb") as f:
        at, before, slashes = start, LF, 0
        if start:
            back = 1
            while True:
                f.seek(max(0, start - back))
                tail = f.read(min(back, start))
                slashes = len(tail) - len(tail.rstrip(b"\\"))
                if slashes < len(tail) or back >= start:
                    break
                back *= 2
            before = tail[-1]
        elif f.read(3) == codecs.BOM_UTF8:
            at = 3
        f.seek(at)
        fresh = at > 3
        while at < stop:
            raw = f.read(min(PIECE, stop - at))
            if not raw:
                break
            at += len(raw)
            ahead = f.read(4)
            f.seek(at)
            try:
                text = raw
                if fresh:  # the rest of a sign that began before this range is the other range's
                    k = next((i for i, b in enumerate(raw[:4]) if b & 0xC0 != 0x80), min(4, len(raw)))
                    text, fresh = raw[k:], False
                if at >= stop:
                    text += ahead[: next((i for i, b in enumerate(ahead) if b & 0xC0 != 0x80), len(ahead))]
                decoder.decode(text, at >= stop)
            except UnicodeDecodeError:
                valid = False
                break
            for quote, escape in ways:
                delimiters = [d for q, e, d in tried if (q, e) == (quote, escape)]
                for d, both in piece_state(raw, before, ahead[0] if ahead else LF, quote, escape, delimiters, slashes).items():
                    key = (quote, escape, d)
                    states[key] = merged(states[key], both) if key in states else both
            before, slashes = raw[-1], len(raw) - len(raw.rstrip(b"\\")) + (slashes if not raw.rstrip(b"\\") else 0)
    return states, valid


def scanning(tried: list[tuple[str, str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                states, valid = range_states(row["path"], row["start"], min(row["start"] + RANGE, row["size"]), row["size"], tried)
                text = json.dumps([[*k, v] for k, v in states.items()])
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "start": row["start"], "valid": valid, "states": text}])

    return run


def folding(group: pd.DataFrame) -> pd.DataFrame:
    """The states of a file's ranges, merged in order and judged."""
    whole: dict[tuple[str, str, str], list[dict]] = {}
    for text in group.sort_values("start")["states"]:
        for quote, escape, delimiter, both in json.loads(text):
            key = (quote, escape, delimiter)
            whole[key] = merged(whole[key], both) if key in whole else both
    dialect = judged({k: v[0] for k, v in whole.items()})
    return pd.DataFrame({"file": [group["file"].iloc[0]], "valid": [bool(group["valid"].all())], "dialect": [json.dumps(dialect)]})


def first_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file's first record that is not blank, read as far as it goes."""
    csv.field_size_limit(1 << 31)
    for batch in batches:
        for row in batch.to_pylist():
            d = json.loads(row["dialect"])
            style = {"doublequote": True} if d["quote"] == d["escape"] else {"doublequote": False, "escapechar": d["escape"]}
            with io.open(row["path"], encoding="utf-8-sig", newline="") as f:
                record = next((r for r in csv.reader(f, delimiter=d["delimiter"], quotechar=d["quote"], **style) if r), [])
            yield pa.RecordBatch.from_pylist([{"file": row["file"], "record": json.dumps(record)}])


def dialects(spark: SparkSession, files: list[tuple[int, str]], options: dict) -> dict[int, dict]:
    """The dialect and the first record of each CSV file, by its number. All bytes are read, in ranges, by tasks."""
    rows = [(i, path, os.path.getsize(path)) for i, path in files]
    frame = spark.createDataFrame(rows, "file long, path string, size long")
    ranges = frame.select("file", "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("size", F.lit(1)).cast("long") - 1, F.lit(RANGE).cast("long"))).alias("start"))
    tasks = sum(1 + size // RANGE for _, _, size in rows)
    scanned = ranges.repartition(min(tasks, 10_000)).mapInArrow(scanning(candidates(options)), "file long, start long, valid boolean, states string")
    found = scanned.groupBy("file").applyInPandas(folding, "file long, valid boolean, dialect string").collect()
    if not all(r.valid for r in found):
        raise CompareError("CSV input must be UTF-8 text")
    out = {r.file: json.loads(r.dialect) for r in found}
    if not all(d.get("records") for d in out.values()):
        raise CompareError("CSV input is empty")
    if any(not d["uniform"] and d["width"] > 1 and d["first_width"] != d["width"] for d in out.values()):
        raise CompareError("A CSV file begins with lines of another width than its other rows; supply a clean file without a preamble")
    heads = spark.createDataFrame([(i, path, json.dumps(out[i])) for i, path in files], "file long, path string, dialect string")
    for r in heads.repartition(min(len(files), 1000)).mapInArrow(first_records, "file long, record string").collect():
        out[r.file]["record"] = json.loads(r.record)
    return out
