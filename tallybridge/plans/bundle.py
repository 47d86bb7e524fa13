"""Result bundles: JSON, HTML, a Spark SQL replay and CSV files, published as one directory at once."""

from __future__ import annotations

import csv
import io
import json
import math
import shutil
import tempfile
from collections.abc import Callable, Iterable
from decimal import Decimal
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallybridge.errors import CompareError
from tallybridge.functions.exact import named


def to_json(value: object) -> str:
    """Indented JSON; exact decimals are texts, and numbers that are not finite are refused."""

    def plain(v: object) -> object:
        if isinstance(v, Decimal):
            return str(v)
        if hasattr(v, "isoformat"):
            return v.isoformat()
        raise TypeError(f"cannot write {type(v).__name__}")

    try:
        return json.dumps(value, default=plain, ensure_ascii=False, indent=2, allow_nan=False)
    except ValueError:
        raise CompareError("A result left the range of numbers (overflow, NaN or infinity) and cannot be written as JSON") from None


#: How evidence is written: nulls as nothing, empty texts as quotes, quotes doubled, all signs kept.
CSV_STYLE = {"header": "false", "escape": '"', "nullValue": "", "emptyValue": '""', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8"}


def write_csv(rows: DataFrame, path: Path) -> int:
    """One CSV file with a header, in the frame's order; returns its rows.

    Tasks write the parts of an ordered frame, which are ranges; the driver joins the files as bytes and sees no row.
    A null that is its row's only value is written as an empty text, as Spark writes no line for nothing.
    """
    seen, parts = Observation(), path.with_name(f".parts-{path.stem}")
    texts = [named(c).cast("string").alias(c) for c in rows.columns]
    texts = texts if len(texts) > 1 else [F.coalesce(texts[0], F.lit("")).alias(rows.columns[0])]
    rows.select(*texts).observe(seen, F.count(F.lit(1)).alias("n")).write.options(**CSV_STYLE).csv(str(parts))
    with path.open("wb") as out:
        header = io.StringIO()
        csv.writer(header, lineterminator="\n").writerow(rows.columns)
        out.write(header.getvalue().encode())
        for part in sorted(parts.glob("part-*")):
            with part.open("rb") as f:
                shutil.copyfileobj(f, out, 1 << 20)
            part.unlink()
    shutil.rmtree(parts)
    return seen.get["n"]


def prepare(out: str | Path, overwrite: bool, inputs: Iterable[str | list[str]] = ()) -> Path:
    """The target directory, if it may be written and lies outside all inputs."""
    target = Path(out).resolve()
    if target.exists() and not target.is_dir():
        raise CompareError("The output path names a file; give a folder")
    if target.exists() and any(target.iterdir()) and not overwrite:
        raise CompareError("The output folder already exists and is not empty; name another, or allow overwriting")
    for source in inputs:
        for path in map(Path, source if isinstance(source, list) else [source]):
            path = path.resolve()
            if target == path or path.is_relative_to(target) or (path.is_dir() and target.is_relative_to(path)):
                raise CompareError("Output directory must be outside input files and directories")
    target.parent.mkdir(parents=True, exist_ok=True)
    return target


def publish(target: Path, overwrite: bool, fill: Callable[[Path], object], recheck: Callable[[Path], None] | None = None) -> object:
    """Fill a hidden directory beside the target, then put it in place by renaming.

    An existing bundle is moved aside first and comes back if the last step fails.
    """
    stage = Path(tempfile.mkdtemp(prefix=".bundle-", dir=target.parent))
    try:
        result = fill(stage)
        aside = None
        if target.exists():
            if any(target.iterdir()) and not overwrite:
                raise CompareError("Output directory already exists; another run has written it")
            aside = Path(tempfile.mkdtemp(prefix=".replaced-", dir=target.parent)) / "old"
            target.rename(aside)
        try:
            if aside is not None and recheck is not None:
                recheck(aside)
            stage.rename(target)
        except BaseException:
            if aside is not None:
                aside.rename(target)
            raise
        finally:
            if aside is not None and target.exists():
                shutil.rmtree(aside.parent, ignore_errors=True)
        return result
    finally:
        if stage.exists():
            shutil.rmtree(stage, ignore_errors=True)


def page(title: str, sections: list[tuple[str, str, list[dict]]], notes: list[str], replay: str) -> str:
    """A report without scripts or outside references: headed tables, notes and the replay text."""

    def show(v: object) -> str:
        if isinstance(v, dict | list):
            return escape(json.dumps(v, default=str, ensure_ascii=False))
        return "<em>(null)</em>" if v is None else escape(str(v))

    parts = [f"<h1>{escape(title)}</h1>"]
    for anchor, heading, rows in sections:
        parts.append(f'<h2 id="{escape(anchor)}">{escape(heading)}</h2>')
        if not rows:
            parts.append("<p>None.</p>")
            continue
        names = list(dict.fromkeys(k for r in rows for k in r))
        head = "".join(f"<th>{escape(n)}</th>" for n in names)
        body = "".join("<tr>" + "".join(f"<td>{show(r.get(n))}</td>" for n in names) + "</tr>" for r in rows)
        parts.append(f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>")
    parts += [f"<p>{escape(n)}</p>" for n in notes]
    parts.append(f"<h2>Replay</h2><pre>{escape(replay)}</pre>")
    style = "body{font:16px/1.5 sans-serif;max-width:72rem;margin:2rem auto;padding:0 1rem}table{border-collapse:collapse}td,th{border:1px solid #bbb;padding:.3rem .5rem;text-align:left}pre{white-space:pre-wrap}"
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{style}</style></head><body>{"".join(parts)}</body></html>'


def is_finite(value: object) -> bool:
    return value is None or math.isfinite(value)
