"""Reading snapshots: strict CSV and Parquet files as one frame with known logical types.

Facts about files (dialects of CSV files, schemas of Parquet footers, types that CSV values fit, rows and
folder conflicts) come from one job each for all files of a snapshot; files that read alike are read together,
and a row's file is known by Spark's hidden metadata column.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybridge.errors import CompareError
from tallybridge.functions.exact import named
from tallybridge.functions.types import logical_name, spark_type
from tallybridge.sources.dialect import dialects
from tallybridge.sources.files import SourceFile, file_digests, inventory, joined_digest, spark_path, spark_uri

# Date format letters of the C library and the patterns of Spark that mean the same.
PATTERNS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%j": "DDD", "%%": "%"}
DATE, TIME = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?"
#: Types that CSV values may turn out to have, in the order in which they are tried.
LADDER = ("BOOLEAN", "BIGINT", "DOUBLE", "TIME", "DATE", "TIMESTAMP")
#: The column that names a row's file while files are put together; no input can have this name.
FILE = "\0file"


@dataclass
class Snapshot:
    """One side of a comparison: its rows, logical types by column, and facts about its files."""

    rows: DataFrame
    schema: dict[str, str]
    profile: dict


@dataclass
class Group:
    """Files that are read together: their numbers, and how their rows and types come about."""

    files: list[int]
    rows: DataFrame
    schema: dict[str, str]
    parsing: dict


def java_pattern(written: str) -> str:
    """A date format such as %d/%m/%Y as a Spark pattern."""
    out, i = "", 0
    while i < len(written):
        two = written[i : i + 2]
        if two in PATTERNS:
            out, i = out + PATTERNS[two], i + 2
        elif written[i] == "%":
            raise CompareError(f"Date format directive {two!r} is not supported for CSV")
        else:
            out, i = out + (f"'{written[i]}'" if written[i].isalpha() else written[i]), i + 1
    return out


# --- Parquet ------------------------------------------------------------------------------------------


def reading_footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fields = [(f.name, str(f.type)) for f in pq.read_schema(row["path"])]
            yield pa.RecordBatch.from_pylist([{"number": row["number"], "fields": json.dumps(fields)}])


def footer_names(fields: list[tuple[str, str]]) -> dict[str, str]:
    """Logical names that Spark's types hide: unsigned integers and coarse or fine timestamps."""
    hidden = {"uint8": "UTINYINT", "uint16": "USMALLINT", "uint32": "UINTEGER", "uint64": "UBIGINT", "timestamp[ns]": "TIMESTAMP_NS", "timestamp[s]": "TIMESTAMP_MS", "timestamp[ms]": "TIMESTAMP_MS"}
    return {name: hidden[kind] for name, kind in fields if kind in hidden}


def parquet_groups(spark: SparkSession, files: list[tuple[int, str]]) -> list[Group]:
    """One group for all Parquet files, which must have the same names and types; footers are read in tasks."""
    if not files:
        return []
    frame = spark.createDataFrame(files, "number long, path string").repartition(min(len(files), 10_000))
    kinds: dict[str, list[int]] = {}
    for r in frame.mapInArrow(reading_footers, "number long, fields string").collect():
        kinds.setdefault(r.fields, []).append(r.number)
    paths, schemas = dict(files), []
    for fields, numbers in sorted(kinds.items(), key=lambda k: min(k[1])):
        sample = spark.read.parquet(spark_path(paths[min(numbers)]))
        schemas.append({f.name: logical_name(f.dataType) for f in sample.schema.fields} | footer_names(json.loads(fields)))
    same_types(schemas)
    rows = spark.read.schema(sample_schema(spark, paths[files[0][0]])).parquet(*[spark_path(p) for _, p in files])
    return [Group([i for i, _ in files], with_file(rows, list(schemas[0])), schemas[0], {})]


def sample_schema(spark: SparkSession, path: str) -> T.StructType:
    return spark.read.parquet(spark_path(path)).schema


def with_file(rows: DataFrame, columns: list[str], values: list[Column] | None = None) -> DataFrame:
    return rows.select(*(values or [named(c) for c in columns]), F.col("_metadata.file_path").alias(FILE))


def same_types(schemas: list[dict[str, str]]) -> None:
    if any(s != schemas[0] for s in schemas):
        raise CompareError("The files of one snapshot disagree about column names or types")


# --- CSV ----------------------------------------------------------------------------------------------


def header_of(record: list[str], options: dict) -> tuple[bool, list[str]]:
    """Whether the first record names the columns, unless that is given, and the names."""
    plain = lambda v: v != "" and not v[:1].lstrip("+-.").isdigit() and not v.lstrip("+-.")[:1].isdigit() and v.lower() not in ("true", "false")
    header = options.get("header")
    if header is None:
        header = all(map(plain, record)) and len(set(record)) == len(record)
    return header, record if header else [f"column{i}" for i in range(len(record))]


def reader_options(dialect: dict, header: bool, options: dict) -> dict[str, str]:
    """Strict reading; only files with line ends inside quotes are read in one piece each."""
    reader = {
        "sep": dialect["delimiter"], "header": str(header).lower(), "quote": dialect["quote"], "escape": dialect["escape"], "nullValue": options.get("nullstr", ""),
        "mode": "FAILFAST", "columnPruning": "false", "encoding": "UTF-8", "enforceSchema": "true", "multiLine": str(dialect["multiline"]).lower(),
    }
    if "nullstr" in options:
        reader["emptyValue"] = ""
    if "dateformat" in options:
        reader["dateFormat"] = java_pattern(options["dateformat"])
    if "timestampformat" in options:
        reader["timestampNTZFormat"] = reader["timestampFormat"] = java_pattern(options["timestampformat"])
    return reader


def ladder(c: Column, reader: dict) -> dict[str, Column]:
    """Whether there is any value in a text column, and whether all fit each type; nulls fit any."""
    fits = lambda test: F.coalesce(F.bool_and(F.when(c.isNotNull(), F.coalesce(test, F.lit(False)))), F.lit(True))
    date = F.try_to_date(c, reader["dateFormat"]).isNotNull() if "dateFormat" in reader else c.rlike(f"^{DATE}$") & F.try_to_date(c).isNotNull()
    stamp = F.try_to_timestamp(c, F.lit(reader["timestampFormat"])).isNotNull() if "timestampFormat" in reader else c.rlike(f"^{DATE}[ T]{TIME}$") & F.try_to_timestamp(c).isNotNull()
    return {
        "any": F.count(c) > 0,
        "BOOLEAN": fits(F.lower(c).isin("true", "false")),
        "BIGINT": fits(c.rlike(r"^[+-]?\d+$") & c.try_cast("bigint").isNotNull()),
        "DOUBLE": fits(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")),
        "TIME": fits(c.rlike(f"^{TIME}$") & c.try_cast("time(6)").isNotNull()),
        "DATE": fits(date),
        "TIMESTAMP": fits(stamp),
    }


def inferred(text: DataFrame, open_: list[str], reader: dict, uris: dict[str, int]) -> dict[int, dict[str, str]]:
    """Types of the columns ``open_`` by file, from all values of all files in one job; files without rows have none."""
    checks = [check.alias(f"{i}_{kind}") for i, n in enumerate(open_) for kind, check in ladder(named(n), reader).items()]
    found = {uris[r[FILE]]: r for r in text.groupBy(named(FILE)).agg(*checks).collect()} if open_ else {}
    return {number: {n: next((k for k in LADDER if r[f"{i}_{k}"]), "VARCHAR") if r[f"{i}_any"] else "VARCHAR" for i, n in enumerate(open_)} for number, r in found.items()}


def csv_groups(spark: SparkSession, files: list[tuple[int, str]], options: dict) -> list[Group]:
    """Groups of CSV files of one dialect, header and types; types are inferred from whole files where not given.

    Files that hold a header alone, as Spark writes of an empty partition, have the types of the other files.
    """
    if not files:
        return []
    given, alike = options.get("types", {}), {}
    found, paths = dialects(spark, files, options), dict(files)
    for number, _ in files:
        d = found[number]
        header, names = header_of(d["record"], options)
        if any(n == "" for n in names) or len({n.lower() for n in names}) < len(names):
            raise CompareError("CSV column names must be nonempty and unique")
        if unknown := set(given) - set(names):
            raise CompareError(f"csv types name unknown columns {sorted(unknown)}")
        reader = reader_options(d, header, options)
        alike.setdefault((tuple(names), json.dumps(reader)), []).append(number)
    types: dict[int, dict[str, str]] = {}
    for (names, reader), numbers in alike.items():
        reader = json.loads(reader)
        text = csv_rows(spark, reader, {n: "VARCHAR" for n in names}, [paths[i] for i in numbers])
        types |= inferred(text, [n for n in names if n not in given], reader, {spark_uri(spark, paths[i]): i for i in numbers})
    usual = types[min(types)] if types else {}
    out = []
    for (names, reader), numbers in alike.items():
        reader = json.loads(reader)
        schemas = [{n: given.get(n) or types.get(i, usual).get(n, "VARCHAR") for n in names} for i in numbers]
        same_types(schemas)
        parsing = {"delimiter": reader["sep"], "header": reader["header"] == "true", "quote": reader["quote"], "escape": reader["escape"], "splittable": reader["multiLine"] == "false", "types": schemas[0], "reader": reader}
        out.append(Group(numbers, csv_rows(spark, reader, schemas[0], [paths[i] for i in numbers]), schemas[0], parsing))
    return out


def csv_rows(spark: SparkSession, reader: dict, schema: dict[str, str], paths: list[str]) -> DataFrame:
    """The rows of CSV files; times are read as text, as Spark's reader knows none, and cast strictly."""
    stored = T.StructType([T.StructField(n, T.StringType() if k == "TIME" else spark_type(k)) for n, k in schema.items()])
    rows = spark.read.options(**reader).schema(stored).csv([spark_path(p) for p in paths])
    return with_file(rows, list(schema), [named(n).cast("time(6)").alias(n) if k == "TIME" else named(n) for n, k in schema.items()])


# --- snapshots ----------------------------------------------------------------------------------------


def with_folders(rows: DataFrame, files: list[SourceFile], uris: list[str], stored: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """The rows with the columns of their folders, which are text; a stored column of that name stays as it is.

    Values come by an equal join on the row's file. The frame of files, a short row for each file that the driver
    has listed, is broadcast: Spark takes it for large, and would broadcast the rows or bring each file to one task. The
    column ``<FILE><name>`` keeps the folder's value beside a stored column, to be compared with it.
    """
    names = list(files[0].folders)
    if not names:
        return rows, stored
    for name in names:
        if any(c != name and c.lower() == name.lower() for c in stored):
            raise CompareError("A folder's column and a column in the file differ by case alone")
    schema = T.StructType([T.StructField(FILE, T.StringType()), *[T.StructField(FILE + n if n in stored else n, T.StringType()) for n in names]])
    values = rows.sparkSession.createDataFrame([(u, *[f.folders[n] for n in names]) for u, f in zip(uris, files, strict=True)], schema)
    return rows.join(F.broadcast(values), FILE), stored | {n: "VARCHAR" for n in names if n not in stored}


def file_counts(rows: DataFrame, columns: list[str], conflicts: list[str]) -> dict[str, int]:
    """Rows by file, in one job that parses every column, so that malformed rows are noticed; and no conflict."""
    other = F.lit(False)
    for n in conflicts:
        other = other | ~named(n).cast("string").eqNullSafe(named(FILE + n))
    found = rows.groupBy(named(FILE)).agg(F.count("*").alias("n"), F.count_if(other).alias("conflicts"), *[F.count(named(c)) for c in columns]).collect()
    if any(r["conflicts"] for r in found):
        raise CompareError("A file stores its folder's column with another value than the folder's name has")
    return {r[FILE]: r["n"] for r in found}


def renamed(rows: DataFrame, schema: dict[str, str], mapping: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """All renames at once, so that names may be swapped."""
    if missing := [c for c in mapping if c not in schema]:
        raise CompareError(f"column_mapping renames columns that the files do not have: {missing}")
    names = {c: mapping.get(c, c) for c in schema}
    if len({n.lower() if n.isascii() else n for n in names.values()}) < len(names):
        raise CompareError("column_mapping collision with another column")
    return rows.select(*[named(c).alias(n) for c, n in names.items()]), {n: schema[c] for c, n in names.items()}


def read_snapshot(spark: SparkSession, source: str | list[str], csv_options: dict | None = None, mapping: dict[str, str] | None = None) -> Snapshot:
    """One frame of all files, aligned by name; no type is changed to make files fit each other."""
    files = inventory(source)
    uris, hashes = [spark_uri(spark, f.path) for f in files], file_digests(spark, [f.path for f in files])
    numbered = [(i, f.path) for i, f in enumerate(files)]
    groups = csv_groups(spark, [n for n in numbered if files[n[0]].is_csv], csv_options or {}) + parquet_groups(spark, [n for n in numbered if not files[n[0]].is_csv])
    same_types([g.schema for g in groups])
    first = min(groups, key=lambda g: min(g.files)).schema
    if len({c.lower() if c.isascii() else c for c in first}) < len(first):
        raise CompareError("Two columns of a snapshot differ by case alone")
    rows = groups[0].rows
    for g in groups[1:]:
        rows = rows.unionByName(g.rows)
    rows, schema = with_folders(rows.select(*[named(c) for c in first], named(FILE)), files, uris, first)
    # a list may name a file twice; each naming reads all of it
    times = {u: uris.count(u) for u in set(uris)} if isinstance(source, list) else {}
    counts = file_counts(rows, list(schema), [n for n in files[0].folders if n in first])
    counts = [counts.get(u, 0) // times.get(u, 1) for u in uris]
    parsing = {i: g.parsing for g in groups for i in g.files}
    profile = {
        "source_schema": dict(schema), "stored": list(first), "column_mapping": mapping or {}, "sha256": joined_digest([(f.path, h) for f, h in zip(files, hashes, strict=True)]), "parsing": [parsing[i] for i in range(len(files))],
        "files": [{"path": f.path, "partitions": f.folders, "rows": n, "sha256": h} for f, n, h in zip(files, counts, hashes, strict=True)], "file_count": len(files), "row_count": sum(counts),
        "input_kind": "list" if isinstance(source, list) else "directory" if len(files) > 1 or files[0].path != source else "file",
    }
    rows, named_schema = renamed(rows, schema, mapping or {})
    return Snapshot(rows, named_schema, {**profile, "schema": named_schema})
