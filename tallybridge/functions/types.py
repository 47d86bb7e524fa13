"""Logical type names of contracts and their Spark types, and which roles a type may play."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from tallybridge.errors import CompareError

# Type names of contracts, the spellings they accept, and their Spark types.
ALIASES = {
    "BOOLEAN": ("boolean", "bool", "logical"),
    "TINYINT": ("tinyint", "int1"),
    "SMALLINT": ("smallint", "int2", "short"),
    "INTEGER": ("integer", "int", "int4", "signed"),
    "BIGINT": ("bigint", "int8", "long"),
    "HUGEINT": ("hugeint", "int128"),
    "UTINYINT": ("utinyint", "uint8"),
    "USMALLINT": ("usmallint", "uint16"),
    "UINTEGER": ("uinteger", "uint32"),
    "UBIGINT": ("ubigint", "uint64"),
    "UHUGEINT": ("uhugeint", "uint128"),
    "FLOAT": ("float", "real", "float4"),
    "DOUBLE": ("double", "float8"),
    "VARCHAR": ("varchar", "string", "text", "char", "bpchar"),
    "DATE": ("date",),
    "TIME": ("time",),
    "TIME WITH TIME ZONE": ("time with time zone", "timetz"),
    "TIMESTAMP": ("timestamp", "datetime", "timestamp_us"),
    "TIMESTAMP_S": ("timestamp_s",),
    "TIMESTAMP_MS": ("timestamp_ms",),
    "TIMESTAMP_NS": ("timestamp_ns",),
    "TIMESTAMP WITH TIME ZONE": ("timestamp with time zone", "timestamptz"),
    "BLOB": ("blob", "bytea", "binary", "varbinary"),
    "UUID": ("uuid",),
    "INTERVAL": ("interval",),
}
SPELLINGS = {spelling: name for name, spellings in ALIASES.items() for spelling in spellings}
WHOLE = {"TINYINT", "SMALLINT", "INTEGER", "BIGINT", "HUGEINT", "UTINYINT", "USMALLINT", "UINTEGER", "UBIGINT", "UHUGEINT"}
APPROXIMATE = {"FLOAT", "DOUBLE"}
TEMPORAL = {"DATE", "TIME", "TIME WITH TIME ZONE", "TIMESTAMP", "TIMESTAMP_S", "TIMESTAMP_MS", "TIMESTAMP_NS", "TIMESTAMP WITH TIME ZONE"}
SPARK = {
    "BOOLEAN": T.BooleanType(), "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(),
    "HUGEINT": T.DecimalType(38, 0), "UTINYINT": T.ShortType(), "USMALLINT": T.IntegerType(), "UINTEGER": T.LongType(), "UBIGINT": T.DecimalType(20, 0),
    "UHUGEINT": T.DecimalType(38, 0), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "VARCHAR": T.StringType(), "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampNTZType(), "TIMESTAMP_S": T.TimestampNTZType(), "TIMESTAMP_MS": T.TimestampNTZType(), "TIMESTAMP_NS": T.LongType(),
    "TIMESTAMP WITH TIME ZONE": T.TimestampType(), "BLOB": T.BinaryType(), "UUID": T.StringType(), "TIME": T.TimeType(6),
}


def decimal_parts(name: str) -> tuple[int, int] | None:
    """Precision and scale of a decimal type's name."""
    found = re.fullmatch(r"DECIMAL\((\d+),(\d+)\)", name)
    return (int(found[1]), int(found[2])) if found else None


def normal_name(written: str) -> str:
    """The canonical name of a type as users may write it."""
    text = re.sub(r"\s+", " ", str(written).strip().lower())
    if text.endswith("[]"):
        return normal_name(text[:-2]) + "[]"
    found = re.fullmatch(r"(decimal|numeric|dec)(?: ?\( ?(\d+) ?(?:, ?(\d+) ?)?\))?", text)
    if found:
        precision, scale = int(found[2] or 18), int(found[3] if found[3] is not None else (0 if found[2] else 3))
        if not 1 <= precision <= 38 or scale > precision:
            raise CompareError(f"Unknown column type {written!r}")
        return f"DECIMAL({precision},{scale})"
    text = re.sub(r" ?\(\d+\)$", "", text) if re.match(r"(var)?char|bpchar|text|string", text) else text
    if text not in SPELLINGS:
        raise CompareError(f"Unknown column type {written!r}")
    return SPELLINGS[text]


def spark_type(name: str) -> T.DataType:
    """The Spark type that holds a logical type."""
    if parts := decimal_parts(name):
        return T.DecimalType(*parts)
    if name not in SPARK:
        raise CompareError(f"Type {name} is not supported for reading")
    return SPARK[name]


def logical_name(dtype: T.DataType) -> str:
    """The logical name of a Spark type; wider origins, such as unsigned ones, come from file footers."""
    if isinstance(dtype, T.DecimalType):
        return f"DECIMAL({dtype.precision},{dtype.scale})"
    if isinstance(dtype, T.ArrayType):
        return logical_name(dtype.elementType) + "[]"
    if isinstance(dtype, T.StructType):
        return "STRUCT(" + ", ".join(f"{f.name} {logical_name(f.dataType)}" for f in dtype.fields) + ")"
    if isinstance(dtype, T.MapType):
        return f"MAP({logical_name(dtype.keyType)}, {logical_name(dtype.valueType)})"
    if isinstance(dtype, T.TimeType):
        return "TIME"
    plain = {T.ByteType: "TINYINT", T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.TimestampNTZType: "TIMESTAMP", T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.DateType: "DATE", T.BinaryType: "BLOB"}
    return plain.get(type(dtype), dtype.simpleString().upper())


def is_numeric(name: str) -> bool:
    return name in WHOLE or name in APPROXIMATE or decimal_parts(name) is not None


def is_exact(name: str) -> bool:
    return is_numeric(name) and name not in APPROXIMATE


def is_nested(name: str) -> bool:
    return "[" in name or name.startswith(("STRUCT", "MAP", "UNION"))


def may_be_key(name: str) -> bool:
    return name not in APPROXIMATE and not is_nested(name)


def may_be_dimension(name: str) -> bool:
    return name in ("VARCHAR", "BOOLEAN") or is_exact(name)


def may_be_compared(name: str) -> bool:
    return name in ("VARCHAR", "BOOLEAN") or is_numeric(name) or name in TEMPORAL


def may_have_transitions(name: str) -> bool:
    return name in ("VARCHAR", "BOOLEAN")


def sum_type(name: str) -> T.DataType:
    """The type that sums of a column have: as wide as exact types go, double for approximate ones."""
    if name in APPROXIMATE:
        return T.DoubleType()
    parts = decimal_parts(name)
    return T.DecimalType(38, parts[1] if parts else 0)
