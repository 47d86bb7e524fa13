"""Column expressions whose results are exact where plain Spark operators would round.

Spark rounds decimal comparisons to a common type, loses scale in differences unless told otherwise, and
corrupts abs() and unary minus beyond 34 digits. These builders bring literals to the column's own scale
before Spark sees them and use subtraction from zero, so every result is exact up to 38 digits.

Builders named ``*_sql`` give Spark SQL text. Runs evaluate that text, and replays print it, so both mean the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import ROUND_FLOOR, Context, Decimal, localcontext
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDE = Context(prec=200)
#: Settings under which frames are analysed; Spark keeps their effect in the plan.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.decimalOperations.allowPrecisionLoss": "false",
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timeType.enabled": "true",
    "spark.sql.legacy.parquet.nanosAsLong": "true",
}


def widely(build):
    """Run a builder with so many digits that no step on a literal rounds."""

    @wraps(build)
    def run(*args, **kwargs):
        with localcontext(WIDE):
            return build(*args, **kwargs)

    return run


@contextmanager
def exact_session(spark: SparkSession) -> Iterator[None]:
    """Build frames under the settings that exactness needs, and restore the user's own afterwards."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def named(name: str) -> Column:
    """A column by its exact name, whatever signs that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def typed(value: Decimal | int, dtype: T.DataType) -> Column:
    return F.lit(format(Decimal(value), "f")).cast(dtype)


def magnitude(c: Column, dtype: T.DataType) -> Column:
    """The absolute value, exact for any decimal."""
    if not isinstance(dtype, T.DecimalType):
        return F.abs(c)
    return F.when(c < typed(0, dtype), typed(0, dtype) - c).otherwise(c)


def negative(c: Column, dtype: T.DataType) -> Column:
    return typed(0, dtype) - c


def differs(a: Column, b: Column) -> Column:
    """Whether two values differ, with null equal to null."""
    return ~a.eqNullSafe(b)


def ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def string_sql(value: str | None) -> str:
    return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def typed_sql(value: Decimal | int, dtype: T.DataType) -> str:
    return f"CAST('{format(Decimal(value), 'f')}' AS {dtype.simpleString().upper()})"


def magnitude_sql(c: str, dtype: T.DataType) -> str:
    return f"CASE WHEN {c} < {typed_sql(0, dtype)} THEN {typed_sql(0, dtype)} - {c} ELSE {c} END" if isinstance(dtype, T.DecimalType) else f"abs({c})"


def limits(scale: int, precision: int = 38) -> Decimal:
    return WIDE.subtract(Decimal(10) ** (precision - scale), Decimal(1).scaleb(-scale))


def to_scale(value: Decimal, scale: int) -> Decimal:
    """The largest multiple of the scale's unit that is not above ``value``."""
    return value.quantize(Decimal(1).scaleb(-scale), rounding=ROUND_FLOOR, context=WIDE)


#: Least and largest value, by Spark type, of whole numbers.
WHOLE_RANGE = {t: (Decimal(-(1 << b)), Decimal((1 << b) - 1)) for t, b in ((T.ByteType(), 7), (T.ShortType(), 15), (T.IntegerType(), 31), (T.LongType(), 63))}


@widely
def compared_sql(c: str, dtype: T.DataType, operator: str, bound: Decimal) -> str:
    """``c operator bound`` for a column of an exact type; the bound may have any scale and size.

    Operators: equals, gt, gte, lt, lte. A null value gives null. The column stands as it is, and the
    literal has its type, so that the comparison can reach a scan.
    """
    scale = dtype.scale if isinstance(dtype, T.DecimalType) else 0
    least, most = WHOLE_RANGE.get(dtype) or (-limits(scale, dtype.precision), limits(scale, dtype.precision))
    floor = to_scale(bound, scale)
    is_exact, never, always = floor == bound, f"({c} IS NULL AND CAST(NULL AS BOOLEAN))", f"({c} IS NOT NULL OR CAST(NULL AS BOOLEAN))"
    if operator == "equals":
        return f"{c} = {typed_sql(floor, dtype)}" if is_exact and least <= floor <= most else never
    if floor > most:
        return always if operator in ("lt", "lte") else never
    if floor < least:
        return never if operator in ("lt", "lte") else always
    sign = {"gt": ">", "gte": ">=" if is_exact else ">", "lt": "<" if is_exact else "<=", "lte": "<="}[operator]
    return f"{c} {sign} {typed_sql(floor, dtype)}"


@widely
def within_sql(a: str, b: str, scale: int, tolerance: Decimal) -> str:
    """Whether two exact non-null values of this scale are at most ``tolerance`` apart."""
    dtype, most, allowed = T.DecimalType(38, scale), limits(scale), to_scale(tolerance, scale)
    kind = dtype.simpleString().upper()
    a, b = f"CAST({a} AS {kind})", f"CAST({b} AS {kind})"
    if allowed >= 2 * most:
        return "true"
    if allowed <= most:
        # a difference that overflows is null, and beyond any tolerance that fits
        apart = f"try_subtract({a}, {b})"
        return f"coalesce({apart} <= {typed_sql(allowed, dtype)} AND {apart} >= {typed_sql(-allowed, dtype)}, false)"
    zero = typed_sql(0, dtype)
    far = f"({typed_sql(most, dtype)} - ({magnitude_sql(a, dtype)})) >= (({magnitude_sql(b, dtype)}) - {typed_sql(allowed - most, dtype)})"
    return f"(({a} < {zero}) = ({b} < {zero}) OR {far})"


#: Unscaled digits in limbs of eight decimal digits: products of limbs and sums of many stay within a long.
LIMB, LIMB_DIGITS, LIMBS = 10**8, 8, 5


def limbs_sql(c: str) -> str:
    """The digits of an exact number without its point as an array of signed limbs, the lowest first."""
    text = f"lpad(regexp_replace(CAST({c} AS STRING), '[.-]', ''), {LIMB_DIGITS * LIMBS}, '0')"
    sign = f"CASE WHEN {c} < 0 THEN -1L ELSE 1L END"
    return "array(" + ", ".join(f"({sign}) * CAST(substring({text}, {LIMB_DIGITS * (LIMBS - 1 - i) + 1}, {LIMB_DIGITS}) AS BIGINT)" for i in range(LIMBS)) + ")"


def literal_limbs(number: int) -> list[int]:
    out, rest = [], abs(number)
    while rest:
        rest, low = divmod(rest, LIMB)
        out.append(low if number > 0 else -low)
    return out


def sign_sql(parts: list[tuple[str, int]], constant: int = 0) -> str:
    """-1, 0 or 1: the sign of a sum of limbed numbers (arrays) times whole factors, and a constant, of any length."""
    places: dict[int, list[str]] = {}
    for array, factor in parts:
        for j, f in enumerate(literal_limbs(factor)):
            for i in range(LIMBS):
                places.setdefault(i + j, []).append(f"{array}[{i}] * {f}L")
    for j, f in enumerate(literal_limbs(constant)):
        places.setdefault(j, []).append(f"{f}L")
    digits = ", ".join(" + ".join(places.get(k, ["0L"])) for k in range(max(places, default=0) + 1))
    value = "(s.carry + d)"
    rest = f"pmod({value}, {LIMB}L)"
    step = f"(s, d) -> named_struct('carry', ({value} - {rest}) div {LIMB}L, 'rest', s.rest OR {rest} <> 0L)"
    return f"aggregate(array({digits}), named_struct('carry', 0L, 'rest', false), {step}, s -> CASE WHEN s.carry < 0 THEN -1 WHEN s.carry > 0 OR s.rest THEN 1 ELSE 0 END)"


def whole_and_scale(value: Decimal) -> tuple[int, int]:
    """A finite decimal as a whole number and the power of ten that it is to be divided by."""
    sign, digits, exponent = value.as_tuple()
    number = int("".join(map(str, digits))) * (-1 if sign else 1)
    return (number * 10**exponent, 0) if exponent > 0 else (number, -exponent)


#: Exponents of two that share a bin, and what fractions of a bin's unit are multiplied by to be whole.
BIN, FRACTION = 32, float(1 << 53)


def binned(x: Column) -> tuple[Column, Column, Column]:
    """A finite double as bin, whole part and fraction in the bin's units: two whole numbers, without rounding.

    The bin's unit is a power of two below the number, so all three steps are exact.
    """
    none = x.isNull() | (x == 0)
    at = F.when(none, F.lit(0)).otherwise(F.floor(F.log2(F.abs(x)) / BIN).cast("int"))
    half = F.pow(F.lit(2.0), at * F.lit(-(BIN // 2)))
    scaled = F.when(none, F.lit(0.0)).otherwise(x * half * half)
    high = F.floor(scaled)
    return at, high.cast("decimal(28,0)"), ((scaled - high) * F.lit(FRACTION)).cast("long").cast("decimal(28,0)")


def unbinned(bins: Column) -> Column:
    """The double nearest to a sum of bins (at, high, low), but for the last bits; the order is that of the bins."""

    def value(b: Column) -> Column:
        half = F.pow(F.lit(2.0), b["at"] * F.lit(BIN // 2))
        return (b["high"].cast("double") + b["low"].cast("double") / F.lit(FRACTION)) * half * half

    return F.aggregate(F.array_sort(bins), F.lit(0.0), lambda total, b: total + value(b))


def exact_sums(rows: DataFrame, keys: list[str], doubles: list[tuple[str, Column]], plain: dict[str, Column]) -> DataFrame:
    """Sums of doubles by ``keys`` that no order or partitioning of the rows changes, beside plain sums.

    Each double counts in the bin of its exponent as two whole numbers, whose sums are exact decimals; a group's bins
    are put together at the end, in their order. A name may stand several times in ``doubles``: its columns
    are summed together. Nulls count as nothing. A sum beyond the range of doubles is an infinity.
    """
    names = list(dict.fromkeys(n for n, _ in doubles))
    entries = F.array(*[F.struct(F.lit(i).alias("__entry"), F.lit(n).alias("__name"), c.cast("double").alias("__x")) for i, (n, c) in enumerate(doubles)])
    # plain columns go with the first entry of a row alone
    own = [c.alias(f"__plain{i}") for i, c in enumerate(plain.values())]
    long = rows.select(*keys, *own, F.inline(entries))
    at, high, low = binned(F.col("__x"))
    first = [F.sum(F.when(F.col("__entry") == 0, F.col(f"__plain{i}"))).alias(f"__plain{i}") for i in range(len(plain))]
    bins = long.groupBy(*keys, "__name", at.alias("__at")).agg(F.sum(high).alias("__high"), F.sum(low).alias("__low"), *first)
    bin_of = F.struct(F.col("__at").alias("at"), F.col("__high").alias("high"), F.col("__low").alias("low"))
    gathered = [F.collect_list(F.when(F.col("__name") == n, bin_of)).alias(n) for n in names]
    summed = bins.groupBy(*keys).agg(*gathered, *[F.sum(f"__plain{i}").alias(f"__plain{i}") for i in range(len(plain))])
    return summed.select(*keys, *[unbinned(F.col(n)).alias(n) for n in names], *[F.col(f"__plain{i}").alias(n) for i, n in enumerate(plain)])
