from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tallybridge.errors import CompareError
from tallybridge.functions import exact
from tallybridge.functions.exact import exact_session
from tallybridge.functions.types import logical_name, normal_name, spark_type, sum_type
from tallybridge.operators.populations import condition

TOP = Decimal("9" * 38)
OPERATORS = {"equals": lambda a, b: a == b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


@pytest.fixture(autouse=True)
def digits():
    with localcontext(prec=120):
        yield


def edges(scale):
    unit, most = Decimal(1).scaleb(-scale), exact.limits(scale)
    return [most, -most, most - unit, Decimal(0), unit, -unit, Decimal("1.25").quantize(unit) if scale > 1 else Decimal(1), -3 * unit]


@pytest.mark.parametrize("scale", [0, 2, 18, 37])
def test_comparisons_never_round(spark, scale):
    values = edges(scale)
    bounds = [b + d for b in values[:6] for d in (Decimal(0), Decimal(1).scaleb(-scale - 1), -Decimal(1).scaleb(-scale - 1))] if scale < 37 else values
    with exact_session(spark):
        df = spark.createDataFrame([(format(v, "f"),) for v in values] + [(None,)], "t string").select("t", F.col("t").cast(f"decimal(38,{scale})").alias("v"))
        tests = [(op, b) for op in OPERATORS for b in bounds]
        rows = df.select("t", *[F.expr(exact.compared_sql("v", DecimalType(38, scale), op, b)).alias(f"c{i}") for i, (op, b) in enumerate(tests)]).collect()
    for r in rows:
        for i, (op, b) in enumerate(tests):
            want = None if r.t is None else OPERATORS[op](Decimal(r.t), b)
            assert r[f"c{i}"] == want, (r.t, op, b)


@pytest.mark.parametrize("scale", [0, 2, 18])
def test_tolerances_at_the_limits(spark, scale):
    values = edges(scale)
    unit, most = Decimal(1).scaleb(-scale), exact.limits(scale)
    allowed = [Decimal(0), unit, Decimal("0.005"), most, most + unit, 2 * most - unit, 2 * most]
    with exact_session(spark):
        df = spark.createDataFrame([(format(a, "f"), format(b, "f")) for a in values for b in values], "x string, y string")
        cast = lambda c: f"CAST({c} AS DECIMAL(38,{scale}))"
        rows = df.select("x", "y", *[F.expr(exact.within_sql(cast("x"), cast("y"), scale, t)).alias(f"c{i}") for i, t in enumerate(allowed)]).collect()
        for r in rows:
            for i, t in enumerate(allowed):
                assert r[f"c{i}"] == (abs(Decimal(r.x) - Decimal(r.y)) <= t), (r.x, r.y, t)


def test_magnitude_and_negation(spark):
    with exact_session(spark):
        v = Decimal("-123456789012345678901234567890123456.78")
        t = spark_type("DECIMAL(38,2)")
        r = spark.range(1).select(exact.typed(v, t).alias("v")).select(exact.magnitude(F.col("v"), t).alias("m"), exact.negative(F.col("v"), t).alias("n")).first()
        assert r.m == -v and r.n == -v


def test_settings_come_back(spark):
    before = {k: spark.conf.get(k, None) for k in exact.SETTINGS}
    with pytest.raises(RuntimeError), exact_session(spark):
        raise RuntimeError
    assert before == {k: spark.conf.get(k, None) for k in exact.SETTINGS}


@pytest.mark.parametrize(
    ("written", "name"),
    [("int4", "INTEGER"), ("long", "BIGINT"), ("varchar(10)", "VARCHAR"), ("numeric", "DECIMAL(18,3)"), ("decimal(18, 2)", "DECIMAL(18,2)"), ("timestamptz", "TIMESTAMP WITH TIME ZONE"), ("integer[]", "INTEGER[]"), ("datetime", "TIMESTAMP"), ("real", "FLOAT"), ("int1", "TINYINT"), ("bool", "BOOLEAN")],
)
def test_type_names(written, name):
    assert normal_name(written) == name
    if "[" not in name:
        assert logical_name(spark_type(name)) == name


def test_unknown_types_and_sums():
    with pytest.raises(CompareError, match="Unknown column type"):
        normal_name("widget")
    assert sum_type("INTEGER").simpleString() == "decimal(38,0)" and sum_type("DECIMAL(9,4)").simpleString() == "decimal(38,4)" and sum_type("FLOAT").simpleString() == "double"


@pytest.mark.parametrize(
    ("item", "kind", "message"),
    [({"operator": "gt", "value": "a"}, "VARCHAR", "bounds"), ({"operator": "equals", "value": 1}, "VARCHAR", "does not match"), ({"operator": "equals", "value": "2024-1-1"}, "DATE", "YYYY-MM-DD"), ({"operator": "equals", "value": "1" * 39}, "BIGINT", "precision 38")],
)
def test_filter_values(spark, item, kind, message):
    with pytest.raises(CompareError, match=message):
        condition({"column": "x", **item}, kind)
