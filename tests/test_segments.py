"""Segment rules, top groups and sums of binary fractions: equal to plain Python, in the plans that were meant."""

import math
import random
from decimal import Decimal, localcontext
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybridge import catalogue
from tallybridge.functions import exact
from tallybridge.functions.exact import exact_session
from tallybridge.operators import alignment, breakdowns, rules
from tallybridge.operators.alignment import Metric

SF = "/root/testdata/sf0.001"
TOP = Decimal("9" * 38)


@pytest.mark.parametrize("scale", [0, 2, 18])
def test_statuses_at_the_limits(spark, scale):
    """Measures against bounds of any length, by Decimal arithmetic of 100 digits."""
    unit = Decimal(1).scaleb(-scale)
    with localcontext() as ctx:
        ctx.prec = 100
        values = [Decimal(0), unit, -unit, TOP * unit, -TOP * unit, 3 * unit, Decimal(7).quantize(unit), -(TOP - 1) * unit]
        rows = [(n, r, c, abs(n * 7) % 5, n % 3, n % 2, n % 4) for n, (r, c) in enumerate((r, c) for r in values for c in values)]
        bounds = [Decimal(0), unit / 10, TOP * unit * 2, Decimal("33.3333333333333333333333333333333333333333"), -Decimal("100"), Decimal("1e45"), Decimal("-200.000000000000000000000000000000001")]
    schema = f"g0 int, reference_total decimal(38,{scale}), current_total decimal(38,{scale}), reference_rows long, current_rows long, added_rows long, removed_rows long"
    cases = [{"min": b} for b in bounds] + [{"max": b} for b in bounds] + [{"min": bounds[4], "max": bounds[3]}]
    with exact_session(spark):
        df = spark.createDataFrame(rows, schema)
        for measure in ("delta", "abs_delta", "percent_change", "abs_percent_change", "current_total", "removed_percent", "added_rows"):
            judging = [{"name": "x", "metric": "m", "measure": measure, **{k: str(v) for k, v in case.items()}} for case in cases]
            judged = df.withColumns({"__c": F.expr(exact.limbs_sql("current_total")), "__r": F.expr(exact.limbs_sql("reference_total"))})
            judged = judged.select("g0", *[F.expr(rules.status_sql(rule, df.schema["reference_total"].dataType)).alias(f"s{i}") for i, rule in enumerate(judging)])
            got = {r.g0: r for r in judged.collect()}
            for r in rows:
                totals = dict(zip(df.columns, r, strict=True))
                observed = rules.observed_value(measure, totals)
                for i, rule in enumerate(judging):
                    want = rules.against(observed, rule)
                    if measure.endswith("percent_change") and observed is not None:  # 100 digits round a quotient; a fraction does not
                        f = (Fraction(totals["current_total"]) - Fraction(totals["reference_total"])) * 100 / Fraction(totals["reference_total"])
                        f = abs(f) if measure.startswith("abs") else f
                        low, high = (Fraction(Decimal(rule[k])) if k in rule else f for k in ("min", "max"))
                        want = "passed" if low <= f <= high else "failed"
                    assert got[r[0]][f"s{i}"] == want, (rule, r)
            assert {r.g0: r.status for r in rules.judged_segments(df, judging[0], 1).collect()} == {k: r.s0 for k, r in got.items()}


def test_sign_of_long_numbers(spark):
    rnd = random.Random(3)
    with exact_session(spark):
        for _ in range(12):
            x, y = (Decimal(rnd.randrange(-(10 ** rnd.randrange(1, 39)), 10 ** rnd.randrange(1, 39))) for _ in range(2))
            a, b, c = (rnd.randrange(-(10 ** rnd.randrange(1, 30)), 10 ** rnd.randrange(1, 30)) for _ in range(3))
            df = spark.createDataFrame([(format(x, "f"), format(y, "f"))], "x string, y string").select(*[F.expr(exact.limbs_sql(f"CAST({n} AS DECIMAL(38,0))")).alias(n) for n in "xy"])
            want = int(x) * a + int(y) * b + c
            assert df.select(F.expr(exact.sign_sql([("x", a), ("y", b)], c)).alias("s")).first().s == (want > 0) - (want < 0)


def test_sums_of_doubles_do_not_depend_on_the_order(spark):
    rnd = random.Random(8)
    values = [rnd.choice([1, -1]) * rnd.random() * 10.0 ** rnd.randrange(-300, 300) for _ in range(400)] + [5e-324, -5e-324, 1.7e308, -1.7e308, 0.0, 1e16, 1.0, -1e16, 2.0**32, 2.0**32 - 2**-20]
    rows = [(i % 3, v) for i, v in enumerate(values)] + [(0, None), (7, None), (8, 0.0), (9, 1e308), (9, 1e308)]
    seen = set()
    for parts in (1, 4, 7):
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, "g int, x double").repartition(parts)
        got = exact.exact_sums(df, ["g"], [("s", F.col("x")), ("two", F.col("x")), ("two", F.col("x"))], {"n": F.lit(1).cast("long")})
        seen.add(tuple(sorted((r.g, r.s, r.two, r.n) for r in got.collect())))
    assert len(seen) == 1
    for g, s, two, n in next(iter(seen)):
        own = [v for k, v in rows if k == g and v is not None]
        want = math.inf if g == 9 else math.fsum(own)
        assert n == sum(k == g for k, _ in rows) and s == pytest.approx(want, rel=1e-14, abs=1e-320) and (g in (0, 1, 2, 9) or two == 2 * s)


def test_double_metrics(spark):
    mass = Metric("mass", "x", "DOUBLE")
    before, after = [(i, f"g{i % 60}", i * 0.1) for i in range(600)], [(i, f"g{i % 61}", i * 0.3 - 20) for i in range(100, 800)]
    with exact_session(spark):
        sides = [spark.createDataFrame(r, "id int, kind string, x double").repartition(5) for r in (before, after)]
        frame = alignment.align(*sides, ["id"], [mass, Metric("n")], ["kind"])
        row = alignment.reconcile(frame, [mass, Metric("n")], 1).first()
        shown = breakdowns.shown_breakdown(frame, mass, [0]).orderBy("rank").collect()
        plain = breakdowns.breakdown_of_sides(*sides, mass, ["kind"]).collect()
    a, b = {r[0]: r[2] for r in before}, {r[0]: r[2] for r in after}
    assert row.reference_total_0 == pytest.approx(math.fsum(a.values()), rel=1e-15) and row.matched_rows == 500 and row.current_total_1 == 700
    assert row.matched_contribution_0 == pytest.approx(math.fsum(b[k] - a[k] for k in a.keys() & b.keys()), rel=1e-14)
    assert row.removed_contribution_0 == pytest.approx(-math.fsum(a[k] for k in a.keys() - b.keys()), rel=1e-15)
    assert len(shown) == 51 and shown[-1].is_other and sum(r.reference_rows for r in shown) == 600
    assert math.fsum(r.contribution for r in shown) == pytest.approx(math.fsum(b.values()) - math.fsum(a.values()), rel=1e-12)
    assert {r.g0: r.reference_total for r in plain}["g7"] == pytest.approx(math.fsum(v for i, g, v in before if g == "g7"), rel=1e-15)


def exchanges(spark, name):
    """Nodes of the plan that ran, by kind."""
    frame = catalogue.QUERIES[name](spark, SF)
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    text = text.replace(", Exchange hashpartitioning", "") if "ReusedExchange" in text else text
    return {k: text.count(k) for k in ("Exchange hashpartitioning", "ReusedExchange", "MapInPandas", "Python", "SortMergeJoin", "BroadcastHashJoin", "FileScan")}


@pytest.mark.parametrize("name", ["breakdown_single", "breakdown_top50_other", "breakdown_combined"])
def test_top_groups_are_grouped_once(spark, name):
    found = exchanges(spark, name)
    assert found["Exchange hashpartitioning"] == 1 and found["FileScan"] == 2 and found["SortMergeJoin"] + found["BroadcastHashJoin"] == 0


def test_segments_stay_in_the_jvm(spark):
    for name in ("segment_rule_eval", "segment_rule_counts", "rule_evidence_segment"):
        found = exchanges(spark, name)
        assert found["MapInPandas"] == found["Python"] == 0
    assert found["Exchange hashpartitioning"] <= 4 and found["FileScan"] == 0, "the join's rows are read from the checkpoint"


def test_filters_reach_the_scan(spark):
    from tallybridge.operators.populations import scope_condition

    kinds = {"o_orderkey": "BIGINT", "o_custkey": "BIGINT"}
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    with exact_session(spark):
        where = scope_condition([{"column": "o_orderkey", "operator": "gt", "value": "100.5"}, {"column": "o_custkey", "operator": "lte", "value": 50}], kinds, kinds)
        plan = spark.read.parquet(f"{SF}/orders.parquet").filter(where)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,100)" in plan and "LessThanOrEqual(o_custkey,50)" in plan


def test_literals_of_every_type(spark):
    """Bounds beyond a type's range compare as numbers do."""
    import operator

    ops = {"equals": operator.eq, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
    with exact_session(spark):
        for dtype, values in ((T.ByteType(), [-128, 0, 127]), (T.LongType(), [-(1 << 63), 5, (1 << 63) - 1]), (T.DecimalType(5, 2), ["-999.99", "0.00", "999.99"])):
            df = spark.createDataFrame([(str(v),) for v in values], "t string").select("t", F.col("t").cast(dtype).alias("v"))
            bounds = [Decimal(v) + d for v in values for d in (Decimal(0), Decimal("0.001"), -Decimal("0.001"), Decimal(1000))]
            tests = [(op, b) for op in ops for b in bounds]
            for r in df.select("t", *[F.expr(exact.compared_sql("v", dtype, op, b)).alias(f"c{i}") for i, (op, b) in enumerate(tests)]).collect():
                assert [r[f"c{i}"] for i in range(len(tests))] == [ops[op](Decimal(r.t), b) for op, b in tests]
