"""Random pairs of snapshots: every identity must hold, and results must equal plain Python."""

from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallybridge.functions.exact import exact_session
from tallybridge.operators import alignment, breakdowns, rules
from tallybridge.operators.alignment import Metric

ROW = st.tuples(st.decimals(min_value=-1000, max_value=1000, places=2), st.sampled_from([None, "", "a", "b", "c"]))
SIDE = st.dictionaries(st.integers(0, 12), ROW, max_size=10)
AMOUNT = Metric("amount", "amount", "DECIMAL(18,2)")


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(SIDE, SIDE)
def test_identities(spark, before, after):
    with exact_session(spark):
        frames = [spark.createDataFrame([(k, *v) for k, v in side.items()], "id int, amount decimal(18,2), kind string") for side in (before, after)]
        frame = alignment.align(*frames, ["id"], [AMOUNT], ["kind"])
        t = alignment.metric_totals(frame, [AMOUNT], 1).first()
        shown = breakdowns.shown_breakdown(frame, AMOUNT, [0], shown=2).collect()
        moves = breakdowns.shown_movements(frame, AMOUNT, [0], shown=2).collect()
        groups = rules.segments(frame, AMOUNT, [0]).collect()
    zero = Decimal(0)
    both = before.keys() & after.keys()
    assert t.added_rows == len(after.keys() - both) and t.removed_rows == len(before.keys() - both) and t.matched_rows == len(both)
    delta = sum((v[0] for v in after.values()), zero) - sum((v[0] for v in before.values()), zero)
    assert t.added_contribution + t.removed_contribution + t.matched_contribution == delta == sum((r.contribution for r in shown), zero)
    assert len(shown) <= 3 and sum(r.reference_rows for r in shown) == len(before)
    pairs = Counter((before[k][1], after[k][1]) for k in both if before[k][1] != after[k][1])
    assert sum(r.rows for r in moves) == sum(pairs.values()) and len(moves) <= 3
    want = defaultdict(lambda: [0, 0])
    for k, (_, kind) in before.items():
        want[kind][1] += k not in both or after[k][1] != kind
    for k, (_, kind) in after.items():
        want[kind][0] += k not in both or before[k][1] != kind
    assert {r.g0: [r.added_rows, r.removed_rows] for r in groups} == dict(want)


def test_rule_results():
    totals = {"reference_total": Decimal("0"), "current_total": Decimal("5"), "reference_rows": 0, "current_rows": 1, "added_rows": 1, "removed_rows": 0}
    rule = {"name": "r", "metric": "m", "measure": "percent_change", "max": 5}
    assert rules.judge_totals(rule, totals, True)["status"] == "undefined"
    assert rules.judge_totals({**rule, "measure": "removed_percent"}, totals, True)["reason"].endswith("row count is zero.")
    assert rules.judge_totals({**rule, "measure": "delta"}, totals, True)["status"] == "passed"
    assert rules.judge_totals({**rule, "measure": "abs_delta", "max": "4.999"}, totals, True)["status"] == "failed"
    third = {**totals, "reference_total": Decimal(3), "current_total": Decimal(4)}
    assert rules.observed_value("percent_change", third) > Decimal("33.3333")
    assert rules.overall_status([]) == "not_configured" and rules.overall_status([{"status": "undefined"}]) == "failed"


@pytest.mark.parametrize(("measure", "n", "status"), [("percent_changed", 1, "failed"), ("changed_rows", 1, "passed"), ("percent_became_null", 0, "passed")])
def test_field_rules(measure, n, status):
    counters = {"matched_rows": 4, "changed_rows": n, "became_null": n}
    got = rules.judge_field({"name": "f", "field": "x", "measure": measure, "max": 20}, counters)
    assert got["status"] == status and got["numerator"] == n and got["denominator"] == 4
