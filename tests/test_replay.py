"""A run and its replay in a fresh session must agree in every number."""

import csv
import json
from collections import Counter

import pytest
import yaml

from tallybridge.errors import CompareError
from tallybridge.plans.diagnose import validate
from tallybridge.plans.investigate import investigate
from tallybridge.plans.replay import cited


def replayed(spark, folder):
    """A fresh session after all statements of a bundle."""
    fresh = spark.newSession()
    for statement in (folder / "analysis.sql").read_text().rstrip().rstrip(";").split(";\n\n"):
        fresh.sql("\n".join(x for x in statement.splitlines() if not x.startswith("--")))
    return lambda name, more="": fresh.sql(f"SELECT * FROM `{name}` {more}").collect()


@pytest.fixture
def config(tmp_path):
    (tmp_path / "r").mkdir()
    for region, rows in (("East%2FNorth", [(i, f"{i * 3 % 17}.{i % 10}5", "ab"[i % 2], f'no"te; {i % 3}' if i % 4 else "", f"{i % 24:02d}:15:00", i * 0.5) for i in range(1, 40)]), ("__HIVE_DEFAULT_PARTITION__", [(i, f"{i}.00", "c", "x\ny", "08:00:00", 1.25) for i in range(40, 60)])):
        (tmp_path / "r" / f"region={region}").mkdir()
        with (tmp_path / "r" / f"region={region}" / "part {1}.csv").open("w", newline="") as f:
            out = csv.writer(f, delimiter=";")
            out.writerow(["id", "amount", "kind", "note", "at", "weight"])
            out.writerows(rows)
    with (tmp_path / "c.csv").open("w", newline="") as f:
        out = csv.writer(f, delimiter="|")
        out.writerow(["key", "amount", "kind", "note", "at", "weight", "region"])
        out.writerows((i, f"{i * 3 % 17 + (i % 5 == 0)}.{i % 10}5" if i < 40 else f"{i}.01", "abc"[i % 3] if i % 7 else "", f'no"te; {i % 2}' if i % 4 else "", f"{i % 20:02d}:15:00", i * 0.5 + (i % 6 == 0), "East/North" if i < 40 else "") for i in range(5, 66))
    types = {"amount": "decimal(12,2)", "weight": "double"}
    cfg = {
        "mode": "snapshots", "reference": "r", "current": "c.csv", "key": ["id"], "dimensions": ["kind", "region"], "dimension_groups": [["kind", "region"]],
        "metrics": [{"name": "total", "aggregate": "sum", "column": "amount", "null_policy": "error"}, {"name": "rows", "aggregate": "count"}, {"name": "mass", "aggregate": "sum", "column": "weight", "null_policy": "error"}],
        "compare_fields": ["note", "at"], "field_transitions": ["note"], "column_mapping": {"current": {"key": "id"}},
        "csv": {"reference": {"types": types}, "current": {"types": types}},
        "filters": [{"column": "amount", "operator": "gte", "value": "1.005"}, {"column": "kind", "operator": "in", "value": ["a", "b", "c"]}, {"column": "id", "operator": "lt", "value": 63}],
        "rules": [
            {"name": "few go", "metric": "total", "measure": "removed_percent", "max": 1, "export": {"limit": 3}},
            {"name": "level", "metric": "total", "measure": "abs_percent_change", "max": "10.5", "group_by": ["kind"], "export": {}},
            {"name": "pairs", "metric": "rows", "measure": "removed_rows", "max": 0, "group_by": ["kind", "region"], "export": {"limit": 1000}},
            {"name": "heavy", "metric": "mass", "measure": "delta", "min": -5, "group_by": ["region"], "where": {"region": None}},
            {"name": "notes", "field": "note", "measure": "percent_changed", "max": 5, "export": {}},
        ],
        "report": {"include_raw_rows": True, "evidence_exports": [{"kind": k} for k in ("added", "removed", "changed", "moved", "field_changed", "largest_changes")]},
    }
    path = tmp_path / "x.yaml"
    path.write_text(yaml.safe_dump(cfg))
    return path


def test_every_finding_is_replayed(spark, tmp_path, config):
    data = investigate(spark, config, tmp_path / "out")
    fresh = replayed(spark, tmp_path / "out")
    row = lambda name: fresh(name)[0].asDict()
    for side, counts in data["filter_scope"]["inputs"].items():
        assert len(fresh(side)) == counts["included_rows"] < counts["total_rows"]
    for m in data["metrics"]:
        p = "" if m["sql_schema"] == "main" else m["sql_schema"] + "_"
        got = row(f"{p}reconciliation")
        assert got["matched_rows"] > 20 and all(m["summary"][k] == pytest.approx(v) if isinstance(v, float) else m["summary"][k] == v for k, v in got.items())
        for n, d in enumerate(m["dimensions"]):
            assert d["evidence"] == f"analysis.sql: {p}dimension_{n}_display"
            rows = [r.asDict() for r in fresh(f"{p}dimension_{n}_display", "ORDER BY rank")]
            assert len(rows) == len(d["rows"]) > 1
            for a, b in zip(rows, d["rows"], strict=True):
                values = [a[f"g{i}"] for i in range(len(d["columns"]))]
                assert (values[0] if len(values) == 1 else dict(zip(d["columns"], values, strict=True))) == b["category"]
                assert all(a[k] == pytest.approx(b[k]) for k in ("reference_rows", "current_rows", "reference_total", "current_total", "contribution"))
        for n, r in enumerate(m["reclassifications"]):
            got = row(f"{p}reclassification_{n}")
            assert all(r[k] == pytest.approx(v) for k, v in got.items())
            rows = fresh(f"{p}movement_{n}_display", "ORDER BY rank")
            assert [(a["rows"], a["also_metric_changed"], a["reference_amount"]) for a in rows] == [(b["rows"], b["also_metric_changed"], pytest.approx(b["reference_amount"])) for b in r["movements"]["rows"]]
    for i, f in enumerate(data["field_changes"]["fields"]):
        got = row(f"field_{i}")
        assert all(f[k] == v for k, v in got.items()) and got["changed_rows"] > 0
    shown = data["field_changes"]["fields"][0]["transitions"]["rows"]
    assert [tuple(r[k] for k in ("from_value", "to_value", "rows")) for r in fresh("field_0_transitions_display", "ORDER BY rank")] == [tuple(r[k] for k in ("from_value", "to_value", "rows")) for r in shown]
    for n, rule in enumerate(data["rule_checks"]["results"]):
        if "segment_counts" in rule:
            assert Counter(r.status for r in fresh(f"segment_rule_{n}")) == Counter(rule["segment_counts"])
    assert len(data["evidence_exports"]) == 3 * 7 + 4
    assert all(fresh(name) is not None for name in cited(data))
    for e in data["evidence_exports"]:
        lines = list(csv.reader((tmp_path / "out" / e["file"]).open(newline="")))
        assert len(lines) - 1 == e["rows"] == len(fresh(e["evidence"])), e
        key = lines[0].index("k0")
        keys = [str(r["k0"]) for r in fresh(e["evidence"])]
        assert sorted(keys) == sorted(x[key] for x in lines[1:])
        assert e["kind"] in ("all",) or keys == [x[key] for x in lines[1:]], e


def test_segment_evidence_holds_whole_segments(spark, tmp_path, config):
    data = investigate(spark, config, tmp_path / "out")
    fresh = replayed(spark, tmp_path / "out")
    failed = {tuple(s["segment"].values()) for s in data["rule_checks"]["results"][2]["segments"] if s["status"] != "passed"}
    want = set()
    for r in fresh("joined"):
        old = (r.rd0, r.rd1) if r.rp else None
        if old in failed and (not r.cp or old != (r.cd0, r.cd1)):
            want.add(str(r.k0))
    lines = list(csv.reader((tmp_path / "out/rule_2_rows.csv").open(newline="")))
    assert {x[lines[0].index("k0")] for x in lines[1:]} == want != set()


def test_validation_replay(spark, tmp_path, config):
    cfg = yaml.safe_load(config.read_text())
    with (tmp_path / "c.csv").open("a") as f:
        f.write("8|3.00|a|twice|01:00:00|1.0|East/North\n|4.00|b|none|01:00:00|2.0|East/North\n|4.00|b|none|01:00:00|NaN|East/North\n")
    cfg["filters"] = cfg["filters"][:2]
    config.write_text(yaml.safe_dump(cfg))
    data = validate(spark, config, tmp_path / "v", export_invalid_rows=True, limit=2)
    assert data["status"] == "failed"
    fresh = replayed(spark, tmp_path / "v")
    failed = {(c["side"], c["check"]): c["details"] for c in data["checks"] if c["status"] == "failed"}
    assert failed["current", "null_key"]["affected_rows"] == 2 and failed["current", "duplicate_key"]["affected_rows"] == 4 and failed["current", "nonfinite_metric"]["affected_rows"] == 1
    for c in data["checks"]:
        if isinstance(c["details"], dict) and "evidence" in c["details"]:
            found = fresh(c["details"]["evidence"])
            if c["check"] == "duplicate_key":
                assert len(found) == c["details"]["duplicate_groups"]
            else:
                assert found[0].affected_rows == c["details"]["affected_rows"]
    for e in data["exports"]:
        lines = list(csv.reader((tmp_path / "v" / e["file"]).open(newline="")))
        shown = [["" if v is None else "NaN" if v != v else str(v) for v in r] for r in fresh(e["evidence"])]
        assert shown == lines[1:] and len(lines) - 1 == e["rows"] == min(2, e["total_rows"])


def test_contract_failure_is_replayed_up_to_the_sides(spark, tmp_path, config):
    cfg = yaml.safe_load(config.read_text()) | {"schema": {"columns": {"nowhere": None}}}
    config.write_text(yaml.safe_dump(cfg))
    data = investigate(spark, config, tmp_path / "out")
    assert data["execution_status"] == "schema_contract_failed"
    fresh = replayed(spark, tmp_path / "out")
    assert len(fresh("reference")) == 59 and json.loads((tmp_path / "out/findings.json").read_text())["metrics"] == []


def test_a_change_during_the_run_is_noticed(spark, tmp_path, config, monkeypatch):
    from tallybridge.plans import investigate as steps

    real = steps.check_rows

    def later(*args):
        with (tmp_path / "c.csv").open("a") as f:
            f.write("64|1.00|a|late|01:00:00|1.0|East/North\n")
        return real(*args)

    monkeypatch.setattr(steps, "check_rows", later)
    with pytest.raises(CompareError, match="changed while"):
        investigate(spark, config, tmp_path / "out")
    assert not (tmp_path / "out").exists()
