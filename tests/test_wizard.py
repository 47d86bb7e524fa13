"""The dialogue asks again after a refusal, and previews what each filter selects."""

import yaml

from tallybridge.plans.wizard import init_config, offered


def dialogue(spark, tmp_path, answers):
    """Answers by the beginning of the question, in turn; then no, or nothing."""
    said, left = [], {k: list(v) for k, v in answers.items()}

    def ask(question):
        mine = next((v for k, v in left.items() if question.startswith(k) and v), None)
        return mine.pop(0) if mine else "n" if "[y/n]" in question else ""

    path = init_config(spark, str(tmp_path / "r.csv"), str(tmp_path / "c.csv"), tmp_path / "new.yaml", ask, said.append)
    assert not any(left.values()), left
    return yaml.safe_load(path.read_text()), said


def test_refusals_and_previews(spark, tmp_path):
    for name, n in (("r", 20), ("c", 24)):
        (tmp_path / f"{name}.csv").write_text("id\tamount\tgood\tkind\n" + "".join(f"{i}\t{i}.50\t{'true' if i % 4 else 'false'}\t{'ab'[i % 2]}\n" for i in range(n)))
    cfg, said = dialogue(spark, tmp_path, {
        "Set CSV options for reference": ["y", "y"], "Set CSV options for current": ["n", "y"], "CSV options to set": ["1,2", "1,2", "1"],
        "Types as": ["amount:widget", "amount:decimal(9,2)", "amount:decimal(9,2)"], "delimiter": ["\\t", "\\t"],
        "Rename columns?": ["y"], "reference renames": ["kind:AMOUNT", "kind:group"], "current renames": ["", "kind:group"],
        "Add a filter?": ["y", "y", "y"], "Column": ["3", "2", "1"], "Operator": ["2", "3", "4"], "Values": ["true, maybe", "true"], "Value": ["many", "3.255", "1000000"],
        "Key columns": ["1"], "Metrics": ["1,2"],
    })
    assert "csv" in cfg, [s for s in said if "again" in s]
    assert cfg["csv"]["reference"] == {"types": {"amount": "decimal(9,2)"}, "delimiter": "\t"} and cfg["column_mapping"]["current"] == {"kind": "group"}
    assert cfg["filters"][:2] == [{"column": "good", "operator": "in", "value": [True]}, {"column": "amount", "operator": "gt", "value": "3.255"}]
    assert sum("Please answer again" in s for s in said) == 4
    assert "reference: 15 of 20 rows selected, 5 left out" in said and "reference: 13 of 20 rows selected, 7 left out" in said
    assert any(s.startswith("No row of either side") for s in said) and not any("0.50" in s for s in said)


def test_operators_by_type():
    assert offered("VARCHAR") == ["equals", "in", "is_null", "is_not_null"] and "gte" in offered("DATE") and "lt" in offered("DECIMAL(9,2)")
    assert offered("TIMESTAMP") == ["is_null", "is_not_null"] and "gt" not in offered("BOOLEAN")
