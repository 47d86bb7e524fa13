"""Questions that lead to a checked configuration; values of rows are never shown."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable
from pathlib import Path

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallybridge.errors import CompareError
from tallybridge.functions.exact import exact_session, named
from tallybridge.functions.types import is_numeric, may_be_compared, may_be_dimension, may_be_key, may_have_transitions
from tallybridge.operators import alignment, populations
from tallybridge.operators.populations import OPERATORS
from tallybridge.operators.rules import FIELD_MEASURES, MEASURES
from tallybridge.plans.investigate import apply_scope, check_contract, check_rows, clean_errors, load_sides, metrics_of
from tallybridge.plans.spec import CSV_OPTIONS, EXPORT_ROWS, EXPORTS, SIDES, check_spec, filter_of, load_spec
from tallybridge.sources.files import inventory

CANCELLED = "Configuration cancelled"
Ask, Tell = Callable[[str], str], Callable[[str], None]


class Dialogue:
    """Numbered menus, yes or no, and numbers, over any pair of functions that ask and tell."""

    def __init__(self, ask: Ask, tell: Tell):
        self.ask, self.tell = ask, tell

    def text(self, question: str) -> str:
        answer = self.ask(question).strip()
        if answer.lower() == "quit":
            raise CompareError(CANCELLED)
        return answer

    def yes(self, question: str) -> bool:
        while (answer := self.text(f"{question} [y/n] ").lower()) not in ("y", "n", "yes", "no", ""):
            self.tell("Please answer y or n.")
        return answer in ("y", "yes")

    def choose(self, question: str, options: list[str], many: bool = False, least: int = 1) -> list[str]:
        for i, o in enumerate(options, 1):
            self.tell(f"  {i}. {o}")
        while True:
            parts = [p.strip() for p in self.text(f"{question}{' (numbers, comma-separated)' if many else ''}: ").split(",") if p.strip()]
            if all(p.isdigit() and 1 <= int(p) <= len(options) for p in parts) and len(set(parts)) == len(parts) and len(parts) >= least and (many or len(parts) <= 1):
                return [options[int(p) - 1] for p in parts]
            self.tell("Please give numbers from the list.")

    def count(self, question: str, usual: int) -> int:
        while True:
            answer = self.text(f"{question} [{usual}] ")
            if answer == "":
                return usual
            if answer.isdigit() and int(answer) > 0:
                return int(answer)
            self.tell("Please give a positive whole number.")

    def value(self, question: str, kind: str) -> object:
        return typed(self.text(question), kind)

    def until(self, attempt: Callable[[], object]) -> object:
        """What an attempt at some answers gives; a refusal is told, and the questions come again."""
        while True:
            try:
                return attempt()
            except CompareError as e:
                if str(e).startswith(CANCELLED):
                    raise
                self.tell(f"{e}. Please answer again.")


def typed(answer: str, kind: str) -> object:
    return {"true": True, "false": False}.get(answer.lower(), answer) if kind == "BOOLEAN" else answer


def offered(kind: str) -> list[str]:
    """The filter operators that a column's type allows."""
    ordered = is_numeric(kind) or kind == "DATE"
    compares = ordered or kind in ("VARCHAR", "BOOLEAN")
    return [o for o in OPERATORS if o.startswith("is_") or (ordered if o in populations.BOUNDS else compares)]


def key_problems(rows, key: list[str]) -> bool:
    """Whether a key has nulls or repeats, in one aggregation over its groups."""
    nulls = populations.null_key(key)
    found = rows.groupBy(*[named(k) for k in key]).agg(F.count("*").alias("__n")).filter((F.col("__n") > 1) | nulls).limit(1)
    return not found.isEmpty()


def usable_sums(sides: dict, columns: list[str]) -> list[str]:
    """Numeric columns without null or nonfinite values on either side; one pass a side."""
    good = set(columns)
    for s in sides.values():
        checks = {f"c{i}": named(c).isNull() | populations.not_finite(c, s.schema[c]) for i, c in enumerate(columns)}
        found = populations.defect_counts(s.rows, checks).first() if checks else {}
        good -= {c for i, c in enumerate(columns) if found[f"c{i}"]}
    return [c for c in columns if c in good]


def csv_answers(talk: Dialogue) -> dict:
    out: dict = {}
    for option in talk.choose("CSV options to set", list(CSV_OPTIONS), many=True, least=0):
        if option == "types":
            out["types"] = dict(p.strip().split(":", 1) for p in re.split(r",(?![^(]*\))", talk.text("Types as column:type, comma-separated: ")) if ":" in p)
        else:
            out[option] = talk.yes("Is there a header?") if option == "header" else {"\\t": "\t"}.get(answer := talk.text(f"{option} (\\t for a tab): "), answer)
    return out


def filter_answers(talk: Dialogue, filters: list[dict], schemas: list[dict[str, str]], common: list[str]) -> dict:
    """One filter that fits its column together with those before it; its value is asked for until it does."""
    column = talk.choose("Column", common)[0]
    kind = schemas[0][column]
    item: dict = {"column": column, "operator": talk.choose("Operator", offered(kind))[0]}

    def attempt() -> dict:
        made = dict(item)
        if item["operator"] == "in":
            made["value"] = [typed(v.strip(), kind) for v in talk.text("Values, comma-separated: ").split(",")]
        elif not item["operator"].startswith("is_"):
            made["value"] = talk.value("Value: ", kind)
        populations.scope_sql([*filters, filter_of(made)], *schemas)
        return made

    return talk.until(attempt)


def preview(talk: Dialogue, filters: list[dict], sides: dict) -> None:
    """How many rows the filters so far select; no values are shown."""
    where, some = populations.scope_condition(filters, *[sides[s].schema for s in SIDES]), False
    for side in SIDES:
        counts = populations.scope_counts(sides[side].rows, where).first()
        some = some or counts["included_rows"] > 0
        talk.tell(f"{side}: {counts['included_rows']} of {counts['total_rows']} rows selected, {counts['excluded_rows']} left out")
    if not some:
        talk.tell("No row of either side is selected, so keys cannot be told from chance.")


def rule_answers(talk: Dialogue, cfg: dict, schema: dict[str, str]) -> dict:
    rule: dict = {"name": talk.text("Rule name: ")}
    metrics = [m["name"] for m in cfg["metrics"]]
    about = talk.choose("Rule on", [*(f"metric {m}" for m in metrics), *(f"field {f}" for f in cfg.get("compare_fields", []))])[0]
    kind, name = about.split(" ", 1)
    rule[kind] = name
    rule["measure"] = talk.choose("Measure", list(MEASURES) if kind == "metric" else list(FIELD_MEASURES))[0]
    for bound in ("min", "max"):
        if answer := talk.text(f"{bound} (empty for none): "):
            rule[bound] = answer
    groups = [[d] for d in cfg.get("dimensions", [])] + cfg.get("dimension_groups", [])
    if kind == "metric" and groups and talk.yes("Judge each segment?"):
        chosen = talk.choose("Segments by", [", ".join(g) for g in groups])[0]
        rule["group_by"] = next(g for g in groups if ", ".join(g) == chosen)
        if talk.yes("Only one segment?"):
            rule["where"] = {c: None if talk.yes(f"Is {c} null there?") else talk.value(f"{c}: ", schema[c]) for c in rule["group_by"]}
    if talk.yes("Export rows if it does not pass?"):
        rule["export"] = {"limit": talk.count("Rows at most", EXPORT_ROWS)}
    return rule


def init_config(spark: SparkSession, reference: str, current: str, out: str | Path = "comparison.yaml", ask: Ask = input, tell: Tell = print) -> Path:
    """Ask for a configuration of two snapshots, try every metric, and write it to a new file."""
    target, talk = Path(out).resolve(), Dialogue(ask, tell)
    if target.exists():
        raise CompareError("Configuration file already exists")
    base = Path.cwd()
    cfg: dict = {"mode": "snapshots", "reference": str((base / reference).resolve()), "current": str((base / current).resolve()), "key": ["?"], "metrics": [{"name": "rows", "aggregate": "count"}]}
    with clean_errors(), exact_session(spark):
        def loaded() -> dict:
            for side in SIDES:
                if any(f.is_csv for f in inventory(cfg[side])) and talk.yes(f"Set CSV options for {side}?"):
                    cfg.setdefault("csv", {})[side] = csv_answers(talk)
            try:
                return load_sides(spark, check_spec(cfg, base))
            except CompareError:
                if not cfg.pop("csv", None):
                    raise CompareError(CANCELLED + ": the inputs cannot be read") from None
                raise

        def with_names() -> dict:
            for side in SIDES:
                pairs = [p.split(":", 1) for p in talk.text(f"{side} renames as old:new, comma-separated (empty for none): ").split(",") if ":" in p]
                if pairs:
                    cfg.setdefault("column_mapping", {})[side] = {a.strip(): b.strip() for a, b in pairs}
            try:
                return load_sides(spark, check_spec(cfg, base))
            except CompareError:
                cfg.pop("column_mapping", None)
                raise

        sides = talk.until(loaded)
        if talk.yes("Rename columns?"):
            sides = talk.until(with_names)
        for side in SIDES:
            tell(f"{side}: {sides[side].profile['row_count']} rows; " + ", ".join(f"{c} {t}" for c, t in sides[side].schema.items()))
        a, b = (sides[s].schema for s in SIDES)
        common = [c for c in a if a[c] == b.get(c)]
        while common and talk.yes("Add a filter?"):
            cfg.setdefault("filters", []).append(filter_answers(talk, cfg.get("filters", []), [a, b], common))
            preview(talk, cfg["filters"], sides)
        apply_scope(check_spec(cfg, base), sides)
        keys = [c for c in common if may_be_key(a[c])]
        while True:
            cfg["key"] = talk.choose("Key columns", keys, many=True)
            if not any(key_problems(sides[s].rows, cfg["key"]) for s in SIDES):
                break
            tell("That key has null or repeated values.")
        rest = [c for c in common if c not in cfg["key"]]
        sums = usable_sums(sides, [c for c in rest if is_numeric(a[c])])
        picked = talk.choose("Metrics", ["row count", *(f"sum of {c}" for c in sums)], many=True)
        cfg["metrics"] = [{"name": "rows", "aggregate": "count"} if p == "row count" else {"name": p[7:], "aggregate": "sum", "column": p[7:], "null_policy": "error"} for p in picked]
        summed = {m.get("column") for m in cfg["metrics"]}
        dims = [c for c in rest if may_be_dimension(a[c])]
        if dims and (chosen := talk.choose("Dimensions (empty for none)", dims, many=True, least=0)):
            cfg["dimensions"] = chosen
        while len(dims) > 1 and talk.yes("Add a combined dimension?"):
            cfg.setdefault("dimension_groups", []).append(talk.choose("Columns", dims, many=True, least=2))
        comparable = [c for c in rest if may_be_compared(a[c])]
        if comparable and (chosen := talk.choose("Fields to compare (empty for none)", comparable, many=True, least=0)):
            cfg["compare_fields"] = chosen
            for c in chosen:
                if is_numeric(a[c]) and (answer := talk.text(f"Absolute tolerance for {c} (empty for none): ")):
                    cfg.setdefault("field_tolerances", {})[c] = {"absolute": answer}
                elif may_have_transitions(a[c]) and talk.yes(f"List transitions of {c}?"):
                    cfg.setdefault("field_transitions", []).append(c)
        if talk.yes("Fix the schema as a contract?"):
            cfg["schema"] = {"columns": {c: a[c] for c in common}, "allow_extra_columns": talk.yes("Allow further columns?")}
        if exports := talk.choose("Evidence exports (empty for none)", list(EXPORTS), many=True, least=0):
            cfg["report"] = {"evidence_exports": [{"kind": k, **({"limit": talk.count("Rows at most", EXPORT_ROWS)} if k == "largest_changes" else {})} for k in exports]}
        while talk.yes("Add a rule?"):
            rule = rule_answers(talk, cfg, a)
            try:
                check_spec({**cfg, "rules": [*cfg.get("rules", []), rule]}, base)
            except CompareError as e:
                tell(str(e))
            else:
                cfg.setdefault("rules", []).append(rule)
        text = yaml.safe_dump(cfg, sort_keys=False, allow_unicode=True)
        handle, temporary = tempfile.mkstemp(prefix=".config-", suffix=".yaml", dir=target.parent)
        try:
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                f.write(text)
            spec = load_spec(temporary)
            if check_contract(spec.contract, sides)["status"] == "failed":
                raise CompareError("The inputs do not meet the schema contract")
            check_rows(spec, sides)
            metrics = metrics_of(spec, a)
            aligned = alignment.align(*[sides[s].rows for s in SIDES], spec.key, metrics, spec.selected, spec.fields)
            alignment.reconcile(aligned, metrics, len(spec.selected)).first()
            try:
                os.link(temporary, target)
            except FileExistsError:
                raise CompareError("Configuration file already exists") from None
        finally:
            os.unlink(temporary)
    tell(f"Wrote {target} for {len(summed | {None}) - 1} sums and {len(cfg['metrics'])} metrics.")
    return target


