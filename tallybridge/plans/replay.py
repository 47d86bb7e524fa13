"""The whole comparison as Spark SQL: an ordered list of views that ends in every one a finding cites.

Readers, filters, measures, fields and segment rules are printed from the same text that the run evaluates.
Each view reads earlier views alone, so running the statements in order in a fresh session gives every number of
the findings again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from tallybridge.functions.exact import SETTINGS, ident, limbs_sql, magnitude_sql, string_sql, typed_sql
from tallybridge.functions.types import spark_type
from tallybridge.operators import populations, rules
from tallybridge.operators.alignment import Metric
from tallybridge.operators.breakdowns import SHOWN
from tallybridge.operators.fields import Field, any_changed_sql, field_conditions_sql
from tallybridge.plans.spec import SIDES, Spec
from tallybridge.sources.files import spark_path
from tallybridge.sources.snapshots import Snapshot

MATCHED = "rp AND cp"


@dataclass
class Script:
    """Statements in order; each name stands for one view."""

    statements: list[str] = field(default_factory=list)
    names: set[str] = field(default_factory=set)

    def view(self, name: str, body: str, how: str = "AS\n") -> str:
        self.statements.append(f"CREATE OR REPLACE TEMPORARY VIEW {ident(name)} {how}{body}")
        self.names.add(name)
        return name

    def text(self) -> str:
        lines = ["-- Run these statements one by one with spark.sql in a fresh session; the input files must be at their paths."]
        return "\n".join(lines) + "\n" + ";\n\n".join([*(f"SET {k}={v}" for k, v in SETTINGS.items()), *self.statements]) + ";\n"


def metric_prefix(index: int) -> str:
    """What the names of a metric's views begin with."""
    return f"metric_{index}_" if index else ""


def reader_view(script: Script, name: str, path: str, parsing: dict) -> None:
    """One input file as Spark's reader gives it under the settings that the run used."""
    options, columns = {"path": spark_path(path)} | parsing.get("reader", {}), ""
    if parsing:
        kinds = {c: T.StringType() if k == "TIME" else spark_type(k) for c, k in parsing["types"].items()}
        columns = "(" + ", ".join(f"{ident(c)} {k.simpleString().upper()}" for c, k in kinds.items()) + ") "
    listed = ", ".join(f"{ident(k)} {string_sql(v)}" for k, v in options.items())
    script.view(name, f"({listed})", f"{columns}USING {'csv' if parsing else 'parquet'} OPTIONS ")


def side_view(script: Script, side: str, snapshot: Snapshot, where: str) -> None:
    """One side: its files under each other, with folder columns and new names, narrowed by the filters."""
    parts, profile = [], snapshot.profile
    for i, (f, parsing) in enumerate(zip(profile["files"], profile["parsing"], strict=True)):
        reader_view(script, f"{side}_file_{i}", f["path"], parsing)
        columns = []
        for c, kind in profile["source_schema"].items():
            stored = c in parsing["types"] if parsing else c not in f["partitions"] or c in profile["stored"]
            value = ident(c) if stored else string_sql(f["partitions"][c])
            value = f"CAST({value} AS TIME(6))" if stored and parsing and kind == "TIME" else value
            columns.append(f"{value} AS {ident(profile['column_mapping'].get(c, c))}")
        parts.append(f"SELECT {', '.join(columns)} FROM {ident(f'{side}_file_{i}')}")
    script.view(side, f"SELECT * FROM (\n{'\nUNION ALL\n'.join(parts)}\n) WHERE {where}")


def value_sql(m: Metric) -> str:
    return f"CAST({ident(m.column)} AS {m.dtype.simpleString().upper()})" if m.column else typed_sql(1, m.dtype)


def joined_view(script: Script, spec: Spec, metrics: list[Metric]) -> None:
    pairs = [(x, i) for x, n in (("v", len(metrics)), ("d", len(spec.selected)), ("f", len(spec.fields))) for i in range(n)]
    chosen = [f"{ident(c)} AS {x}{i}" for x, columns in (("k", spec.key), ("d", spec.selected), ("f", spec.fields)) for i, c in enumerate(columns)]
    chosen += [*(f"{value_sql(m)} AS v{i}" for i, m in enumerate(metrics)), "true AS p"]
    keys = [f"coalesce(r.k{i}, c.k{i}) AS k{i}" for i in range(len(spec.key))]
    sides = [f"{s}.{x}{i} AS {s}{x}{i}" for x, i in pairs for s in "rc"]
    on = " AND ".join(f"r.k{i} = c.k{i}" for i in range(len(spec.key)))
    each = ", ".join(chosen)
    script.view("joined", f"SELECT r.p AS rp, c.p AS cp, {', '.join([*keys, *sides])}\nFROM (SELECT {each} FROM reference) r\nFULL OUTER JOIN (SELECT {each} FROM current) c ON {on}")


def sum_sql(c: str, dtype: T.DataType, where: str | None = None) -> str:
    kind = dtype.simpleString().upper()
    return f"coalesce(CAST(sum({c}){f' FILTER (WHERE {where})' if where else ''} AS {kind}), {typed_sql(0, dtype)})"


def moved_sql(at: list[int]) -> str:
    return "(" + (" OR ".join(f"NOT rd{j} <=> cd{j}" for j in at) or "false") + ")"


def ranked_view(script: Script, name: str, keys: list[str], order: str, sums: dict[str, str], shown: int = SHOWN) -> None:
    """The first rows of a grouped view in order, and one row for all others."""
    listed, added = ", ".join([*keys, *sums]), ", ".join(f"CAST(sum({s}) AS {t}) AS {s}" for s, t in sums.items())
    nulls = ", ".join(f"NULL AS {k}" for k in keys)
    script.view(f"{name}_ranked", f"SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM {name}")
    script.view(f"{name}_display", f"SELECT {listed}, false AS is_other, rank FROM {name}_ranked WHERE rank <= {shown}\nUNION ALL\nSELECT {nulls}, {', '.join(sums)}, true, {shown + 1} FROM (SELECT count(*) AS n, {added} FROM {name}_ranked WHERE rank > {shown}) WHERE n > 0")


def metric_views(script: Script, spec: Spec, metrics: list[Metric], index: int) -> None:
    m, p = metrics[index], metric_prefix(index)
    t, v = m.dtype, index
    kind = t.simpleString().upper()
    differs = f"NOT rv{v} <=> cv{v}"
    counts = {
        "reference_rows": "rp", "current_rows": "cp", "added_rows": "rp IS NULL", "removed_rows": "cp IS NULL", "matched_rows": MATCHED,
        "dimension_changed_rows": f"{MATCHED} AND {moved_sql(list(range(len(spec.selected))))}", "metric_changed_rows": f"{MATCHED} AND {differs}",
    }
    totals = {
        "reference_total": sum_sql(f"rv{v}", t), "current_total": sum_sql(f"cv{v}", t), "added_contribution": sum_sql(f"cv{v}", t, "rp IS NULL"),
        "removed_contribution": f"{typed_sql(0, t)} - {sum_sql(f'rv{v}', t, 'cp IS NULL')}", "matched_contribution": sum_sql(f"cv{v} - rv{v}", t, MATCHED),
    }
    listed = [*(f"count_if({c}) AS {n}" for n, c in counts.items()), *(f"{c} AS {n}" for n, c in totals.items())]
    script.view(f"{p}reconciliation", f"SELECT *, current_total - reference_total AS delta FROM (SELECT {', '.join(listed)} FROM joined)")
    for n, group in enumerate(spec.categories):
        at = [spec.selected.index(c) for c in group]
        cats, nulls = [f"g{i}" for i in range(len(at))], "FIRST" if len(at) == 1 else "LAST"
        own = lambda s: ", ".join(f"{s}d{j} AS g{i}" for i, j in enumerate(at))  # noqa: B023, E731
        none = typed_sql(0, t)
        both = f"SELECT {own('r')}, 1L AS rn, 0L AS cn, CAST(rv{v} AS {kind}) AS rt, {none} AS ct FROM joined WHERE rp\nUNION ALL\nSELECT {own('c')}, 0L, 1L, {none}, CAST(cv{v} AS {kind}) FROM joined WHERE cp"
        sums = f"sum(rn) AS reference_rows, sum(cn) AS current_rows, CAST(sum(rt) AS {kind}) AS reference_total, CAST(sum(ct) AS {kind}) AS current_total"
        name = script.view(f"{p}dimension_{n}", f"SELECT *, CAST(current_total - reference_total AS {kind}) AS contribution FROM (\nSELECT {', '.join(cats)}, {sums} FROM (\n{both}\n) GROUP BY {', '.join(cats)})")
        order = ", ".join([f"{magnitude_sql('contribution', t)} DESC", *(f"{g} NULLS {nulls}" for g in cats)])
        ranked_view(script, name, cats, order, {"reference_rows": "BIGINT", "current_rows": "BIGINT", "reference_total": kind, "current_total": kind, "contribution": kind})
        changed = f"joined WHERE {MATCHED} AND {moved_sql(at)}"
        amounts = f"count_if({differs}) AS also_metric_changed, {sum_sql(f'rv{v}', t)} AS reference_amount, {sum_sql(f'cv{v}', t)} AS current_amount"
        script.view(f"{p}reclassification_{n}", f"SELECT count(*) AS rows, {amounts} FROM {changed}")
        steps = [f"{x}_g{i}" for x in ("from", "to") for i in range(len(at))]
        ends = ", ".join(f"{s}d{j} AS {x}_g{i}" for x, s in (("from", "r"), ("to", "c")) for i, j in enumerate(at))
        name = script.view(f"{p}movement_{n}", f"SELECT {ends}, count(*) AS rows, {amounts} FROM {changed} GROUP BY {', '.join(f'{s}d{j}' for s in 'rc' for j in at)}")
        ranked_view(script, name, steps, ", ".join(["rows DESC", *(f"{g} NULLS {nulls}" for g in steps)]), {"rows": "BIGINT", "also_metric_changed": "BIGINT", "reference_amount": kind, "current_amount": kind})


def field_views(script: Script, spec: Spec, compared: list[Field]) -> None:
    if not compared:
        return
    script.view("field_overview", f"SELECT count(*) AS matched_rows, count_if({any_changed_sql(compared)}) AS any_changed_rows FROM joined WHERE {MATCHED}")
    for i, (f, own) in enumerate(zip(compared, field_conditions_sql(compared), strict=True)):
        script.view(f"field_{i}", f"SELECT count(*) AS matched_rows, {', '.join(f'count_if({c}) AS {n}' for n, c in own.items())} FROM joined WHERE {MATCHED}")
        if f.name in spec.transitions:
            name = script.view(f"field_{i}_transitions", f"SELECT rf{i} AS from_value, cf{i} AS to_value, count(*) AS rows FROM joined WHERE {MATCHED} AND NOT rf{i} <=> cf{i} GROUP BY rf{i}, cf{i}")
            ranked_view(script, name, ["from_value", "to_value"], "rows DESC, from_value NULLS FIRST, to_value NULLS FIRST", {"rows": "BIGINT"})


def segment_view(script: Script, spec: Spec, rule: dict, number: int, metrics: list[Metric], where: str) -> None:
    """All segments of a rule with their totals and statuses; rows that moved leave one and enter another."""
    v = [m.name for m in metrics].index(rule["metric"])
    t, at = metrics[v].dtype, [spec.selected.index(c) for c in rule["group_by"]]
    kind, none, cats = t.simpleString().upper(), typed_sql(0, t), ", ".join(f"g{i}" for i in range(len(at)))
    own = lambda s: ", ".join(f"{s}d{j} AS g{i}" for i, j in enumerate(at))
    left = lambda gone: f"CASE WHEN {gone} OR {moved_sql(at)} THEN 1L ELSE 0L END"
    both = f"SELECT {own('r')}, CAST(rv{v} AS {kind}) AS rt, {none} AS ct, 1L AS rn, 0L AS cn, 0L AS an, {left('cp IS NULL')} AS mn FROM joined WHERE rp\nUNION ALL\nSELECT {own('c')}, {none}, CAST(cv{v} AS {kind}), 0L, 1L, {left('rp IS NULL')}, 0L FROM joined WHERE cp"
    sums = f"CAST(sum(rt) AS {kind}) AS reference_total, CAST(sum(ct) AS {kind}) AS current_total, sum(rn) AS reference_rows, sum(cn) AS current_rows, sum(an) AS added_rows, sum(mn) AS removed_rows"
    name = script.view(f"segments_of_rule_{number}", f"SELECT {cats}, {sums} FROM (\n{both}\n) GROUP BY {cats}")
    limbs = f", {limbs_sql('current_total')} AS __c, {limbs_sql('reference_total')} AS __r" if isinstance(t, T.DecimalType) else ""
    script.view(f"segment_rule_{number}", f"SELECT {cats}, reference_total, current_total, reference_rows, current_rows, added_rows, removed_rows, {rules.status_sql(rule, t)} AS status\nFROM (SELECT *{limbs} FROM {name}) WHERE {where}")


def rule_evidence_sql(spec: Spec, rule: dict, number: int, compared: list[Field]) -> str:
    measure = rule["measure"]
    if "field" in rule:
        counter = rules.FIELD_MEASURES[measure][0]
        return f"SELECT * FROM joined WHERE {MATCHED} AND {field_conditions_sql(compared)[spec.fields.index(rule['field'])][counter]}"
    if "group_by" not in rule:
        return "SELECT * FROM joined WHERE " + {"removed_rows": "cp IS NULL", "removed_percent": "cp IS NULL", "added_rows": "rp IS NULL", "current_rows": "cp", "current_total": "cp"}.get(measure, "true")
    at = [spec.selected.index(c) for c in rule["group_by"]]
    bad = f"(SELECT *, true AS bad FROM segment_rule_{number} WHERE status <> 'passed')"
    old, new = (" AND ".join(f"j.{s}d{j} <=> {x}.g{i}" for i, j in enumerate(at)) for s, x in (("r", "o"), ("c", "w")))
    stays = f"({MATCHED} AND NOT {moved_sql(at)})"
    held = {"removed_rows": f"rp AND o.bad AND NOT coalesce({stays}, false)", "added_rows": f"cp AND w.bad AND NOT coalesce({stays}, false)", "current_rows": "cp AND w.bad"}
    held |= {"removed_percent": held["removed_rows"], "current_total": held["current_rows"]}
    return f"SELECT j.* FROM joined j LEFT JOIN {bad} o ON {old} LEFT JOIN {bad} w ON {new} WHERE {held.get(measure, 'rp AND o.bad OR cp AND w.bad')}"


def export_views(script: Script, spec: Spec, metrics: list[Metric], compared: list[Field], exports: list[dict]) -> None:
    """The rows of each exported file, in its order."""
    keys = ", ".join(f"k{i} NULLS LAST" for i in range(len(spec.key)))
    for e in exports:
        limit = "" if e["limit"] is None else f" LIMIT {e['limit']}"
        if e["kind"] == "rule":
            script.view(e["evidence"], f"{rule_evidence_sql(spec, spec.rules[e['rule_index']], e['rule_index'], compared)} ORDER BY {keys}{limit}")
            continue
        v = [m.name for m in metrics].index(e["metric"])
        t, zero = metrics[v].dtype, typed_sql(0, metrics[v].dtype)
        where = {
            "added": "rp IS NULL", "removed": "cp IS NULL", "changed": f"{MATCHED} AND NOT rv{v} <=> cv{v}", "moved": f"{MATCHED} AND {moved_sql(list(range(len(spec.selected))))}",
            "field_changed": f"{MATCHED} AND ({any_changed_sql(compared)})", "largest_changes": f"NOT coalesce(cv{v}, {zero}) <=> coalesce(rv{v}, {zero})", "all": "true",
        }[e["kind"]]
        columns = [*("rp", "cp"), *(f"k{i}" for i in range(len(spec.key))), f"rv{v}", f"cv{v}", *(f"{s}{x}{i}" for x, n in (("d", len(spec.selected)), ("f", len(spec.fields))) for i in range(n) for s in "rc")]
        body = f"SELECT {', '.join(columns)}, CAST(coalesce(cv{v}, {zero}) - coalesce(rv{v}, {zero}) AS {t.simpleString().upper()}) AS contribution FROM joined WHERE {where}"
        script.view(e["evidence"], body if e["kind"] == "all" else f"{body} ORDER BY {magnitude_sql('contribution', t)} DESC, {keys}{limit}")


def sides_script(spec: Spec, sides: dict[str, Snapshot], scoped: bool = True) -> Script:
    script = Script()
    where = populations.scope_sql(spec.filters, *[sides[s].schema for s in SIDES]) if scoped else "true"
    for side in SIDES:
        side_view(script, side, sides[side], where)
    return script


def comparison_script(spec: Spec, sides: dict[str, Snapshot], metrics: list[Metric], compared: list[Field], selectors: dict[int, str], exports: list[dict]) -> Script:
    """All statements of a comparison; ``selectors`` has the condition on segments of each grouped rule."""
    script = sides_script(spec, sides)
    joined_view(script, spec, metrics)
    for i in range(len(metrics)):
        metric_views(script, spec, metrics, i)
    field_views(script, spec, compared)
    for n, where in selectors.items():
        segment_view(script, spec, spec.rules[n], n, metrics, where)
    export_views(script, spec, metrics, compared, exports)
    return script


def cited(data: object) -> set[str]:
    """The names of all views that findings cite."""
    found: set[str] = set()
    if isinstance(data, dict):
        for k, v in data.items():
            if k in ("evidence", "denominator_evidence") and isinstance(v, str):
                found.add(v.removeprefix("analysis.sql: "))
            else:
                found |= cited(v)
    elif isinstance(data, list):
        for v in data:
            found |= cited(v)
    return found
