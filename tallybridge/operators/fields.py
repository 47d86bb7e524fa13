"""Changes of fields outside key and metrics, on matched keys."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybridge.functions.exact import differs, within_sql
from tallybridge.functions.types import APPROXIMATE, decimal_parts
from tallybridge.operators.alignment import matched
from tallybridge.operators.breakdowns import ranked

COMMON = ("changed_rows", "unchanged_rows", "exact_match_rows", "within_tolerance_rows", "became_null", "from_null", "both_null", "value_changed_rows")


@dataclass(frozen=True)
class Field:
    """A compared field of the logical type ``kind``; numbers may differ by ``tolerance``."""

    name: str
    kind: str
    tolerance: Decimal | None = None

    @property
    def counters(self) -> tuple[str, ...]:
        if self.kind == "VARCHAR":
            return (*COMMON, "became_blank", "from_blank")
        return COMMON if self.kind == "BOOLEAN" else (*COMMON, "increased_rows", "decreased_rows")


def conditions_sql(field: Field, before: str, after: str) -> dict[str, str]:
    """Each counter's condition; none is ever null, so that their negations hold as well."""
    equal, both, near = f"{before} <=> {after}", f"({before} IS NOT NULL AND {after} IS NOT NULL)", "false"
    if field.tolerance is not None:
        if field.kind in APPROXIMATE:
            near = f"abs(CAST({after} AS DOUBLE) - CAST({before} AS DOUBLE)) <= CAST('{float(field.tolerance)!r}' AS DOUBLE)"
        else:
            near = within_sql(before, after, (decimal_parts(field.kind) or (0, 0))[1], field.tolerance)
        near = f"coalesce(NOT ({equal}) AND {both} AND {near}, false)"
    changed = f"(NOT ({equal}) AND NOT ({near}))"
    out = {
        "changed_rows": changed,
        "unchanged_rows": f"NOT {changed}",
        "exact_match_rows": equal,
        "within_tolerance_rows": near,
        "became_null": f"{before} IS NOT NULL AND {after} IS NULL",
        "from_null": f"{before} IS NULL AND {after} IS NOT NULL",
        "both_null": f"{before} IS NULL AND {after} IS NULL",
        "value_changed_rows": f"{both} AND {changed}",
    }
    if field.kind == "VARCHAR":
        out |= {"became_blank": f"coalesce({after} = '', false) AND NOT ({before} <=> '')", "from_blank": f"coalesce({before} = '', false) AND NOT ({after} <=> '')"}
    elif field.kind != "BOOLEAN":
        out |= {"increased_rows": f"coalesce({after} > {before}, false) AND {changed}", "decreased_rows": f"coalesce({after} < {before}, false) AND {changed}"}
    return out


def field_conditions_sql(fields: list[Field]) -> list[dict[str, str]]:
    return [conditions_sql(f, f"rf{i}", f"cf{i}") for i, f in enumerate(fields)]


def field_conditions(fields: list[Field]) -> list[dict[str, Column]]:
    return [{name: F.expr(c) for name, c in own.items()} for own in field_conditions_sql(fields)]


def any_changed_sql(fields: list[Field]) -> str:
    return " OR ".join(c["changed_rows"] for c in field_conditions_sql(fields)) or "false"


def any_changed(fields: list[Field]) -> Column:
    return F.expr(any_changed_sql(fields))


def field_counters(aligned: DataFrame, fields: list[Field]) -> DataFrame:
    """One row for all fields: matched_rows, any_changed_rows and each field's counters as counter_i.

    The fields share one pass over the aligned rows.
    """
    counters = [F.count_if(c).alias(f"{name}_{i}") for i, own in enumerate(field_conditions(fields)) for name, c in own.items()]
    return aligned.filter(matched()).agg(F.count("*").alias("matched_rows"), F.count_if(any_changed(fields)).alias("any_changed_rows"), *counters)


def field_summary(aligned: DataFrame, fields: list[Field], counters: tuple[str, ...]) -> DataFrame:
    """A row for each field: field, matched_rows and the counters asked for (null where a type has none)."""
    wide = field_counters(aligned, fields)
    value = lambda f, i, c: F.col(f"{c}_{i}") if c in f.counters else F.lit(None).cast("long")
    rows = [F.struct(F.lit(f.name).alias("field"), "matched_rows", *[value(f, i, c).alias(c) for c in counters]) for i, f in enumerate(fields)]
    return wide.select(F.inline(F.array(*rows)))


def transitions(aligned: DataFrame, index: int) -> DataFrame:
    """Matched keys whose field differs, by both values; tolerances play no part."""
    before, after = F.col(f"rf{index}"), F.col(f"cf{index}")
    return aligned.filter(matched() & differs(before, after)).groupBy(before.alias("from_value"), after.alias("to_value")).agg(F.count("*").alias("rows"))


def shown_transitions(aligned: DataFrame, index: int, shown: int = 50) -> DataFrame:
    """The most frequent transitions, and the others as one row."""
    order = [F.desc("rows"), F.asc_nulls_first("from_value"), F.asc_nulls_first("to_value")]
    return ranked(transitions(aligned, index), ["from_value", "to_value"], order, ["rows"], shown)
