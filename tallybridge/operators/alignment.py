"""Two snapshots aligned by key, and what the aligned rows say about each metric.

The aligned frame has one row for each key of either side: rp and cp (true where the side has the key, else
null), the key columns k0.., both sides' metric values rv0/cv0.., dimensions rd0/cd0.. and compared fields
rf0/cf0... All metrics share the one full outer join, so the snapshots are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybridge.functions.exact import differs, exact_sums, named, negative, typed
from tallybridge.functions.types import APPROXIMATE, sum_type


@dataclass(frozen=True)
class Metric:
    """A row count (no column) or the sum of a column of the logical type ``kind``."""

    name: str
    column: str | None = None
    kind: str = "BIGINT"

    @property
    def dtype(self) -> T.DataType:
        return sum_type(self.kind) if self.column else T.DecimalType(38, 0)

    @property
    def approximate(self) -> bool:
        return self.column is not None and self.kind in APPROXIMATE

    @property
    def value(self) -> Column:
        return named(self.column).cast(self.dtype) if self.column else typed(1, self.dtype)


def selected(side: DataFrame, key: list[str], metrics: list[Metric], dimensions: list[str], fields: list[str]) -> DataFrame:
    """The columns of one side that a comparison needs, under positional names."""
    return side.select(
        *[named(k).alias(f"k{i}") for i, k in enumerate(key)],
        *[named(d).alias(f"d{i}") for i, d in enumerate(dimensions)],
        *[named(c).alias(f"f{i}") for i, c in enumerate(fields)],
        *[m.value.alias(f"v{i}") for i, m in enumerate(metrics)],
        F.lit(True).alias("p"),
    )


def align(reference: DataFrame, current: DataFrame, key: list[str], metrics: list[Metric], dimensions: Iterable[str] = (), fields: Iterable[str] = ()) -> DataFrame:
    """Full outer join of both sides on all key columns; keys are non-null and unique by then."""
    dimensions, fields = list(dimensions), list(fields)
    r, c = (selected(side, key, metrics, dimensions, fields).alias(x) for side, x in ((reference, "r"), (current, "c")))
    on = [F.col(f"r.k{i}") == F.col(f"c.k{i}") for i in range(len(key))]
    pairs = [(x, i) for x, n in (("v", len(metrics)), ("d", len(dimensions)), ("f", len(fields))) for i in range(n)]
    return r.join(c, on, "full").select(
        F.col("r.p").alias("rp"),
        F.col("c.p").alias("cp"),
        *[F.coalesce(f"r.k{i}", f"c.k{i}").alias(f"k{i}") for i in range(len(key))],
        *[F.col(f"{s}.{x}{i}").alias(f"{s}{x}{i}") for x, i in pairs for s in "rc"],
    )


def matched() -> Column:
    return F.col("rp").isNotNull() & F.col("cp").isNotNull()


def added() -> Column:
    return F.col("rp").isNull()


def removed() -> Column:
    return F.col("cp").isNull()


def any_moved(indices: Iterable[int]) -> Column:
    """Whether any of these dimensions differs between the sides."""
    out = F.lit(False)
    for i in indices:
        out = out | differs(F.col(f"rd{i}"), F.col(f"cd{i}"))
    return out


def total(value: Column, where: Column | None, dtype: T.DataType) -> Column:
    return F.coalesce(F.sum(value if where is None else F.when(where, value)), typed(0, dtype))


def one(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0).cast("long")


COUNTS = ("reference_rows", "current_rows", "added_rows", "removed_rows", "matched_rows", "dimension_changed_rows")
AMOUNTS = ("reference_total", "current_total", "added_contribution", "removed_contribution", "matched_contribution")


def reconcile(aligned: DataFrame, metrics: list[Metric], dimensions: int = 0) -> DataFrame:
    """One row with all counts and, for each metric i, its totals: metric_changed_rows_i, reference_total_i ...

    removed_contribution is negative: what the removed rows take away. Sums of binary fractions are the same for
    any order of the rows.
    """
    counted = {
        "reference_rows": F.col("rp").isNotNull(),
        "current_rows": F.col("cp").isNotNull(),
        "added_rows": added(),
        "removed_rows": removed(),
        "matched_rows": matched(),
        "dimension_changed_rows": matched() & any_moved(range(dimensions)),
    } | {f"metric_changed_rows_{i}": matched() & differs(F.col(f"rv{i}"), F.col(f"cv{i}")) for i in range(len(metrics))}
    plain, doubles, out = {n: one(c) for n, c in counted.items()}, [], {n: F.coalesce(F.col(n), F.lit(0).cast("long")) for n in counted}
    for i, m in enumerate(metrics):
        rv, cv, t = F.col(f"rv{i}"), F.col(f"cv{i}"), m.dtype
        if m.approximate:
            parts = [("reference_total", rv), ("current_total", cv), ("added_contribution", F.when(added(), cv)), ("removed_contribution", F.when(removed(), -rv)), ("matched_contribution", F.when(matched(), cv)), ("matched_contribution", F.when(matched(), -rv))]
            doubles += [(f"{n}_{i}", c) for n, c in parts]
            out |= {f"{n}_{i}": F.col(f"{n}_{i}") for n in AMOUNTS}
            continue
        plain |= {f"reference_total_{i}": rv, f"current_total_{i}": cv, f"added_contribution_{i}": F.when(added(), cv), f"removed_contribution_{i}": F.when(removed(), rv), f"matched_contribution_{i}": F.when(matched(), cv - rv)}
        out |= {f"{n}_{i}": F.coalesce(F.col(f"{n}_{i}").cast(t), typed(0, t)) for n in AMOUNTS}
        out[f"removed_contribution_{i}"] = negative(out[f"removed_contribution_{i}"], t)
    summed = exact_sums(aligned, [], doubles, plain) if doubles else aligned.agg(*[F.sum(c).alias(n) for n, c in plain.items()])
    return summed.select(*[c.alias(n) for n, c in out.items()])


def metric_totals(aligned: DataFrame, metrics: list[Metric], dimensions: int = 0) -> DataFrame:
    """A row for each metric: metric, counts, metric_changed_rows, totals (as text where types differ) and delta."""
    wide = reconcile(aligned, metrics, dimensions)
    rows = [F.struct(F.lit(m.name).alias("metric"), *COUNTS, F.col(f"metric_changed_rows_{i}").alias("metric_changed_rows"), *[F.round(F.col(f"{a}_{i}"), 2).cast("decimal(38,2)").alias(a) if m.approximate else F.col(f"{a}_{i}").cast("decimal(38,2)").alias(a) for a in AMOUNTS]) for i, m in enumerate(metrics)]
    return wide.select(F.inline(F.array(*rows)))
