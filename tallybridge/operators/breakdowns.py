"""Breakdowns by category, moves between categories, and the bounded tables that reports show.

Categories are one or more dimension columns, kept as columns g0.. (or from_g0.., to_g0..). Grouping comes
before any ranking. The most important 50 groups come from a top-k sort, and one more row sums up all
others; nothing sorts all groups in one task. Sums of binary fractions do not depend on the rows' order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybridge.functions.exact import differs, exact_sums, magnitude, named, typed
from tallybridge.operators.alignment import Metric, any_moved, matched, total

SHOWN = 50


def category_order(columns: list[str], width: int) -> list[Column]:
    """Nulls first for a single column, and last within the components of a combined category."""
    return [F.asc_nulls_first(c) if width == 1 else F.asc_nulls_last(c) for c in columns]


def breakdown(aligned: DataFrame, metric: Metric, indices: list[int], metric_index: int = 0) -> DataFrame:
    """Rows, totals and contribution of each category, each side by its own membership.

    One pass over the aligned rows and one aggregation; each row gives its membership of either side.
    """
    i, t = metric_index, metric.dtype
    cats, long = [f"g{n}" for n in range(len(indices))], F.lit(1).cast("long")

    def membership(side: str) -> Column:
        own = [F.col(f"{side}d{j}").alias(g) for g, j in zip(cats, indices, strict=True)]
        here = lambda x, value, none: (value if x == side else none).alias
        return F.struct(F.col(f"{side}p").isNotNull().alias("present"), *own, *[here(x, long, long - 1)(f"{x}n") for x in "rc"], *[here(x, F.col(f"{side}v{i}").cast(t), typed(0, t))(f"{x}t") for x in "rc"])

    return summed(aligned.select(F.inline(F.array(membership("r"), membership("c")))).filter("present"), cats, metric)


def summed(memberships: DataFrame, categories: list[str], metric: Metric) -> DataFrame:
    """Rows, totals and contribution by category, of rows with rn, cn, rt and ct."""
    t, counts = metric.dtype, {"reference_rows": F.col("rn"), "current_rows": F.col("cn")}
    if metric.approximate:
        sums = exact_sums(memberships, categories, [("reference_total", F.col("rt")), ("current_total", F.col("ct"))], counts)
    else:
        sums = memberships.groupBy(*categories).agg(*[F.sum(c).alias(n) for n, c in counts.items()], F.sum("rt").cast(t).alias("reference_total"), F.sum("ct").cast(t).alias("current_total"))
    out = sums.select(*categories, "reference_rows", "current_rows", "reference_total", "current_total")
    return out.withColumn("contribution", (F.col("current_total") - F.col("reference_total")).cast(t))


def breakdown_of_sides(reference: DataFrame, current: DataFrame, metric: Metric, dimensions: list[str]) -> DataFrame:
    """The same as :func:`breakdown`, from the two sides as they are: each row counts for its own side, without a join.

    One exchange, on the categories: tasks add up their rows of both sides before it.
    """
    cats, t, long = [f"g{n}" for n in range(len(dimensions))], metric.dtype, F.lit(1).cast("long")

    def side_rows(side: DataFrame, name: str) -> DataFrame:
        here = lambda x, value, none: value if x == name else none
        return side.select(*[named(d).alias(g) for g, d in zip(cats, dimensions, strict=True)], *[here(x, long, long - 1).alias(f"{x}n") for x in "rc"], *[here(x, metric.value, typed(0, t)).alias(f"{x}t") for x in "rc"])

    return summed(side_rows(reference, "r").unionByName(side_rows(current, "c")), cats, metric)


def ranked(groups: DataFrame, keys: list[str], order: list[Column], sums: list[str], shown: int = SHOWN) -> DataFrame:
    """The first ``shown`` groups in order, and one row is_other for all further ones (keys null), with rank.

    The others are all groups together without the first ones, so the groups are not joined or filtered again:
    both sums read what one exchange has grouped. Rounding of binary fractions stays far below what
    reconciliation allows for it.
    """
    types = dict(groups.dtypes)
    numbered = groups.orderBy(*order).limit(shown).withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("is_other", F.lit(False))
    n = F.count("*").alias("n")
    whole = groups.agg(n, *[F.sum(s).cast(types[s]).alias(s) for s in sums])
    first = numbered.agg(n, *[F.sum(s).cast(types[s]).alias(s) for s in sums])
    less = first.select((F.lit(0).cast("long") - F.col("n")).alias("n"), *[(F.lit(0).cast(types[s]) - F.col(s)).cast(types[s]).alias(s) for s in sums])
    other = whole.unionByName(less).agg(F.sum("n").alias("n"), *[F.sum(s).cast(types[s]).alias(s) for s in sums]).filter("n > 0")
    other = other.select(*[F.lit(None).cast(types[k]).alias(k) for k in keys], *sums, F.lit(True).alias("is_other"), F.lit(shown + 1).alias("rank"))
    return numbered.select(other.columns).unionByName(other)


def shown_breakdown(aligned: DataFrame, metric: Metric, indices: list[int], metric_index: int = 0, shown: int = SHOWN) -> DataFrame:
    """The breakdown's largest contributions, and the others as one row."""
    return shown_groups(breakdown(aligned, metric, indices, metric_index), metric, len(indices), shown)


def shown_groups(groups: DataFrame, metric: Metric, width: int, shown: int = SHOWN) -> DataFrame:
    """The largest contributions of a breakdown by ``width`` columns, and the others as one row."""
    cats = [f"g{n}" for n in range(width)]
    order = [F.desc(magnitude(F.col("contribution"), metric.dtype)), *category_order(cats, width)]
    return ranked(groups, cats, order, ["reference_rows", "current_rows", "reference_total", "current_total", "contribution"], shown)


def contribution_size(groups: DataFrame, metric: Metric) -> DataFrame:
    """Sum and sum of magnitudes of all contributions; the latter bounds rounding of approximate metrics."""
    size = magnitude(F.col("contribution"), metric.dtype) if metric.approximate else typed(0, metric.dtype)
    return groups.agg(total(F.col("contribution"), None, metric.dtype).alias("contribution"), F.coalesce(F.sum(size), typed(0, metric.dtype)).alias("size"))


def reclassified(aligned: DataFrame, metric: Metric, indices: list[int], metric_index: int = 0) -> DataFrame:
    """One row on matched keys that changed category: rows, also_metric_changed and both amounts."""
    i, t = metric_index, metric.dtype
    rv, cv = F.col(f"rv{i}"), F.col(f"cv{i}")
    return aligned.filter(matched() & any_moved(indices)).agg(
        F.count("*").alias("rows"), F.count_if(differs(rv, cv)).alias("also_metric_changed"), total(rv, None, t).alias("reference_amount"), total(cv, None, t).alias("current_amount")
    )


def movements(aligned: DataFrame, metric: Metric, indices: list[int], metric_index: int = 0) -> DataFrame:
    """Matched keys that changed category, by source and destination."""
    i, t = metric_index, metric.dtype
    rv, cv = F.col(f"rv{i}"), F.col(f"cv{i}")
    sources, targets = ([F.col(f"{s}d{j}").alias(f"{x}_g{n}") for n, j in enumerate(indices)] for s, x in (("r", "from"), ("c", "to")))
    return aligned.filter(matched() & any_moved(indices)).groupBy(*sources, *targets).agg(
        F.count("*").alias("rows"), F.count_if(differs(rv, cv)).alias("also_metric_changed"), F.sum(rv).cast(t).alias("reference_amount"), F.sum(cv).cast(t).alias("current_amount")
    )


def shown_movements(aligned: DataFrame, metric: Metric, indices: list[int], metric_index: int = 0, shown: int = SHOWN) -> DataFrame:
    """The most frequent movements, and the others as one row."""
    keys = [f"{x}_g{n}" for x in ("from", "to") for n in range(len(indices))]
    order = [F.desc("rows"), *category_order(keys, len(indices))]
    return ranked(movements(aligned, metric, indices, metric_index), keys, order, ["rows", "also_metric_changed", "reference_amount", "current_amount"], shown)
