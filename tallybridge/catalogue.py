"""Queries over the driver's tables, one for each operator family, with the same meaning in DuckDB SQL.

The main pair of snapshots derives from orders; lineitem serves for composite keys and as an input with
repeated keys. Counts are bigint and amounts decimal(38,2) in both dialects.
"""

from __future__ import annotations

import atexit
import json
import shutil
import uuid
from collections.abc import Callable
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybridge.errors import CompareError
from tallybridge.functions.exact import exact_session, magnitude
from tallybridge.operators import alignment, breakdowns, fields, populations, rules
from tallybridge.operators.alignment import Metric
from tallybridge.operators.fields import Field
from tallybridge.plans.diagnose import validate
from tallybridge.plans.investigate import investigate, selector_sql
from tallybridge.sources.files import shared_folder
from tallybridge.sources.snapshots import read_snapshot

ORDERS_REFERENCE = """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status, nullif(o_orderpriority, '5-LOW') AS priority,
  CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_totalprice AS amount_f, CAST(o_orderdate AS DATE) AS order_date,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN '' ELSE concat('n', CAST(o_orderkey % 6 AS {text})) END AS note
FROM orders WHERE o_orderkey % 10 <> 7"""
ORDERS_CURRENT = """
SELECT o_orderkey AS order_id, o_custkey + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS customer_id,
  CASE WHEN o_orderkey % 11 = 0 THEN CASE o_orderstatus WHEN 'O' THEN 'F' WHEN 'F' THEN 'P' ELSE 'O' END ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE nullif(o_orderpriority, '5-LOW') END AS priority,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 5 = 0 THEN 10.00 WHEN o_orderkey % 7 = 0 THEN 0.01 ELSE 0.00 END AS DECIMAL(18,2)) AS amount,
  o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 10.0 ELSE 0.0 END AS amount_f,
  {later} AS order_date,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN '' ELSE concat('n', CAST(o_orderkey % 6 AS {text})) END AS note
FROM orders WHERE o_orderkey % 10 <> 3"""
SHIFT = "CAST(CASE WHEN o_orderkey % 19 = 0 THEN 1 WHEN o_orderkey % 23 = 0 THEN -1 ELSE 0 END AS INTEGER)"
SPARK_WORDS = {"text": "STRING", "later": f"date_add(CAST(o_orderdate AS DATE), {SHIFT})"}
DUCK_WORDS = {"text": "VARCHAR", "later": f"CAST(o_orderdate AS DATE) + {SHIFT}"}
KINDS = {"order_id": "BIGINT", "customer_id": "BIGINT", "status": "VARCHAR", "priority": "VARCHAR", "amount": "DECIMAL(18,2)", "amount_f": "DOUBLE", "order_date": "DATE", "note": "VARCHAR"}
AMOUNT, COUNT = Metric("amount", "amount", "DECIMAL(18,2)"), Metric("orders")
DIMENSIONS = ["status", "customer_id", "priority"]
FIELDS = [
    Field("note", "VARCHAR"), Field("order_date", "DATE"), Field("amount", "DECIMAL(18,2)", Decimal("0.01")), Field("amount_f", "DOUBLE", Decimal("9.5")),
    Field("priority", "VARCHAR"), Field("customer_id", "BIGINT", Decimal("0.5")), Field("status", "VARCHAR"),
]


def view(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    """A derived table, without leaving a view behind in the session."""
    return spark.sql(sql.replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(view(spark, sf_dir, "orders", q.format(**SPARK_WORDS)) for q in (ORDERS_REFERENCE, ORDERS_CURRENT))


def aligned(spark: SparkSession, sf_dir: str, metrics: list[Metric] | None = None) -> DataFrame:
    return alignment.align(*snapshots(spark, sf_dir), ["order_id"], metrics or [AMOUNT], DIMENSIONS, [f.name for f in FIELDS])


def by_side(spark: SparkSession, sf_dir: str, indices: list[int], shown: int | None = None) -> DataFrame:
    """A breakdown by these of DIMENSIONS; totals by category need no join of the sides."""
    groups = breakdowns.breakdown_of_sides(*snapshots(spark, sf_dir), AMOUNT, [DIMENSIONS[i] for i in indices])
    return groups if shown is None else breakdowns.shown_groups(groups, AMOUNT, len(indices), shown)


CTE = f"""WITH reference AS ({ORDERS_REFERENCE.format(**DUCK_WORDS)}), current AS ({ORDERS_CURRENT.format(**DUCK_WORDS)}),
joined AS (
  SELECT r.order_id IS NOT NULL AS rp, c.order_id IS NOT NULL AS cp, coalesce(r.order_id, c.order_id) AS k0, r.amount AS rv, c.amount AS cv,
    r.status AS rd0, c.status AS cd0, r.customer_id AS rd1, c.customer_id AS cd1, r.priority AS rd2, c.priority AS cd2,
    r.note AS rf0, c.note AS cf0, r.order_date AS rf1, c.order_date AS cf1, r.amount_f AS rf3, c.amount_f AS cf3
  FROM reference r FULL OUTER JOIN current c ON r.order_id = c.order_id
)
"""
MONEY = "decimal(38,2)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, built under the settings that exactness needs, and its SQL."""

    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with exact_session(spark):
                return build(spark, sf_dir)

        key = name or build.__name__
        QUERIES[key] = run
        if sql is not None:
            SQL[key] = sql
        return build

    return add


def kept(frame: DataFrame) -> DataFrame:
    """The frame, computed once and held in the checkpoint folder, so that several steps can read it."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def long(c: str):
    return F.col(c).cast("long").alias(c)


def money(c: str):
    return F.col(c).cast(MONEY).alias(c)


# --- totals -------------------------------------------------------------------------------------------

TOTALS = """count(*) FILTER (WHERE rp) AS reference_rows, count(*) FILTER (WHERE cp) AS current_rows, count(*) FILTER (WHERE NOT rp) AS added_rows,
  count(*) FILTER (WHERE NOT cp) AS removed_rows, count(*) FILTER (WHERE rp AND cp) AS matched_rows, {moved} AS dimension_changed_rows,
  count(*) FILTER (WHERE rp AND cp AND {rv} IS DISTINCT FROM {cv}) AS metric_changed_rows,
  CAST(coalesce(sum({rv}) FILTER (WHERE rp), 0) AS DECIMAL(38,2)) AS reference_total, CAST(coalesce(sum({cv}) FILTER (WHERE cp), 0) AS DECIMAL(38,2)) AS current_total,
  CAST(coalesce(sum({cv}) FILTER (WHERE NOT rp), 0) AS DECIMAL(38,2)) AS added_contribution, CAST(-coalesce(sum({rv}) FILTER (WHERE NOT cp), 0) AS DECIMAL(38,2)) AS removed_contribution,
  CAST(coalesce(sum({cv} - {rv}) FILTER (WHERE rp AND cp), 0) AS DECIMAL(38,2)) AS matched_contribution FROM joined"""
MOVED = "count(*) FILTER (WHERE rp AND cp AND (rd0 IS DISTINCT FROM cd0 OR rd1 IS DISTINCT FROM cd1 OR rd2 IS DISTINCT FROM cd2))"
TOTALS_SUM = "SELECT 'amount' AS metric, " + TOTALS.format(rv="rv", cv="cv", moved=MOVED)
TOTALS_COUNT = "SELECT 'orders' AS metric, " + TOTALS.format(rv="1", cv="1", moved=MOVED)


@query(CTE + TOTALS_SUM)
def reconcile_totals_sum(spark, sf_dir):
    return alignment.metric_totals(aligned(spark, sf_dir), [AMOUNT], 3)


@query(CTE + TOTALS_COUNT)
def reconcile_totals_count(spark, sf_dir):
    return alignment.metric_totals(aligned(spark, sf_dir, [COUNT]), [COUNT], 3)


@query(CTE + TOTALS_SUM + " UNION ALL " + TOTALS_COUNT)
def reconcile_multi_metric(spark, sf_dir):
    return alignment.metric_totals(aligned(spark, sf_dir, [AMOUNT, COUNT]), [AMOUNT, COUNT], 3)


LINES = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_returnflag, l_linestatus,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) + {more} AS DECIMAL(18,2)) AS price FROM lineitem WHERE l_orderkey % 10 <> {left}"""
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
LINE_SIDES = [LINES.format(more="0.00", left=7), LINES.format(more="CASE WHEN l_partkey % 5 = 0 THEN 1.25 ELSE 0.00 END", left=3)]


@query(
    f"WITH reference AS ({LINE_SIDES[0]}), current AS ({LINE_SIDES[1]}), joined AS (SELECT r.l_orderkey IS NOT NULL AS rp, c.l_orderkey IS NOT NULL AS cp, r.price AS rv, c.price AS cv "
    "FROM reference r FULL OUTER JOIN current c USING (l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate)) SELECT 'price' AS metric, " + TOTALS.format(rv="rv", cv="cv", moved="CAST(0 AS BIGINT)")
)
def reconcile_composite_key(spark, sf_dir):
    price = Metric("price", "price", "DECIMAL(18,2)")
    sides = [view(spark, sf_dir, "lineitem", q) for q in LINE_SIDES]
    return alignment.metric_totals(alignment.align(*sides, LINE_KEY, [price]), [price])


MASS = Metric("amount_f", "amount_f", "DOUBLE")
#: The doubles of orders have two decimal places, so their decimals sum to the same once both are rounded there.
AS_MONEY = CTE.replace("r.amount AS rv, c.amount AS cv", "CAST(r.amount_f AS DECIMAL(18,2)) AS rv, CAST(c.amount_f AS DECIMAL(18,2)) AS cv")


@query(AS_MONEY + "SELECT 'amount_f' AS metric, " + TOTALS.format(rv="rv", cv="cv", moved=MOVED))
def reconcile_double(spark, sf_dir):
    return alignment.metric_totals(aligned(spark, sf_dir, [MASS]), [MASS], 3)


# --- breakdowns and movements -------------------------------------------------------------------------


def breakdown_sql(columns: list[str], order: str, shown: int | None = 50) -> str:
    """Both sides grouped and joined null-safely; the first groups in order and one row for the others."""
    names = [f"g{i}" for i in range(len(columns))]
    cats = ", ".join(f"{c} AS {g}" for c, g in zip(columns, names, strict=True))
    by, on = ", ".join(columns), " AND ".join(f"r.{g} IS NOT DISTINCT FROM c.{g}" for g in names)
    both = ", ".join(f"CASE WHEN r.n IS NOT NULL THEN r.{g} ELSE c.{g} END AS {g}" for g in names)
    body = f""", r AS (SELECT {cats}, count(*) AS n, sum(amount) AS t FROM reference GROUP BY {by}), c AS (SELECT {cats}, count(*) AS n, sum(amount) AS t FROM current GROUP BY {by}),
    groups AS (SELECT {both}, coalesce(r.n, 0) AS reference_rows, coalesce(c.n, 0) AS current_rows, CAST(coalesce(r.t, 0) AS DECIMAL(38,2)) AS reference_total,
      CAST(coalesce(c.t, 0) AS DECIMAL(38,2)) AS current_total, CAST(coalesce(c.t, 0) - coalesce(r.t, 0) AS DECIMAL(38,2)) AS contribution FROM r FULL OUTER JOIN c ON {on})"""
    cols = ", ".join(names)
    if shown is None:
        return CTE.rstrip() + body + f" SELECT {cols}, reference_rows, current_rows, reference_total, current_total, contribution FROM groups"
    nulls = ", ".join("NULL" for _ in names)
    return CTE.rstrip() + body + f""", numbered AS (SELECT *, row_number() OVER (ORDER BY abs(contribution) DESC, {order}) AS place FROM groups)
    SELECT {cols}, reference_rows, current_rows, reference_total, current_total, contribution, false AS is_other, CAST(place AS INTEGER) AS rank FROM numbered WHERE place <= {shown}
    UNION ALL SELECT {nulls}, CAST(sum(reference_rows) AS BIGINT), CAST(sum(current_rows) AS BIGINT), CAST(sum(reference_total) AS DECIMAL(38,2)), CAST(sum(current_total) AS DECIMAL(38,2)),
      CAST(sum(contribution) AS DECIMAL(38,2)), true, {shown + 1} FROM numbered WHERE place > {shown} HAVING count(*) > 0"""


@query(breakdown_sql(["status"], "g0 NULLS FIRST"))
def breakdown_single(spark, sf_dir):
    return by_side(spark, sf_dir, [0], 50)


@query(breakdown_sql(["priority"], "g0 NULLS FIRST", None))
def breakdown_null_category(spark, sf_dir):
    return breakdowns.breakdown(aligned(spark, sf_dir), AMOUNT, [2])


@query(breakdown_sql(["status", "priority"], "g0 NULLS LAST, g1 NULLS LAST"))
def breakdown_combined(spark, sf_dir):
    return by_side(spark, sf_dir, [0, 2], 50)


@query(breakdown_sql(["customer_id"], "g0 NULLS FIRST"))
def breakdown_top50_other(spark, sf_dir):
    return by_side(spark, sf_dir, [1], 50)


@query(
    breakdown_sql(["status"], "", None)
    .replace("sum(amount) AS t", "sum(CAST(amount_f AS DECIMAL(18,2))) AS t")
)
def breakdown_double(spark, sf_dir):
    groups = breakdowns.breakdown_of_sides(*snapshots(spark, sf_dir), MASS, ["status"])
    return groups.select("g0", "reference_rows", "current_rows", *[F.round(c, 2).cast(MONEY).alias(c) for c in ("reference_total", "current_total", "contribution")])


@query(breakdown_sql(["customer_id"], "", None).rsplit(" SELECT ", 1)[0] + " SELECT CAST(sum(contribution) AS DECIMAL(38,2)) AS contribution, CAST(sum(abs(contribution)) AS DECIMAL(38,2)) AS size FROM groups")
def breakdown_identity(spark, sf_dir):
    groups = by_side(spark, sf_dir, [1])
    size = F.sum(magnitude(F.col("contribution"), AMOUNT.dtype)).cast(MONEY).alias("size")
    return groups.agg(F.sum("contribution").cast(MONEY).alias("contribution"), size)


@query(CTE + "SELECT count(*) AS rows, count(*) FILTER (WHERE rv IS DISTINCT FROM cv) AS also_metric_changed, CAST(coalesce(sum(rv), 0) AS DECIMAL(38,2)) AS reference_amount, CAST(coalesce(sum(cv), 0) AS DECIMAL(38,2)) AS current_amount FROM joined WHERE rp AND cp AND rd0 IS DISTINCT FROM cd0")
def reclassification(spark, sf_dir):
    return breakdowns.reclassified(aligned(spark, sf_dir), AMOUNT, [0])


def movement_sql(index: int) -> str:
    return CTE.rstrip() + f""", moves AS (SELECT rd{index} AS from_g0, cd{index} AS to_g0, count(*) AS rows, count(*) FILTER (WHERE rv IS DISTINCT FROM cv) AS also_metric_changed,
      CAST(sum(rv) AS DECIMAL(38,2)) AS reference_amount, CAST(sum(cv) AS DECIMAL(38,2)) AS current_amount FROM joined WHERE rp AND cp AND rd{index} IS DISTINCT FROM cd{index} GROUP BY 1, 2),
    numbered AS (SELECT *, row_number() OVER (ORDER BY rows DESC, from_g0 NULLS FIRST, to_g0 NULLS FIRST) AS place FROM moves)
    SELECT from_g0, to_g0, rows, also_metric_changed, reference_amount, current_amount, false AS is_other, CAST(place AS INTEGER) AS rank FROM numbered WHERE place <= 50
    UNION ALL SELECT NULL, NULL, CAST(sum(rows) AS BIGINT), CAST(sum(also_metric_changed) AS BIGINT), CAST(sum(reference_amount) AS DECIMAL(38,2)), CAST(sum(current_amount) AS DECIMAL(38,2)), true, 51
    FROM numbered WHERE place > 50 HAVING count(*) > 0"""


@query(movement_sql(2))
def movements(spark, sf_dir):
    return breakdowns.shown_movements(aligned(spark, sf_dir), AMOUNT, [2])


@query(movement_sql(1))
def movements_top50_other(spark, sf_dir):
    return breakdowns.shown_movements(aligned(spark, sf_dir), AMOUNT, [1])


# --- fields -------------------------------------------------------------------------------------------


def field_sql(name: str, a: str, b: str, near: str = "false", kind: str = "number") -> str:
    """All counters of one field; ``near`` says when distinct values are close enough."""
    changed = f"({a} IS DISTINCT FROM {b} AND NOT coalesce({a} IS NOT NULL AND {b} IS NOT NULL AND ({near}), false))"
    special = {
        "text": {"became_blank": f"{b} = '' AND {a} IS DISTINCT FROM ''", "from_blank": f"{a} = '' AND {b} IS DISTINCT FROM ''", "increased_rows": None, "decreased_rows": None},
        "number": {"became_blank": None, "from_blank": None, "increased_rows": f"{b} > {a} AND {changed}", "decreased_rows": f"{b} < {a} AND {changed}"},
    }[kind]
    counters = {
        "changed_rows": changed, "unchanged_rows": f"NOT {changed}", "exact_match_rows": f"{a} IS NOT DISTINCT FROM {b}", "within_tolerance_rows": f"{a} IS DISTINCT FROM {b} AND NOT {changed}",
        "became_null": f"{a} IS NOT NULL AND {b} IS NULL", "from_null": f"{a} IS NULL AND {b} IS NOT NULL", "both_null": f"{a} IS NULL AND {b} IS NULL", "value_changed_rows": f"{a} IS NOT NULL AND {b} IS NOT NULL AND {changed}",
    } | special
    out = ", ".join(f"{f'count(*) FILTER (WHERE {c})' if c else 'CAST(NULL AS BIGINT)'} AS {n}" for n, c in counters.items())
    return f"SELECT '{name}' AS field, count(*) AS matched_rows, {out} FROM joined WHERE rp AND cp"


COUNTERS = (*fields.COMMON, "became_blank", "from_blank", "increased_rows", "decreased_rows")
FIELD_SQL = {
    "note": field_sql("note", "rf0", "cf0", kind="text"),
    "order_date": field_sql("order_date", "rf1", "cf1"),
    "amount": field_sql("amount", "rv", "cv", "abs(cv - rv) <= 0.01"),
    "amount_f": field_sql("amount_f", "rf3", "cf3", "abs(cf3 - rf3) <= CAST(9.5 AS DOUBLE)"),
    "priority": field_sql("priority", "rd2", "cd2", kind="text"),
    "customer_id": field_sql("customer_id", "rd1", "cd1", "abs(cd1 - rd1) <= 0.5"),
    "status": field_sql("status", "rd0", "cd0", kind="text"),
}


def one_field(name: str) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        chosen = [f for f in FIELDS if f.name == name]
        frame = alignment.align(*snapshots(spark, sf_dir), ["order_id"], [AMOUNT], [], [name])
        return fields.field_summary(frame, chosen, COUNTERS)

    query(CTE + FIELD_SQL[name], {"note": "field_summary_text", "order_date": "field_summary_date", "amount": "field_tolerance_decimal", "amount_f": "field_tolerance_double", "customer_id": "field_summary_numeric"}[name])(build)


for _name in ("note", "order_date", "amount", "amount_f", "customer_id"):
    one_field(_name)


@query(CTE + " UNION ALL ".join(FIELD_SQL[f.name] for f in FIELDS))
def field_summary_all(spark, sf_dir):
    return fields.field_summary(aligned(spark, sf_dir), FIELDS, COUNTERS)


@query(CTE + "SELECT count(*) AS matched_rows, count(*) FILTER (WHERE rf0 IS DISTINCT FROM cf0 OR rf1 IS DISTINCT FROM cf1 OR abs(cv - rv) > 0.01 OR abs(cf3 - rf3) > 9.5 OR rd0 IS DISTINCT FROM cd0 OR rd1 IS DISTINCT FROM cd1 OR rd2 IS DISTINCT FROM cd2) AS any_changed_rows FROM joined WHERE rp AND cp")
def field_overview(spark, sf_dir):
    return fields.field_counters(aligned(spark, sf_dir), FIELDS).select("matched_rows", "any_changed_rows")


@query(
    CTE.rstrip()
    + """, pairs AS (SELECT rf0 AS from_value, cf0 AS to_value, count(*) AS rows FROM joined WHERE rp AND cp AND rf0 IS DISTINCT FROM cf0 GROUP BY 1, 2),
    numbered AS (SELECT *, row_number() OVER (ORDER BY rows DESC, from_value NULLS FIRST, to_value NULLS FIRST) AS place FROM pairs)
    SELECT from_value, to_value, rows, false AS is_other, CAST(place AS INTEGER) AS rank FROM numbered WHERE place <= 5
    UNION ALL SELECT NULL, NULL, CAST(sum(rows) AS BIGINT), true, 6 FROM numbered WHERE place > 5 HAVING count(*) > 0"""
)
def field_transitions(spark, sf_dir):
    return fields.shown_transitions(aligned(spark, sf_dir), 0, shown=5)


# --- filters and checks -------------------------------------------------------------------------------

FILTERS = {
    "filter_equals": ([{"column": "status", "operator": "equals", "value": "O"}], "status = 'O'"),
    "filter_in": ([{"column": "priority", "operator": "in", "value": ["1-URGENT", "2-HIGH"]}], "priority IN ('1-URGENT', '2-HIGH')"),
    "filter_bounds_exact": ([{"column": "amount", "operator": "gt", "value": "100000.005"}, {"column": "amount", "operator": "lte", "value": "250000.10"}], "amount > 100000.005 AND amount <= 250000.10"),
    "filter_date": ([{"column": "order_date", "operator": "gte", "value": "1995-01-01"}, {"column": "order_date", "operator": "lt", "value": "1998-01-01"}], "order_date >= DATE '1995-01-01' AND order_date < DATE '1998-01-01'"),
    "filter_whole_numbers": ([{"column": "customer_id", "operator": "gte", "value": "150.5"}, {"column": "order_id", "operator": "lt", "value": "99999999999999999999"}, {"column": "customer_id", "operator": "lte", "value": 900}], "customer_id >= 150.5 AND customer_id <= 900"),
    "filter_double": ([{"column": "amount_f", "operator": "gt", "value": 100000.5}, {"column": "status", "operator": "in", "value": ["F", "P"]}], "amount_f > CAST(100000.5 AS DOUBLE) AND status IN ('F', 'P')"),
    "filter_nulls": ([{"column": "priority", "operator": "is_null"}, {"column": "note", "operator": "is_not_null"}], "priority IS NULL AND note IS NOT NULL"),
}
SCOPE = "SELECT '{0}' AS side, count(*) AS total_rows, count(*) FILTER (WHERE {1}) AS included_rows, count(*) - count(*) FILTER (WHERE {1}) AS excluded_rows FROM {0}"


def scoped(name: str, filters: list[dict], where: str) -> None:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        condition = populations.scope_condition(filters, KINDS, KINDS)
        r, c = (s.filter(condition) for s in snapshots(spark, sf_dir))
        return alignment.metric_totals(alignment.align(r, c, ["order_id"], [AMOUNT], DIMENSIONS), [AMOUNT], 3)

    narrowed = CTE.replace("FROM reference r FULL OUTER JOIN current c", f"FROM (SELECT * FROM reference WHERE {where}) r FULL OUTER JOIN (SELECT * FROM current WHERE {where}) c")
    query(narrowed + TOTALS_SUM, name)(build)


for _name, _filter in FILTERS.items():
    scoped(_name, *_filter)


@query(CTE + SCOPE.format("reference", FILTERS["filter_bounds_exact"][1]) + " UNION ALL " + SCOPE.format("current", FILTERS["filter_bounds_exact"][1]))
def filter_scope_counts(spark, sf_dir):
    condition = populations.scope_condition(FILTERS["filter_bounds_exact"][0], KINDS, KINDS)
    r, c = (populations.scope_counts(s, condition).select(F.lit(n).alias("side"), "*") for n, s in zip(("reference", "current"), snapshots(spark, sf_dir), strict=True))
    return r.unionByName(c)


DEFECTS = """SELECT nullif(o_orderkey, 0) AS order_id, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
  CASE WHEN o_orderkey % 101 = 0 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END AS amount_f FROM orders"""


@query(f"WITH d AS ({DEFECTS}) SELECT count(*) FILTER (WHERE order_id IS NULL) AS null_key, count(*) FILTER (WHERE amount IS NULL) AS null_metric, count(*) FILTER (WHERE NOT isfinite(amount_f)) AS nonfinite_metric FROM d")
def validate_defects(spark, sf_dir):
    checks = {"null_key": populations.null_key(["order_id"]), "null_metric": F.col("amount").isNull(), "nonfinite_metric": populations.not_finite("amount_f", "DOUBLE")}
    return populations.defect_counts(view(spark, sf_dir, "orders", DEFECTS), checks)


@query("WITH g AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS affected_rows, CAST(coalesce(sum(n), 0) - count(*) AS BIGINT) AS excess_rows FROM g")
def validate_duplicate_keys(spark, sf_dir):
    return populations.duplicate_counts(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1 ORDER BY l_orderkey, l_linenumber LIMIT 100")
def invalid_rows_export(spark, sf_dir):
    rows = populations.duplicate_rows(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])
    return populations.offending(rows, ["l_orderkey", "l_linenumber"], 100)


# --- rules and evidence -------------------------------------------------------------------------------

SEGMENTS = """, memberships AS (
  SELECT rd{0} AS g0, rv AS rt, 0 AS ct, 1 AS rn, 0 AS cn, 0 AS an, CASE WHEN NOT cp OR rd{0} IS DISTINCT FROM cd{0} THEN 1 ELSE 0 END AS mn FROM joined WHERE rp
  UNION ALL SELECT cd{0}, 0, cv, 0, 1, CASE WHEN NOT rp OR rd{0} IS DISTINCT FROM cd{0} THEN 1 ELSE 0 END, 0 FROM joined WHERE cp),
segments AS (SELECT g0, CAST(sum(rt) AS DECIMAL(38,2)) AS reference_total, CAST(sum(ct) AS DECIMAL(38,2)) AS current_total, CAST(sum(rn) AS BIGINT) AS reference_rows,
  CAST(sum(cn) AS BIGINT) AS current_rows, CAST(sum(an) AS BIGINT) AS added_rows, CAST(sum(mn) AS BIGINT) AS removed_rows FROM memberships GROUP BY g0)"""


@query(CTE.rstrip() + SEGMENTS.format(0) + " SELECT * FROM segments")
def segment_membership(spark, sf_dir):
    return rules.segments(aligned(spark, sf_dir), AMOUNT, [0])


@query(CTE.rstrip() + SEGMENTS.format(1) + " SELECT g0, CASE WHEN reference_rows = 0 THEN 'undefined' WHEN CAST(removed_rows AS DECIMAL(38,0)) * 100 > 20 * CAST(reference_rows AS DECIMAL(38,0)) THEN 'failed' ELSE 'passed' END AS status FROM segments")
def segment_rule_eval(spark, sf_dir):
    rule = {"name": "few leave", "metric": "amount", "measure": "removed_percent", "max": 20}
    return rules.judged_segments(rules.segments(aligned(spark, sf_dir), AMOUNT, [1]), rule, 1).select("g0", "status")


@query(CTE.rstrip() + SEGMENTS.format(1) + " SELECT count(*) FILTER (WHERE s = 'passed') AS passed, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'undefined') AS undefined FROM (SELECT CASE WHEN reference_total = 0 THEN 'undefined' WHEN abs(current_total - reference_total) * 100 > 15.5 * abs(reference_total) THEN 'failed' ELSE 'passed' END AS s FROM segments)")
def segment_rule_counts(spark, sf_dir):
    rule = {"name": "steady", "metric": "amount", "measure": "abs_percent_change", "max": "15.5"}
    judged = rules.judged_segments(rules.segments(aligned(spark, sf_dir), AMOUNT, [1]), rule, 1)
    return judged.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "undefined")])


@query(CTE.rstrip() + SEGMENTS.format(2) + " SELECT g0, reference_total, current_total, CASE WHEN abs(current_total - reference_total) > 1234567.895 THEN 'failed' WHEN current_total - reference_total = 0 THEN 'passed' ELSE 'passed' END AS status FROM segments")
def segment_rule_amounts(spark, sf_dir):
    rule = {"name": "small steps", "metric": "amount", "measure": "abs_delta", "max": "1234567.895"}
    return rules.judged_segments(rules.segments(aligned(spark, sf_dir), AMOUNT, [2]), rule, 1).select("g0", "reference_total", "current_total", "status")


@query(CTE.rstrip() + SEGMENTS.format(2) + " SELECT g0, added_rows, CASE WHEN added_rows > 100 THEN 'failed' ELSE 'passed' END AS status FROM segments WHERE g0 IS NULL")
def segment_rule_selected(spark, sf_dir):
    rule = {"name": "few unknown", "metric": "amount", "measure": "added_rows", "max": 100, "group_by": ["priority"], "where": {"priority": None}}
    groups = rules.segments(aligned(spark, sf_dir), AMOUNT, [2]).filter(selector_sql(rule, KINDS))
    return rules.judged_segments(groups, rule, 1).select("g0", "added_rows", "status")


@query(
    CTE.rstrip() + SEGMENTS.format(2) + """, bad AS (SELECT g0 FROM segments WHERE reference_total = 0 OR abs(current_total - reference_total) * 100 > 5 * abs(reference_total))
    SELECT k0, rd2, cd2 FROM joined WHERE rp AND EXISTS (SELECT 1 FROM bad WHERE bad.g0 IS NOT DISTINCT FROM rd2) OR cp AND EXISTS (SELECT 1 FROM bad WHERE bad.g0 IS NOT DISTINCT FROM cd2)"""
)
def rule_evidence_both_sides(spark, sf_dir):
    frame = kept(aligned(spark, sf_dir).select("rp", "cp", "k0", "rv0", "cv0", "rd2", "cd2"))
    rule = {"name": "steady", "metric": "amount", "measure": "abs_percent_change", "max": 5}
    return rules.segment_evidence(frame, rule, AMOUNT, [2]).select("k0", "rd2", "cd2")


EVIDENCE_ORDER = "abs(contribution) DESC, k0"
EVIDENCE = {
    "added": "NOT rp",
    "removed": "NOT cp",
    "changed": "rp AND cp AND rv IS DISTINCT FROM cv",
    "moved": "rp AND cp AND (rd0 IS DISTINCT FROM cd0 OR rd1 IS DISTINCT FROM cd1 OR rd2 IS DISTINCT FROM cd2)",
    "field_changed": "rp AND cp AND (rf0 IS DISTINCT FROM cf0 OR rf1 IS DISTINCT FROM cf1 OR abs(cv - rv) > 0.01 OR abs(cf3 - rf3) > 9.5 OR rd0 IS DISTINCT FROM cd0 OR rd1 IS DISTINCT FROM cd1 OR rd2 IS DISTINCT FROM cd2)",
    "largest_changes": "coalesce(CASE WHEN cp THEN cv END, 0) IS DISTINCT FROM coalesce(CASE WHEN rp THEN rv END, 0)",
    "all": "true",
}


def evidence(kind: str) -> None:
    limit = 100 if kind == "largest_changes" else None

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = rules.focused(aligned(spark, sf_dir), kind, AMOUNT, 1, 3, FIELDS, limit)
        return rows.select("k0", F.coalesce("rp", F.lit(False)).alias("rp"), F.coalesce("cp", F.lit(False)).alias("cp"), F.col("rv0").cast(MONEY).alias("rv"), F.col("cv0").cast(MONEY).alias("cv"), money("contribution"))

    rows = f"SELECT k0, rp, cp, CAST(rv AS DECIMAL(38,2)) AS rv, CAST(cv AS DECIMAL(38,2)) AS cv, CAST(coalesce(cv, 0) - coalesce(rv, 0) AS DECIMAL(38,2)) AS contribution FROM joined WHERE {EVIDENCE[kind]}"
    query(CTE + (f"SELECT * FROM ({rows}) ORDER BY {EVIDENCE_ORDER} LIMIT {limit}" if limit else rows), "evidence_all" if kind == "all" else f"evidence_{kind}")(build)


for _name in EVIDENCE:
    evidence(_name)


@query(CTE + "SELECT k0, CAST(rv AS DECIMAL(38,2)) AS rv0, CAST(cv AS DECIMAL(38,2)) AS cv0 FROM joined WHERE NOT cp ORDER BY k0 LIMIT 100")
def rule_evidence_overall(spark, sf_dir):
    rows = rules.overall_evidence(aligned(spark, sf_dir), "removed_rows")
    return rules.limited(rows, 1, 100).select("k0", money("rv0"), money("cv0"))


@query(CTE + "SELECT k0, rd2, cd2 FROM joined WHERE rp AND cp AND rd2 IS NOT NULL AND cd2 IS NULL ORDER BY k0 LIMIT 100")
def rule_evidence_field(spark, sf_dir):
    rows = rules.field_evidence(aligned(spark, sf_dir), FIELDS, 4, "became_null")
    return rules.limited(rows, 1, 100).select("k0", "rd2", "cd2")


@query(
    CTE.rstrip() + SEGMENTS.format(1) + """, bad AS (SELECT g0 FROM segments WHERE reference_rows = 0 OR CAST(removed_rows AS DECIMAL(38,0)) * 100 > 20 * CAST(reference_rows AS DECIMAL(38,0)))
    SELECT k0, rd1, cd1 FROM joined WHERE rp AND (NOT cp OR rd1 IS DISTINCT FROM cd1) AND EXISTS (SELECT 1 FROM bad WHERE bad.g0 IS NOT DISTINCT FROM rd1)"""
)
def rule_evidence_segment(spark, sf_dir):
    # both steps read the aligned rows of this one join
    frame = kept(aligned(spark, sf_dir).select("rp", "cp", "k0", "rv0", "cv0", "rd1", "cd1"))
    rule = {"name": "few leave", "metric": "amount", "measure": "removed_percent", "max": 20}
    return rules.segment_evidence(frame, rule, AMOUNT, [1]).select("k0", "rd1", "cd1")


# --- sources and life cycle ---------------------------------------------------------------------------


def scratch(spark: SparkSession) -> Path:
    """A new folder for derived inputs below the shared one, gone when the driver ends; snapshots are files on mounted paths."""
    shared = shared_folder(spark)
    if "://" in shared.removeprefix("file://"):
        raise RuntimeError("these queries need spark.checkpoint.dir on a mounted path, as snapshots are local files")
    folder = Path("/" + shared.removeprefix("file:").lstrip("/"), f"snapshot-{uuid.uuid4().hex}")
    folder.mkdir(parents=True, exist_ok=True)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@query("SELECT o_orderkey AS order_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day, o_orderkey % 2 = 0 AS even FROM orders")
def source_csv_typed(spark, sf_dir):
    rows = view(spark, sf_dir, "orders", "SELECT o_orderkey AS order_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS amount, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS even FROM orders")
    path = scratch(spark) / "rows"
    rows.write.csv(str(path), header=True, sep=";")
    return read_snapshot(spark, str(path), {"delimiter": ";", "header": True, "types": {"order_id": "BIGINT", "amount": "DECIMAL(18,2)"}}).rows


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS status FROM orders")
def source_csv_sniffed(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS order_id", "o_custkey AS customer_id", "o_orderstatus AS status")
    path = scratch(spark) / "rows"
    rows.write.csv(str(path), header=True, sep="|")
    found = read_snapshot(spark, str(path)).rows
    return found.select(F.col("order_id").cast("long"), F.col("customer_id").cast("long"), "status")


REMARK = "concat('say \"', o_orderpriority, '\"; ', o_orderstatus, CASE WHEN o_orderkey % 50 = 0 THEN {line} ELSE '' END)"


@query(f"SELECT o_orderkey AS order_id, {REMARK.format(line='chr(10)')} AS remark FROM orders")
def source_csv_quoted(spark, sf_dir):
    """Quotes, delimiters and line ends inside values; the dialect is found in all bytes."""
    path = scratch(spark) / "rows"
    rows = view(spark, sf_dir, "orders", f"SELECT o_orderkey AS order_id, {REMARK.format(line='chr(10)')} AS remark FROM orders")
    rows.write.csv(str(path), header=True, sep=";", escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return read_snapshot(spark, str(path)).rows


CLOCK = "concat(lpad(CAST(o_orderkey % 24 AS {text}), 2, '0'), ':', lpad(CAST(o_orderkey % 60 AS {text}), 2, '0'), ':05')"


@query(f"SELECT clock, count(*) AS orders, count(DISTINCT o_orderstatus) AS statuses FROM (SELECT *, {CLOCK.format(text='VARCHAR')} AS clock FROM orders) GROUP BY clock")
def source_csv_time(spark, sf_dir):
    """Times of day are found in a CSV file, and group as such."""
    path = scratch(spark) / "rows"
    view(spark, sf_dir, "orders", f"SELECT o_orderkey AS order_id, o_orderstatus AS status, {CLOCK.format(text='STRING')} AS clock FROM orders").write.csv(str(path), header=True)
    found = read_snapshot(spark, str(path))
    if found.schema["clock"] != "TIME":
        raise CompareError("the column of times was read as another type")
    return found.rows.groupBy("clock").agg(F.count("*").alias("orders"), F.countDistinct("status").alias("statuses")).select(F.col("clock").cast("string").alias("clock"), "orders", "statuses")


def write_folders(rows: DataFrame, column: str, folder: Path) -> None:
    """A folder of Parquet files for each value of a column of few values, whose writers stay open side by side, so no task sorts its rows."""
    conf, writers = rows.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(writers)
    conf.set(writers, "8")
    try:
        rows.write.partitionBy(column).parquet(str(folder))
    finally:
        conf.set(writers, before)


@query("SELECT l_orderkey, l_linenumber, l_returnflag AS flag FROM lineitem")
def source_stored_folders(spark, sf_dir):
    """Folder values that the files store too, compared on every row in the pass that counts rows."""
    folder = scratch(spark) / "rows"
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "l_returnflag AS flag", "l_returnflag AS part")
    write_folders(rows, "part", folder)
    for p in folder.glob("part=*"):
        p.rename(folder / p.name.replace("part=", "flag="))
    return read_snapshot(spark, str(folder)).rows.select("l_orderkey", "l_linenumber", "flag")


@query("SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_returnflag AS flag FROM lineitem")
def source_hive_folders(spark, sf_dir):
    folder = scratch(spark)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS quantity", "l_returnflag AS flag")
    folder = folder / "rows"
    write_folders(rows, "flag", folder)
    return read_snapshot(spark, str(folder)).rows.select("l_orderkey", "l_linenumber", "quantity", "flag")


@query("SELECT o_custkey AS order_id, o_orderkey AS customer_id, o_orderstatus AS status FROM orders")
def source_renamed(spark, sf_dir):
    return read_snapshot(spark, f"{sf_dir}/orders.parquet", mapping={"o_orderkey": "customer_id", "o_custkey": "order_id", "o_orderstatus": "status"}).rows.select("order_id", "customer_id", "status")


@query("SELECT CAST(0 AS BIGINT) AS file, count(*) AS rows FROM orders UNION ALL SELECT 1, count(*) FROM orders")
def source_file_counts(spark, sf_dir):
    profile = read_snapshot(spark, [f"{sf_dir}/orders.parquet", f"{sf_dir}/orders.parquet"]).profile
    return spark.createDataFrame([(i, f["rows"]) for i, f in enumerate(profile["files"])], "file long, rows long")


def settings(folder: Path, **more: object) -> Path:
    """A configuration of the orders pair, which stands as Parquet files in ``folder``."""
    base = {"mode": "snapshots", "reference": "reference", "current": "current", "key": ["order_id"], "metric": {"name": "amount", "aggregate": "sum", "column": "amount", "null_policy": "error"}}
    (folder / "settings.yaml").write_text(json.dumps(base | more))
    return folder / "settings.yaml"


def pair_files(spark: SparkSession, sf_dir: str) -> Path:
    folder = scratch(spark)
    for name, rows in zip(("reference", "current"), snapshots(spark, sf_dir), strict=True):
        rows.select("order_id", "amount", "amount_f", "status", "priority", "note").write.parquet(str(folder / name))
    return folder


@query(CTE + "SELECT count(*) FILTER (WHERE NOT rp) AS added_rows, count(*) FILTER (WHERE NOT cp) AS removed_rows, count(*) FILTER (WHERE rp AND cp) AS matched_rows, CAST(sum(rv) AS DECIMAL(38,2)) AS reference_total, CAST(sum(cv) AS DECIMAL(38,2)) AS current_total FROM joined")
def investigation_run(spark, sf_dir):
    folder = pair_files(spark, sf_dir)
    found = investigate(spark, settings(folder, dimensions=["status"]), folder / "out")["summary"]
    names = ("added_rows", "removed_rows", "matched_rows", "reference_total", "current_total")
    return spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} {'long' if n.endswith('rows') else 'decimal(38,2)'}" for n in names))


@query(CTE + "SELECT 'removed_percent' AS measure, CASE WHEN 100 * count(*) FILTER (WHERE NOT cp) > 20 * count(*) FILTER (WHERE rp) THEN 'failed' ELSE 'passed' END AS status FROM joined UNION ALL SELECT 'delta', CASE WHEN sum(cv) - sum(rv) > 1 THEN 'failed' ELSE 'passed' END FROM joined")
def investigation_rules(spark, sf_dir):
    folder = pair_files(spark, sf_dir)
    listed = [{"name": "few go", "metric": "amount", "measure": "removed_percent", "max": 20}, {"name": "level", "metric": "amount", "measure": "delta", "max": 1}]
    found = investigate(spark, settings(folder, rules=listed), folder / "out")["rule_checks"]["results"]
    return spark.createDataFrame([(r["measure"], r["status"]) for r in found], "measure string, status string")


@query("SELECT count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS null_key FROM orders WHERE o_orderkey % 10 <> 7")
def validation_run(spark, sf_dir):
    folder = pair_files(spark, sf_dir)
    found = validate(spark, settings(folder, key=["order_id", "priority"]), folder / "out")["checks"]
    counts = [c["details"]["affected_rows"] for c in found if (c["side"], c["check"]) == ("reference", "null_key")]
    return spark.createDataFrame([(n,) for n in counts], "null_key long")


@query(CTE + "SELECT 'note' AS field, 'percent_changed' AS measure, count(*) FILTER (WHERE rf0 IS DISTINCT FROM cf0) AS numerator, count(*) AS denominator, CASE WHEN 100 * count(*) FILTER (WHERE rf0 IS DISTINCT FROM cf0) > 30 * count(*) THEN 'failed' ELSE 'passed' END AS status FROM joined WHERE rp AND cp UNION ALL SELECT 'priority', 'became_null', count(*) FILTER (WHERE rd2 IS NOT NULL AND cd2 IS NULL), count(*), CASE WHEN count(*) FILTER (WHERE rd2 IS NOT NULL AND cd2 IS NULL) > 5 THEN 'failed' ELSE 'passed' END FROM joined WHERE rp AND cp")
def investigation_field_rules(spark, sf_dir):
    folder = pair_files(spark, sf_dir)
    listed = [{"name": "notes", "field": "note", "measure": "percent_changed", "max": 30}, {"name": "kept", "field": "priority", "measure": "became_null", "max": 5}]
    found = investigate(spark, settings(folder, compare_fields=["note", "priority"], rules=listed), folder / "out")["rule_checks"]["results"]
    return spark.createDataFrame([(r["field"], r["measure"], r["numerator"], r["denominator"], r["status"]) for r in found], "field string, measure string, numerator long, denominator long, status string")


@query("SELECT * FROM (VALUES ('reference', 'amount', 'failed', 'type_mismatch'), ('current', 'amount', 'failed', 'type_mismatch'), ('reference', 'gone', 'failed', 'missing_column'), ('current', 'gone', 'failed', 'missing_column'), ('reference', 'order_id', 'passed', NULL), ('current', 'order_id', 'passed', NULL)) t(side, name, status, issue)")
def investigation_contract(spark, sf_dir):
    folder = pair_files(spark, sf_dir)
    contract = {"columns": {"amount": "decimal(9,2)", "gone": None, "order_id": "bigint"}}
    found = investigate(spark, settings(folder, schema=contract), folder / "out")["schema_checks"]["results"]
    return spark.createDataFrame([(r["side"], r["column"], r["status"], r["issue"]) for r in found], "side string, name string, status string, issue string")


@query(CTE + "SELECT k0, CAST(coalesce(cv, 0) - coalesce(rv, 0) AS DECIMAL(38,2)) AS contribution FROM joined WHERE NOT rp ORDER BY abs(contribution) DESC, k0")
def export_added(spark, sf_dir):
    """An export of all added rows, read back from the file that tasks wrote in parts."""
    folder = pair_files(spark, sf_dir)
    investigate(spark, settings(folder, report={"evidence_exports": [{"kind": "added"}]}), folder / "out")
    rows = read_snapshot(spark, str(folder / "out" / "added.csv"), {"types": {"k0": "BIGINT", "contribution": "DECIMAL(38,2)"}}).rows
    return rows.select("k0", "contribution")


@query(CTE + "SELECT count(*) FILTER (WHERE NOT rp) AS added_rows, count(*) FILTER (WHERE NOT cp) AS removed_rows, count(*) FILTER (WHERE rp AND cp AND rd0 IS DISTINCT FROM cd0) AS moved_rows, CAST(sum(rv) AS DECIMAL(38,2)) AS reference_total, CAST(sum(cv) AS DECIMAL(38,2)) AS current_total FROM (SELECT * REPLACE (coalesce(rv > 50000, false) AS rp, coalesce(cv > 50000, false) AS cp, CASE WHEN rv > 50000 THEN rv END AS rv, CASE WHEN cv > 50000 THEN cv END AS cv) FROM joined) WHERE rp OR cp")
def investigation_replay(spark, sf_dir):
    """The statements of a filtered run, executed in a fresh session."""
    folder = pair_files(spark, sf_dir)
    investigate(spark, settings(folder, dimensions=["status"], filters=[{"column": "amount", "operator": "gt", "value": 50000}]), folder / "out")
    fresh = spark.newSession()
    for statement in (folder / "out" / "analysis.sql").read_text().rstrip().rstrip(";").split(";\n\n"):
        fresh.sql("\n".join(x for x in statement.splitlines() if not x.startswith("--")))
    row = fresh.sql("SELECT t.added_rows, t.removed_rows, m.rows AS moved_rows, t.reference_total, t.current_total FROM reconciliation t, reclassification_0 m").first()
    return spark.createDataFrame([tuple(row)], "added_rows long, removed_rows long, moved_rows long, reference_total decimal(38,2), current_total decimal(38,2)")


@query("SELECT side, name, CASE WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status, n AS affected_rows FROM (SELECT 'reference' AS side, 'null_key' AS name, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS n FROM orders WHERE o_orderkey % 10 <> 7 UNION ALL SELECT 'current', 'null_key', count(*) FILTER (WHERE o_orderpriority = '5-LOW' OR o_orderkey % 13 = 0) FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT s, c, 0 FROM (VALUES ('reference'), ('current')) a(s), (VALUES ('null_metric'), ('nonfinite_metric'), ('duplicate_key')) b(c))")
def validation_checks(spark, sf_dir):
    folder = pair_files(spark, sf_dir)
    found = validate(spark, settings(folder, key=["order_id", "priority"]), folder / "out")["checks"]
    rows = [(c["side"], c["check"], c["status"], c["details"]["affected_rows"]) for c in found if isinstance(c["details"], dict) and "affected_rows" in c["details"]]
    return spark.createDataFrame(rows, "side string, name string, status string, affected_rows long")
