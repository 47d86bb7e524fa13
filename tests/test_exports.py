"""Exported files: exact cells, whole order, no rows on the driver."""

import csv

from tallybridge.plans import bundle


def test_cells(spark, tmp_path):
    rows = [(1, None, "a,b", True), (2, "", 'say "x"', False), (3, " edge ", "line\nend", None), (4, "é日", "cr\rin", True), (5, "'", ";|\t", None)]
    df = spark.createDataFrame(rows, "id int, a string, `b c` string, ok boolean")
    assert bundle.write_csv(df.orderBy("id"), tmp_path / "x.csv") == 5
    lines = list(csv.reader((tmp_path / "x.csv").open(newline="")))
    cell = lambda v: "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
    assert lines == [["id", "a", "b c", "ok"], *[[cell(v) for v in r] for r in rows]]
    assert b'\n1,,"a,b",true\n2,"",' in (tmp_path / "x.csv").read_bytes() and [p.name for p in tmp_path.iterdir()] == ["x.csv"]
    assert bundle.write_csv(df.select("a").orderBy("id").limit(2), tmp_path / "y.csv") == 2
    assert len(list(csv.reader((tmp_path / "y.csv").open(newline="")))) == 3
    assert bundle.write_csv(df.filter("false"), tmp_path / "z.csv") == 0 and (tmp_path / "z.csv").read_text() == "id,a,b c,ok\n"


def test_many_parts_in_one_order(spark, tmp_path):
    df = spark.range(60_000).selectExpr("id", "(id * 7919) % 60000 as place", "concat('row ', id) as note").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert bundle.write_csv(df.orderBy("place"), tmp_path / "x.csv") == 60_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    places = [int(r[1]) for r in list(csv.reader((tmp_path / "x.csv").open(newline="")))[1:]]
    assert places == list(range(60_000))
