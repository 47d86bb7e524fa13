import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybridge.llm import fim

SF = "/root/testdata/sf0.001"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, fim_percent=50, spm_percent=80):
    text = text or ""
    units = UNITS.findall(text)
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return n, "plain", text, None, None, None
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_percent:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", p, m, s
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", p, m, s


def check(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = fim.fill_in_middle(df, **kwargs)
    want = sorted(((i, *brute(i, t, **kwargs)) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.n, r.form, r.output, r.prefix, r.middle, r.suffix) for r in made.collect()), key=repr) == want
    back = made.select("doc_id", fim.restored(made.output, made.form).alias("text"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)


def test_against_brute_force(spark):
    texts = [
        None, "", " ", "\n\n", "one", " one two\tthree  ", "a<P>b", "<S>", "x <M> y", "<P", "P> S> <<S >", "a\x01b \x02 \x02e\x02d \x01\x01 c", "é ü ß 日本 \U0001f600 x", " a b\u0085c", "\x0b\x0c\x1fz",
        "word " * 30_000, "y" * 200_000, " " * 100_000, "$0 \\1 $& \\", "<" * 9 + "S" + ">",
    ]
    rows = [(i * 100 + k, t) for i, t in enumerate(texts) for k in range(6)]
    check(spark, [*rows, (None, "no id here"), (None, None), (7, "same row"), (7, "same row"), (7, "other row")])
    check(spark, rows, fim_percent=100, spm_percent=30)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab <>PSM\x01\x02ed\né\U0001f600", max_size=40), min_size=1, max_size=30))
def test_any_text(spark, texts):
    check(spark, list(enumerate(texts)), fim_percent=100)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(fim.SQL)
    got = fim.digests(fim.fill_in_middle(spark.read.parquet(f"{SF}/documents.parquet")))
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and {r[2] for r in rows} == {"plain", "spm", "psm"}


def test_stays_in_the_jvm_with_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 5)], "doc_id long, text string, output string, n int")
    made = fim.digests(fim.fill_in_middle(df))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert made.count() == 1 and fim.digests(fim.fill_in_middle(df.filter("false"))).collect() == []


@pytest.mark.parametrize("column", ["text", "body"])
def test_other_names(spark, column):
    df = spark.createDataFrame([(3, "a b c d e f")], f"`the id` long, {column} string")
    got = fim.fill_in_middle(df, 100, id_col="the id", text_col=column).collect()[0]
    assert (got.n, got.form, got.output) == brute(3, "a b c d e f", 100)[:3]
