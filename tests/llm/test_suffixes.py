import hashlib
import random

import numpy as np

from tallybridge.llm import suffixes


def brute(rows):
    seen, out = set(), {}
    for doc, text in sorted({(suffixes.NO_ID if d is None else d, t or "") for d, t in rows}):
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - 99):
            s = raw[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        out[doc] = (len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_multikey_order_of_long_runs():
    rnd = np.random.default_rng(4)
    columns = [np.sort(rnd.integers(-5, 5, 4000)), np.zeros(4000, np.int64), rnd.integers(-(1 << 62), 1 << 62, 4000)]
    assert np.array_equal(suffixes.multikey_order(columns), np.lexsort(columns[::-1]))


def check(spark, df, **more):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows)
    got = suffixes.digests(suffixes.remove_repeats(df, **more)).collect()
    assert len(got) == len(rows)
    bad = [(r, want[suffixes.NO_ID if r.doc_id is None else r.doc_id]) for r in got if tuple(r)[1:] != want[suffixes.NO_ID if r.doc_id is None else r.doc_id]]
    assert not bad, bad[:3]
    return got


def test_documents(spark):
    got = check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    assert sum(r.n_removed for r in got) > 10_000


def test_odd_rows(spark):
    rnd = random.Random(6)
    draw = lambda n, signs="abcdefgh é": "".join(rnd.choice(signs) for _ in range(n))
    passage, copy = draw(400), draw(900)
    rows = [(1, None), (2, ""), (3, "a" * 99), (4, "a" * 350), (5, "a" * 100), (6, "ab" * 300), (7, draw(50)), (None, copy), (8, copy), (9, copy), (9, copy), (10, copy[:99]), (11, copy[1:101]), (12, "é" * 130)]
    for i in range(120):
        w = list(copy)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = "Z"
        a, b = sorted(rnd.sample(range(401), 2))
        rows.append((100 + i, rnd.choice(["".join(w), draw(rnd.randrange(300)) + passage + draw(rnd.randrange(300)), draw(80) + passage[a:b] + draw(60)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "'x' as own")
    check(spark, df)
    check(spark, df, bucket_rows=40)  # many buckets: tokens lie on splitters
    check(spark, df, compared_rows=3)  # contexts too large for a task
    assert suffixes.remove_repeats(df.filter("false")).count() == 0


def test_rows_without_id_are_documents_of_their_own(spark):
    rnd = random.Random(11)
    draw = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, others = draw(300), [draw(400), draw(400)]
    rows = [(1, passage), (None, others[0] + passage), (None, passage + others[1]), (None, others[0][:90])]
    got = {(r.n_bytes, r.n_removed, r.kept_sha256) for r in suffixes.digests(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect() if r.doc_id is None}
    whole = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(700, 300, whole(others[0])), (700, 300, whole(others[1])), (90, 0, whole(others[0][:90]))}


def test_strings_of_one_hash_are_told_apart(spark, monkeypatch):
    import pyarrow as pa

    rnd = random.Random(12)
    a, b = ("".join(rnd.choice("abc") for _ in range(100)).encode() for _ in range(2))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 0, 0]), pa.array([0, 0, 0], pa.int32()), pa.array([0, 0, 0], pa.int32()), pa.array([a, b, a], pa.binary())], ["doc", "at", "back", "low", "bytes"])
    monkeypatch.setattr(suffixes.RangeHash, "__call__", lambda self, starts, ends: np.zeros(len(starts), np.uint64))
    assert [r for x in suffixes.comparing(iter([batch])) for r in x.to_pylist()] == [{"doc": 3, "start": 0, "stop": 100}]


def test_long_text_in_stretches(spark):
    rnd = random.Random(8)
    rows = [(1, "".join(rnd.choice("abc ") for _ in range(9000))), (2, "x" * 700), (3, "")]
    rows.append((4, rows[0][1][1000:5000] + "y" + rows[0][1][2000:2500]))
    old = suffixes.STRETCH
    try:
        suffixes.STRETCH = 512
        check(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    finally:
        suffixes.STRETCH = old


def test_multikey_order():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 2, 500):
        columns = [rnd.integers(0, 4, n) for _ in range(4)]
        assert np.array_equal(np.stack(columns)[:, suffixes.multikey_order(columns)], np.stack(columns)[:, np.lexsort(columns[::-1])])


def test_one_byte_is_dealt_to_many_buckets(spark):
    """A long run of one byte has one leading token; its place is part of the key, so no task holds it whole."""
    df = spark.createDataFrame([(1, "x" * 60_000), (2, "y" + "x" * 5000)], "doc_id long, text string")
    rows = suffixes.digests(suffixes.remove_repeats(df, bucket_rows=100)).orderBy("doc_id").collect()
    # all but the first hundred bytes repeat; of the second text all x, but not the y before them
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in rows] == [(60_000, 59_999, 1), (5001, 5000, 1)]
    texts = df.selectExpr("doc_id", "cast(text as binary) as text")
    dealt = texts.mapInArrow(suffixes.dealing, suffixes.SUFFIX).repartitionByRange(40, "a", "b", "c", "doc", "place")
    sizes = [r["count"] for r in dealt.selectExpr("spark_partition_id() as p").groupBy("p").count().collect()]
    assert len(sizes) > 10 and max(sizes) < sum(sizes) / 5
