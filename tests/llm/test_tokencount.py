import numpy as np
import public_tokenizers as P
import tiktoken

from tallybridge.llm import tokencount as tc

RANKS = P.path("byte_bpe_50k.tiktoken")


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    df = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (None, "x y"), (-3, "word " * 9000), (-4, "a"), (-4, "a")], "doc_id long, text string")).selectExpr("*", "1 as file")
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tc.read_ranks(RANKS), special_tokens={})
    want = sorted(((r.doc_id, len(coder.encode_ordinary(r.text or ""))) for r in df.collect()), key=str)
    for size in (50, 1000, tc.BLOCK_TOKENS):
        got = tc.count_documents(tc.token_stream(df, RANKS, P.PATTERN, 50256, block_tokens=size), 50256)
        assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == want
    assert tc.count_documents(tc.token_stream(df.filter("false"), RANKS, P.PATTERN, 50256), 50256).count() == 0


def test_files(spark, tmp_path):
    rnd = np.random.default_rng(5)
    want = []
    old = tc.GROUP_BLOCKS
    for name in ("a.bin", "b.bin", "empty.bin", "none.bin", "only.bin"):
        ids = {"empty.bin": np.zeros(0, int), "none.bin": np.full(777, 3), "only.bin": np.full(9, 7)}.get(name, rnd.integers(0, 40, 5000))
        ids.astype("<u2").tofile(tmp_path / name)
        cuts = np.flatnonzero(ids == 7)
        lengths = np.diff(np.concatenate([[-1], cuts])) - 1
        want += [(name, i, int(n), True) for i, n in enumerate(lengths)]
        rest = len(ids) - (cuts[-1] + 1 if len(cuts) else 0)
        if rest:
            want.append((name, len(cuts), int(rest), False))
    try:
        tc.GROUP_BLOCKS = 5
        for size in (1, 16, 333, 10_000):
            got = tc.count_documents(tc.read_token_files(spark, str(tmp_path), size), 7).collect()
            assert sorted((r.file.rsplit("/", 1)[1], r.ordinal, r.n_tokens, r.closed) for r in got) == sorted(want)
    finally:
        tc.GROUP_BLOCKS = old


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    ids = np.random.default_rng(6).integers(0, 50, 60_000)
    folder = tmp_path / "a folder"
    folder.mkdir()
    ids.astype("<u2").tofile(folder / "x.bin")
    blocks = tc.read_token_files(spark, str(folder), 1000)
    tasks = {r[0] for r in blocks.selectExpr("spark_partition_id()").collect()}
    assert len(tasks) > 1
    rows = blocks.orderBy("block").collect()
    assert b"".join(bytes(r.tokens) for r in rows) == ids.astype("<u2").tobytes()
    assert "content" not in blocks._jdf.queryExecution().executedPlan().toString()
