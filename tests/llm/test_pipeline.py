import corpus_pipeline
from tallybridge.llm import decontaminate, secrets


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, "en", "s", 0), (900002, "12 34", None, "s", 5), (900003, "ein Haus und der Garten token = abcdef123456", None, None, None)], docs.schema)
    docs = docs.unionByName(odd)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "bpe":
            assert out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert {900001, 900002} & set(kept["language_id"]) == set() and len(kept["language_id"]) == 201
    assert kept["language_id"][900003].lang is not None
    assert 100 < len(kept["near_duplicates"]) < 201
    bench = [decontaminate.words_of(r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in kept["near_duplicates"].values():
        words = decontaminate.words_of(r.text.encode())
        leaked = any(decontaminate.best_match(p, words)[0] <= int(0.2 * len(p)) for p in bench)
        assert (r.doc_id in kept["decontamination"]) == (not leaked)
    assert set(kept["secret_scan"]) == set(kept["decontamination"]) == set(kept["bpe"])
    for r in kept["secret_scan"].values():
        assert not [s for s in secrets.base_spans(r.text.encode()) if s[2] != "assign"]
        before = kept["decontamination"][r.doc_id]
        assert (r.text == before.text) or ("[secret]" in r.text and r.n_chars == len(r.text))
    assert "[secret]" in kept["secret_scan"][900003].text


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert 50 < got.count() <= 200 and "ids_sha256" in got.columns


def test_stages_on_odd_tables(spark):
    """Very long and repeated texts, clashing extra columns, rows without ids, and an empty table."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    long = "The quick brown fox and the lazy dog went over the hill to see " + " ".join(f"w{i}x" for i in range(60_000))
    odd = spark.createDataFrame([(800001, long, None, "s", None), (800002, None, None, None, None), (None, "no id but some words here", "en", "s", 3), (800003, "same text twice over and over again", "en", "s", 1), (800003, "same text twice over and over again", "en", "s", 1)], docs.schema)
    wide = docs.unionByName(odd).selectExpr("*", "'x' as hash", "1 as key", "'y' as words", "2.5 as label", "'z' as spans")
    for table in (wide, wide.filter("false")):
        rows = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            if name != "bpe":
                assert out.dtypes == table.dtypes, name
            rows = spark.createDataFrame(out.collect(), out.schema)
            if table is wide and name != "bpe":
                by_id = {r.doc_id: r for r in rows.collect()}
                assert 800002 not in by_id and {800001, 800003, None} <= set(by_id) and by_id[800001].hash == "x" and len(by_id[800001].text) == len(long)
                assert name == "language_id" or rows.filter("doc_id = 800003").count() == 1
        assert (rows.count() > 30) == (table is wide)
