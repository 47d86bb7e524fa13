import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallybridge.llm.bpe import bpe_encode, digests

PATH = public_tokenizers.path("word_bpe_49k.json")

TEXTS = [
    None, "", "   \n", "Hello, World! it's we'll 'tis  don't 12345", "ÉÀ naïve Café ΟΔΥΣΣΕΥΣ İstanbul ẞ",
    "<|endoftext|>x<|startoftext|> <|endoftext", "日本語テキスト 한국어 🙂🙂👩‍👩‍👧 ñ", "a" * 3000, "ab" * 700 + " " + "!?" * 500,
    "tab\tvt\x0bfs\x1cgs\x1dnel\x85nbsp\xa0zw​ x", "x²½Ⅷ٣", "0" * 70, "the the the of",
]


def test_matches_the_library(spark):
    rnd = random.Random(5)
    rows = list(enumerate(TEXTS)) + [(1, "the the the of"), (None, "null id")]
    for i in range(300):
        rows.append((1000 + i, "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x250), rnd.randrange(0x370, 0x3100)])) for _ in range(rnd.randrange(60)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' as ids", "1 as decoded")
    lib = Tokenizer.from_file(PATH)
    got = sorted(map(tuple, digests(bpe_encode(df, PATH)).collect()), key=str)
    want = []
    for doc, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((doc, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    bad = [(g, w) for g, w in zip(got, sorted(want, key=str)) if g != w]
    assert not bad, bad[:5]


def test_empty_table(spark):
    assert bpe_encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_documents(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    lib = Tokenizer.from_file(PATH)
    got = {r.doc_id: r for r in bpe_encode(docs, PATH).collect()}
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(got[r.doc_id].ids) == struct.pack(f"<{len(ids)}I", *ids)
        assert got[r.doc_id].decoded == lib.decode(ids, skip_special_tokens=False)
