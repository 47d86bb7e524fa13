import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tallybridge.llm import spelling


def brute_words(rows, least_length=5, least_count=3):
    words = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= least_length and n >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words):
    buckets = defaultdict(list)
    for w in words:
        buckets[len(w)].append(w)
    near = {w: [u for d in (-1, 0, 1) for u in buckets[len(w) + d] if one_edit(w, u)] for w in words}
    form = {}
    for w, us in near.items():
        if us:
            best = min(us, key=lambda u: (-words[u], u))
            if words[best] >= 2 * words[w]:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = spelling.report(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_groups(brute_words(rows))
    assert sorted(map(tuple, got.collect())) == want and any(r[1] for r in want) and len(want) > 1000
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    sql = con.sql(spelling.SQL)
    assert sorted(sql.fetchall()) == want and sql.columns == got.columns


def test_odd_texts(spark):
    rows = [(None, "NAÏVE naïve Naïve naive naive naive"), (None, None), (1, ""), (1, "Ünder ünder"), (2, "x" * 3000 + " " + "x" * 3000), (3, "x" * 3000), (4, "x" * 2999 + "y"), (5, ("x" * 2999 + "y ") * 8), (6, "abcde1abcde_abcde abcdé×÷ " * 4)] * 2
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert sorted(map(tuple, spelling.report(df).collect())) == brute_groups(brute_words(rows))
    empty = df.filter("false")
    assert spelling.report(empty).collect() == []


def test_chains_ties_and_roots(spark):
    # each word twice as frequent as the one before: a chain of eleven links; two equally frequent near words
    chain = {"aaaaaaaaaaaa"[:i] + "bbbbbbbbbbbb"[i:]: 3 * 2**i for i in range(12)}
    words = {**chain, "zebra": 3, "zebrb": 9, "zebrc": 9, "zzzzz": 4, "zzzz": 8, "zzzzzz": 9}
    got = spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long"))
    rows = sorted(map(tuple, got.collect()))
    assert rows == brute_groups(words)
    by_word = {r[0]: r for r in rows}
    assert by_word["bbbbbbbbbbbb"][2] == "aaaaaaaaaaab" and by_word["zebra"][1] == "zebrb"
    with pytest.raises(ValueError):
        spelling.variant_groups(got.select("word", "n"), factor=1)


def test_neighbourhood_is_whole_and_distinct():
    """With a filter that lets all pass, a word emits each of its neighbours exactly once."""
    alphabet = "abé"
    codes = np.array(sorted(map(ord, alphabet)), np.uint32)
    rnd = random.Random(4)
    words = ["", "a", "aa", "aba", "bbbb"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 9))) for _ in range(40)]
    full = np.full(spelling.filter_words(1), 2**64 - 1, np.uint64)
    made = defaultdict(list)
    for rows, candidates in spelling.neighbours([w for w in words if w], codes, full):
        for i, c in zip(rows.tolist(), candidates, strict=True):
            made[i].append(c)
    for i, w in enumerate(w for w in words if w):
        want = {w[:k] + w[k + 1 :] for k in range(len(w))}
        want |= {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in alphabet} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in alphabet}
        assert sorted(made[i]) == sorted(want - {w})


def test_filter_loses_no_word(spark, monkeypatch):
    """Every near word passes the filter, however small and full that is."""
    rnd = random.Random(9)
    words = {w: rnd.randrange(3, 50) for w in {"".join(rnd.choice("abc") for _ in range(rnd.randrange(5, 8))) for _ in range(1500)}}
    monkeypatch.setattr(spelling, "PASS_CANDIDATES", 64)
    monkeypatch.setattr(spelling, "FILTER_BITS", 1 << 10)
    monkeypatch.setattr(spelling, "BLOCK_BITS", 1 << 8)
    got = spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert sorted(map(tuple, got.collect())) == brute_groups(words)
