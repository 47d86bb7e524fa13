import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallybridge.llm import neardup
from tallybridge.llm.components import components
from tallybridge.llm.shingles import shingle_sets, word_hashes


def words(text):
    fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        fold = fold.replace(c, " ")
    return [w for w in fold.split(" ") if w]


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width):
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t, width))
    ids, group = sorted(sets), {d: d for d in sets}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    inverted = {}
    for d in ids:
        for s in sets[d]:
            for x in s:
                inverted.setdefault(x, set()).add(d)
    pairs = {(a, b) for m in inverted.values() for a in m for b in m if a < b}
    for a, b in pairs:
        if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            ra, rb = root(a), root(b)
            group[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d in ids}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\t\x85x", max_size=30), min_size=1, max_size=5), st.integers(1, 5))
def test_shingle_sets(texts, width):
    raw = [t.encode() for t in texts]
    got, (hashes, at) = shingle_sets(raw, width), word_hashes(raw)
    for t, s, a, b in zip(texts, got, at[:-1], at[1:], strict=True):
        assert len(s) == len(shingles(t, width)) and b - a == len(words(t))
    flat = [w for t in texts for w in words(t)]
    assert len(set(hashes.tolist())) == len(set(flat)) and len(hashes) == len(flat)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(5, None)]
    group = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in range(400):
        for a, b in edges:
            if b is not None and a != b:
                group[a] = group[b] = min(group[a], group[b])
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == group
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(120)]
    rows = [(5000, None), (5001, ""), (5002, " \n"), (5003, "a b"), (5004, "A  B"), (5005, "a b"), (5005, "c d e f"), (5006, "C D\te f"), (None, "a b")]
    for i in range(150):  # a group of near copies around one text, in which few are alike
        w = list(base)
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((6000 + i, " ".join(w)))
    df = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("*", "1 as n", "'x' as key", "2 as id")
    whole = neardup.BLOCK_SHINGLES
    try:
        neardup.BLOCK_SHINGLES = 3000  # several blocks in a group
        got = neardup.near_duplicates(df, width=4).collect()
    finally:
        neardup.BLOCK_SHINGLES = whole
    data = [(neardup.NO_ID if r.doc_id is None else r.doc_id, r.text) for r in df.collect()]
    want = brute(data, 4)
    assert len(got) == len(data)
    bad = [(r.doc_id, r.component_id, want[r.doc_id]) for r in got if r.doc_id is not None and r.component_id != want[r.doc_id]]
    assert not bad, bad[:10]
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t, 4)) for _, t in data)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert neardup.near_duplicates(df.filter("false")).count() == 0


def test_signature_estimates():
    rnd = np.random.default_rng(1)
    for share in (0.5, 0.8):
        x = rnd.integers(0, 2**63, 600, dtype=np.uint64) * np.uint64(2)
        both = int(600 * 2 * share / (1 + share))
        y = np.concatenate([x[:both], rnd.integers(0, 2**63, 600 - both, dtype=np.uint64)])
        assert abs((neardup.signature(x) == neardup.signature(y)).mean() - share) < 0.13


def test_rows_without_id_and_repeated_rows(spark):
    rnd = random.Random(4)
    one, two = (" ".join(f"w{rnd.randrange(9999)}" for _ in range(60)) for _ in range(2))
    rows = [(1, one, "x"), (2, two, "x"), (None, one + " more", "a"), (None, two + " more", "b"), (None, "alone here", "c"), (None, "alone here", "c"), (None, None, None), (7, "own text of seven", "z"), (7, "own text of seven", "y"), (7, "own text of seven", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    # two texts without id, each like another document, join nothing with each other
    assert {(1, 1, True), (2, 2, True), (None, 1, False), (None, 2, False), (None, None, True), (7, 7, True)} == got
    left = sorted(map(tuple, neardup.first_of_groups(df).collect()), key=str)
    assert left == sorted([rows[0], rows[1], rows[4], rows[6], rows[8]], key=str)
    assert neardup.first_of_groups(df.filter("false")).count() == 0
