import random

from tallybridge.llm import decontaminate as dec


def semi_global(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    best = min(row)
    return best, row.index(best)


def test_bit_vectors_against_the_table():
    rnd = random.Random(4)
    for _ in range(300):
        p = [rnd.choice(b"abc") for _ in range(rnd.randrange(1, 90))]
        t = [rnd.choice(b"abc") for _ in range(rnd.randrange(0, 120))]
        assert dec.best_match(p, t) == semi_global(p, t)


def test_leaks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    rnd = random.Random(1)
    items = {r.item_id: r.text.split() for r in bench.collect()}
    rows, planted = [], set()
    for n, (item, words) in enumerate(sorted(items.items())):
        w, k = list(words), min(int(0.2 * len(words)), len(words) // 5 - 1)
        for _ in range(k // 2):
            i = rnd.randrange(len(w))
            w[i : i + 1] = rnd.choice([[], ["zzz"], [w[i], "qq"]])
        rows.append((-1 - n, "Before it. " + " ".join(w).upper() + " after it."))
        planted.add((-1 - n, item))
    rows += [(-1000, None), (-1001, ""), (None, " ".join(items[0])), (-1002, "word " * 100_000 + " ".join(items[1]))]
    df = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("*", "0 as item_id", "1 as distance")
    odd = bench.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "the and of"), (None, "x y z a b c")], "item_id long, text string"))
    got = dec.find_leaks(df, odd).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert planted <= pairs and (None, 0) in pairs and (-1002, 1) in pairs
    assert {(r.doc_id, r.item_id) for r in dec.find_leaks(df, odd, block_bytes=2000).collect()} == pairs
    want = set()
    for r in df.filter("doc_id % 7 = 0 or doc_id < 0").collect():
        words = dec.words_of((r.text or "").encode())
        if len(words) > 5000:
            continue
        for item, text in [*items.items(), (902, ["the", "and", "of"])]:
            p = dec.words_of(" ".join(text).encode())
            if dec.best_match(p, words)[0] <= int(0.2 * len(p)):
                want.add((r.doc_id, item))
    assert {p for p in pairs if p[0] is not None and (p[0] % 7 == 0 or p[0] < 0) and p[0] != -1002} == want
    assert dec.find_leaks(df.filter("false"), odd).count() == 0 and dec.find_leaks(df, odd.filter("false")).count() == 0


def test_the_whole_budget_at_every_length(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    items = {m: [rnd.choice(vocabulary) for _ in range(m)] for m in (1, 2, 3, 4, 5, 6, 9, 10, 24, 25, 50, 101)}
    rows = []
    for m, words in items.items():
        for edits in (m // 5, m // 5 + 1):
            w = list(words)
            for i in rnd.sample(range(m), edits):
                w[i] = "edited"
            rows.append((len(rows), " ".join(["before", *w, "after"])))
    rows += [(len(rows) + i, " ".join(rnd.choice(vocabulary) for _ in range(300))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(m, " ".join(w)) for m, w in items.items()], "item_id long, text string")
    encoded = {m: [w.encode() for w in words] for m, words in items.items()}
    for budget, edits in ((0.2, lambda m: m // 5), (0.5, lambda m: m // 2)):
        got = {(r.doc_id, r.item_id) for r in dec.find_leaks(docs, bench, budget=budget, least_words=1).collect()}
        want = {(d, m) for d, text in rows for m, p in encoded.items() if semi_global(p, text.encode().split())[0] <= edits(m)}
        assert got == want
    assert {(2 * i, m) for i, m in enumerate(items) if m >= 5} <= {(r.doc_id, r.item_id) for r in dec.find_leaks(docs, bench).collect()}


def test_two_places_in_one_stretch():
    found = dec.Items([(7, b"a b c d")], 0.5, 1).find(b"a b x a b".split())
    assert [(f[3], f[4]) for f in found] == [(0, 1), (3, 4)]


def test_rows_without_leaks_by_their_own_text(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, f"a {item} b", "x"), (1, "clean text", "y"), (None, f"{item.upper()}", "x"), (None, "clean", "x"), (2, None, "x"), (3, "", None), (4, f"a {item} b", "x"), (4, f"a {item} b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, item), (2, None), (None, "clean text a b c"), (5, item)], "item_id long, text string")
    want = sorted([rows[1], rows[3], rows[4], rows[5]], key=str)
    for block_bytes in (1 << 20, 60):
        assert sorted(map(tuple, dec.without_leaks(df, bench, block_bytes=block_bytes).collect()), key=str) == want
    assert dec.without_leaks(df, bench.filter("false")).count() == len(rows)
    assert dec.without_leaks(df.filter("false"), bench).count() == 0
