import random
import re

from tallybridge.llm import licenses as lic


def test_matching_statistics_against_brute_force():
    rnd = random.Random(2)
    seqs = [[rnd.choice([b"a", b"b", b"c"]) for _ in range(rnd.randrange(1, 12))] for _ in range(6)]
    auto = lic.SuffixAutomaton(seqs)
    known = {(tuple(s[i:j])): None for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(50):
        text = [rnd.choice([b"a", b"b", b"c", b"z"]) for _ in range(40)]
        got = {p: (n, s) for p, s, n in auto.statistics(text)}
        for p in range(len(text)):
            want = max((n for n in range(1, p + 2) if tuple(text[p - n + 1 : p + 1]) in known), default=0)
            assert got.get(p, (0, 0))[0] == want
            if want:
                run = text[p - want + 1 : p + 1]
                ends = {(t, e) for t, s in enumerate(seqs) for e in range(want - 1, len(s)) if s[e - want + 1 : e + 1] == run}
                assert auto.ends[got[p][1]] == ends


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    found = []
    for phrase, label in lic.BASE_PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_documents_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    mit = lic.TEMPLATES[0][1]
    rows = [(-1, None), (-2, ""), (-3, "Under the MIT-License, under THE mit license! " * 2), (-4, "é under the mit licenseé"), (-5, "cc by nc cc BY/nc apache license, version 2.0"), (None, "cc by nc"), (-6, mit.upper()), (-7, "x " * 100_000 + "cc by nc"), (-8, "Under the MIT License "), (-9, "the software is furnished"), (-9, "the software is furnished")]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    df = docs.unionByName(extra).selectExpr("*", "1 as base", "2 as n_words")
    got = lic.report(lic.scan_licenses(df)).collect()
    want = {r.doc_id: brute(r.text) for r in df.collect()}
    assert len(got) == 1000 + len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id], r.doc_id
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[-6].labels == "mit" and by[-6].score == 1 and by[-9].labels == "" and by[-1].n_words == 0
    assert lic.report(lic.scan_licenses(df.filter("false"))).count() == 0
