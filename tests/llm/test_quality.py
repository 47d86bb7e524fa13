import math

import numpy as np
from pyspark.sql import functions as F

from tallybridge.llm import quality


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.assess(docs, labels)
    assert got.count() == docs.count()
    rows = [r for r in got.join(labels, "doc_id").collect() if r.held_out]
    bad = [r for r in rows if r.quality == 0]
    assert len(rows) > 50 and len(bad) >= 5
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97
    assert sum(r.predicted == 0 for r in bad) / len(bad) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_attention_finds_the_bad_passage(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    clean = "the cat sat on this mat and then it went over there to see who was at home. " * 90
    clean = " ".join(w + str(i % 7) * 0 for i, w in enumerate(clean.split()))
    noise = " ".join(f"word{chr(97 + i % 26)}***" for i in range(45))[: quality.PASSAGE]
    text = clean[: 3 * quality.PASSAGE] + noise.ljust(quality.PASSAGE, "&") + clean[: 2 * quality.PASSAGE]
    rows = quality.score_quality(spark.createDataFrame([(1, text), (2, clean[: 6 * quality.PASSAGE])], "doc_id long, text string"), model).collect()
    mixed, plain = sorted(rows, key=lambda r: r.doc_id)
    assert mixed.n_passages == 6 and mixed.score < plain.score


def test_gradients():
    rnd = np.random.default_rng(3)
    x = rnd.random((9, quality.FEATURES)).astype(np.float64)
    starts, label, weight = np.array([0, 2, 3, 7]), np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 0.5, 1])
    net = quality.Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}

    def loss():
        raw, share = net.pooled(*net.forward(x)[:2], starts)
        assert np.allclose(np.add.reduceat(share, starts), 1)
        p = quality.logistic(raw)
        return -(weight * (label * np.log(p) + (1 - label) * np.log(1 - p))).sum() / weight.sum()

    grads = net.gradients(x, starts, label, weight)
    for name, w in net.w.items():
        flat, g = w.reshape(-1), grads[name].reshape(-1)
        for i in rnd.choice(len(flat), min(6, len(flat)), replace=False):
            kept = flat[i]
            flat[i] = kept + 1e-6
            up = loss()
            flat[i] = kept - 1e-6
            down = loss()
            flat[i] = kept
            assert math.isclose((up - down) / 2e-6, g[i], rel_tol=1e-3, abs_tol=1e-7), name


def brute_features(text: bytes) -> np.ndarray:
    out = []
    for part in [text[i : i + quality.PART] for i in range(0, max(1, len(text)), quality.PART)]:
        words, at = [], 0
        while at < len(part):
            if quality.CLASS[part[at]] > 2:
                end = at
                while end < len(part) and quality.CLASS[part[end]] > 2:
                    end += 1
                words.append((at, part[at:end]))
                at = end
            at += 1
        for lo in range(0, max(1, len(part)), quality.PASSAGE):
            window = part[lo : lo + quality.PASSAGE]
            pairs, triples, shape = np.zeros(quality.PAIRS), np.zeros(quality.TRIPLES), np.zeros(quality.SHAPE)
            for i in range(len(window)):
                a, b, c = (int(part[lo + i + k]) if lo + i + k < len(part) else 0 for k in range(3))
                pairs[int(quality.CLASS[a]) * quality.CLASSES + int(quality.CLASS[b])] += 1
                h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) * 0x27D4EB2F % 2**32
                triples[h >> 24] += a > 0
            pairs[0] = 0
            own = [k for k, (at, _) in enumerate(words) if lo <= at < lo + quality.PASSAGE]
            n = max(1, len(own))
            shape[0] = sum(k > 0 and words[k][1] == words[k - 1][1] for k in own) / n
            shape[1] = sum(words[k][1] in [w for _, w in words[max(0, k - 4) : k]] for k in own) / n
            shape[2] = len(own) / max(1, len(window))
            shape[3] = min(100, sum(quality.CLASS[c] > 2 for c in window) / n) / 10
            shape[4] = len(window) / quality.PASSAGE
            size = max(1, len(window))
            out.append(np.concatenate([np.sqrt(pairs / size), np.sqrt(triples / size), shape]))
    return np.array(out)


def test_features_against_brute_force(monkeypatch):
    monkeypatch.setattr(quality, "PART", 2048)
    monkeypatch.setattr(quality, "SLICE_BYTES", 3000)
    texts = [b"", b"a", b"the the cat cat the", "Über ÉTÉ 日本! ".encode() * 60, b"x" * 512, b"ab " * 683, b"\0\0 a\0b", b"w " * 4000, b" " * 600]
    got = np.concatenate(list(quality.Encoder().groups(texts)))
    want = np.concatenate([brute_features(t) for t in texts])
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-6)
    assert quality.passages_of(np.array([len(t) for t in texts])).tolist() == [len(brute_features(t)) for t in texts]


def test_odd_rows(spark):
    rows = [(1, "a b c d e", "x", 1), (2, None, None, 2), (3, "", "y", 3), (None, "no id", "z", 4), (5, "w!!! " * 60_000, "q", 5), (1, "a b c d e", "x", 1), (6, "fine words here", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1), (None, 1), (2, None), (99, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.n_passages for r in got if r.doc_id == 5} == {-(-300_000 // 512)}
    assert quality.assess(docs, labels).filter("doc_id is null and not held_out").count() == 1
    # nothing to learn from: the constant share of label 1
    assert {r.score for r in quality.score_quality(docs, quality.train(docs, labels.filter("false"))).collect()} == {0.5}
    one = quality.train(docs, labels.filter("quality = 1"))
    assert {r.score for r in quality.score_quality(docs, one).collect()} == {(2 + 1) / (2 + 2)}
    empty = docs.filter("false")
    assert quality.assess(empty, labels).collect() == [] and quality.train(empty, labels)["weights"] is None


def test_sample_is_bounded(spark):
    labels = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 > 0).cast("int").alias("quality"))
    docs = labels.select("doc_id", F.when(F.col("quality") == 1, "good words in a row").otherwise(F.lit("bad!!! " * 200)).alias("text"))
    kept = labels.select("doc_id", F.col("quality").alias("label"), F.xxhash64("doc_id").alias("hash"))
    rows, found = quality.chosen(kept, 100)
    assert found == {0: 500, 1: 1500} and [sum(r.label == k for r in rows) for k in (0, 1)] == [100, 100]
    model = quality.train(docs, labels, per_label=50, most_passages=60)
    got = quality.score_quality(docs, model).join(labels, "doc_id").filter("(score >= 0.3) <> (quality = 1)").count()
    assert got == 0
