import math

import numpy as np
import public_tokenizers

from tallybridge.llm import langid

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba", "bb"]
    lattice = langid.Lattice(pieces)
    rnd = np.random.default_rng(1)
    probs = rnd.random((lattice.unknown + 1, 2))

    def brute(word, k):
        if not word:
            return 1.0
        total = 0.0
        for n in range(1, len(word) + 1):
            head = word[:n]
            if head in lattice.index:
                total += probs[lattice.index[head], k] * brute(word[n:], k)
            elif n == 1:
                total += probs[lattice.unknown, k] * brute(word[n:], k)
        return total

    words = ["a", "ab", "abab", "bbaba", "abzab", "babababab", "z"]
    got = lattice.log_likelihood(words, probs)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, [math.log(brute(w, k)) for k in range(2)])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs, PATH).collect()}
    rows = [r for r in docs.select("doc_id", "lang").collect() if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in rows)
    assert len(rows) > 100 and right / len(rows) > 0.97, right / len(rows)
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, None, "en", None), (3, "123 ²", None, "y"), (None, "le chat et le chien", "fr", "z"), (4, "le chat et la souris", "fr", "q"), (4, "le chat et la souris", "fr", "q"), (5, "x" * 5000, None, ""), (6, "", "en", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = sorted(map(tuple, langid.predict(df, langid.train(df, PATH)).collect()), key=str)
    assert len(got) == len(rows)
    pred = {g[0]: g[1] for g in got}
    assert pred[1] == "en" and pred[2] == "und" and pred[3] == "und" and pred[4] == "fr" and pred[6] == "und"
    empty = df.filter("false")
    assert langid.identify(empty, PATH).count() == 0
    assert {r.lang_pred for r in langid.predict(df, langid.train(empty, PATH)).collect()} == {"und"}


def test_whole_vocabulary_and_whole_words():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    every = {model.id_to_piece(i).strip("▁").lower() for i in range(model.get_piece_size())}
    lattice = langid.Lattice(langid.read_pieces(PATH))
    assert set(lattice.index) == {p for p in every if p.isalpha()} and lattice.longest > 5

    def brute(word, probs, k):
        """Logarithm of the sum over all segmentations, by place, in whole fractions."""
        from fractions import Fraction

        sums = [Fraction(1)] + [Fraction(0)] * len(word)
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - lattice.longest), end):
                piece = lattice.index.get(word[start:end], lattice.unknown if end - start == 1 else None)
                if piece is not None:
                    sums[end] += sums[start] * Fraction(float(probs[piece, k]))
        return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)

    rnd = np.random.default_rng(3)
    probs = rnd.random((lattice.unknown + 1, 2)) / 1000
    words = ["information" * 9, "international", "x", "\U0001e900" * 50, "über" * 20 + "一" * 40 + "straße", "a" * 33]
    got = lattice.log_likelihood(words, probs)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, [brute(w, probs, k) for k in range(2)], rtol=1e-9), w
    # a word of many letters keeps finite sums, and training counts each of its segmentations
    assert np.isfinite(lattice.log_likelihood(["q" * 20000], probs)).all()


def test_expected_uses_against_all_segmentations():
    lattice = langid.Lattice(["a", "b", "ab", "ba", "aba", "abab", "bbbbbb"])
    words = ["abab", "b" * 7, "ab" * 21, "z", "ba" * 3 + "z"]
    counts = np.array([[3.0], [1.0], [2.0], [1.0], [5.0]])
    probs = np.full(lattice.unknown + 1, 1 / lattice.unknown)
    probs[lattice.unknown] = langid.UNKNOWN
    for _ in range(langid.EM_ROUNDS):
        used = np.full(lattice.unknown + 1, 0.01)
        for word, n in zip(words, counts[:, 0], strict=True):
            edges = [(i, j, lattice.index.get(word[i:j], lattice.unknown if j == i + 1 else None)) for i in range(len(word)) for j in range(i + 1, len(word) + 1)]
            edges = [e for e in edges if e[2] is not None]
            up, down = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
            for i, j, p in sorted(edges, key=lambda e: e[1]):
                up[j] += up[i] * probs[p]
            for i, j, p in sorted(edges, key=lambda e: -e[0]):
                down[i] += probs[p] * down[j]
            for i, j, p in edges:
                used[p] += n * up[i] * probs[p] * down[j] / up[-1]
        probs[: lattice.unknown] = used[: lattice.unknown] / used[: lattice.unknown].sum()
    assert np.allclose(lattice.train(words, counts)[:, 0], probs)
