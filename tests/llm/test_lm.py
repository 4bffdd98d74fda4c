import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from emberfield.llm import lm
from emberfield.llm.lm import Lattice, score_documents, vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


def paths(word, index):
    """All segmentations, by brute force."""
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[last:i])
                last = i
        parts.append(word[last:])
        if all(p in index for p in parts):
            yield parts


@pytest.fixture(scope="module")
def model():
    pieces, scores = vocabulary(PATH)
    return pieces, scores, Lattice(pieces)


def test_forward_and_expected_counts_equal_all_segmentations(model):
    pieces, scores, lattice = model
    assert abs(np.exp(scores).sum() - 1) < 1e-9
    index = {p: i for i, p in enumerate(pieces)}
    words = [b"the", b"enting", "über".encode(), b"x", b"zzz", b"a.b,c!!", "漢".encode(), b"the"]
    counts = np.zeros(len(scores))
    for word, got in zip(words, lattice.likelihoods(words, scores)):
        found = list(paths(b" " + word, index))
        weights = [math.exp(sum(scores[index[p]] for p in parts)) for parts in found]
        assert math.isclose(got, math.log(sum(weights)), rel_tol=1e-9)
        for parts, w in zip(found, weights):
            for p in parts:
                counts[index[p]] += w / sum(weights)
    assert np.allclose(counts, lattice.expected(words, scores))


def test_very_long_word(model):
    _, scores, lattice = model
    assert np.isfinite(lattice.likelihoods([b"ab\xc3\xa9" * 2000, b"a"], scores)).all()


def test_documents_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 500)
    rng = random.Random(1)
    words = ["the", "The", "of", "Éa", "éa", "rare", "\x85odd", "x" * 90, *(f"w{i}" for i in range(40))]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randint(0, 50))), 1.0) for i in range(90)]
    rows += [(None, None, 1.0), (5, rows[5][1], 1.0)]
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3).drop("score"), PATH).collect()
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, t, _ in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(
        (-1 if d is None else d, held(d), len(tokens(t)), sum(w in c for w in tokens(t)), n,
         round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6))
        for d, t, _ in rows
    )
    assert want == sorted(
        (-1 if r[0] is None else r[0], r[1], r[2], r[3], r[4], round(r["base_score"], 6)) for r in got
    )
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_estimating_the_scores_raises_held_out_likelihood(spark, monkeypatch):
    rng = random.Random(8)
    parts = ["er", "ing", "st", "an", "de", "th", "ou", "on", "le"]
    word = lambda: "".join(rng.choice(parts) for _ in range(min(int(rng.expovariate(0.5)) + 1, 6)))
    rows = [(i, " ".join(word() for _ in range(100))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def total():
        return sum(r["score"] for r in score_documents(docs, PATH).where("held_out").collect())

    learned = total()
    monkeypatch.setattr(lm, "ROUNDS", 0)
    assert learned > total()


def test_no_training_rows_and_empty(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([(held, "some text")], "doc_id long, text string")
    row = score_documents(docs, PATH).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and math.isfinite(row["score"])
    assert score_documents(docs.limit(0), PATH).count() == 0
