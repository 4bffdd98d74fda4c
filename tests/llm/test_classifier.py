import random
import zlib

import numpy as np
import pytest

from emberfield.llm.classifier import STATISTICS, passing, pooled, score_documents, statistics


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


def corpus(seed, count):
    rng = random.Random(seed)
    syllables = ["er", "ing", "st", "an", "de", "th", "ou", "on", "le"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(count):
        good = rng.random() < 0.7
        words = [word() for _ in range(rng.randint(20, 200))]
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + rng.choice(["###", "$$$"]) for w in words]
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_bounds(spark):
    rows, labels = corpus(1, 500)
    rows += [(None, None, None), (3, "", "x"), (9000, "w " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marked = spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0), (2, labels[2][1], 0)], "doc_id long, quality int, toxic int")
    out = score_documents(docs, marked).collect()
    assert len(out) == len(rows)
    truth = {i: q for i, q, _ in labels}
    wrong = [r for r in out if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 3 and r["predicted"] != truth[r["doc_id"]]]
    assert len(wrong) <= 2
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == held(r["doc_id"])


def test_held_out_labels_are_not_learned_and_order_does_not_matter(spark):
    rows, labels = corpus(2, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, s string")
    schema = "doc_id long, quality int, toxic int"
    turned = [(i, 1 - q if held(i) else q, t) for i, q, t in labels]
    scores = lambda marked: {r["doc_id"]: r["score"] for r in score_documents(docs, marked).collect()}
    first = scores(spark.createDataFrame(labels, schema))
    second = scores(spark.createDataFrame(turned[::-1], schema).repartition(5))
    assert first.keys() == second.keys() and all(abs(first[k] - second[k]) < 1e-9 for k in first)


@pytest.mark.parametrize("labels, want", [([], 0.5), ([(i, 1, 0) for i in range(30)], 1.0)])
def test_labels_of_one_kind(spark, labels, want):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r["score"] for r in score_documents(docs, marked).collect()} == {want}


def test_passing_keeps_columns_and_empty(spark):
    rows, labels = corpus(3, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, stats string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = passing(docs, marked)
    assert kept.columns == docs.columns
    good = {i for i, q, _ in labels if q}
    assert len({r["doc_id"] for r in kept.collect()} ^ good) <= 4
    assert passing(docs.limit(0), marked).count() == 0 and score_documents(docs.limit(0), marked).count() == 0


def test_pooling():
    counts = np.array([4, 0, 4, 4, 0, 4.0])
    curve = pooled(np.array([0, 0, 3, 1, 0, 4.0]), counts)
    assert (np.diff(curve) >= 0).all() and curve[2] <= curve[3] and curve[0] < 0.3 and curve[-1] > 0.7
    assert (pooled(np.zeros(3), np.zeros(3)) == 0.5).all()


def test_statistics_of_odd_texts():
    for raw in (b"", b" \n", b"a", "é".encode(), b"!" * 50, b"x\n" * 500):
        own = statistics(raw, max(1, len(raw) // 2))
        assert len(own) == len(STATISTICS) and np.isfinite(own).all()
