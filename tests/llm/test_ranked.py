import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from emberfield.llm import ranked
from emberfield.llm.ranked import rank_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
DOCS, ITEMS = "doc_id long, text string, n int, terms int", "item_id long, text string, item int"


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def slow(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        mine = set(terms(text))
        scored = []
        for d, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in mine if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if z else d, -s) for r, (s, z, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, parts=3, **more):
    d = spark.createDataFrame([(*r, 1, 1) for r in docs], DOCS).repartition(parts)
    i = spark.createDataFrame([(*r, 1) for r in items], ITEMS)
    return sorted((tuple(r) for r in rank_documents(d, i, **more).collect()), key=str)


def corpus(rng, n, words=400):
    zipf = [1 / (i + 1) for i in range(words)]
    text = lambda size: " ".join(f"w{i}" for i in rng.choices(range(words), zipf, k=size))
    docs = [(i, text(rng.randint(1, 60))) for i in range(n)]
    return docs, [(i, text(12)) for i in range(25)]


def test_random_texts_in_small_hierarchies(spark, monkeypatch):
    monkeypatch.setattr(ranked, "DOCS", 50)
    docs, items = corpus(random.Random(5), 600)
    want = slow(docs, items)
    assert run(spark, docs, items, seed=8) == want
    assert run(spark, docs, items, seed=1, item_terms=40) == want  # several blocks of items, no first search
    assert run(spark, docs, items, k=3) == slow(docs, items, 3)


def test_nulls_ties_repeats_and_letters(spark):
    docs = [(i, "same words here") for i in range(30)] + [(None, "same words here"), (4, "same words here"), (40, None), (41, ""), (42, " .,\n!")]
    docs += [(50, "Élan ÉLAN élan A_B a-b x's 日本 日本語"), (51, "rare " * 5), (52, "rare"), (53, "\x7fdel{brace}~")]
    items = [(1, "same"), (1, "same"), (None, "RARE rare Rare"), (2, None), (3, "nothing known"), (4, "élan ÉLAN b del 日本"), (5, "..")]
    assert run(spark, docs, items) == slow(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, None)], items) == []


def test_very_long_texts_are_read_in_windows(spark, monkeypatch):
    monkeypatch.setattr(ranked, "WINDOW", 1000)
    docs = [(1, "alpha beta " * 60_000), (2, "gamma" * 50_000), (3, "alpha"), (4, "b " * 2000 + "gamma")]
    items = [(1, "alpha gamma"), (2, "gamma" * 50_000)]
    assert run(spark, docs, items) == slow(docs, items)


@pytest.mark.parametrize("same", [True, False])
def test_node_pairs_are_passed_over(same):
    """Bounds spare most pairs where documents differ, and nothing is lost."""
    rng = random.Random(7)
    docs = [[rng.randrange(20) + 20 * (i % 40) * (not same) for _ in range(8)] for i in range(4000)]
    items = [np.unique([rng.randrange(20) + 20 * (j % 40) * (not same) for _ in range(6)]) for j in range(40)]
    df = np.bincount([t for d in docs for t in set(d)], minlength=800)
    weight = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * n + 1))) for n in df])
    own = ranked.Search(items, weight, len(docs), 8 * len(docs), np.zeros(len(items), np.int64), 10)
    doc = np.repeat(np.arange(len(docs)), [len(set(d)) for d in docs])
    term = np.concatenate([sorted(set(d)) for d in docs])
    count = np.concatenate([[d.count(t) for t in sorted(set(d))] for d in docs])
    own.add(np.arange(len(docs)), np.full(len(docs), 8), doc, term, count)
    value = own.coordinates(np.full(len(docs), 8), doc, term, count)
    for i, mine in enumerate(items):
        scores = np.bincount(doc, value * np.isin(term, mine), minlength=len(docs)).astype(np.int64)
        order = np.lexsort((np.arange(len(docs)), -scores))[:10]
        assert own.best[i][0].tolist() == scores[order].tolist() and own.best[i][1].tolist() == order.tolist()
    if not same:
        assert own.scored < 0.1 * len(docs) * len(items)
