import random

import pytest

from emberfield.llm.near_copies import bands, lone_shingles, shingles, similar, with_reach
from emberfield.llm.simhash import keep_one


def changed(rng, own, count):
    out = list(own)
    for at in rng.sample(range(len(own)), count):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def jaccard(a, b):
    a, b = shingles(a.encode()), shingles(b.encode())
    return len(a & b) / len(a | b)


def test_near_copies_go(spark):
    """Planted copies at a similarity of 0.8 and more leave one row; texts below it stay."""
    rng = random.Random(11)
    rows, near, apart = [], [], []
    for i in range(120):
        words, count = rng.choice([(300, 1), (300, 3), (100, 1), (1000, 10), (300, 5), (300, 20)])
        own = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        a, b = " ".join(own), " ".join(changed(rng, own, count))
        rows += [(2 * i, a), (2 * i + 1, b)]
        (near if jaccard(a, b) >= 0.8 else apart).append(2 * i + 1)
    assert len(near) > 80 and len(apart) > 10
    kept = {r["doc_id"] for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert kept == set(range(0, 240, 2)) | set(apart)


@pytest.mark.parametrize("dense", [64, 3])
def test_one_large_group_equals_brute_force(spark, dense):
    """Copies of one text around the limit, in whole signatures and in blocks."""
    rng = random.Random(dense)
    own = [f"w{i}" for i in range(60)]
    texts = [" ".join(changed(rng, own, rng.choice([1, 1, 2, 3]))) for _ in range(70)]
    root = list(range(70))
    for i, a in enumerate(texts):
        for j in range(i):
            if jaccard(a, texts[j]) >= 0.8 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert 1 < len(set(root)) < 70
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in keep_one(docs, dense=dense).collect()} == set(root)


def test_signatures():
    assert bands(b" \n") == [] and bands(b"A b") == bands(b"a  B") != bands(b"a c")
    assert similar({b"a", b"b", b"c", b"d"}, {b"a", b"b", b"c", b"d", b"e"}) and not similar({b"a", b"b", b"c"}, {b"a", b"b", b"c", b"d"})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reach_and_blocks_lose_no_pair(spark, seed):
    """Copies whose changes are shared in part and whose lengths differ: groups equal those of all pairs, with and without the text they come from."""
    rng = random.Random(seed)
    own = [f"w{i}" for i in range(50)]
    spots = [changed(rng, own, 2) for _ in range(4)]
    texts = [" ".join(own)] if seed > 1 else []
    for _ in range(60):
        words = changed(rng, rng.choice([own, *spots]), rng.choice([0, 1, 2, 3]))
        texts.append(" ".join(words[: rng.choice([50, 50, 47, 42])]))
    texts = sorted(set(texts))
    linked = {(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8}
    root = list(range(len(texts)))
    for i, j in sorted(linked):
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in keep_one(docs, dense=4).collect()} == set(root)
    bodies = docs.selectExpr("doc_id AS digest", "CAST(text AS BINARY) AS body")
    sizes = spark.createDataFrame([(i, len(shingles(t.encode()))) for i, t in enumerate(texts)], "digest long, size int")
    reach = {r["digest"]: r for r in with_reach(sizes, lone_shingles(bodies)).collect()}
    for i, j in linked:
        assert reach[i]["low"] <= len(shingles(texts[j].encode())) <= reach[i]["high"]
        assert reach[j]["low"] <= len(shingles(texts[i].encode())) <= reach[j]["high"]
