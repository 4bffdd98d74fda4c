import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from emberfield.llm import near_copies
from emberfield.llm.common import Stages, numbered, sieved
from emberfield.llm.simhash import candidates, keep_one, with_fingerprints


def changed(rng, own, count):
    out = list(own)
    for at in rng.sample(range(len(own)), count):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def staged(docs):
    return with_fingerprints(near_copies.with_signatures(docs, "text"), "text").withColumn("row", F.monotonically_increasing_id())


def test_simhash_finds_links_without_min_hashes(spark):
    """Texts within two bits are candidates by their fingerprints, and links that hold make groups where no min-hash is shared."""
    rng = random.Random(2)
    rows = []
    for i in range(25):
        own = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        rows += [(3 * i, " ".join(own)), (3 * i + 1, " ".join(changed(rng, own, 1))), (3 * i + 2, " ".join(changed(rng, own, 1)))]
    stages = Stages(spark)
    made = stages.write(staged(spark.createDataFrame(rows, "doc_id long, text string")))
    prints = {r["digest"]: r["fingerprint"] & (1 << 64) - 1 for r in made.collect()}
    names = sorted(prints)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2}
    found = candidates(made, stages)
    pairs = {tuple(sorted((r["u"], r["v"]))) for r in found.collect()}

    def roots(edges):
        root = {n: n for n in names}
        for a, b in edges:
            low, high = sorted((root[a], root[b]))
            root = {n: low if r == high else r for n, r in root.items()}
        return root

    assert len(want) > 20 and roots(pairs) == roots(want)
    bare = made.withColumn("bands", F.array().cast("array<bigint>"))
    joined = {r["digest"]: r["root"] for r in near_copies.groups(bare, "text", stages, candidates=found).collect()}
    assert {n: joined.get(n, n) for n in names} == roots(want)


def block(texts):
    hashes = [near_copies.shingle_hashes(t.encode()) for t in texts]
    columns = {
        "digest": pa.array(range(len(texts)), pa.int64()), "root": pa.array(range(len(texts)), pa.int64()), "size": pa.array([len(h) for h in hashes], pa.int32()),
        "held": pa.array([len(h) for h in hashes], pa.int64()), "mins": [near_copies.least_hashes(h).astype("<u2").tobytes() for h in hashes],
        "hashes": [np.unique(h).tobytes() for h in hashes],
    }
    half = pa.table(columns)
    return pa.concat_tables([half.append_column("rest", pa.array([r] * len(texts))) for r in (True, False)])


def test_a_block_gives_links_not_pairs():
    """Of texts just below the limit no pair leaves a block, of a group of copies a tree does."""
    rng = random.Random(4)
    own = [f"w{i}" for i in range(200)]
    run = near_copies._alike(near_copies.SIMILAR)
    below = [" ".join(changed(rng, own, 4)) for _ in range(60)]
    sets = [near_copies.shingles(t.encode()) for t in below]
    close = {(j, i) for i in range(60) for j in range(i) if near_copies.similar(sets[i], sets[j])}
    got = {tuple(r.values()) for r in run(block(below)).to_pylist()}
    assert got <= close and len(got) < 60
    copies = [" ".join(changed(rng, own, 1)) for _ in range(50)]
    assert run(block(copies)).num_rows == 49


def test_rows_by_number_and_by_hash(spark):
    """Marks of row numbers give exactly the rows wanted, the sieve none too few."""
    df = spark.range(20_000, numPartitions=7).select("id", F.xxhash64("id").alias("h")).withColumn("row", F.monotonically_increasing_id())
    stages = Stages(spark)
    df = stages.write(df)
    wanted = df.where("id % 7 = 3 or id in (0, 19999)")
    want = {r["id"] for r in wanted.collect()}
    got = numbered(df, wanted.select("row"), stages)
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == sorted(want)
    assert numbered(df, wanted.select("row").limit(0), stages).count() == 0
    passed = [r["id"] for r in sieved(df, wanted.select("h"), "h").collect()]
    assert want <= set(passed) and len(passed) == len(set(passed)) < len(want) + 50


def test_texts_are_not_shuffled_whole(spark):
    """Neither picking candidates nor the result moves the texts of all rows, whatever is broadcast by size."""
    docs = spark.createDataFrame([(i, f"text {i} " + "of its own words " * 3) for i in range(50)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
