import random
from collections import defaultdict

import corpus_pipeline
from emberfield.llm.pii import redact
from emberfield.llm.quality_rules import passing


def write(spark, folder, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def documents(seed, count):
    rng = random.Random(seed)
    syllables = ["er", "ing", "st", "an", "de", "th", "ou", "on", "le"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(count):
        good = i % 4 != 0
        words = [word() for _ in range(rng.randint(40, 300))]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words]), "en", "s", 1, i))
        labels.append((i, int(good), 0))
    return rows, labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = documents(1, 200)
    text = rows[1][1]
    rows += [(1000, text, "en", "s", 1, 0), (1001, text + " extra", "en", "s", 1, 0), (1002, None, None, None, None, None), (1003, "", "en", "s", 1, 0)]
    rows += [(1004, "same words here again " * 60, "en", "s", 1, 0), (1005, f"{rows[2][1]} mail a@b.co and {rows[3][1]}", "en", "s", 1, 0), (None, rows[5][1], "en", "s", 1, 0)]
    folder = str(tmp_path / "sf")
    write(spark, folder, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, kept, folder).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in kept.collect()}
    good = {i for i, q, _ in labels if q}
    assert len((set(seen["quality classifier"]) & set(range(200))) ^ good) <= 4
    ruled = seen["quality rules"]
    assert not {1002, 1003, 1004} & set(ruled)
    assert set(ruled) <= set(seen["quality classifier"])
    near = seen["near duplicates"]
    assert 1000 not in near and (1 in near) == (1 in ruled) and (5 in near) == (5 in ruled)
    assert None not in near or 5 not in ruled
    assert set(near) >= set(ruled) - {1000, 1001, None}
    done = seen["personal data"]
    assert set(done) == set(near) and "[EMAIL]" in done[1005] and "a@b.co" not in done[1005]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, folder).collect()
    tokens, sequences = defaultdict(int), defaultdict(int)
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]] += r["length"]
    assert set(tokens) == set(done) and max(sequences.values()) <= 1024
    assert all(tokens[r["doc_id"]] == r["doc_tokens"] for r in packed)
    pieces = lambda rows: {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows}
    assert pieces(packed) == pieces(corpus_pipeline.run(spark, folder).collect())


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "sf")
    write(spark, folder, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_filters_do_not_touch_other_columns(spark):
    docs = spark.createDataFrame([(1, "a clean text of more than ten words that says very little at all", "ratio")], "doc_id long, text string, ratio string")
    assert passing(docs).first() == docs.first() and redact(docs).first() == docs.first()
