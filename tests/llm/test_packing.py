import random
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from emberfield.llm.packing import added_tokens, cut, encoder, pack, patterns, slots

RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)  # as it is loaded: strings of added tokens have ids of their own


def test_ids_equal_the_library(library):
    rng = random.Random(1)
    parts = ["the", "Über", "don't", "\n", "  ", "\t", "<|endoftext|>", "漢字", "é", "1234", "...", " ", "\xa0", " ", "\x1c", "😀"]
    encode = encoder(RANKS, added_tokens(JSON))
    for _ in range(2000):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))
        want = library.encode(text, add_special_tokens=False).ids
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in want), repr(text)


def test_patterns_use_every_length_once():
    rng = random.Random(2)
    for length in (16, 1024):
        histogram = {n: rng.randint(1, 500) for n in rng.sample(range(1, length + 1), min(length, 300) // 2)}
        packs = patterns(histogram, length)
        used = defaultdict(int)
        for pattern, count in packs:
            assert sum(pattern) <= length and count > 0
            for own in pattern:
                used[own] += count
        assert used == histogram
        taken = {(own, first + i) for own, first, n, _, _ in slots(packs) for i in range(n)}
        assert len(taken) == sum(histogram.values())
    assert patterns({}) == [] and slots([]) == []


def test_documents_are_whole_and_sequences_full(spark, library):
    rng = random.Random(3)
    words = [line.split() for line in ["some words of a text", "einige Wörter mehr", "et puis encore"]]
    rows = [(i, " ".join(rng.choice(rng.choice(words)) for _ in range(rng.choice([0, 3, 200, 900, 3000]))), 1) for i in range(120)]
    rows += [(7, None, 1), (None, "no id", 1), (8, rows[8][1], 1), (8, rows[8][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int").repartition(5)
    pieces, placed = pack(docs, RANKS)
    ids = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in placed.collect()}
    assert ids and placed.count() == pieces.count()
    by_doc = defaultdict(list)
    for r in pieces.collect():
        by_doc[r["doc_id"]].append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    for doc_id, text, _ in rows:
        if doc_id in (7, 8):
            continue
        want = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[doc_id])
        assert b"".join(p[1] for p in own) == b"".join(i.to_bytes(4, "little") for i in want)
        assert {p[2] for p in own} == {len(want)}
    sequences = defaultdict(list)
    for r in placed.collect():
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
        total += at
    assert sorted(sequences) == list(range(len(sequences)))
    assert total / (1024 * len(sequences)) > 0.97
    assert cut(docs.limit(0), RANKS).count() == 0 and pack(docs.limit(0), RANKS)[1].count() == 0
