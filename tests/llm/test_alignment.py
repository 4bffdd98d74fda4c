import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from emberfield.llm import alignment, csr
from emberfield.llm.alignment import align_documents, links

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, block int, pair int"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"]


@pytest.fixture(scope="module")
def pair():
    return alignment.load(PATHS)


def plain(pair, text):
    """Tokens with byte ranges by whole-text calls of the libraries, then links and groups pair by pair."""
    first = tokenizers.Tokenizer.from_file(PATHS[0])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    if not text:
        return None
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
        return None

    def placed(ids, own):
        at = 0
        for i in ids:
            yield i, at, at + len(own[i])
            at += len(own[i])

    a, b = list(placed(a, pair.a_bytes)), list(placed(b, pair.b_bytes))
    linked = [(i, j, min(x[2], y[2]) - max(x[1], y[1])) for i, x in enumerate(a) for j, y in enumerate(b) if x[1] < y[2] and y[1] < x[2]]
    cuts = sorted({x[2] for x in a} & {y[2] for y in b})
    groups, last = [], 0
    for cut in cuts:
        groups.append(([x[0] for x in a if last < x[2] <= cut], [y[0] for y in b if last < y[2] <= cut]))
        last = cut
    return a, b, linked, groups


def slow(pair, rows):
    made = [(r[0], plain(pair, r[1])) for r in rows]
    ids = lambda p: [(p[0][i][0], p[1][j][0]) for i, j, _ in p[2]]
    docs = Counter(x for _, p in made if p for x in set(ids(p)))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for doc_id, p in made:
        if not p:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        own = ids(p)
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in p[3])
        best, total = sum(docs[x] == most[x[0]] for x in own), sum(docs[x] for x in own)
        shared = sum(len(a) * len(b) for a, b in p[3])
        out.append((doc_id, len(p[0]), len(p[1]), len(p[3]), len(own), best, total, hashlib.sha256(text.encode()).hexdigest(), shared))
    return sorted(out, key=str), docs


TEXTS = [
    None, "", " ", "a", "The cat sat. The cat's hat isn't 12345 red!", "<|endoftext|> and <s> </s> <unk> <0x41>", "with▁mark", "naïve café über", "日本語のテキスト です",
    "  leading and  double   spaces ", "tabs\tand\nlines\n\n next \r\n x", "nul\x00 \x85   x y 　z", "é é \U0001f600 \U0001f468‍\U0001f469 ok", "x" * 700 + " " + "ab" * 400,
    "The cat sat. The cat's hat isn't 12345 red!", "\x1c \x1d a \x1e", "don't  we'll 'tis", "a ᠎ b ​ c", "end ", "﻿bom",
]


def rows_of(texts):
    return [(i if i % 9 else None, t, 1, 2) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_documents_against_brute_force(spark, pair, block):
    rng = random.Random(4)
    letters = "ab Z.,'\t\n é日😀1 ▁ \x00  "
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = rows_of(texts)
    found, counts = align_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), PATHS, block)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str)
    want, docs = slow(pair, rows)
    assert got == want
    table = {(r["a_id"], r["b_id"]): (r["docs"], r["best"]) for r in counts.collect()}
    assert {k: n for k, (n, _) in table.items()} == dict(docs)
    most = {a: max(n for (x, _), n in docs.items() if x == a) for a, _ in docs}
    assert all(best == (n == most[a]) for (a, _), (n, best) in table.items())


def test_links_of_both_kinds(spark, pair):
    rows = rows_of(TEXTS)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {k: sorted(map(tuple, links(df.where("doc_id is not null"), PATHS, k).collect())) for k in (False, True)}
    overlap, shared = [], []
    for doc_id, text, *_ in rows:
        p = plain(pair, text)
        if p is None or doc_id is None:
            continue
        overlap += [(doc_id, i, j, p[0][i][0], p[1][j][0], n) for i, j, n in p[2]]
        i = j = 0
        for a, b in p[3]:
            shared += [(doc_id, i + x, j + y, a[x], b[y], 1) for x in range(len(a)) for y in range(len(b))]
            i, j = i + len(a), j + len(b)
    assert got[False] == sorted(overlap) and got[True] == sorted(shared)


def test_given_documents_by_whole_text_calls(spark, pair):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40).collect()]
    rows = [(d, t[:1500] if t else t) for d, t in rows]
    found, _ = align_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATHS)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found.collect()), key=str) == slow(pair, rows)[0]


def test_long_words_and_no_documents(spark, pair):
    long = "".join(random.Random(1).choice("abcdefghij") for _ in range(300_000))
    found = align_documents(spark.createDataFrame([(1, long, 0, 0)], SCHEMA), PATHS)[0].first()
    first = tokenizers.Tokenizer.from_file(PATHS[0])
    assert found["n_a"] == len(first.encode(" " + long, add_special_tokens=False).ids) and found["n_links"] >= found["n_a"]
    found, counts = align_documents(spark.createDataFrame([], SCHEMA), PATHS)
    assert found.count() == 0 and counts.count() == 0


def test_products_against_dense_ones():
    rng = np.random.default_rng(3)
    for panel in (1, 5, 1 << 20):
        for _ in range(20):
            n, k, m = rng.integers(1, 9, 3)
            a, b = (rng.integers(-2, 3, s) * (rng.random(s) < 0.4) for s in ((n, k), (k, m)))
            own = [csr.from_entries(*np.nonzero(x), *x.shape, x[np.nonzero(x)]) for x in (a, b)]
            made = csr.product(*own, panel=panel)
            dense = np.zeros((n, m), np.int64)
            np.add.at(dense, (made.rows(), made.columns), made.values)
            assert (dense == a @ b).all()
            back = csr.transpose(own[0])
            dense = np.zeros((k, n), np.int64)
            np.add.at(dense, (back.rows(), back.columns), back.values)
            assert (dense == a.T).all()
