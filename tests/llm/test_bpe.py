import random

import public_tokenizers
import pytest
import regex
import tiktoken

from emberfield.llm.bpe import Encoder, PieceIds, Transducer, decode_ids, encode_texts, load_ranks, stream_decode

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed, count):
    rng = random.Random(seed)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "eiouts nr", "漢字かなカナ한글", "абвгд", "0123456789", "!?.,;*-=_", "😀🚀é́ßø", "ab\n\t  ", "a b's. 1 ", "x \u3000y \x85\x1c z"]
    for _ in range(count):
        own = rng.choice(alphabets) + rng.choice(["", rng.choice(alphabets)])
        yield "".join(rng.choice(own) for _ in range(rng.randint(0, 60)))


@pytest.mark.parametrize("keep", [250_000, 50])
def test_transducer_equals_the_library(ranks, library, keep):
    ids = PieceIds(Transducer(ranks, keep), keep)
    encode = Encoder(ids, public_tokenizers.PATTERN)
    pieces = regex.compile(public_tokenizers.PATTERN).findall
    for text in [*texts(1, 3000 if keep > 1000 else 300), "a" * 5000, "", "<|endoftext|>"]:
        got = b"".join(map(ids.__getitem__, pieces(text)))
        assert got == encode(text) == b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(text)), text


def test_decoding_by_any_chunks(ranks, library):
    import numpy as np

    bytes_of = {r: t for t, r in ranks.items()}
    for text in texts(2, 300):
        ids = np.array(library.encode_ordinary(text), "<u4")
        for size in (1, 2, 7):
            assert "".join(stream_decode([ids[i : i + size] for i in range(0, len(ids), size)], bytes_of)) == text


def test_frames_with_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, "some text", "x"), (1, "some text", "x"), (None, None, None), (3, "", "y"), (4, "日本語 " * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    out = decode_ids(encode_texts(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(out) == 5
    for row in out:
        assert row["n_tokens"] == len(library.encode_ordinary(row["text"] or ""))
        assert row["decoded"] == (row["text"] or "")
    assert encode_texts(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
