import random
import re
import sysconfig
from pathlib import Path

import zstandard

from emberfield.llm.quality_rules import in_band, judge, passing, repeat_words, with_measures


def slow(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines, seen, dups = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_counts_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(150):
        parts = rng.choice([["a", "b"], ["a", "b", "é|", "#", " ", "\x85"], [f"w{j}" for j in range(40)]])
        rows.append((i, "".join(rng.choice(parts) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randint(0, 60)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in with_measures(docs).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == slow(r["text"])
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_repeat_words_counts_each_word_once():
    own = [b"a"] * 7
    assert repeat_words(own) == 7
    assert repeat_words([b"x", *[b"1", b"2", b"3", b"4", b"5"] * 2, b"y"]) == 10
    assert repeat_words([b"%d" % i for i in range(10)]) == 0


def test_bands(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    common = [word() for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.6 else word() for _ in range(n))
    noise = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(40)) for _ in range(100))
    rows = [(i, prose(n), "x") for i, n in enumerate((12, 40, 150, 600, 3000, 20000))]
    rows += [(100, "".join(f"row {i % 9} of it is here {i}\n" for i in range(600)), "x"), (101, noise, "x"), (102, None, "x"), (103, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    kept = {r["doc_id"] for r in passing(docs).collect()}
    assert kept == set(range(6))
    assert passing(docs).columns == docs.columns and passing(docs.limit(0)).count() == 0


SYMBOLS = {
    "hex": (3072, "0123456789abcdef"),
    "base32": (768, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base64": (128, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}


def size_of(raw):
    return len(zstandard.ZstdCompressor(level=3).compress(raw))


def test_random_symbols_are_outside_and_clean_texts_inside():
    """Random text of every length from which the limits can tell it, against parts of a real text of the same lengths."""
    rng = random.Random(3)
    real = Path(sysconfig.get_path("stdlib"), "LICENSE.txt").read_bytes()
    for n in (128, 200, 300, 400, 700, 1000, 1100, 2000, 3500, 4096, 9000, 20000):
        for least, symbols in SYMBOLS.values():
            raw = " ".join("".join(rng.choice(symbols) for _ in range(rng.randint(12, 16))) for _ in range(n // 12)).encode()[:n]
            assert n < least or not in_band(n, size_of(raw)), (n, symbols)
        if n <= 4096:
            parts = [real[i : i + n] for i in range(0, len(real) - n, n)]
            assert sum(in_band(n, size_of(p)) or len(p) / size_of(p) > 3 for p in parts) >= 0.98 * len(parts), n


def test_one_junk_part_of_a_long_text():
    """A junk chunk among four, and two in a row among many, reject a clean text."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    common = [word() for _ in range(300)]
    clean = " ".join(rng.choice(common) if rng.random() < 0.6 else word() for _ in range(60000)).encode()
    junk = "".join(rng.choice(SYMBOLS["base64"][1]) for _ in range(8192)).encode()
    assert judge(clean[:16384], size_of)[3] and judge(clean[: 60 * 4096], size_of)[3]
    assert not judge(clean[:8192] + junk[:4096] + clean[8192:12288], size_of)[3]
    assert not judge(clean[: 30 * 4096] + junk + clean[30 * 4096 : 58 * 4096], size_of)[3]
