import base64
import hashlib
import random
import re

from pyspark.sql import functions as F

from emberfield.llm.secrets import battery, scan

ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def slow(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{['assign', 'access', 'hex'][k]}:{s}:{e}" for s, k, e in sorted(found)]


PARTS = [
    "password", "PassWd", "secret", "ToKen", "api_key", "APIKEY", '"', "'", " ", "=", ":", " = ", "abcdefghijkl", "0123456789abcdef", "AKIA", "AKIAABCDEFGHIJKLMN",
    "x", "é", "\n", "deadbeef", "A1", "😀", "toKen",
]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))), "x") for i in range(800)]
    rows += [(None, None, None), (900, "", "x"), (901, "token=" + "a" * 30000 + " " + "secret: " * 3000, "x")]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)).collect()
    want = {d: slow(t or "") for d, t, _ in rows}
    for r in got:
        own = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest(), r
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in own) for k in ("assign", "access", "hex")]
        assert set(own) <= set(r["spans"].split(",")) or not own


def test_random_keys_are_found_and_words_are_not(spark):
    rng = random.Random(4)
    key = lambda n: base64.b64encode(rng.randbytes(n)).decode()
    long_word = lambda: "".join(rng.choice(["ing", "tion", "ness", "er", "the", "ment", "ab"]) for _ in range(9))
    rows = [(i, f"some words {key(30)} more") for i in range(150)]
    rows += [(1000 + i, f"a {long_word()} and {long_word()} or {'=' * 40} {'zy' * 15}") for i in range(300)]
    rows += [(2000, "http/path/to/some/long/file/name/here")]
    out = {r["doc_id"]: r["spans"] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(out[i] == "random:11:51" for i in range(150))
    wrong = sum(bool(out[i]) for i in out if i >= 1000)
    assert found >= 120 and wrong <= 0.1 * (found + wrong)


def test_battery_is_even_for_random_symbols(spark):
    rng = random.Random(9)
    rows = [("".join(rng.choice("0123456789abcdef") for _ in range(40)),) for _ in range(400)]
    df = spark.createDataFrame(rows, "t string").select(battery(F.col("t")).alias("b"))
    p = [r["b"]["p"] for r in df.collect()]
    assert 0.35 < sum(x > 0.5 for x in p) / len(p) < 0.65 and all(r["b"]["encoding"] == 1 for r in df.collect())


def test_keys_of_rare_kinds_are_found_at_every_size(spark):
    """Thin bands find most keys, few names, and a table just past 20 candidates in a band gives what a smaller one gives."""
    rng = random.Random(12)
    kinds = {"base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "HEX": "0123456789ABCDEF", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    keys = ["".join(rng.choice(a) for _ in range(n)) for a in kinds.values() for n in (22, 28, 40, 56, 100, 200) for _ in range(14)]
    names = ["test_that_it_does_what_it_should", "AbstractSingletonProxyFactoryBean", "org/apache/spark/sql/catalyst/expressions", "RESOURCE_NOT_AVAILABLE_ERROR"]
    rows = list(enumerate([f"see {k} there" for k in keys + names]))
    spans = lambda rows: {r["doc_id"]: r["spans"] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    small = spans(rows)
    assert sum(small[i] == f"random:4:{4 + len(k)}" for i, k in enumerate(keys)) >= 0.85 * len(keys)
    assert not any(small[len(keys) + i] for i in range(len(names)))
    more = [(i + 1000, t.replace(k[:4], k[3::-1])) for (i, t), k in zip(rows, keys)]
    large = spans(rows + more)
    assert sum(small[i] != large[i] for i, _ in rows) <= 0.05 * len(rows)


def test_empty(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
