"""Secret scan: fixed formats, and a battery of randomness tests over all long tokens with false-discovery control.

A candidate is a run of at least 20 characters of the base-64 alphabets. Its encoding is the smallest alphabet that holds it
(decimal, hex, base 32, base 64). Three tests ask whether its symbols could be random ones: chi-squared uniformity over the alphabet (a normal
deviate by Wilson and Hilferty), runs above and below the alphabet's middle, and serial correlation of
neighbours. The squares of the deviates add up to one chi-squared value with a tail probability p: near zero for words, names
and numbers, evenly spread over 0 to 1 for random keys.

False discoveries are controlled per encoding and length, since short words pass by chance more often than long
ones: all candidates of the corpus are counted by p, the even part is estimated from the upper half of the counts, and the least
threshold is taken above which at most ``RATE`` of the candidates exceed that even part. Every band starts from the counts of
``PRIOR`` random keys and as many names of its length, so that one rule holds for thin bands and full ones and a few more
candidates move a threshold by little. Only the counts, a table of fixed size, go to the driver. Candidates that overlap a fixed-format span are left out. No Python runs on executors.

Defined results: null texts count as empty and have no spans; repeated rows and null ids are scanned like any; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.llm.common import Stages
from emberfield.llm.spans import apart_from, find, joined

#: Fixed values of the contract, in their order.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Encodings: name, test, symbols in order.
ENCODINGS = (
    ("decimal", "^[0-9]*$", "0123456789"),
    ("hex", "^([0-9a-f]*|[0-9A-F]*)$", "0123456789abcdef"),
    ("base32", "^[A-Z2-7]*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
#: Lengths from which a band begins.
LENGTHS = (20, 24, 32, 48, 64, 128)
RATE = 0.1
P_BINS = 100
#: Random keys, and names, that every band holds before its own candidates are counted.
PRIOR = 20
#: Share of names with p of at least each edge, by the first band it holds for. Measured on 16,000 distinct candidates of Python's
#: standard library (6,829, 6,175 and 3,065 in base 64); its longer ones are largely keys themselves and take the last row.
EDGES = (0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 1.0)
NAMES = (
    (0, (1.0, 0.252, 0.197, 0.133, 0.086, 0.050, 0.036, 0.017, 0.007, 0.001, 0.0)),
    (2, (1.0, 0.080, 0.061, 0.041, 0.027, 0.014, 0.008, 0.003, 0.001, 0.0, 0.0)),
    (3, (1.0, 0.014, 0.012, 0.008, 0.006, 0.006, 0.004, 0.002, 0.001, 0.0, 0.0)),
)


def _chi2_tail3(x: Column) -> Column:
    """P(chi-squared with 3 degrees of freedom >= x), by Wilson and Hilferty and a logistic normal tail."""
    z = (F.pow(F.greatest(x, F.lit(1e-12)) / 3, F.lit(1 / 3)) - (1 - 2 / 27)) / math.sqrt(2 / 27)
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070565988 * z * z * z)))


def battery(token: Column) -> Column:
    """``struct<encoding,band,p>`` of a candidate; uses only expressions, so it can stand inside a lambda."""
    plain = F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")
    number = F.lit(len(ENCODINGS) - 1)
    for i, (_, test, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        number = F.when(plain.rlike(test), i).otherwise(number)
    alphabet = F.element_at(F.array(*(F.lit(a) for _, _, a in ENCODINGS)), number + 1)
    folded = F.when(number == 1, F.lower(plain)).otherwise(plain)
    symbols = F.array_remove(F.split(folded, ""), "")
    prepared = F.struct(
        number.alias("e"),
        F.length(alphabet).cast("double").alias("k"),
        F.transform(symbols, lambda c: F.call_function("instr", alphabet, c) - 1).alias("x"),
    )
    # ``transform`` over one element binds the struct, so that it is computed once.
    return F.transform(F.array(prepared), _tests)[0]


def _tests(s: Column) -> Column:
    x, k, n = s["x"], s["k"], F.size(s["x"]).cast("double")
    squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(x, lambda y: y == c)), F.lit(2)))
    chi = F.greatest(k / n * squares - n, F.lit(0.0))
    df = k - 1
    uniform = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    neighbours = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    high = F.size(F.filter(x, lambda y: y >= k / 2)).cast("double")
    low = n - high
    runs = 1 + F.size(F.filter(neighbours, lambda p: (p["a"] >= k / 2) != (p["b"] >= k / 2))).cast("double")
    expected = 2 * high * low / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    runs_z = F.when(variance > 1e-9, (runs - expected) / F.sqrt(variance)).otherwise(F.sqrt(n))
    middle = (k - 1) / 2
    spread = F.aggregate(x, F.lit(0.0), lambda a, y: a + (y - middle) * (y - middle))
    serial = F.aggregate(neighbours, F.lit(0.0), lambda a, p: a + (p["a"] - middle) * (p["b"] - middle))
    serial_z = F.when(spread > 0, serial / spread * F.sqrt(n)).otherwise(F.sqrt(n))
    total = F.pow(F.greatest(uniform, F.lit(0.0)), F.lit(2)) + runs_z * runs_z + serial_z * serial_z
    band = sum((n >= at).cast("int") for at in LENGTHS)
    sound = n > 1
    return F.struct(
        s["e"].alias("encoding"),
        band.alias("band"),
        F.when(sound, F.least(_chi2_tail3(total), F.lit(0.999999))).otherwise(0.0).alias("p"),
    )


def with_findings(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, ``base`` (array of start, kind number, end) and ``candidates`` (start, end, encoding, band, p)."""
    body = F.coalesce(F.col(text), F.lit(""))
    numbered = lambda spans, i: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))
    assign = F.filter(find(body, ASSIGN), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 12)
    made = docs.withColumn(
        "base", F.array_sort(F.concat(numbered(assign, 0), numbered(find(body, ACCESS), 1), numbered(find(body, HEX), 2)))
    ).withColumn("tokens", find(body, CANDIDATE))
    of_kind = lambda k: F.filter("base", lambda s: s["kind"] == k)
    tested = F.transform(
        apart_from(F.col("tokens"), *(of_kind(k) for k in range(3))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), battery(s["hit"]).alias("t")),
    )
    flat = F.transform(
        tested,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["t"]["encoding"].alias("encoding"),
            s["t"]["band"].alias("band"),
            s["t"]["p"].alias("p"),
        ),
    )
    return made.withColumn("candidates", flat).drop("tokens")


def prior(band: int) -> list[float]:
    """Counts by p that a band starts from."""
    tail = [t for at, t in NAMES if at <= band][-1]

    def names(p: float) -> float:
        i = max(k for k, e in enumerate(EDGES[:-1]) if e <= p)
        return tail[i] + (tail[i + 1] - tail[i]) * (p - EDGES[i]) / (EDGES[i + 1] - EDGES[i])

    return [PRIOR * (1 / P_BINS + names(i / P_BINS) - names((i + 1) / P_BINS)) for i in range(P_BINS)]


def thresholds(found: DataFrame, rate: float = RATE) -> dict[tuple[int, int], float]:
    """(encoding, band) to the least p from which false discoveries are at most ``rate``; absent: none is found."""
    rows = (
        found.select(F.explode("candidates").alias("c"))
        .groupBy(F.col("c.encoding").alias("e"), F.col("c.band").alias("b"), F.floor(F.col("c.p") * P_BINS).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )  # at most encodings x bands x bins
    counts: dict[tuple[int, int], list[float]] = {}
    for r in rows:
        counts.setdefault((r["e"], r["b"]), prior(r["b"]))[r["bin"]] += r["n"]
    out = {}
    for key, bins in counts.items():
        if ENCODINGS[key[0]][0] == "decimal":
            continue  # numbers are no keys
        even = 2 * sum(bins[P_BINS // 2 :]) / P_BINS  # random candidates per bin
        for at in range(P_BINS):
            above = sum(bins[at:])
            if above and 1 - min(1.0, even * (P_BINS - at) / above) <= rate:
                out[key] = at / P_BINS
                break
    return out


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` to doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document."""
    stages = Stages(docs.sparkSession)
    found = stages.write(with_findings(docs.select("doc_id", "text")).drop("text"))
    limits = thresholds(found)
    base = F.col("base")
    key = lambda c: c["encoding"] * 100 + c["band"]

    def random(c: Column) -> Column:
        limit = F.lit(2.0)
        for (e, b), p in sorted(limits.items()):
            limit = F.when(key(c) == e * 100 + b, p).otherwise(limit)
        return c["p"] >= limit

    added = F.transform(
        F.filter("candidates", random), lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end"))
    )
    name = lambda s: F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["kind"] + 1)
    count = lambda i: F.size(F.filter(base, lambda s: s["kind"] == i)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(base, name).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat(base, added)), name).alias("spans"),
    )
