"""Quality classifier: random Fourier features over document statistics, ridge regression by normal equations,
isotonic calibration.

Every text gives some twenty statistics (lengths, character classes, repetition, compression); nothing but the text
is used. Standardised, they pass through cosines of random projections, whose inner products approximate a Gaussian
kernel, beside the statistics themselves. Each partition of labelled rows adds up its part of the normal equations in whole
numbers (features are rounded to fixed point), so that the sum does not depend on order; only that matrix, whose size is
fixed by the number of features, goes to the driver, where it is solved. Calibration counts labels per
score bin, with scores of a model fitted on the other half of the labelled rows, and pools bins until they rise.

Defined results: null texts count as empty and are scored like any; without labels, or with labels of one kind, the
score is the share of ones (0.5 without any); repeated documents and labels each count, a document with several
labels counts with their mean; null labels are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.llm.common import Batch, Stages, crc_remainder, map_texts, raw_texts

FOLDS, HELD_OUT = 3, 1
FEATURES = 128
SEED = 20_240_607
BANDWIDTH = 4.0
RIDGE = 1e-3
CLIP = 5.0
FIXED = 1 << 12
#: Calibration bins between the raw scores -0.5 and 1.5.
BINS = 2048
UPPER, DIGITS, MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?()'\"-"
LETTERS = UPPER + bytes(range(97, 123))
SYMBOLS = b"#*$%&|<>@^_~=+/\\{}[]"
ASCII = bytes(range(128))
SPACES = b" \t\n\x0b\x0c\r"
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "spread_word", "long_words", "letters", "upper", "digits", "marks",
    "symbols", "shouts", "spaces", "beyond_ascii", "lines_per_word", "distinct_words", "top_word", "doubled_words",
    "bare_words", "symbol_ends", "repeated_lines", "sentence_ends", "capital_words", "ratio",
)


def statistics(raw: bytes, packed: int) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``; ``packed`` is its compressed size."""
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [math.log1p(size), *[0.0] * (len(STATISTICS) - 1)]
    share = lambda kinds: (size - len(raw.translate(None, kinds))) / size
    lengths = np.fromiter(map(len, words), np.float64, n)
    counts = Counter(words)
    lines = [line for line in raw.split(b"\n") if line.strip(SPACES)]
    ends = Counter(w[-1] for w in words)
    starts = Counter(w[0] for w in words)
    return [
        math.log1p(size),
        math.log1p(n),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths > 15).mean()),
        share(LETTERS),
        share(UPPER),
        share(DIGITS),
        share(MARKS),
        share(SYMBOLS),
        share(b"!"),
        share(SPACES),
        0.0 if raw.isascii() else len(raw.translate(None, ASCII)) / size,
        len(lines) / n,
        math.log(len(counts)) / math.log(n + 1),
        max(counts.values()) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        sum(not w.translate(None, SYMBOLS + MARKS + DIGITS + b"!") for w in words) / n,
        sum(ends[c] for c in SYMBOLS) / n,
        1 - len(set(lines)) / len(lines),
        sum(ends[c] for c in b".?!") / n,
        sum(starts[c] for c in UPPER) / n,
        math.log(size / packed),
    ]


def with_statistics(df: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """All columns and the array of statistics of every whole text."""

    def factory():
        compressor = zstandard.ZstdCompressor(level=1)

        def run(batch: Batch) -> dict:
            texts = raw_texts(batch.column(batch.schema.get_field_index(text)))
            return {name: [statistics(raw, len(compressor.compress(raw)) if raw else 1) for raw in texts]}

        return run

    return map_texts(df, text, factory, f"{name} array<double>")


class Features:
    """Standardised statistics to cosines of random projections, the statistics and a constant."""

    def __init__(self, means: np.ndarray, spreads: np.ndarray, count: int = FEATURES) -> None:
        rng = np.random.default_rng(SEED)
        self.means, self.spreads = means, np.where(spreads > 1e-9, spreads, 1.0)
        self.directions = rng.normal(0, 1 / BANDWIDTH, (len(means), count))
        self.phases = rng.uniform(0, 2 * math.pi, count)
        self.size = count + len(means) + 1

    def __call__(self, stats: list[list[float]]) -> np.ndarray:
        z = np.clip((np.array(stats, float).reshape(-1, len(self.means)) - self.means) / self.spreads, -CLIP, CLIP)
        cosines = math.sqrt(2) * np.cos(z @ self.directions + self.phases)
        return np.concatenate([cosines, z, np.ones((len(z), 1))], axis=1)


def _normal_equations(rows: DataFrame, features: Features) -> dict[int, np.ndarray]:
    """``(stats, quality, half)`` to the summed matrix and target of either half; at most a matrix' cells per partition."""
    size = features.size
    upper = np.triu_indices(size + 1)

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        sums = {}
        for batch in batches:
            x = features(batch.column(0).to_pylist())
            y = batch.column(1).to_numpy()
            both = np.rint(np.concatenate([x, y[:, None]], axis=1) * FIXED)
            half = batch.column(2).to_numpy()
            for h in np.unique(half):
                part = both[half == h]
                for at in range(0, len(part), 8192):  # whole numbers below 2**53
                    block = part[at : at + 8192]
                    sums[h] = sums.get(h, 0) + (block.T @ block).astype(np.int64)
        for h, total in sums.items():
            cells = np.arange(len(upper[0]), dtype=np.int64)
            yield Batch.from_pydict({"half": pa.array([int(h)] * len(cells), pa.int64()), "cell": cells, "v": total[upper]})

    sums = rows.mapInArrow(run, "half bigint, cell bigint, v bigint").groupBy("half", "cell").agg(F.sum("v").alias("v"))
    out = {}
    for r in sums.collect():
        if r["half"] not in out:
            out[r["half"]] = np.zeros((size + 1, size + 1))
        out[r["half"]][upper[0][r["cell"]], upper[1][r["cell"]]] = r["v"] / FIXED**2
    return {h: m + np.triu(m, 1).T for h, m in out.items()}


def _solve(both: np.ndarray) -> np.ndarray:
    size = len(both) - 1
    rows = max(both[size - 1, size - 1], 1.0)
    penalty = RIDGE * rows * np.eye(size)
    penalty[-1, -1] = 1e-9 * rows
    return np.linalg.solve(both[:size, :size] + penalty, both[:size, size])


def pooled(ones: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic shares of ones per bin (pool adjacent violators); empty bins lie on the line between their neighbours."""
    blocks: list[list[float]] = []
    for at in np.flatnonzero(counts):
        blocks.append([ones[at], counts[at], at, at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            o, c, _, last = blocks.pop()
            blocks[-1][0] += o
            blocks[-1][1] += c
            blocks[-1][3] = last
    # A block's share has one count of doubt; its line runs through its middle, so scores keep their order inside it.
    middles = [(b[2] + b[3]) / 2 for b in blocks]
    shares = [(b[0] + 0.5) / (b[1] + 1) for b in blocks]
    if not blocks:
        return np.full(len(counts), 0.5)
    return np.interp(np.arange(len(counts)), middles, np.maximum.accumulate(shares))


def _bins(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def fit(scored: DataFrame, labels: DataFrame) -> tuple[Features, np.ndarray, np.ndarray]:
    """Features, weights and calibration curve from ``(doc_id, stats)``, learning where crc32(doc_id) mod 3 is not 1."""
    n = len(STATISTICS)
    figures = scored.agg(*(f(F.col("stats")[i]) for i in range(n) for f in (F.avg, F.stddev_pop))).first()
    value = lambda i: np.array([figures[2 * j + i] or 0.0 for j in range(n)])
    features = Features(value(0), value(1))
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = scored.where(crc_remainder(F.col("doc_id"), FOLDS) != HELD_OUT).join(marked, "doc_id")
    rows = rows.select("stats", F.col("y").cast("double"), F.pmod(F.floor(crc / FOLDS), F.lit(2)).cast("bigint").alias("half"))
    halves = _normal_equations(rows, features)
    total = sum(halves.values()) if halves else np.zeros((features.size + 1, features.size + 1))
    ones, count = total[-1, -2], total[-2, -2]
    if not 0 < ones < count:
        return features, np.zeros(features.size), np.full(BINS, ones / count if count else 0.5)
    weights = _solve(total)
    other = {h: _solve(halves.get(1 - h, total)) for h in (0, 1)}

    def score(batches: Iterator[Batch]) -> Iterator[Batch]:
        for batch in batches:
            x, half = features(batch.column(0).to_pylist()), batch.column(2).to_numpy()
            raw = np.where(half == 0, x @ other[0], x @ other[1])
            yield Batch.from_pydict({"bin": _bins(raw), "y": batch.column(1)})

    bins = rows.mapInArrow(score, "bin bigint, y double").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"))
    hit, all_rows = np.zeros(BINS), np.zeros(BINS)
    for r in bins.collect():
        hit[r["bin"]], all_rows[r["bin"]] = r["ones"], r["n"]
    return features, weights, pooled(hit, all_rows)


def apply(df: DataFrame, model: tuple[Features, np.ndarray, np.ndarray], stats: str = "stats", name: str = "score") -> DataFrame:
    """All columns and the score from 0 to 1 of the statistics."""
    features, weights, curve = model

    def factory():
        def run(batch: Batch) -> dict:
            raw = features(batch.column(batch.schema.get_field_index(stats)).to_pylist()) @ weights
            at = np.clip((raw + 0.5) / 2 * BINS - 0.5, 0, BINS - 1)
            return {name: pa.array(np.clip(np.interp(at, np.arange(BINS), curve), 0.0, 1.0))}

        return run

    return map_texts(df, stats, factory, f"{name} double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text)`` and ``(doc_id, quality)`` to doc_id, held_out, score and predicted of every document."""
    stages = Stages(docs.sparkSession)
    scored = stages.write(with_statistics(docs.select("doc_id", "text")).drop("text"))
    return apply(scored, fit(scored, labels)).select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def passing(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with the columns they came with.

    Only ids and statistics are kept while it learns, and they go at once; the texts are measured again for the result.
    """
    stages = Stages(docs.sparkSession)
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    narrow = plain.select(F.col(own[doc_id]).alias("doc_id"), F.col(own[text]).alias("text"))
    model = fit(stages.write(with_statistics(narrow).drop("text")), labels)
    stages.drop_all()
    return apply(with_statistics(plain, own[text]), model).where("score >= 0.5").select(*(F.col(n).alias(c) for c, n in own.items()))
