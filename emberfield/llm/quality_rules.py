"""Quality rules: compression bands over whole documents and fixed chunks, beside word and line counts.

Repetitive text compresses too well, random text hardly at all. The zstandard ratio (bytes to compressed bytes) grows
with length because short inputs pay for headers and unknown words, so every length has its own limits. The
ratio of the whole document must lie within the limits of its length, and so must those of nearly all of its fixed
chunks, which finds a junk part that a long document would hide, and junk whose repeats lie far apart.

Defined results: null texts have no words and fail the base rule (fewer than 10 words); documents and chunks shorter
than the first limit's length have no band and pass it; repeated rows are judged alike; other columns are carried
along; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.llm.common import Batch, map_texts, raw_texts

#: Length in bytes from which a band holds, least and greatest ratio. A least ratio is at most the smallest one of clean documents and
#: chunks of that length (labelled good in a quarter of a 0.5 GB table, and license texts). Random base 64 in words lies below it
#: from 128 bytes, base 32 from 768 and hex from 3,072; shorter ones have the ratios of clean texts, so they pass.
BANDS = (
    (64, 0.0, 3.0),
    (128, 1.03, 3.0),
    (192, 1.13, 3.0),
    (256, 1.2, 3.2),
    (384, 1.29, 3.2),
    (512, 1.37, 3.5),
    (768, 1.51, 3.5),
    (1024, 1.59, 4.0),
    (1536, 1.7, 4.0),
    (2048, 1.78, 4.0),
    (3072, 1.89, 4.0),
    (4096, 1.94, 4.5),
    (8192, 2.1, 4.5),
    (16384, 2.2, 5.0),
)
CHUNK = 4096
#: A document goes if more than this share of its chunks lies outside the band, or so many in a row.
CHUNK_SHARE = 0.05
CHUNK_RUN = 2
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
_SPACE = b" \t\n\x0b\x0c\r"


def repeat_words(own: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more, each word once."""
    total = len(own) - window + 1
    if total < 2 or len(set(own)) == len(own):
        return 0
    windows = list(zip(*(own[i:] for i in range(window))))
    if len(set(windows)) == total:
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for at, w in enumerate(windows):
        if counts[w] > 1:
            covered += at + window - max(at, end)
            end = at + window
    return covered


def in_band(length: int, packed: int, bands: tuple = BANDS) -> bool:
    at = bisect_right(bands, length, key=lambda b: b[0]) - 1
    if at < 0:
        return True
    _, least, most = bands[at]
    return least * packed <= length <= most * packed


def judge(raw: bytes, size_of, bands: tuple = BANDS) -> tuple[float | None, int, int, bool]:
    """(ratio of the whole, chunks, chunks outside the band, whether the bands accept the document)."""
    if not raw:
        return None, 0, 0, True
    packed = size_of(raw)
    chunks = [(len(raw), packed)]
    if len(raw) > CHUNK:
        parts = [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]
        chunks = [(len(p), size_of(p)) for p in parts]
    bad = bytes(not in_band(*c, bands) for c in chunks)
    outside = sum(bad)
    fine = in_band(len(raw), packed, bands) and outside <= CHUNK_SHARE * len(chunks) and b"\1" * CHUNK_RUN not in bad
    return len(raw) / packed, len(chunks), outside, fine


ADDED = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "ratio double, n_chunks bigint, n_bad_chunks bigint, in_bands boolean"
)


def with_measures(df: DataFrame, text: str = "text", bands: tuple = BANDS) -> DataFrame:
    """All columns, the counts, the compression ratios and the verdicts ``base_failed`` and ``kept``."""
    names = [part.split()[0] for part in ADDED.split(", ")]

    def factory():
        compressor = zstandard.ZstdCompressor(level=LEVEL)

        def size_of(part: bytes) -> int:
            return len(compressor.compress(part))

        def measure(raw: bytes) -> tuple:
            own = raw.split()
            # White space is single bytes, so code points in words are all code points less the bytes outside words.
            chars = len(raw.decode()) - len(raw) + sum(map(len, own))
            lines = Counter(raw.split(b"\n")) if raw.count(b"\n") else {}
            repeated = sum(n - 1 for line, n in lines.items() if n > 1 and line.strip(_SPACE))
            symbols = len(raw) - len(raw.translate(None, SYMBOLS))
            return (len(own), chars, symbols, repeated, repeat_words(own), *judge(raw, size_of, bands))

        def run(batch: Batch) -> dict:
            rows = [measure(raw) for raw in raw_texts(batch.column(batch.schema.get_field_index(text)))]
            return dict(zip(names, map(list, zip(*rows))))

        return run

    made = map_texts(df, text, factory, ADDED)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return made.withColumn("base_failed", failed).withColumn("kept", ~failed & F.col("in_bands"))


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they came with."""
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    return with_measures(plain, own[text]).where("kept").select(*(F.col(n).alias(c) for c, n in own.items()))
