"""Packing of documents into sequences: shortest-pack-first over the histogram of piece lengths.

A document's ids, closed by an end id, are cut into pieces: full sequences and one rest. Only the histogram of lengths
(at most as many rows as a sequence has tokens) goes to the driver. There lengths are placed longest first, each time into the
packs with most room, by counts: a pattern of lengths and how often it is used. Patterns are joined back to the
pieces by rank: the pieces of a length are numbered, and every slot of a pattern owns an interval of those numbers.

Numbering needs no sort: pieces are numbered within the task that cuts them, and the counts of (task, length) give each
task its start. A length that holds a third of all pieces is spread over tasks like any other.

Defined results: null texts are empty and give one piece, the end id; repeated rows and null ids are packed like any
others; sequences fill up from offset 0 without gaps; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberfield.llm.bpe import load_ranks
from emberfield.llm.common import Batch, Stages, slices

LENGTH = 1024
END_ID = 0
#: Slots are a function of the histogram, not of the rows; up to this many they are broadcast.
BROADCAST_SLOTS = 50_000
_ENCODERS: dict[str, Callable[[str], bytes]] = {}


class _Chunks(dict):
    """Ids (little-endian u32) of the text between two single spaces with the space before it; started anew when full."""

    def __init__(self, encode: Callable[[str], list[int]], keep: int = 500_000) -> None:
        super().__init__()
        self.encode, self.keep = encode, keep

    def __missing__(self, chunk: str) -> bytes:
        packed = np.array(self.encode(" " + chunk), "<u4").tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.keep:
                self.clear()
            self[chunk] = packed
        return packed


def added_tokens(json_path: str) -> dict[str, int]:
    """Strings that a tokenizer file gives ids of their own, wherever they stand in a text."""
    with open(json_path, encoding="utf-8") as source:
        return {t["content"]: t["id"] for t in json.load(source)["added_tokens"]}


def encoder(ranks_path: str, added: dict[str, int] | None = None) -> Callable[[str], bytes]:
    """Whole text to ids; the tokenizer's pattern never matches across a single space between other characters, so such
    chunks are looked up one by one. Texts with neighbouring white space are encoded as they are. ``added`` strings are
    taken out first, the longest where several start at one place, and what is between them is encoded by itself."""
    plain = _plain_encoder(ranks_path)
    if not added:
        return plain
    strings = sorted(added, key=len, reverse=True)
    cut = re.compile("(" + "|".join(map(re.escape, strings)) + ")")
    own = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}

    def encode(text: str) -> bytes:
        if not any(t in text for t in strings):
            return plain(text)
        return b"".join(own[part] if part in own else plain(part) for part in cut.split(text) if part)

    return encode


def _plain_encoder(ranks_path: str) -> Callable[[str], bytes]:
    if ranks_path not in _ENCODERS:
        gc.disable()  # large tables without cycles
        own = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(ranks_path), special_tokens={}
        )
        chunks = _Chunks(own.encode_ordinary).__getitem__
        wide_space = re.compile(r"\s\s").search

        def encode(text: str) -> bytes:
            if wide_space(text):
                return np.array(own.encode_ordinary(text), "<u4").tobytes()
            first, *rest = text.split(" ")
            return np.array(own.encode_ordinary(first), "<u4").tobytes() + b"".join(map(chunks, rest))

        _ENCODERS[ranks_path] = encode
    return _ENCODERS[ranks_path]


def cut(
    docs: DataFrame, ranks_path: str, length: int = LENGTH, end_id: int = END_ID, added: dict[str, int] | None = None
) -> DataFrame:
    """``(doc_id, text)`` to pieces ``(doc_id, start, length, ids, doc_tokens, task, nth)``: nth of its length in its task.

    The numbers hold only for one run of the tasks, so the result is to be written before it is used twice.
    """
    schema = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, task bigint, nth bigint"

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        encode = encoder(ranks_path, added)
        task = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        seen = [0] * (length + 1)
        for batch in slices(batches, 1):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = (encode(text) if text else b"") + end
                total = len(ids) // 4
                for start in range(0, total, length):
                    own = min(length, total - start)
                    rows.append((doc_id, start, own, ids[4 * start : 4 * (start + own)], total, task, seen[own]))
                    seen[own] += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "task", "nth"]
            yield Batch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Length counts to (pattern of lengths, count): longest lengths first, each into the packs that are shortest so far."""
    open_packs: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(length + 1)]
    for own in sorted(histogram, reverse=True):
        left = histogram[own]
        room = length
        while left:
            while room >= own and not open_packs[room]:
                room -= 1
            if room < own:
                open_packs[length - own].append(((own,), left))
                break
            pattern, count = open_packs[room].pop()
            used = min(left, count)
            if used < count:
                open_packs[room].append((pattern, count - used))
            open_packs[room - own].append(((*pattern, own), used))
            left -= used
    return [pack for packs in open_packs for pack in packs]


def slots(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Patterns to (length, first rank, count, first sequence, offset): which pieces of a length go where."""
    out: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = {}
    sequence = 0
    for pattern, count in packs:
        offset = 0
        for own in pattern:
            first = used.get(own, 0)
            out.append((own, first, count, sequence, offset))
            used[own] = first + count
            offset += own
        sequence += count
    return out


def place(pieces: DataFrame, stages: Stages, length: int = LENGTH) -> DataFrame:
    """Pieces as ``cut`` numbers them, written already, to all their columns but task and nth, and sequence_id, offset."""
    spark = pieces.sparkSession
    counts = stages.write(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    made = slots(patterns(histogram, length))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_nth"))
    table = spark.createDataFrame(made, "length bigint, first bigint, n bigint, first_sequence bigint, slot_offset bigint")
    if len(made) <= BROADCAST_SLOTS:
        table = F.broadcast(table)
    ranked = pieces.join(starts, ["task", "length"]).withColumn("rank", F.col("first_nth") + F.col("nth"))
    slot = table.withColumnRenamed("length", "slot_length")
    here = (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("first"), F.col("first") + F.col("n") - 1)
    kept = [c for c in pieces.columns if c not in ("task", "nth")]
    return ranked.join(slot, here).select(
        *kept, (F.col("first_sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("slot_offset").alias("offset")
    )


def pack(
    docs: DataFrame, ranks_path: str, length: int = LENGTH, end_id: int = END_ID, added: dict[str, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, written as a table; placement of every piece, with a crc32 of its ids)."""
    stages = Stages(docs.sparkSession)
    pieces = stages.write(cut(docs, ranks_path, length, end_id, added))
    narrow = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "task", "nth")
    return pieces, place(narrow, stages, length)
