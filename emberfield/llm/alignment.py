"""Alignment of the tokens of two tokenizers by products of token-byte incidence matrices.

A row of the incidence matrix of a tokenizer holds the bytes of one token occurrence. With A and B over the same bytes, the entries of
A·Bᵀ are the pairs of tokens whose byte ranges overlap, and their values how many bytes they share. Offsets where tokens of
both end cut the bytes into groups; with the token-group incidence matrices G, the entries of Ga·Gbᵀ are the pairs of one group.

Neither tokenizer has a token across a single space between other characters, so texts are cut there, and the products
are made once per distinct chunk of a block of texts. The links of a document follow by a third product, (documents x chunks) ·
(chunks x id pairs). Texts with neighbouring white space are cut at the single spaces that are left, and a text without any is one chunk.

A block is some 8 MB of text of one task. It gives one row per document, and one row per distinct pair of ids with the number
of its documents; only the latter are shuffled by pair, summed over the corpus, and handed back to their block, where they meet its documents. So a
pair that every document holds is one row a block and adds up before the shuffle.

Defined results: texts that are null, empty or that either tokenizer does not give back byte by byte (as where B's word mark stands in a text) have
no tokens: zeros and an empty groups_sha256. Strings of special tokens are plain text. Repeated rows and null ids are documents of their own. No documents give no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.llm import csr
from emberfield.llm.common import Batch, Stages, slices

BLOCK_BYTES = 8 << 20
BLOCK_SCHEMA = (
    "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, groups_sha256 string, "
    "at binary, times binary, local int, pair bigint, docs bigint"
)
LINK_SCHEMA = "doc_id bigint, a_at bigint, b_at bigint, a_id bigint, b_id bigint, n_bytes bigint"
#: Links per Arrow batch.
LINKS_OUT = 1 << 16
#: Chunks encoded at once; what the library returns of a chunk is large.
ENCODED = 4096
#: Characters of distinct chunks whose matrices are made together.
ALIGNED = 1 << 18
#: The word mark of the second tokenizer.
MARK = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WIDE = re.compile(r"\s\s|^\s|\s$").search
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_LOADED: dict[tuple[str, str], Pair] = {}


def byte_letters() -> dict[str, int]:
    """The letter of byte-level vocabularies for each byte: itself where it prints, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers with the bytes of every token."""

    def __init__(self, byte_json: str, piece_model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.first = tokenizers.Tokenizer.from_file(byte_json)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        letters = byte_letters()
        self.a_bytes = [b""] * self.first.get_vocab_size()
        for token, i in self.first.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = map(self.second.id_to_piece, range(self.second.get_piece_size()))
        self.b_bytes = [
            bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(MARK, " ").encode() for p in pieces
        ]
        ends = [(i, end) for side, end in ((self.a_bytes, "|"), (self.b_bytes, ";")) for i in range(len(side))]
        #: Ids of A, then of B, as decimals with a comma and with the end of their side of a group.
        self.tokens = np.array([f"{i}{e}" for i, end in ends for e in (",", end)], object)
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in own], np.int64) for own in (self.a_bytes, self.b_bytes))

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of ' ' + chunk by the first and of the chunk, to which the second adds its own space."""
        a: list[list[int]] = []
        for at in range(0, len(chunks), ENCODED):
            found = self.first.encode_batch_fast([" " + c for c in chunks[at : at + ENCODED]], add_special_tokens=False)
            a += [e.ids for e in found]
        return a, self.second.encode(chunks, num_threads=1)


def load(paths: tuple[str, str]) -> Pair:
    if paths not in _LOADED:
        _LOADED[paths] = Pair(*paths)
    return _LOADED[paths]


def chunks_of(text: str) -> list[str]:
    """The text cut at single spaces between other characters."""
    return _CUT.split(text) if _WIDE(text) else text.split(" ")


class Aligned(NamedTuple):
    """Token occurrences of some chunks after each other, and the products over them."""

    a: np.ndarray  # ids
    b: np.ndarray
    a_chunk: np.ndarray  # chunk of every token
    b_chunk: np.ndarray
    a_group: np.ndarray  # group of every token
    b_group: np.ndarray
    overlap: csr.Csr  # tokens of A x tokens of B: shared bytes
    good: np.ndarray  # chunks that both give back

    def shared(self) -> csr.Csr:
        """Tokens of A x tokens of B: 1 where both are of one group."""
        return csr.product(self.group_matrix(self.a_group), csr.transpose(self.group_matrix(self.b_group)))

    def group_matrix(self, groups: np.ndarray) -> csr.Csr:
        return csr.one_per_row(groups, 1 + int(max(self.a_group.max(initial=-1), self.b_group.max(initial=-1))))


def _cut_by_size(chunks: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of chunks of about ``size`` characters together, or of one chunk."""
    first = seen = 0
    for i, chunk in enumerate(chunks):
        if seen and seen + len(chunk) > size:
            yield first, i
            first, seen = i, 0
        seen += len(chunk) + 1
    if first < len(chunks):
        yield first, len(chunks)


def _flat(lists: list[list[int]], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists)) * keep
    kept = [i for own, k in zip(lists, keep) if k for i in own]
    return np.array(kept, np.int64), np.repeat(np.arange(len(lists)), counts)


def align(pair: Pair, chunks: list[str]) -> Aligned:
    a_lists, b_lists = pair.encode(chunks)
    good = np.fromiter(
        (
            (raw := (" " + c).encode()) == b"".join([pair.a_bytes[i] for i in a]) == b"".join([pair.b_bytes[i] for i in b])
            for c, a, b in zip(chunks, a_lists, b_lists)
        ),
        bool,
        len(chunks),
    )
    (a, a_chunk), (b, b_chunk) = _flat(a_lists, good), _flat(b_lists, good)
    incidence_a, incidence_b = csr.spans(pair.a_sizes[a]), csr.spans(pair.b_sizes[b])
    a_ends, b_ends = incidence_a.starts[1:], incidence_b.starts[1:]
    cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
    overlap = csr.product(incidence_a, csr.transpose(incidence_b))
    return Aligned(a, b, a_chunk, b_chunk, np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), overlap, good)


def group_texts(pair: Pair, own: Aligned, count: int) -> tuple[list[str], np.ndarray]:
    """For every chunk its groups as ``a1,a2|b1;a3|b2,b3;``, and how many they are.

    Every token is its id with the separator that follows it: a comma inside its side of a group, else the end of that side.
    """
    a_last = np.diff(own.a_group, append=-1) != 0
    b_last = np.diff(own.b_group, append=-1) != 0
    codes = np.concatenate([2 * own.a + a_last, 2 * (len(pair.a_bytes) + own.b) + b_last])
    order = np.argsort(np.concatenate([2 * own.a_group, 2 * own.b_group + 1]), kind="stable")
    chunk = np.concatenate([own.a_chunk, own.b_chunk])[order]
    ends = np.searchsorted(chunk, np.arange(count + 1)).tolist()
    parts = pair.tokens[codes[order]].tolist()
    return ["".join(parts[i:j]) for i, j in zip(ends, ends[1:])], np.bincount(own.a_chunk[a_last], minlength=count)


class Block:
    """Texts until their chunks are aligned together."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        own = chunks_of(text) if text else []
        index = self.index
        at = np.array([index.setdefault(c, len(index)) for c in own], np.int64)
        self.docs.append((doc_id, at))
        self.size += len(text or "") + 64

    def close(self, pair: Pair, block: int) -> Iterator[Batch]:
        chunks = list(self.index)
        names: list[str] = []
        parts: list[tuple[np.ndarray, ...]] = []
        codes: list[np.ndarray] = []
        for first, last in _cut_by_size(chunks, ALIGNED):
            own = align(pair, chunks[first:last])
            count = last - first
            texts, n_groups = group_texts(pair, own, count)
            names += texts
            each = lambda at, w=None: np.bincount(at, w, minlength=count).astype(np.int64)  # noqa: B023, E731
            n_shared = csr.work(own.group_matrix(own.a_group), csr.transpose(own.group_matrix(own.b_group)))
            parts.append((each(own.a_chunk), each(own.b_chunk), n_groups, each(own.a_chunk, n_shared), own.good))
            rows = own.overlap.rows()
            codes.append(np.stack([first + own.a_chunk[rows], (own.a[rows] << 32) | own.b[own.overlap.columns]]))
        empty = np.zeros(0, np.int64)
        n_a, n_b, n_groups, n_shared, good = (np.concatenate([empty, *c]) for c in zip(*parts)) if parts else [empty] * 5
        linked = np.concatenate([np.zeros((2, 0), np.int64), *codes], axis=1)
        pairs, local = np.unique(linked[1], return_inverse=True)
        by_chunk = csr.from_entries(linked[0], local, len(chunks), len(pairs))
        # A document with a chunk that is not given back has no tokens at all.
        whole = [bool(len(at)) and bool(good[at].all()) for _, at in self.docs]
        at = [at if w else at[:0] for (_, at), w in zip(self.docs, whole)]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in at])])
        flat = np.concatenate([np.zeros(0, np.int64), *at])
        held = csr.product(csr.Csr(starts, flat, np.ones(len(flat), np.int64), len(chunks)), by_chunk)
        docs = np.bincount(held.columns, minlength=len(pairs))
        out: dict[str, list] = {f: [] for f in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "at", "times")}
        for i, ((doc_id, _), mine) in enumerate(zip(self.docs, at)):
            span = slice(held.starts[i], held.starts[i + 1])
            times = held.values[span].astype("<i4")
            text = "".join([names[c] for c in mine.tolist()])[:-1]
            row = (
                doc_id, int(n_a[mine].sum()), int(n_b[mine].sum()), int(n_groups[mine].sum()), int(times.sum(dtype=np.int64)),
                int(n_shared[mine].sum()), hashlib.sha256(text.encode()).hexdigest() if whole[i] else "",
                held.columns[span].astype("<i4").tobytes(), times.tobytes(),
            )
            for column, value in zip(out.values(), row):
                column.append(value)
        yield _batch(len(self.docs), block, out)
        used = np.flatnonzero(docs)
        yield _batch(len(used), block, {"local": used.astype(np.int32), "pair": pairs[used], "docs": docs[used].astype(np.int64)})


_KINDS = [
    *((n, pa.int64()) for n in ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared")),
    ("groups_sha256", pa.string()), ("at", pa.binary()), ("times", pa.binary()), ("local", pa.int32()), ("pair", pa.int64()), ("docs", pa.int64()),
]


def _batch(rows: int, block: int, columns: dict) -> Batch:
    given = {"block": np.full(rows, block, np.int64), **columns}
    return Batch.from_arrays([pa.array(given[n], k) if n in given else pa.nulls(rows, k) for n, k in _KINDS], names=[n for n, _ in _KINDS])


def to_blocks(docs: DataFrame, paths: tuple[str, str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, text)`` to rows of documents (``pair`` null) and of id pairs, by block."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        pair = load(paths)
        number = TaskContext.get().partitionId() << 32
        block = Block()
        for batch in slices(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                block.add(doc_id, text)
                if block.size >= block_bytes:
                    yield from block.close(pair, number)
                    number, block = number + 1, Block()
        if block.docs:
            yield from block.close(pair, number)

    return docs.select("doc_id", "text").mapInArrow(run, BLOCK_SCHEMA)


def align_documents(
    docs: DataFrame, paths: tuple[str, str], block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Documents with their counts, and the corpus-wide table ``(a_id, b_id, docs, best)`` of linked id pairs.

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_shared (pairs of one group), groups_sha256, n_best (links whose pair is in as many documents
    as any of its A id) and count_sum (documents of the pair, summed over links).
    """
    stages = Stages(docs.sparkSession)
    blocks = stages.write(to_blocks(docs, paths, block_bytes))
    listed = blocks.where("pair is not null")
    summed = stages.write(listed.groupBy("pair").agg(F.sum("docs").alias("docs")))
    a_id = F.shiftright("pair", 32)
    most = summed.groupBy(a_id.alias("a_id")).agg(F.max("docs").alias("most"))
    counts = summed.withColumn("a_id", a_id).join(most, "a_id").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    handed = listed.select(F.col("block").alias("to_block"), "local", "pair").join(counts, "pair").select("to_block", "local", "docs", "best")

    def add_up(own: pa.Table, pairs: pa.Table) -> pa.Table:
        at = pairs["local"].to_numpy()
        size = int(at.max(initial=-1)) + 1
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        count[at], best[at] = pairs["docs"].to_numpy(), pairs["best"].to_numpy(zero_copy_only=False)
        sums, bests = [], []
        for columns, times in zip(own["at"].to_pylist(), own["times"].to_pylist()):
            index, n = np.frombuffer(columns, "<i4"), np.frombuffer(times, "<i4").astype(np.int64)
            sums.append(int(n @ count[index]))
            bests.append(int(n @ best[index]))
        kept = own.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256"])
        return kept.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    schema = (
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, groups_sha256 string, "
        "n_best bigint, count_sum bigint"
    )
    own = blocks.where("pair is null").select(
        "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "at", "times"
    )
    done = own.groupBy("block").cogroup(handed.groupBy("to_block")).applyInArrow(add_up, schema)
    low = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return done, counts.select(a_id.alias("a_id"), low.alias("b_id"), "docs", "best")


def links(docs: DataFrame, paths: tuple[str, str], shared: bool = False) -> DataFrame:
    """Every link of every document: numbers of its tokens in the document, their ids, and shared bytes (groups: 1)."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        pair = load(paths)
        for batch in slices(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = align(pair, [text] if text else [])
                for rows, columns, values in _linked(own, shared):
                    made = [pa.array([doc_id] * len(rows), pa.int64()), *map(pa.array, (rows, columns, own.a[rows], own.b[columns], values))]
                    yield Batch.from_arrays(made, names=["doc_id", "a_at", "b_at", "a_id", "b_id", "n_bytes"])

    return docs.select("doc_id", "text").mapInArrow(run, LINK_SCHEMA)


def _linked(own: Aligned, shared: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Entries of the product, some rows at a time."""
    if not shared:
        rows = own.overlap.rows()
        for at in range(0, len(rows), LINKS_OUT):
            part = slice(at, at + LINKS_OUT)
            yield rows[part], own.overlap.columns[part], own.overlap.values[part]
        return
    left, right = own.group_matrix(own.a_group), csr.transpose(own.group_matrix(own.b_group))
    ends = np.cumsum(csr.work(left, right))
    first = 0
    while first < left.height:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + LINKS_OUT, "right")))
        part = csr.product(csr.Csr(left.starts[first : last + 1] - left.starts[first], left.columns[first:last], left.values[first:last], left.width), right)
        yield part.rows() + first, part.columns, part.values
        first = last
