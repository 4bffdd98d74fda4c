"""Language-model scores by the likelihood of a subword lattice.

A word's lattice holds every way to cut it into pieces of an existing vocabulary (and single bytes); each piece has a
score, a path the sum of its scores, and the word the log of the sum over all paths, by a forward recursion in log
space. The scores start from those of the vocabulary file (ranks, read as a Zipf law) and are re-estimated twice from
the lattices' expected piece counts over all distinct training words. Pieces never cross words, so a text's
probability is the product over its words and one end, and each distinct word is scored once.

Words of the training rows are one more arc across their whole lattice: their count less a discount, while the
discounts together weigh the pieces, P(w) = (max(c - d, 0) + d V P_pieces(w)) / N, which is a proper distribution.

Layout: one pass turns documents into blocks of bounded size, each with its own word list and, per document, indices
into it. Word counts are summed over all blocks, scored once per distinct word and handed back to the blocks that
hold the word, so neither the vocabulary nor a text is ever in one task as a whole.

Defined results: null texts are empty (their score is that of the end alone); repeated rows and null ids are scored
like others and a null id's remainder is that of the empty text; without training rows every token is unknown; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfield.llm.common import Batch, Stages, crc_remainder, raw_texts, slices

FOLDS, HELD_OUT = 7, 2
#: Text bytes from which a block is closed.
BLOCK_BYTES = 24 << 20
#: Weight, in pieces, of the vocabulary's own scores against the counted ones.
PRIOR = 1000.0
FIXED = 1 << 16
#: Re-estimations of the scores.
ROUNDS = 2
GROUP = 8192


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces that lower-cased words can hold (a space marks a word's start) and single bytes, with log scores.

    The file's scores fall by one from piece to piece, so they are ranks; a Zipf law makes them probabilities. Bytes
    weigh as much as the last piece.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i)
        body = piece[1:] if piece.startswith("▁") else piece
        raw = body.encode()
        if "▁" in body or raw != raw.lower() or len(raw.split()) > 1 or (raw and raw != raw.strip()):
            continue
        found[(b" " if piece.startswith("▁") else b"") + raw] = 2.0 - model.get_score(i)
    last = max(found.values(), default=2.0)
    for byte in range(256):
        if byte not in b" \t\n\x0b\x0c\r":
            found.setdefault(bytes([byte]), last)
    found.setdefault(b" ", last)
    weights = 1.0 / np.array(list(found.values()))
    return list(found), np.log(weights / weights.sum())


class Lattice:
    """Log likelihoods of words, many of one length at a time, over a byte trie of the pieces."""

    def __init__(self, pieces: list[bytes]) -> None:
        # Bytes that no piece holds share a column; node 0 is dead, node 1 the root.
        used = sorted({b for p in pieces for b in p})
        self.column = np.zeros(256, np.int32)
        self.column[used] = np.arange(1, len(used) + 1)
        children: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for number, piece in enumerate(pieces):
            node = 1
            for byte in piece:
                node = children.setdefault((node, byte), len(children) + 2)
            ends[node] = number
        self.step = np.zeros((len(children) + 2, len(used) + 1), np.int32)
        for (node, byte), after in children.items():
            self.step[node, self.column[byte]] = after
        self.piece = np.full(len(children) + 2, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())

    def _forward(self, words: list[bytes], scores: np.ndarray, arcs: list | None) -> np.ndarray:
        count, length = len(words), len(words[0])
        columns = self.column[np.frombuffer(b"".join(words), np.uint8).reshape(count, length).T]
        alpha = np.full((length + 1, count), -np.inf)
        alpha[0] = 0.0
        for start in range(length):
            rows = np.flatnonzero(alpha[start] > -np.inf)
            node = np.ones(len(rows), np.int32)
            for at in range(start, length):
                node = self.step[node, columns[at, rows]]
                alive = node > 0
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                piece = self.piece[node]
                whole = piece >= 0
                own, piece = rows[whole], piece[whole]
                alpha[at + 1, own] = np.logaddexp(alpha[at + 1, own], alpha[start, own] + scores[piece])
                if arcs is not None:
                    arcs.append((start, at + 1, own, piece))
        return alpha

    def _groups(self, words: list[bytes]) -> Iterator[np.ndarray]:
        """Positions of words of one length, at most ``GROUP`` at a time, fewer of long ones."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            own = lengths[order[at]]
            end = at + int(np.searchsorted(lengths[order[at : at + max(1, GROUP * 16 // max(16, own))]], own, "right"))
            yield order[at:end]
            at = end

    def likelihoods(self, words: list[bytes], scores: np.ndarray) -> np.ndarray:
        """Natural log of every word's marginal probability over all segmentations."""
        out = np.empty(len(words))
        for group in self._groups(words):
            out[group] = self._forward([b" " + words[i] for i in group], scores, None)[-1]
        return out

    def expected(self, words: list[bytes], scores: np.ndarray) -> np.ndarray:
        """Expected count of every piece over all segmentations of the words, by a backward recursion over the arcs."""
        counts = np.zeros(len(scores))
        for group in self._groups(words):
            arcs: list = []
            alpha = self._forward([b" " + words[i] for i in group], scores, arcs)
            beta = np.full(alpha.shape, -np.inf)
            beta[-1] = 0.0
            for start, end, own, piece in reversed(arcs):
                ahead = scores[piece] + beta[end, own]
                beta[start, own] = np.logaddexp(beta[start, own], ahead)
                share = np.exp(alpha[start, own] + ahead - alpha[-1, own])
                counts += np.bincount(piece, share, len(counts))
        return counts


_LATTICES: dict[str, Lattice] = {}


def _lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(vocabulary(path)[0])
    return _LATTICES[path]


BLOCK_SCHEMA = (
    "block bigint, doc_id bigint, held_out boolean, n_words bigint, steps binary, counts binary, "
    "word string, local int, train bigint"
)


def to_blocks(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Documents (indices into the block's word list as steps, and counts) and the words of each block, in one table."""
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]

    def packed(block: int, docs: list[tuple], index: dict[bytes, int], train: np.ndarray) -> Iterator[Batch]:
        n = len(docs)
        own = [[block] * n, *zip(*docs), [None] * n, [None] * n, [None] * n]
        yield Batch.from_arrays([pa.array(c, k) for c, k in zip(own, kinds)], names=names)
        n = len(index)
        words = pa.array(list(index), pa.binary()).cast(pa.string())
        filled = [pa.array([block] * n, pa.int64()), *(pa.nulls(n, k) for k in kinds[1:6])]
        yield Batch.from_arrays([*filled, words, pa.array(np.arange(n, dtype=np.int32)), pa.array(train)], names=names)

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        task, number, size = TaskContext.get().partitionId(), 0, 0
        index: dict[bytes, int] = {}
        docs: list[tuple] = []
        train: list[np.ndarray] = []

        def close() -> Iterator[Batch]:
            total = np.zeros(len(index), np.int64)
            for at in train:
                np.add.at(total, at[0], at[1])
            return packed(task << 32 | number, docs, index, total)

        for batch in slices(batches, 1):
            for doc_id, held, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), raw_texts(batch.column(1))):
                own = raw.lower().split()
                at, counts = np.unique(np.fromiter((index.setdefault(w, len(index)) for w in own), np.int32, len(own)), return_counts=True)
                counts = counts.astype(np.int32)
                docs.append((doc_id, held, len(own), np.diff(at, prepend=np.int32(0)).tobytes(), counts.tobytes()))
                if not held:
                    train.append((at, counts))
                size += len(raw)
                if size >= BLOCK_BYTES:
                    yield from close()
                    number, size, index, docs, train = number + 1, 0, {}, [], []
        if docs:
            yield from close()

    held = crc_remainder(F.col("doc_id"), folds) == held_out
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, BLOCK_SCHEMA)


def _estimate(types: DataFrame, path: str, start: np.ndarray, now: np.ndarray) -> np.ndarray:
    """New log scores of the pieces: expected counts over the given words, each once, and the first ones as prior."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        lattice, total = _lattice(path), np.zeros(len(start))
        for batch in batches:
            total += lattice.expected(batch.column(0).cast(pa.binary()).to_pylist(), now)
        fixed = np.rint(total * FIXED).astype(np.int64)
        at = np.flatnonzero(fixed)
        yield Batch.from_pydict({"piece": at.astype(np.int64), "n": fixed[at]})

    sums = types.select("word").mapInArrow(run, "piece bigint, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = PRIOR * np.exp(start)
    for r in sums.collect():  # at most one row per piece of the vocabulary
        counts[r["piece"]] += r["n"] / FIXED
    return np.log(counts / counts.sum())


def score_documents(docs: DataFrame, path: str, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """``(doc_id, text)`` to doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (both log10)."""
    stages = Stages(docs.sparkSession)
    blocks = stages.write(to_blocks(docs, folds, held_out))
    listed = blocks.where("word is not null").select("block", "local", "word", "train")
    counted = stages.write(listed.groupBy("word").agg(F.sum("train").alias("c")))
    ends = blocks.where("word is null and not held_out").count()
    seen = counted.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.count_if(F.col("c") > 0).alias("v"),
        F.count_if(F.col("c") == 1).alias("n1"),
        F.count_if(F.col("c") == 2).alias("n2"),
    ).first()
    n_words, types = seen["n"], seen["v"]
    discount = seen["n1"] / (seen["n1"] + 2 * seen["n2"]) if seen["n1"] else 0.5
    tokens, distinct = n_words + ends, types + bool(ends)
    floor = math.log10(tokens + distinct + 1)
    start = vocabulary(path)[1]
    scores = start
    for _ in range(ROUNDS if types else 0):
        scores = _estimate(counted.where("c > 0"), path, start, scores)
    # An end after no training rows is as likely as a word; one pseudo-count each keeps both above zero.
    end_share = (ends + 1) / (tokens + 2)
    left_over = discount * types / n_words if n_words else 1.0

    def weigh(batches: Iterator[Batch]) -> Iterator[Batch]:
        lattice = _lattice(path)
        for batch in batches:
            c = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            pieces = np.log10(np.e) * lattice.likelihoods(batch.column(0).cast(pa.binary()).to_pylist(), scores)
            own = np.maximum(c - discount, 0.0) / n_words if n_words else np.zeros(len(c))
            with np.errstate(divide="ignore"):
                both = np.logaddexp(np.log(own), np.log(left_over) + pieces * np.log(10)) / np.log(10)
            yield Batch.from_pydict(
                {"word": batch.column(0), "known": c > 0, "base": np.log10(c + 1) - floor, "lp": both + math.log10(1 - end_share)}
            )

    weighed = counted.select("word", "c").mapInArrow(weigh, "word string, known boolean, base double, lp double")
    handed = listed.select("block", "local", "word").join(weighed, "word").select(F.col("block").alias("to_block"), "local", "known", "base", "lp")
    base_end, lp_end, known_end = math.log10(ends + 1) - floor, math.log10(end_share), int(ends > 0)

    def add_up(own: pa.Table, words: pa.Table) -> pa.Table:
        size = words.num_rows
        at = words["local"].to_numpy()
        known, base, lp = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        known[at] = words["known"].to_numpy(zero_copy_only=False)
        base[at], lp[at] = words["base"].to_numpy(), words["lp"].to_numpy()
        rows = []
        for steps, counts in zip(own["steps"].to_pylist(), own["counts"].to_pylist()):
            index, n = np.cumsum(np.frombuffer(steps, np.int32)), np.frombuffer(counts, np.int32)
            rows.append((known_end + int(n @ known[index]), base_end + float(n @ base[index]), lp_end + float(n @ lp[index])))
        k, b, s = zip(*rows) if rows else ([], [], [])
        return pa.table(
            {
                "doc_id": own["doc_id"],
                "held_out": own["held_out"],
                "n_tokens": pa.array([n + 1 for n in own["n_words"].to_pylist()], pa.int64()),
                "n_known": pa.array(k, pa.int64()),
                "train_tokens": pa.array([tokens] * len(k), pa.int64()),
                "base_score": pa.array(b, pa.float64()),
                "score": pa.array(s, pa.float64()),
            }
        )

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    texts = blocks.where("word is null").select("block", "doc_id", "held_out", "n_words", "steps", "counts")
    return texts.groupBy("block").cogroup(handed.groupBy("to_block")).applyInArrow(add_up, schema)
