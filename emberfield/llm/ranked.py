"""Exact ranked retrieval of documents for items by a dual-tree search.

A document is a sparse vector: a term's coordinate is its weight times its saturated frequency, so that an item's score is the sum of the coordinates of its
terms. Two hierarchies hold coordinate maxima: items are split by what they share down to single ones, a node having every term
of its items; documents of a block are put in order of their heaviest coordinate and grouped 16 and then 8 at a time, a node having the greatest
coordinate of each term. The sum of a document node's maxima over an item node's terms is a bound for all pairs below the two, and
where it is less than the weakest k-th score of the node's items, all of them are passed over. At single items and documents the bound is the score itself.

Passes: documents are tokenised once per block of items (blocks hold a bounded number of terms; one block unless there are very many items)
into postings of the block's terms; counts of documents, terms and holders are added up by task. Weights follow, at most one per term of the block. A
first search over one in ``SEED`` documents gives every item a k-th score that all documents can only raise; the search over all documents starts with
it, so that tasks emit little. Each task gives at most k rows an item, which are merged by rank.

Defined results: null texts, texts without terms and items without known terms rank nothing and count nowhere. Repeated items are ranked each, repeated
documents are documents of their own; equal scores go to the smaller doc_id, null last. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberfield.llm.common import Batch, Stages, raw_texts, slices

K = 10
#: Distinct terms of the items that are searched together, at most about so many.
ITEM_TERMS = 500_000
#: Documents of one hierarchy, and how many nodes each level takes together.
DOCS, FIRST, NEXT = 4096, 16, 8
#: One in so many documents, by hash, is searched before all are.
SEED = 64
WINDOW = 4 << 20
NONE = (1 << 63) - 1
_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256)
)
POSTINGS = "doc_id bigint, n bigint, terms binary, counts binary, docs bigint"


def words(raw: bytes) -> Iterator[list[bytes]]:
    """Terms of a text: runs of ASCII letters and digits and all that is beyond ASCII, A-Z lower-cased; some megabytes at a time."""
    at = 0
    while at < len(raw):
        end = at + WINDOW
        while end < len(raw) and _LOWER[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(_LOWER).split(b" ")
        at = end


def term_counts(raw: bytes) -> Counter:
    found: Counter = Counter()
    for part in words(raw):
        found.update(part)
    found.pop(b"", None)
    return found


def item_table(items: DataFrame) -> DataFrame:
    """``(item_id, text)`` to ``(item_row, item_id, terms)`` of the items with terms; numbers hold once it is written."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        for batch in batches:
            terms = [sorted(term_counts(t)) for t in raw_texts(batch.column(1))]
            yield Batch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], names=["item_id", "terms"])

    made = items.select("item_id", "text").mapInArrow(run, "item_id bigint, terms array<binary>")
    return made.where(F.size("terms") > 0).withColumn("item_row", F.monotonically_increasing_id())


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row per document with known terms; and per task a row of sums (``docs`` not null): documents, terms, holders of each term."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        known, size = vocabulary.get, len(vocabulary)
        held, n_docs, n_terms = np.zeros(size, np.int64), 0, 0
        names = ["doc_id", "n", "terms", "counts", "docs"]
        for batch in slices(batches, 1):
            rows = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                n, mine = 0, []
                for part in words(raw):
                    n += len(part) - part.count(b"")
                    mine += [i for i in map(known, part) if i is not None]
                if n:
                    n_docs, n_terms = n_docs + 1, n_terms + n
                if mine:
                    terms, counts = np.unique(np.array(mine, np.int32), return_counts=True)
                    held[terms] += 1
                    rows.append((doc_id, n, terms.astype("<i4").tobytes(), counts.astype("<i8").tobytes(), None))
            yield _columns(rows, names)
        at = np.flatnonzero(held)
        yield _columns([(None, n_terms, at.astype("<i4").tobytes(), held[at].astype("<i8").tobytes(), n_docs)], names)

    return docs.select("doc_id", "text").mapInArrow(run, POSTINGS)


def _columns(rows: list[tuple], names: list[str]) -> Batch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    columns = list(zip(*rows)) or [()] * len(names)
    return Batch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def weights(made: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Weight of every term of the vocabulary, number of documents, number of terms with repeats."""
    sums = made.where("docs is not null")

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[np.frombuffer(terms, "<i4")] += np.frombuffer(counts, "<i8")
        at = np.flatnonzero(held)
        yield Batch.from_pydict({"term": at, "df": held[at]})

    n_docs, n_terms = (int(x or 0) for x in sums.agg(F.sum("docs"), F.sum("n")).first())
    found = sums.select("terms", "counts").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    own = np.zeros(size, np.int64)
    for r in found.collect():  # at most one row per term of the block of items
        own[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    return own, n_docs, n_terms


class ItemNode:
    """Items with every term of any of them; ``parts`` is empty for a single item."""

    def __init__(self, items: list[int], terms: list[np.ndarray], weight: np.ndarray) -> None:
        self.items = items
        self.terms = np.unique(np.concatenate([terms[i] for i in items]))
        self.parts: list[ItemNode] = []
        if len(items) > 1:
            self.parts = [ItemNode(part, terms, weight) for part in _split(items, terms, weight)]


def _split(items: list[int], terms: list[np.ndarray], weight: np.ndarray) -> list[list[int]]:
    """Halves: items that share most with the first against those that share least."""
    first = np.zeros(len(weight), np.int64)
    first[terms[items[0]]] = weight[terms[items[0]]]
    near = np.array([first[terms[i]].sum() / (1 + weight[terms[i]].sum()) for i in items])
    near[0] = np.inf
    order = np.argsort(-near, kind="stable")
    half = len(items) // 2
    return [[items[i] for i in order[:half]], [items[i] for i in order[half:]]]


class Level:
    """Nodes by rows: terms of each with the greatest coordinate."""

    def __init__(self, node: np.ndarray, term: np.ndarray, value: np.ndarray, count: int, width: int) -> None:
        key = node * width + term
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.diff(key, prepend=-1))
        self.values = np.maximum.reduceat(value[order], at) if len(at) else value[:0]
        self.nodes, self.terms = np.divmod(key[at], width)
        self.starts = np.searchsorted(self.nodes, np.arange(count + 1))
        self.count = count

    def bounds(self, nodes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Sums of the nodes' values over the chosen terms (a 0/1 vector over all terms)."""
        if len(nodes) == self.count:
            sums = np.concatenate([[0], np.cumsum(self.values * chosen[self.terms])])
            return np.diff(sums[self.starts])
        size = self.starts[nodes + 1] - self.starts[nodes]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[nodes] - (ends - size), size)
        sums = np.concatenate([[0], np.cumsum(self.values[at] * chosen[self.terms[at]])])
        return np.diff(sums[np.concatenate([[0], ends])])


class Search:
    """Best k documents of every item so far, and the search of further blocks of documents."""

    def __init__(self, terms: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, floors: np.ndarray, k: int) -> None:
        self.weight, self.n_docs, self.n_terms, self.k = weight, n_docs, n_terms, k
        self.root = ItemNode(list(range(len(terms))), terms, weight) if terms else None
        self.floors = floors.copy()
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in terms]
        self.chosen = np.zeros(len(weight), np.int64)
        self.scored = self.bounded = 0

    def coordinates(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        if int(n.max(initial=0)) * 90 * self.n_docs < NONE:
            m = 10 + (90 * n * self.n_docs) // self.n_terms
        else:
            m = np.array([10 + (90 * int(x) * self.n_docs) // self.n_terms for x in n], np.int64)
        return self.weight[term] * ((1_000_000_000 * count) // (1000 * count + 8 * m[doc]))

    def add(self, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        """One block: doc_id and length of its documents; document, term and count of its postings (by document)."""
        value = self.coordinates(n, doc, term, count)
        width, size = len(self.weight), len(ids)
        # Documents of one heaviest term go together; the greater its coordinate, the earlier.
        order = np.lexsort((value, doc))
        last = np.flatnonzero(np.diff(doc[order], append=-1))
        top = order[last]
        place = np.empty(size, np.int64)
        place[doc[top][np.lexsort((-value[top], term[top]))]] = np.arange(len(top))
        ids, own = self._moved(ids, place), place[doc]
        levels = [Level(own, term, value, size, width)]
        step = FIRST
        while levels[-1].count > NEXT:
            below = levels[-1]
            levels.append(Level(below.nodes // step, below.terms, below.values, -(-below.count // step), width))
            step = NEXT
        self.levels, self.ids = levels, ids
        self.visit(self.root, len(levels) - 1, np.arange(levels[-1].count))

    @staticmethod
    def _moved(values: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.empty_like(values)
        out[place] = values
        return out

    def visit(self, node: ItemNode, level: int, nodes: np.ndarray) -> None:
        """All documents below the nodes of a level against all items below the item node."""
        self.chosen[node.terms] = 1
        found = self.levels[level].bounds(nodes, self.chosen)
        self.chosen[node.terms] = 0
        kept = (found >= min(self.floors[i] for i in node.items)) & (found > 0)
        nodes, found = nodes[kept], found[kept]
        if not len(nodes):
            return
        if level == 0 and not node.parts:
            self.scored += len(kept)
            self.take(node.items[0], nodes, found)
            return
        self.bounded += len(kept)
        # Single documents are left for single items.
        if level > 1 or (level == 1 and not node.parts):
            step = FIRST if level == 1 else NEXT
            nodes = (nodes[:, None] * step + np.arange(step)).ravel()
            nodes = nodes[nodes < self.levels[level - 1].count]
            level -= 1
        for part in node.parts or [node]:
            self.visit(part, level, nodes)

    def take(self, item: int, nodes: np.ndarray, scores: np.ndarray) -> None:
        scores, ids = np.concatenate([self.best[item][0], scores]), np.concatenate([self.best[item][1], self.ids[nodes]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[item] = scores[order], ids[order]
        if len(order) == self.k:
            self.floors[item] = max(self.floors[item], scores[order[-1]])


def search(made: DataFrame, terms: list[np.ndarray], known: tuple[np.ndarray, int, int], floors: np.ndarray, k: int) -> DataFrame:
    """Postings to ``(item, doc_id, score)``: the best k of every task, those that can be among the best k of all."""
    weight, n_docs, n_terms = known

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        own = Search(terms, weight, n_docs, n_terms, floors, k)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                ids = part.column(0).fill_null(NONE).to_numpy()
                rows = [np.frombuffer(t, "<i4") for t in part.column(2).to_pylist()]
                counts = np.frombuffer(b"".join(part.column(3).to_pylist()), "<i8")
                doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
                own.add(ids, part.column(1).to_numpy(), doc, np.concatenate(rows).astype(np.int64), counts)
        for item, (scores, ids) in enumerate(own.best):
            kept = scores >= own.floors[item]
            none = ids[kept] == NONE
            yield Batch.from_arrays(
                [pa.array(np.full(int(kept.sum()), item, np.int64)), pa.array(ids[kept], mask=none), pa.array(scores[kept])],
                names=["item", "doc_id", "score"],
            )

    return made.where("docs is null").select("doc_id", "n", "terms", "counts").mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K, item_terms: int = ITEM_TERMS, seed: int = SEED) -> DataFrame:
    """``(doc_id, text)`` and ``(item_id, text)`` to item_id, rank (from 1), doc_id and score of the best k documents of each item."""
    spark = docs.sparkSession
    stages = Stages(spark)
    table = stages.write(item_table(items))
    total = table.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // item_terms))
    parts = []
    for block in range(blocks):
        rows = table.where(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == block).select("item_id", "terms").collect()
        vocabulary: dict[bytes, int] = {}
        terms = [np.array(sorted(vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r["terms"]), np.int64) for r in rows]
        if not rows:
            continue
        made = stages.write(postings(docs, vocabulary))
        known = weights(made, len(vocabulary))
        floors = np.zeros(len(rows), np.int64)
        if known[1] and seed > 1:
            some = made.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(seed)) == 0)
            for r in _ranked(search(some, terms, known, floors, k), k).where(F.col("rank") == k).select("item", "score").collect():
                floors[r["item"]] = r["score"]  # at most one row per item of the block
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item bigint, item_id bigint")
        best = stages.write(_ranked(search(made, terms, known, floors, k), k))
        stages.drop(made)
        parts.append(best.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
