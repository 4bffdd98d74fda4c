"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8 are linked, links make components.

Texts are compared as lower-case words. Candidates come from the caller (``simhash.keep_one``: fingerprints within two bits) and from
min-hashes, for the pairs at 0.8 whose fingerprints differ by more: ``BANDS`` x ``ROWS`` of a text give one signature per band, and two texts at
similarity s share one with probability 1 - (1 - s^6)^32: 0.9999 at 0.8. Every link is decided on whole shingle sets, so no pair below
the limit is linked. Exact copies are one text. Signatures shared by the same texts are looked at once.

First every text of a signature meets ``PIVOTS`` of them, whatever their number; the links found make components. One pivot is the text whose
signatures are shared most: in a group of copies the one that the others differ least from. Only where a signature has more than one
component left, texts outside its largest one meet texts of other components. A shingle that no other text of such signatures holds is never in
common, so the number of the remaining ones bounds every similarity of a text from above, and with it the sizes of partners (``with_reach``): most
changed copies reach nobody. Those that do meet the texts of these sizes in blocks that hold 16 bits of each min-hash and the hashed shingles: pairs that
the bound rules out, or that agree in fewer than ``LEAST_EQUAL`` of 192 (one pair at 0.8 in fifty thousand does, fewer above), are passed
over, the others are compared by their hashed shingles there, and only links between components not yet joined in the block leave it.

What is shuffled is narrow: texts are read where they lie, by marks of their row numbers, and only candidates' bodies move.

Defined results: texts of fewer than five words are one shingle; null and wordless texts are copies of each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.llm.common import Batch, Stages, map_texts, numbered, raw_texts, sieved, slices
from emberfield.llm.components import components

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 6
#: Texts of a block, where a signature has components left to compare, and their shingles.
DENSE, BLOCK_SHINGLES = 256, 1 << 18
#: Texts of a signature that all others of it meet first.
PIVOTS = 3
#: Classes of sizes (numbers of shingles) for a doubling.
CLASSES = 16
#: Partners of one text that are decided together, about; and keys that the texts of a signature are dealt over.
GROUP, SALTS = 64, 16
#: Of 192 min-hashes two texts at 0.8 share 154 on average, with a deviation of 5.5.
LEAST_EQUAL = 131
_CHUNK = 512
_rng = np.random.default_rng(42)
_FACTORS = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def shingles(raw: bytes, length: int = SHINGLE) -> set[bytes]:
    own = raw.lower().split()
    if len(own) <= length:
        return {b" ".join(own)} if own else set()
    return set(map(b" ".join, zip(*(own[i:] for i in range(length)))))


def digest(raw: bytes) -> int:
    """One number for texts of the same lower-case words."""
    return xxhash.xxh64_intdigest(b" ".join(raw.lower().split()), 42) - (1 << 63)


def shingle_hashes(raw: bytes, length: int = SHINGLE) -> np.ndarray:
    parts = shingles(raw, length)
    return np.fromiter(map(xxhash.xxh64_intdigest, parts), "<u8", len(parts))


def least_hashes(hashes: np.ndarray) -> np.ndarray | None:
    """The min-hashes of a text by its shingles' hashes; a wordless one has none."""
    if not len(hashes):
        return None
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, ((hashes[at : at + _CHUNK] ^ _SHIFTS) * _FACTORS).min(axis=1), out=least)
    return least


def signatures(least: np.ndarray) -> list[int]:
    return [xxhash.xxh64_intdigest(row.tobytes(), i) - (1 << 63) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def bands(raw: bytes, length: int = SHINGLE) -> list[int]:
    """The signatures of a text; a wordless one has none."""
    least = least_hashes(shingle_hashes(raw, length))
    return [] if least is None else signatures(least)


def similar(a: set[bytes], b: set[bytes], limit: tuple[int, int] = SIMILAR) -> bool:
    over, under = limit
    if under * min(len(a), len(b)) < over * max(len(a), len(b)):
        return False
    both = len(a & b)
    return under * both >= over * (len(a) + len(b) - both)


def with_signatures(df: DataFrame, text: str, length: int = SHINGLE) -> DataFrame:
    """All columns, ``digest``, ``size`` (shingles), ``bands`` and ``mins`` (16 bits of every min-hash; empty for a wordless text)."""

    def factory() -> Callable[[Batch], dict]:
        def run(batch: Batch) -> dict:
            texts = raw_texts(batch.column(batch.schema.get_field_index(text)))
            hashes = [shingle_hashes(t, length) for t in texts]
            least = [least_hashes(h) for h in hashes]
            return {
                "digest": [digest(t) for t in texts],
                "size": [len(h) for h in hashes],
                "bands": [[] if m is None else signatures(m) for m in least],
                "mins": [b"" if m is None else m.astype("<u2").tobytes() for m in least],
            }

        return run

    return map_texts(df, text, factory, "digest bigint, size int, bands array<bigint>, mins binary")


def _decide(length: int, limit: tuple[int, int]) -> Callable[[pa.Table], pa.Table]:
    """Links of one text (``first``) with the others of the group; one other set is held at a time."""

    def run(group: pa.Table) -> pa.Table:
        names, first = group["digest"].to_pylist(), group["first"].to_pylist()
        texts = raw_texts(group["body"].combine_chunks())
        own = first.index(True)
        mine = shingles(texts[own], length)
        out = [n for n, f, t in zip(names, first, texts) if not f and similar(mine, shingles(t, length), limit)]
        return pa.table({"u": pa.array([names[own]] * len(out), pa.int64()), "v": pa.array(out, pa.int64())})

    return run


def decided(pairs: DataFrame, bodies: DataFrame, length: int = SHINGLE, limit: tuple[int, int] = SIMILAR) -> DataFrame:
    """The similar ones of distinct pairs ``(u, v)``, a written table. A text ``u`` with many partners is dealt over groups of about ``GROUP`` of them."""
    hubs = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups")).where("groups > 1")
    part = F.when(F.col("groups").isNull(), 0).otherwise(F.pmod(F.xxhash64("u", "v"), F.col("groups"))).cast("int")
    dealt = pairs.join(hubs, "u", "left").select("u", part.alias("part"), "v")
    others = dealt.select("u", "part", F.col("v").alias("digest"), F.lit(False).alias("first"))
    hosts = dealt.select("u", "part").distinct().select("u", "part", F.col("u").alias("digest"), F.lit(True).alias("first"))
    met = others.unionByName(hosts).join(bodies.select("digest", "body"), "digest")
    return met.groupBy("u", "part").applyInArrow(_decide(length, limit), "u bigint, v bigint")


def _stars(shared: DataFrame) -> DataFrame:
    """Every text of a signature with the pivots of the signature: the text whose signatures are shared most, and the least by hashes that are the
    same everywhere."""
    weights = shared.groupBy("digest").agg(F.sum("n").alias("w"))
    keys = [F.struct(F.negative("w").alias("k"), F.xxhash64("digest").alias("h"), "digest")]
    keys += [F.struct(F.lit(0).cast("bigint").alias("k"), F.xxhash64("digest", F.lit(i)).alias("h"), "digest") for i in range(1, PIVOTS)]
    names = [f"p{i}" for i in range(PIVOTS)]
    pivots = shared.join(weights, "digest").groupBy("sig", "salt").agg(*(F.min(k).alias(p) for k, p in zip(keys, names)))
    handed = pivots.select("sig", "salt").join(pivots.groupBy("sig").agg(*(F.min(p).alias(p) for p in names)), "sig")
    met = shared.join(handed, ["sig", "salt"])
    named = met.select("digest", F.explode(F.array_distinct(F.array(*(f"{p}.digest" for p in names)))).alias("u"))
    return named.where("digest <> u").select("u", F.col("digest").alias("v")).distinct()


def lone_shingles(bodies: DataFrame, length: int = SHINGLE) -> DataFrame:
    """``(digest, lone)``: how many shingles of a text are in no other one; texts without such are absent."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        for batch in slices(batches, 1):
            for name, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                hashes = shingle_hashes(text, length).view("<i8")
                yield Batch.from_arrays([pa.array(hashes), pa.array(np.full(len(hashes), name, "<i8"))], names=["h", "digest"])

    held = bodies.select("digest", "body").mapInArrow(run, "h bigint, digest bigint")
    once = held.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("digest")).where("n = 1")
    return once.groupBy("digest").agg(F.count(F.lit(1)).alias("lone"))


def with_reach(sized: DataFrame, lone: DataFrame, limit: tuple[int, int] = SIMILAR) -> DataFrame:
    """``digest, size`` with ``held``, the shingles that others hold too, and ``low`` and ``high``, the sizes of texts that can be similar.

    Two texts of sizes a and b with o shingles in common are similar if (over + under) * o >= over * (a + b); o is at most ``held`` and at most b.
    """
    over, under = limit
    bound = sized.join(lone, "digest", "left").withColumn("held", F.col("size") - F.coalesce("lone", F.lit(0)))
    high = F.floor((over + under) * F.col("held") / over) - F.col("size")
    return bound.select("digest", "size", "held", F.ceil(over * F.col("size") / under).alias("low"), high.alias("high")).where("low <= high")


def _alike(limit: tuple[int, int]) -> Callable[[pa.Table], pa.Table]:
    """Links of one block, from texts outside the largest component to all of other components, by hashed shingles. What others hold of
    the texts and their min-hashes rule most pairs out, and components that the block has joined already are not compared again."""
    over, under = limit

    def run(group: pa.Table) -> pa.Table:
        mins = np.frombuffer(b"".join(group["mins"].to_pylist()), "<u2").reshape(-1, BANDS * ROWS)
        sets = [np.frombuffer(h, "<u8") for h in group["hashes"].to_pylist()]
        names, roots, sizes, held = (group[c].to_numpy() for c in ("digest", "root", "size", "held"))
        rest = group["rest"].to_numpy(zero_copy_only=False)
        here, there = np.flatnonzero(rest), np.flatnonzero(~rest)
        above: dict[int, int] = {}
        out = []

        def top(root: int) -> int:
            while root in above:
                root = above[root]
            return root

        for i in here:
            able = (over + under) * np.minimum(held[there], held[i]) >= over * (sizes[there] + sizes[i])
            near = there[able & (roots[there] != roots[i])]
            for j in near[(mins[near] == mins[i]).sum(axis=1) >= LEAST_EQUAL]:
                one, other = top(roots[i]), top(roots[j])
                if one == other:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if under * both >= over * (sizes[i] + sizes[j] - both):
                    above[one] = other
                    out.append((min(names[i], names[j]), max(names[i], names[j])))
        u, v = zip(*out) if out else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _with_hashes(bodies: DataFrame, length: int) -> DataFrame:
    """``hashes``, the sorted hashes of all shingles of ``body``, in its place."""

    def factory() -> Callable[[Batch], dict]:
        def run(batch: Batch) -> dict:
            texts = raw_texts(batch.column(batch.schema.get_field_index("body")))
            return {"hashes": [np.unique(shingle_hashes(t, length)).tobytes() for t in texts]}

        return run

    return map_texts(bodies, "body", factory, "hashes binary").drop("body")


def _open_members(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Texts of signatures with several components: ``sig, digest, root`` and whether they are outside the largest one."""
    named = shared.join(roots.withColumnsRenamed({"u": "digest", "v": "root"}), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    sizes = named.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("n"))
    tops = sizes.groupBy("sig").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("c"))
    most = tops.where("c > 1").select("sig", F.col("top.root").alias("most"))
    return named.join(most, "sig").select("sig", "digest", "root", (F.col("root") != F.col("most")).alias("rest"))


def _left_over(members: DataFrame, reaching: DataFrame, dense: int, limit: tuple[int, int]) -> DataFrame:
    """Links found among open members; ``reaching`` has the texts that reach any size, others meet nobody."""
    of_size = lambda c: F.floor(F.log2(c) * CLASSES).cast("int")
    able = members.join(reaching.select("digest", "size", "low", "high"), "digest")
    wanted = F.explode(F.sequence(of_size(F.col("low")), of_size(F.col("high"))))
    from_rest = able.where("rest").withColumn("class", wanted)
    whole = able.withColumn("class", of_size(F.col("size")))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / dense, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    number = lambda df, n: df.groupBy("sig", "class").agg(blocks.alias(n))
    counts = number(from_rest, "x_all").join(number(whole, "y_all"), ["sig", "class"])
    at = F.xxhash64("digest", "sig")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    one = lambda count: F.pmod(at, F.col(count)).cast("int")
    columns, wide = ["sig", "class", "x", "y", "digest", "root", "size", "held", "mins", "hashes"], reaching.drop("low", "high")
    deal = lambda df, x, y, rest: (
        df.select("sig", "class", "digest", "root").join(counts, ["sig", "class"]).join(wide, "digest").withColumns({"x": x, "y": y})
        .select(*columns, F.lit(rest).alias("rest"))
    )
    dealt = deal(from_rest, one("x_all"), every("y_all"), True).unionByName(deal(whole, every("x_all"), one("y_all"), False))
    return dealt.groupBy("sig", "class", "x", "y").applyInArrow(_alike(limit), "u bigint, v bigint").distinct()


def _shared(staged: DataFrame, stages: Stages) -> DataFrame:
    """``(digest, sig, n, salt)`` of signatures that several texts share; of signatures with the same texts one is enough."""
    index = staged.select("digest", F.explode("bands").alias("sig"))
    several = index.groupBy("sig").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).where("a <> z")
    twice = stages.write(several.select("sig"))
    held = stages.write(sieved(index, twice, "sig").distinct().join(twice, "sig"))
    sizes = held.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("digest")).alias("mark"))
    once = sizes.groupBy("n", "mark").agg(F.min("sig").alias("sig")).select("sig", "n")
    shared = stages.write(held.join(once, "sig").withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS))))
    stages.drop(twice, held)
    return shared


def groups(
    staged: DataFrame,
    text: str,
    stages: Stages,
    dense: int = DENSE,
    candidates: DataFrame | None = None,
    length: int = SHINGLE,
    limit: tuple[int, int] = SIMILAR,
) -> DataFrame:
    """``row``, ``digest``, ``size``, ``bands``, ``mins`` and a text, and further ``candidates`` ``(u, v)`` of digests, to ``(digest, root)``:
    every text but the one that names its component.

    The result is a written table; all others made here are dropped.
    """
    shared = _shared(staged, stages)
    stars = _stars(shared)
    pairs = stages.write(stars if candidates is None else stars.unionByName(candidates.select("u", "v")).distinct())
    wanted = shared.select("digest").unionByName(pairs.select(F.col("u").alias("digest"))).unionByName(pairs.select(F.col("v").alias("digest")))
    first = staged.select("digest", "row").join(wanted.distinct(), "digest", "left_semi").groupBy("digest").agg(F.min("row").alias("row"))
    bodies = stages.write(numbered(staged.select("row", "digest", "size", "mins", F.col(text).alias("body")), first, stages).drop("row"))
    found = stages.write(decided(pairs, bodies, length, limit))
    roots = components(found, stages, SALTS)
    members = stages.write(_open_members(shared, roots))
    compared = stages.write(bodies.join(members.select("digest").distinct(), "digest", "left_semi"))
    reach = with_reach(compared.select("digest", "size"), lone_shingles(compared, length), limit)
    reaching = stages.write(_with_hashes(compared.join(reach.drop("size"), "digest"), length))
    left = stages.write(_left_over(members, reaching, dense, limit))
    more = stages.write(decided(left, bodies, length, limit))
    if more.limit(1).count():
        # Links between components only: the roots are the nodes now.
        named = lambda df, c: df.join(roots.select(F.col("u").alias(c), F.col("v").alias(f"{c}r")), c, "left").withColumn(c, F.coalesce(f"{c}r", c))
        above = components(named(named(more, "u"), "v").select("u", "v"), stages, SALTS)
        higher = above.select(F.col("u").alias("v"), F.col("v").alias("top"))
        moved = roots.join(higher, "v", "left").select("u", F.coalesce("top", "v").alias("v"))
        # A root that moves is a member of its component now.
        joined = stages.write(moved.unionByName(above))
        stages.drop(roots, above)
        roots = joined
    stages.drop(shared, pairs, bodies, found, members, compared, reaching, left, more)
    return roots.withColumnsRenamed({"u": "digest", "v": "root"})
