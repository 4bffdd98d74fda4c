"""Spans of regular-expression matches as column expressions: code-point offsets without leaving SQL.

``split`` gives the text between matches and ``regexp_extract_all`` the matches, so offsets are running sums of their lengths.
The sums run in two levels (spans of ``GROUP`` matches, then inside each). What a lambda reads is bound once (``bound``), since an expression
inside a lambda is evaluated for every element. Arrays are compared by one sort of both (``before``), so that a text with very many matches takes
the time of a sort; short arrays are compared directly, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUP = 256
#: Arrays whose sizes multiply to at most this are compared element by element.
FEW = 1024
#: Code points before a match that are kept as its context, and after it.
BEFORE, AFTER = 24, 1
SPAN = "struct<start:int,end:int,hit:string,before:string,after:string>"


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often and however deep in lambdas it is read."""
    return F.transform(F.array(value), body)[0]


def find(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<start,end,hit,before,after>>``; none gives an empty array.

    ``before`` and ``after`` are the neighbouring characters up to the next match. The pattern must not match the empty
    text. It may use ``\\G`` (end of the match before).
    """
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(pattern), bound(found, lambda f: bound(_pairs(f["gaps"], f["hits"]), _placed))).otherwise(none())


def _pairs(gaps: Column, hits: Column) -> Column:
    around = F.zip_with(
        F.slice(gaps, 1, F.size(hits)),
        F.slice(gaps, 2, F.size(hits)),
        lambda g, n: F.struct(F.length(g).alias("g"), F.right(g, F.lit(BEFORE)).alias("before"), F.left(n, F.lit(AFTER)).alias("after")),
    )
    return F.zip_with(
        around,
        hits,
        lambda a, h: F.struct(a["g"].alias("g"), F.length(h).alias("h"), h.alias("hit"), a["before"].alias("before"), a["after"].alias("after")),
    )


def _inside(group: Column, start: Column) -> Column:
    first = F.struct(start.cast("int").alias("at"), none().alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        own = F.struct(begin.alias("start"), (begin + x["h"]).alias("end"), *(x[c].alias(c) for c in ("hit", "before", "after")))
        return F.struct((begin + x["h"]).alias("at"), F.concat(acc["out"], F.array(own)).alias("out"))

    return F.aggregate(group, first, add, lambda acc: acc["out"])


def _placed(pairs: Column) -> Column:
    return F.when(F.size(pairs) <= GROUP, _inside(pairs, F.lit(0))).otherwise(bound(in_groups(pairs), _placed_groups))


def in_groups(items: Column) -> Column:
    """An array in pieces of ``GROUP``; it must not be empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / GROUP).cast("int")), lambda i: F.slice(items, i * GROUP + 1, GROUP))


def _placed_groups(groups: Column) -> Column:
    totals = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda a, x: a + x["g"] + x["h"]))
    starts = F.aggregate(
        totals,
        F.array(F.lit(0)),
        lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t)),
    )
    return F.flatten(F.zip_with(groups, F.slice(starts, 1, F.size(groups)), _inside))


def joined(spans: Column, kind: Callable[[Column], Column]) -> Column:
    """``kind:start:end`` of all spans, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def before(own: Column, others: Column) -> Column:
    """For every span of ``own``, in order, the number of ``others`` that start at or before it. Both are sorted by start."""
    marks = lambda spans, tag: F.transform(spans, lambda s, i: F.struct(s["start"].alias("at"), F.lit(tag).alias("tag"), i.alias("i")))
    merged = F.sort_array(F.concat(marks(others, 0), marks(own, 1)))
    # In the merged order a span has its predecessors of both kinds in front; those of its own are its number.
    counts = F.transform(merged, lambda m, k: F.when(m["tag"] == 1, k - m["i"]))
    return F.filter(counts, lambda c: c.isNotNull())


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def apart_from(spans: Column, *others: Column) -> Column:
    """The spans that overlap none of the others. Each array is sorted and its own spans do not overlap."""
    for some in others:
        spans = bound(F.struct(spans.alias("own"), some.alias("others")), lambda b: _apart(b["own"], b["others"]))
    return spans


def _apart(own: Column, others: Column) -> Column:
    direct = F.filter(own, lambda s: ~F.exists(others, lambda o: overlap(s, o)))

    def free(s: Column, n: Column) -> Column:
        last, following = F.get(others, n - 1), F.get(others, n)
        meets = F.coalesce(last["end"] > s["start"], F.lit(False)) | F.coalesce(following["start"] < s["end"], F.lit(False))
        return F.when(~meets, s)

    merged = F.filter(F.zip_with(own, before(own, others), free), lambda s: s.isNotNull())
    return F.when(F.size(own).cast("bigint") * F.size(others) <= FEW, direct).otherwise(merged)


def told(spans: Column, others: Column) -> Column:
    """For every span whether the others hold one of the same start and end; arrays as for ``apart_from``."""

    def tell(own: Column, them: Column) -> Column:
        same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"])
        direct = F.transform(own, lambda s: F.exists(them, lambda o: same(s, o)))
        merged = F.zip_with(own, before(own, them), lambda s, n: F.coalesce(same(s, F.get(them, n - 1)), F.lit(False)))
        return F.when(F.size(own).cast("bigint") * F.size(them) <= FEW, direct).otherwise(merged)

    return bound(F.struct(spans.alias("own"), others.alias("them")), lambda b: tell(b["own"], b["them"]))


def beaten(own: Column, others: Column) -> Column:
    """Numbers of the spans of ``own`` that overlap a smaller span (as structs compare) of ``others``; arrays as for ``apart_from``."""
    # Of two that overlap one starts inside the other.
    inside = F.zip_with(own, before(own, others), lambda s, n: F.struct(s.alias("s"), F.get(others, n - 1).alias("o")))
    lost = F.transform(inside, lambda x, i: F.when(overlap(x["s"], x["o"]) & (x["o"] < x["s"]), i))
    around = F.zip_with(others, before(others, own), lambda o, n: F.struct(o.alias("o"), F.get(own, n - 1).alias("s"), (n - 1).alias("i")))
    more = F.transform(around, lambda x: F.when(overlap(x["s"], x["o"]) & (x["o"] < x["s"]), x["i"]))
    return F.filter(F.concat(lost, more), lambda i: i.isNotNull())
