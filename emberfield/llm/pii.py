"""Personal data: fixed formats, and wide candidate generators judged by boosted trees.

Generators of high recall propose overlapping spans (anything like an address, four numbers, a long run of digits taken
as card and as phone). Each proposal becomes a key of a few format and context features, which has a bounded number of values. The
trees are fitted on the table of keys, weighted by how many proposals of the whole corpus have each key and how many of
them the fixed formats confirm, so all data count and nothing of the corpus's size is fitted or collected. The features that
make up the fixed formats (``FORMAT``) are hidden from the trees: what is confirmed at one format carries over to proposals of the
same shape and context in others (``name [at] host [dot] org``, numbers without plus or with slashes, addresses with spaces).

Wrong for certain is an unconfirmed proposal that its own numbers refute (``sound``: a part above 255, no Luhn number, a
count of digits that no phone has, no top-level domain) or that is part of a longer word. A kind's threshold is the least score above
which at most 1 - ``PRECISION`` of the proposals are wrong, as these tell (``CHANCE``), and no less than 0.5: at least half of a shape are confirmed. Sound
proposals above it are added, unless they overlap a fixed span or a better proposal. A variant that outnumbers the confirmed
proposals of its shape and context is not added. Only DataFrame functions and MLlib; no Python on executors.

Defined results: null texts count as empty and have no spans; repeated rows and null ids are scanned like any; where no
proposal, or every proposal, is confirmed there is nothing to learn and nothing is added; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.llm.common import Stages
from emberfield.llm.spans import apart_from, beaten, bound, find, in_groups, joined, overlap, told

KINDS = ("email", "ip", "card", "phone")
#: Fixed values of the contract. Look-behinds and possessive runs keep them linear and change no match: a match starts
#: where its run of characters starts or where the match before ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE_PARTS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
#: Generators; a run of digits is proposed as card and as phone.
WIDE_EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?@\x20?|\x20?[\[(](?:at|AT)[\])]\x20?)"
    r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63}){1,8}"
)
WIDE_IP = r"(?<![0-9])[0-9]{1,4}(?:\x20?[.,:]\x20?[0-9]{1,4}){3}"
WIDE_DIGITS = r"(?<![0-9A-Za-z+])\+?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,24}"
CONTEXT = (
    r"(?i)(?:tel|phone|call|fon|mobil|fax)",
    r"(?i)(?:card|karte|carte|tarjeta|visa|credit)",
    r"(?i)(?:mail|contact|write)",
    r"(?i)(?:\bip\b|addr|host|server)",
)
#: Features of a key and how many values each has; a key is their mixed-radix number.
FEATURES = (("kind", 4), ("digits", 8), ("marks", 5), ("plus", 2), ("sound", 2), ("context", 5), ("glued", 2), ("plain", 2))
#: Not seen by the trees.
FORMAT = ("plus", "sound", "plain")
PRECISION = 0.95
#: By kind, how many sound proposals chance makes for each refuted one: a number passes Luhn one time in ten, a part below 1,000
#: stays within 255 one time in four.
CHANCE = (1.0, 1 / 3, 1 / 9, 1.0)
TREES, DEPTH = 20, 4
SPAN = "array<struct<start:int,kind:int,end:int>>"
TAGS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a number of up to 20 digits passes the Luhn check; zeros in front change nothing."""
    padded = F.lpad(digits, 20, "0")
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(20)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 0, F.substring(padded, i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*(F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(padded, i, F.lit(1)).cast("int") + 1)
        ),
    )
    return total % 10 == 0


def _plain(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def base_spans(body: Column) -> list[Column]:
    """The fixed formats' spans, an array per kind; a match that fails its check is dropped without another try."""
    none = F.array().cast(SPAN)
    number = body.rlike("[0-9]")
    emails = F.when(F.contains(body, F.lit("@")), _plain(find(body, EMAIL), 0)).otherwise(none)
    ips = F.when(number, _plain(F.filter(find(body, IP), lambda s: s["hit"].rlike(BYTE_PARTS)), 1)).otherwise(none)

    def card(s: Column) -> Column:
        digits = _digits(s["hit"])
        return F.length(digits).between(13, 19) & luhn(digits)

    cards = F.when(number, _plain(F.filter(find(body, CARD), card), 2)).otherwise(none)
    phones = F.when(
        F.contains(body, F.lit("+")),
        _plain(F.filter(find(body, PHONE), lambda s: F.length(_digits(s["hit"])).between(9, 15)), 3),
    ).otherwise(none)
    return [emails, ips, cards, phones]


def _key(s: Column, kind: int) -> Column:
    """Format and context of a proposal as one number."""
    digits, hit = _digits(s["hit"]), s["hit"]
    n = F.length(digits)
    length = sum((n >= at).cast("int") for at in (9, 11, 12, 13, 16, 17, 20))
    marks = (
        F.when(hit.rlike(r"^\+?[0-9]*$"), 0)
        .when(hit.rlike(r"^\+?[0-9 ]*$"), 1)
        .when(hit.rlike(r"^\+?[0-9-]*$"), 2)
        .when(hit.rlike(r"^\+?[0-9.]*$"), 3)
        .otherwise(4)
    )
    context = F.lit(0)
    for i, words in reversed(list(enumerate(CONTEXT, 1))):
        context = F.when(s["before"].rlike(words), i).otherwise(context)
    bytes_only = F.regexp_replace(hit, r"\x20?[.,:]\x20?", ".").rlike(BYTE_PARTS)
    sound = {0: hit.rlike(r"[A-Za-z]{2,}$"), 1: bytes_only, 2: luhn(digits) & n.between(13, 19), 3: n.between(9, 15)}[kind]
    fits = {0: ~hit.rlike(r"[\x20\[(]"), 1: hit.rlike(BYTE_PARTS), 2: n.between(13, 19), 3: n.between(9, 15)}[kind]
    values = (
        F.lit(kind),
        length if kind > 1 else F.lit(0),
        marks if kind > 1 else F.lit(0),
        hit.startswith("+").cast("int"),
        sound.cast("int"),
        context,
        (s["before"].rlike("[A-Za-z0-9]$") | s["after"].rlike("^[A-Za-z0-9]")).cast("int"),
        fits.cast("int"),
    )
    key = F.lit(0)
    for value, (_, size) in zip(values, FEATURES):
        key = key * size + value
    return key


def proposals(body: Column) -> list[Column]:
    """Overlapping proposals of all kinds as arrays of ``struct<start,kind,end,key>``."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,key:int>>")

    def keyed(spans: Column, kind: int) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), _key(s, kind).cast("int").alias("key")),
        )

    sign, number = body.rlike(r"@|[\[(](?:at|AT)[\])]"), body.rlike("[0-9]")
    return [
        F.when(sign, keyed(find(body, WIDE_EMAIL), 0)).otherwise(none),
        F.when(number, keyed(find(body, WIDE_IP), 1)).otherwise(none),
        F.when(number, keyed(find(body, WIDE_DIGITS), 2)).otherwise(none),
        F.when(number, keyed(find(body, WIDE_DIGITS), 3)).otherwise(none),
    ]


def with_proposals(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, ``base`` (array of start, kind, end by kind, then start) and ``proposed`` (the same with key and confirmed)."""
    body = F.coalesce(F.col(text), F.lit(""))
    made = docs.withColumn("base", F.concat(*base_spans(body))).withColumn("wide", F.array(*proposals(body)))
    fields = ("start", "kind", "end", "key")
    flagged = lambda p, c: F.struct(*(p[f].alias(f) for f in fields), c.alias("confirmed"))

    def of_kind(kind: int) -> Column:
        return bound(F.col("wide")[kind], lambda w: F.zip_with(w, told(w, _only(F.col("base"), kind)), flagged))

    proposed = F.concat(*(of_kind(k) for k in range(len(KINDS))))
    return made.withColumn("proposed", proposed).drop("wide")


def _only(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def fit(found: DataFrame) -> dict[int, float]:
    """Keys that are redacted and their scores, from the counts of keys over all proposals."""
    counts = (
        found.select(F.explode("proposed").alias("p"))
        .groupBy(F.col("p.key").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p.confirmed").cast("bigint")).alias("hits"))
    )
    rows = [(r["key"], r["n"], r["hits"]) for r in counts.collect()]  # at most as many as keys have values
    if not any(h for _, _, h in rows) or all(h == n for _, n, h in rows):
        return {}
    spark = found.sparkSession
    grid = spark.createDataFrame(sorted(rows), "key int, n long, hits long").coalesce(1)
    rest = F.col("key")
    for name, size in reversed(FEATURES):
        grid, rest = grid.withColumn(name, (rest % size).cast("double")), F.floor(rest / size)
    seen_by_trees = [name for name, _ in FEATURES if name not in FORMAT]
    grid = VectorAssembler(inputCols=seen_by_trees, outputCol="features").transform(grid)
    both = grid.withColumn("label", F.lit(1.0)).withColumn("w", F.col("hits").cast("double"))
    both = both.unionByName(grid.withColumn("label", F.lit(0.0)).withColumn("w", (F.col("n") - F.col("hits")).cast("double")))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, weightCol="w", seed=7, maxBins=16)
    model = trees.fit(both.where("w > 0").coalesce(1))
    columns = ("key", "kind", "n", "hits", "sound", "glued")
    scored = model.transform(grid).select(*columns, vector_to_array("probability")[1].alias("score")).collect()
    kept: dict[int, float] = {}
    for kind in range(len(KINDS)):
        own = sorted((r for r in scored if r["kind"] == kind and r["score"] >= 0.5), key=lambda r: (-r["score"], r["key"]))
        seen = wrong = 0
        cut = None
        for at, r in enumerate(own):
            seen += r["n"]
            wrong += 0 if r["sound"] and not r["glued"] else (r["n"] - r["hits"]) * CHANCE[kind]
            # Keys of one score stand or fall together.
            if (at + 1 == len(own) or own[at + 1]["score"] < r["score"]) and wrong <= (1 - PRECISION) * seen:
                cut = r["score"]
        kept |= {r["key"]: r["score"] for r in own if cut is not None and r["score"] >= cut and r["sound"] and not r["glued"]}
    return kept


def added_spans(keys: dict[int, float]) -> Column:
    """Unconfirmed proposals with one of the keys, apart from fixed spans; of overlapping ones the best, then the first."""
    if not keys:
        return F.array().cast(SPAN)
    order = {k: i for i, k in enumerate(sorted(keys, key=lambda k: (-keys[k], k)))}
    wanted = F.array(*(F.lit(k) for k in sorted(order, key=order.get)))
    wanted_ones = F.filter("proposed", lambda p: ~p["confirmed"] & F.array_contains(wanted, p["key"]))
    ranked = F.transform(
        wanted_ones,
        lambda p: F.struct(F.array_position(wanted, p["key"]).alias("rank"), p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")),
    )
    kinds = range(len(KINDS))
    bases = [_only(F.col("base"), k) for k in kinds]
    by_kind = bound(ranked, lambda r: F.array(*(bound(_only(r, k), lambda own: apart_from(own, *bases)) for k in kinds)))
    best = bound(by_kind, lambda lists: F.when(F.size(F.flatten(lists)) <= 32, _best_of_few(F.flatten(lists))).otherwise(_best(lists)))
    return F.transform(best, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))


def _best_of_few(ranked: Column) -> Column:
    return bound(ranked, lambda all_: F.filter(all_, lambda p: ~F.exists(all_, lambda o: overlap(o, p) & (o < p))))


def _best(lists: Column) -> Column:
    """The same for arrays by kind, each of spans that do not overlap."""

    def of_kind(k: int) -> Column:
        lost = F.concat(*(beaten(lists[k], lists[o]) for o in range(len(KINDS)) if o != k))
        numbers = F.transform(lists[k], lambda p, i: i)
        return F.transform(F.array_except(numbers, lost), lambda i: F.get(lists[k], i))

    return F.concat(*(of_kind(k) for k in range(len(KINDS))))


def _by_kind(spans: Column) -> Column:
    turned = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.array_sort(turned)


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` to doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document."""
    stages = Stages(docs.sparkSession)
    found = stages.write(with_proposals(docs.select("doc_id", "text")).drop("text"))
    added = added_spans(fit(found))
    name = lambda s: F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["kind"] + 1)
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("bigint")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(joined(_by_kind(F.col("base")), name).cast("binary"), 256).alias("base_sha256"),
        joined(_by_kind(F.concat("base", added)), name).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, overlapping ones together, replaced by the tag of its first kind."""
    both = F.struct(text.alias("text"), bound(F.array_sort(spans), in_groups).alias("groups"))
    return F.when(F.size(spans) > 0, bound(both, lambda b: _tagged(b["text"], b["groups"]))).otherwise(text)


def _tagged(text: Column, groups: Column) -> Column:
    """A piece of text for each group of spans, from the largest end before the group to that after it, and the rest."""
    tops = F.transform(groups, lambda g: F.array_max(F.transform(g, lambda s: s["end"])))
    ends = F.aggregate(tops, F.array(F.lit(0)), lambda acc, t: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), t))))

    def around(reach: Column) -> Column:
        rendered = F.zip_with(
            groups,
            F.zip_with(F.slice(reach, 1, F.size(groups)), F.slice(reach, 2, F.size(groups)), lambda a, z: F.struct(a.alias("a"), z.alias("z"))),
            lambda g, r: bound(F.struct(r["a"].alias("a"), F.substring(text, r["a"] + 1, r["z"] - r["a"]).alias("piece")), lambda p: _piece(g, p)),
        )
        return F.concat(F.array_join(rendered, ""), F.substring(text, F.element_at(reach, -1) + 1, F.length(text)))

    return bound(ends, around)


def _piece(group: Column, piece: Column) -> Column:
    tag = lambda s: F.element_at(F.array(*(F.lit(t) for t in TAGS)), s["kind"] + 1)
    first = F.struct(piece["a"].alias("reach"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(piece["piece"], acc["reach"] - piece["a"] + 1, s["start"] - acc["reach"])
        # A span that starts before the largest end so far belongs to the block before it.
        out = F.when(s["start"] >= acc["reach"], F.concat(acc["out"], F.array(F.concat(gap, tag(s))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["reach"], s["end"]).alias("reach"), out.alias("out"))

    return F.aggregate(group, first, add, lambda acc: F.array_join(acc["out"], ""))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, personal data in the text replaced by tags; null texts stay null.

    Only spans are kept while the trees learn, and they go at once; the texts are searched again for the result.
    """
    stages = Stages(docs.sparkSession)
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items()))
    model = fit(stages.write(with_proposals(plain.select(own[text]), own[text]).drop(own[text])))
    stages.drop_all()
    spans = F.concat("base", added_spans(model))
    done = with_proposals(plain, own[text]).withColumn("spans", spans).withColumn(own[text], redacted(F.col(own[text]), F.col("spans")))
    return done.select(*(F.col(n).alias(c) for c, n in own.items()))
