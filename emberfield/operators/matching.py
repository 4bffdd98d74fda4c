"""Spatial and temporal matching: cross-frame deduplication, inspection comparison, media pairing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberfield import fixed_values as fv
from emberfield.functions.columns import flag, haversine_m
from emberfield.operators.ordering import CHAIN_SPAN, around, number_groups, previous_in_spans, rank_in_groups, running_max
from emberfield.operators.regions import propagate_minimum
from emberfield.session import cut_lineage, drop_stage

METRES_PER_DEGREE = math.pi * fv.EARTH_RADIUS_M / 180.0

#: Side of a grid cell in reaches. A point's reach touches 2.25 cells of this side on average, and nine of a side of one reach.
GRID = 4


def _lon_step(band: Column, dlat: float, metres: float) -> Column:
    """Longitude degrees per cell in a latitude band: at least ``metres`` wide everywhere in it and in the bands beside it.

    Within 0.1° of a pole one cell spans the circle; one percent is slack.
    """
    widest = (F.greatest(F.abs(band), F.abs(band + 1)) + 1) * dlat
    return F.when(
        widest < 89.9, F.lit(metres * 1.01 / METRES_PER_DEGREE) / F.cos(F.radians(widest))
    ).otherwise(360.0)


def _cell_key(band: Column, cell: Column) -> Column:
    """One 64-bit key per cell; a cell number stays far below 2³³."""
    return band * F.lit(1 << 33) + cell


def at_home(df: DataFrame, metres: float) -> DataFrame:
    """``cell``: key of the grid cell a located row lies in; cells are ``GRID`` times ``metres`` wide."""
    dlat = GRID * metres / METRES_PER_DEGREE
    placed = df.withColumn("_band", F.floor(F.col("latitude") / dlat))
    placed = placed.withColumn("_step", _lon_step(F.col("_band"), dlat, GRID * metres))
    cell = F.floor(F.pmod(F.col("longitude"), F.lit(360.0)) / F.col("_step"))
    return placed.withColumn("cell", _cell_key(F.col("_band"), cell)).drop("_band", "_step")


def at_near_cells(df: DataFrame, metres: float) -> DataFrame:
    """One row per ``cell`` that can hold a point within ``metres``: those that the reach touches, one to four, ±180° wrapped.

    The cell arithmetic is spread over projections, because a generator re-evaluates whatever its
    argument repeats; as columns every band is computed once per row.
    """
    dlat = GRID * metres / METRES_PER_DEGREE
    reach = 1.01 / GRID
    col = lambda name, b: F.col(f"_{name}_{b}")
    bands = {"a": -reach, "b": reach}
    at = F.col("latitude") / dlat
    p = df.withColumns({**{f"_band_{b}": F.floor(at + o) for b, o in bands.items()}, "_turned": F.pmod(F.col("longitude"), F.lit(360.0))})
    p = p.withColumns({f"_step_{b}": _lon_step(col("band", b), dlat, GRID * metres) for b in bands})
    near = lambda b, side: F.pmod(F.col("_turned") + side * reach * col("step", b), F.lit(360.0))
    p = p.withColumns({f"_{n}_{b}": near(b, side) for b in bands for n, side in (("west", -1), ("east", 1))})
    keys = []
    for b in bands:
        west, east = (F.floor(col(n, b) / col("step", b)) for n in ("west", "east"))
        # Round the circle: the last cell may be narrower than the reach, so both cells at the seam belong to it.
        seam = F.when(col("west", b) > col("east", b), F.ceil(F.lit(360.0) / col("step", b)) - 1)
        keys += [_cell_key(col("band", b), c) for c in (west, east, seam, F.when(seam.isNotNull(), F.lit(0)))]
    temporary = [f"_{n}_{b}" for n in ("band", "step", "west", "east") for b in bands]
    return p.withColumn("cell", F.explode(F.array_distinct(F.array_compact(F.array(*keys))))).drop("_turned", *temporary)


def _place_kind(placed: DataFrame) -> DataFrame:
    """``at``: one 64-bit key per cell and word, making "same class or same type" an equi-join.

    A row whose class is its type has one word (``way`` 2), others one of each (0: class, 1: type). The key is a hash; the join
    conditions test the real values, so a collision costs only a look.
    """
    kind, sort = F.col("classification"), F.col("finding_type")
    word = lambda way, value: F.struct(F.lit(way).alias("way"), value.alias("word"))
    words = F.when(kind.eqNullSafe(sort), F.array(word(2, kind))).otherwise(F.array(word(0, kind), word(1, sort)))
    placed = placed.withColumn("kind", F.explode(words)).where("kind.word IS NOT NULL")
    return placed.withColumns({"way": F.col("kind.way"), "at": F.xxhash64("cell", "kind.word")}).drop("kind", "cell")


def _same_kind(a: str, b: str) -> Column:
    """Join condition over ``_place_kind`` rows; a pair agreeing in both ways is taken once, by its class."""
    same_class = flag(F.col(f"{a}.classification") == F.col(f"{b}.classification"))
    same_type = flag(F.col(f"{a}.finding_type") == F.col(f"{b}.finding_type"))
    by_type = (F.col(f"{a}.way") == 1) | (F.col(f"{b}.way") == 1)
    return (F.col(f"{a}.at") == F.col(f"{b}.at")) & F.when(by_type, same_type & ~same_class).otherwise(same_class)


def _distance(a: str, b: str) -> Column:
    return haversine_m(*[F.col(f"{s}.{n}") for s in (a, b) for n in ("latitude", "longitude")])


def _clique(distance_m: float, delta_c: float, maximum_c: float, of: str = "") -> Column:
    """Key of a cell whose members are compatible with each other by construction, from the columns of ``of``."""
    col = lambda name: F.col(of + name)
    side = distance_m / math.sqrt(2.0) * 0.99
    dlat = side / METRES_PER_DEGREE
    band = F.floor(col("latitude") / dlat)
    nearest = F.least(F.abs(band), F.abs(band + 1)) * dlat
    step = F.lit(side / METRES_PER_DEGREE) / F.cos(F.radians(nearest))
    return F.struct(
        band.alias("band"),
        F.floor(F.pmod(col("longitude"), F.lit(360.0)) / step).alias("cell"),
        F.floor(col("delta_temperature_c") / (delta_c * 0.99)).alias("delta"),
        F.floor(col("max_temperature_c") / (maximum_c * 0.99)).alias("maximum"),
        col("classification").alias("classification"),
        col("finding_type").alias("finding_type"),
    )


def compatibility_edges(
    observations: DataFrame,
    distance_m: float = fv.DEDUP_DISTANCE_M,
    delta_c: float = fv.DEDUP_DELTA_C,
    maximum_c: float = fv.DEDUP_MAXIMUM_C,
) -> DataFrame:
    """Directed edges ``u → v`` (u earlier) with the same reachability as all compatible pairs.

    Inside a clique cell everyone is compatible, so a chain in input order replaces its n² pairs.
    Between neighbouring cells only the latest earlier partner per observation is kept, because the
    chain already leads from every earlier member of that cell to it.
    """
    located = observations.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(
        "obs_ord", "latitude", "longitude", "delta_temperature_c", "max_temperature_c", "classification", "finding_type"
    )
    # read four times below, so kept once; it also keeps the cell arithmetic out of the upstream expressions
    located = cut_lineage(
        located.withColumn("clique", _clique(distance_m, delta_c, maximum_c)).withColumn("mark", F.xxhash64("clique"))
    )
    # Rows that meet carry the clique's hash; the clique itself follows from their values again.
    placed = located.drop("clique")
    clique = lambda of: _clique(distance_m, delta_c, maximum_c, of)
    chain = previous_in_spans(
        located.select("clique", "obs_ord"), ["clique"], "obs_ord", "obs_ord", F.floor(F.col("obs_ord") / CHAIN_SPAN), "u"
    ).select("u", F.col("obs_ord").alias("v"))
    probe = _place_kind(at_near_cells(placed, distance_m)).alias("i")
    home = _place_kind(at_home(placed, distance_m)).alias("j")
    cross = probe.join(
        home,
        _same_kind("i", "j")
        & (F.col("j.obs_ord") < F.col("i.obs_ord"))
        & ((F.col("i.mark") != F.col("j.mark")) | (clique("i.") != clique("j.")))
        & (F.abs(F.col("i.delta_temperature_c") - F.col("j.delta_temperature_c")) <= delta_c)
        & (F.abs(F.col("i.max_temperature_c") - F.col("j.max_temperature_c")) <= maximum_c)
        & (_distance("i", "j") <= distance_m),
    )
    latest = cross.groupBy(F.col("i.obs_ord").alias("v"), clique("j.").alias("clique")).agg(
        F.max("j.obs_ord").alias("u")
    )
    return chain.where("u IS NOT NULL").unionByName(latest.select("u", "v")).distinct()


def assign_clusters(observations: DataFrame, **limits) -> DataFrame:
    """``founder`` (the cluster's first observation) and ``cluster_index`` by first appearance.

    The ordered greedy rule "join the first cluster with any compatible member" has a closed form: the
    founder of an observation is the smallest observation reachable through earlier compatible ones.
    So the fold becomes min-propagation along directed edges that contracts chains, and no site is handled by one task.
    """
    roots = propagate_minimum(compatibility_edges(observations, **limits))
    joined = observations.join(roots.withColumnRenamed("node", "obs_ord"), "obs_ord", "left")
    return joined.withColumn("founder", F.coalesce("root", "obs_ord")).drop("root")


def canonical_findings(assigned: DataFrame) -> DataFrame:
    """The strongest member per cluster (ΔT, maximum, area; earliest on ties) with merged provenance.

    Only combinable aggregates per cluster: the supporting ids of a cluster may be a large part of the
    data, so they are rows of ``supporting_observations``, not an array in one row.
    """
    strength = F.struct("delta_temperature_c", "max_temperature_c", "area_px", (-F.col("obs_ord")).alias("first"))
    merged = assigned.groupBy("founder").agg(
        F.max(strength).alias("best"),
        F.count("*").alias("members"),
    )
    merged = number_groups(merged, "founder", "cluster_index")
    rows = merged.withColumn("obs_ord", -F.col("best.first")).drop("best").join(
        assigned.drop("founder", "finding_id"), "obs_ord"
    )
    many = F.col("members") > 1
    raised = (
        F.when(many & (F.col("confidence") == "low"), "medium")
        .when((F.col("confidence") == "medium") & (F.col("members") >= 3), "high")
        .otherwise(F.col("confidence"))
    )
    note = F.format_string("corroborated by %d geospatially compatible observations", F.col("members"))
    rows = rows.withColumns(
        {
            "finding_id": F.format_string("A-%03d", F.col("cluster_index")),
            "duplicate_cluster_id": F.when(many, F.format_string("D-%03d", F.col("cluster_index"))).otherwise(""),
            "confidence": raised,
            "cross_frame_corroboration": F.when(many, F.col("members")),
        }
    ).withColumn("canonical_finding_id", F.col("finding_id"))
    if "evidence" in rows.columns:
        rows = rows.withColumn(
            "evidence", F.when(many, F.concat("evidence", F.array(note))).otherwise(F.col("evidence"))
        )
    else:
        rows = rows.withColumn("evidence", F.when(many, F.array(note)).otherwise(F.array().cast("array<string>")))
    return rows


def supporting_observations(assigned: DataFrame) -> DataFrame:
    """Members of every cluster as rows ``(founder, obs_ord, finding_id)``; a blank id gives way to its source image."""
    named = F.nullif("finding_id", F.lit(""))
    if "source_image_id" in assigned.columns:
        named = F.coalesce(named, F.nullif("source_image_id", F.lit("")))
    return assigned.select("founder", "obs_ord", named.alias("finding_id")).where("finding_id IS NOT NULL")


def _candidate_pairs(previous: DataFrame, current: DataFrame, distance_m: float) -> DataFrame:
    probe = _place_kind(at_near_cells(current, distance_m)).alias("c")
    home = _place_kind(at_home(previous.where("latitude IS NOT NULL AND longitude IS NOT NULL"), distance_m)).alias("p")
    near = probe.join(home, _same_kind("c", "p")).select(
        F.col("c.obs_ord").alias("cur"), F.col("p.obs_ord").alias("prev"), _distance("c", "p").alias("d")
    )
    return near.where(F.col("d") <= distance_m).select("cur", "prev", F.round("d", 6).alias("d"))


KIND = ["latitude", "longitude", "classification", "finding_type"]
#: Places of a site's preferences that a refused finding looks through in one round.
LOOK = 64


def _sites(df: DataFrame, name: str) -> DataFrame:
    """Findings of one position and kind as one row, named by the first of them, with their number."""
    return df.where("latitude IS NOT NULL AND longitude IS NOT NULL").groupBy(*KIND).agg(
        F.min("obs_ord").alias(name), F.count("*").alias("members")
    )


def _with_site(df: DataFrame, sites: DataFrame, name: str, ord_name: str) -> DataFrame:
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}")) for k in KIND]
    return df.alias("f").join(sites.alias("s"), same).select(F.col("f.obs_ord").alias(ord_name), f"s.{name}")


def _preferences(previous: DataFrame, current_sites: DataFrame, distance_m: float) -> DataFrame:
    """``(site, pos, prev, d)``: what the findings of a site prefer, nearest first, once for all of them.

    Distances are between sites; a previous finding is a row for every site in range, however many current findings stand there.
    """
    previous_sites = _sites(previous, "home")
    as_points = lambda sites, name: sites.withColumn("obs_ord", F.col(name)).drop("members", name)
    near = _candidate_pairs(as_points(previous_sites, "home"), as_points(current_sites, "site"), distance_m)
    near = near.select(F.col("cur").alias("site"), F.col("prev").alias("home"), "d")
    listed = cut_lineage(near.join(_with_site(previous, previous_sites, "home", "prev"), "home").select("site", "prev", "d"))
    levels = [[F.floor(F.col("d") * 64)], [F.col("d"), F.floor(F.col("prev") / CHAIN_SPAN)]]
    ranked = rank_in_groups(listed, ["site"], levels, [F.col("d"), F.col("prev")], "pos", listed.count())
    kept = cut_lineage(ranked.withColumn("part", F.floor(F.col("pos") / LOOK)))
    drop_stage(listed)
    return kept


def match_inspections(previous: DataFrame, current: DataFrame, distance_m: float = fv.COMPARE_DISTANCE_M) -> DataFrame:
    """Pairs of the in-order greedy: each current takes its nearest still free previous.

    Serial picking equals deferred acceptance where every previous finding prefers the earlier current one, so all sites progress
    together. A finding's state is one row: the first place of its site's preferences that is not known to be out of reach. It
    proposes to that place; a previous finding holds its earliest proposer, and refused ones move on, past all places that earlier findings hold.

    Within a site partners get strictly worse from one finding to the next, so a finding's place is at least an earlier one's plus the steps
    between them: findings at one spot spread over their partners in one round. Pairs of findings are neither stored nor shuffled;
    a round writes one row per finding that still has a place, and what refused findings look through.
    """
    located = current.where("latitude IS NOT NULL AND longitude IS NOT NULL")
    sites = _sites(located, "site")
    wanted = _preferences(previous, sites, distance_m)
    members = cut_lineage(_with_site(located, sites, "site", "cur"))
    total = members.count()
    numbered = rank_in_groups(members, ["site"], [[F.floor(F.col("cur") / CHAIN_SPAN)]], [F.col("cur")], "nth", total)
    state, quiet, left, kept = numbered.withColumn("place", F.col("nth").cast("long")), None, None, [members]
    while True:
        lead = running_max(state.withColumn("lead", F.col("place") - F.col("nth")), ["site"], "nth", "lead", "least", total)
        moved = lead.select("cur", "site", "nth", (F.col("nth") + F.col("least")).alias("pos"))
        offers = moved.join(wanted.drop("part"), ["site", "pos"])  # a finding beyond the last place stays without a partner
        made = cut_lineage(_held(offers) if quiet is None else _held_again(quiet, left, offers, kept))
        drop_stage(*kept)
        restless = cut_lineage(made.where("cur > holder").select("site").distinct())
        kept = [made, restless]
        if restless.limit(1).count() == 0:
            return made.select("cur", "prev", F.col("d").alias("distance_m"))
        # Sites without a refused finding keep their places, so that only the others are looked at again.
        quiet, left = made.join(restless, "site", "left_anti"), made.join(restless, "site", "left_semi")
        state = cut_lineage(_next_places(left, made, wanted, kept))
        kept.append(state)


def _held(offers: DataFrame) -> DataFrame:
    """Offers with ``holder``, the earliest proposer of their previous finding."""
    return offers.join(offers.groupBy("prev").agg(F.min("cur").alias("holder")), "prev")


def _held_again(quiet: DataFrame, left: DataFrame, offers: DataFrame, kept: list[DataFrame]) -> DataFrame:
    """``_held`` of the quiet and the new offers; only previous findings that are left or asked now can change hands."""
    fresh = cut_lineage(offers)
    touched = cut_lineage(fresh.select("prev").unionByName(left.select("prev")).distinct())
    kept += [fresh, touched]
    again = quiet.drop("holder").join(touched, "prev", "left_semi").unionByName(fresh)
    return quiet.join(touched, "prev", "left_anti").unionByName(_held(again))


def _next_places(left: DataFrame, made: DataFrame, wanted: DataFrame, kept: list[DataFrame]) -> DataFrame:
    """State rows of the next round: refused findings look through the next ``LOOK`` places for one that no earlier finding holds.

    Those who look, and what they see, are written, so that late rounds, which have few of them, pass by the long tables without moving them.
    """
    here = F.floor(F.col("pos") / LOOK)
    asking = cut_lineage(left.where("cur > holder").select("cur", "site", "nth", "pos"))
    kept.append(asking)
    spots = wanted.select("site", "part", F.col("pos").alias("there"), "prev")
    seen = cut_lineage(
        asking.withColumn("part", F.explode(F.array(here, here + 1)))
        .join(spots, ["site", "part"])
        .where(F.col("there").between(F.col("pos") + 1, F.col("pos") + LOOK))
        .select("cur", "there", "prev")
    )
    kept.append(seen)
    held = made.where("cur = holder").select("prev", "holder").join(seen.select("prev"), "prev", "left_semi")
    free = seen.join(held, "prev", "left").where(F.col("holder").isNull() | (F.col("holder") > F.col("cur")))
    found = asking.join(free.groupBy("cur").agg(F.min("there").alias("there")), "cur", "left").select(
        "cur", "site", "nth", F.coalesce("there", F.col("pos") + LOOK + 1).cast("long").alias("place")
    )
    content = left.where("cur = holder").select("cur", "site", "nth", F.col("pos").cast("long").alias("place"))
    return content.unionByName(found)


def compare_inspections(
    previous: DataFrame,
    current: DataFrame,
    distance_m: float = fv.COMPARE_DISTANCE_M,
    material_c: float = fv.COMPARE_MATERIAL_C,
) -> DataFrame:
    """Worsened / improved / persisted / new / resolved rows."""
    matches = match_inspections(previous, current, distance_m)
    c = current.select(
        F.col("obs_ord").alias("cur"), F.col("delta_temperature_c").alias("cur_delta"), F.col("max_temperature_c").alias("cur_max")
    )
    p = previous.select(
        F.col("obs_ord").alias("prev"), F.col("delta_temperature_c").alias("prev_delta"), F.col("max_temperature_c").alias("prev_max")
    )
    kept = c.join(matches, "cur", "left").join(p, "prev", "left")
    change = F.col("cur_delta") - F.col("prev_delta")
    state = (
        F.when(F.col("prev").isNull(), "new")
        .when(change >= material_c, "worsened")
        .when(change <= -material_c, "improved")
        .otherwise("persisted")
    )
    rows = kept.select(
        state.alias("state"),
        F.col("cur").alias("current_ord"),
        F.col("prev").alias("previous_ord"),
        change.alias("delta_t_change_c"),
        (F.col("cur_max") - F.col("prev_max")).alias("max_temperature_change_c"),
    )
    empty = F.lit(None).cast("double")
    gone = p.join(matches, "prev", "left_anti").select(
        F.lit("resolved").alias("state"),
        F.lit(None).cast("long").alias("current_ord"),
        F.col("prev").alias("previous_ord"),
        empty.alias("delta_t_change_c"),
        empty.alias("max_temperature_change_c"),
    )
    return rows.unionByName(gone)


def pair_media(
    thermal: DataFrame,
    visible: DataFrame,
    seconds: float = fv.PAIR_SECONDS,
    distance_m: float = fv.PAIR_DISTANCE_M,
) -> DataFrame:
    """Best visible per thermal by time and place, either clue being enough.

    No pair of media is emitted. Of all visibles only the nearest in time before and after a thermal can win by time, and of those at one
    position only the nearest in time there can win by both clues; both come from one sorted sweep that carries edges over
    pieces of time. So a thermal gives two candidates, and two more for every distinct position of visibles in range.
    The place branch ignores time and needs the nearest *position* only, however many media share it.
    """
    width = int(seconds * 1_000_000)
    micros = lambda n: F.unix_micros(F.col(n))
    t = thermal.select("media_id", "capture_ts", "latitude", "longitude").withColumn("at", micros("capture_ts"))
    v = visible.select(F.col("media_id").alias("visible_id"), "capture_ts", "latitude", "longitude").withColumn("at", micros("capture_ts"))
    dist = _distance("t", "v")
    place_score = F.when(dist <= distance_m, (1.0 - dist / distance_m) * 0.4).otherwise(0.0)
    timed = "at IS NOT NULL"
    seen = F.struct("visible_id", "at", "latitude", "longitude")
    at_once = lambda keys: v.where(timed).groupBy(*keys, "at").agg(F.min_by(seen, "visible_id").alias("seen"))
    one = F.lit(0).alias("everywhere")

    def hits(swept: DataFrame) -> DataFrame:
        """Thermals with the visibles around them, scored by both clues."""
        found = swept.select("media_id", "at", "t_latitude", "t_longitude", F.explode(F.array("before", "after")).alias("v"))
        found = found.where(F.abs(F.col("at") - F.col("v.at")) <= width)
        gap = F.abs(F.col("at") - F.col("v.at")) / 1e6
        apart = haversine_m(F.col("t_latitude"), F.col("t_longitude"), F.col("v.latitude"), F.col("v.longitude"))
        near = F.when(apart <= distance_m, (1.0 - apart / distance_m) * 0.4).otherwise(0.0)
        hit = F.struct(
            F.round((1.0 - gap / seconds) * 0.6 + F.coalesce(near, F.lit(0.0)), 12).alias("score"),
            (-F.col("v.visible_id")).alias("neg_order"),
            gap.alias("gap"),
            apart.alias("distance"),
        )
        return found.select("media_id", hit.alias("hit"))

    asking = t.where(timed).select("media_id", "at", F.col("latitude").alias("t_latitude"), F.col("longitude").alias("t_longitude"))
    anywhere = around(asking.withColumn("everywhere", one), at_once([one]), ["everywhere"], "at", "seen", width)
    has_place = "latitude IS NOT NULL AND longitude IS NOT NULL"
    spots = t.where(has_place).select("latitude", "longitude").distinct()
    stands = v.where(has_place).groupBy("latitude", "longitude").agg(
        F.min(F.struct("visible_id", "capture_ts")).alias("first")
    )
    probe = at_near_cells(spots, distance_m).alias("t")
    home = at_home(stands, distance_m).alias("v")
    # A row per pair of distinct positions in range: met twice below, so kept.
    ranges = cut_lineage(
        probe.join(home, (F.col("t.cell") == F.col("v.cell")) & (dist <= distance_m)).select(
            F.col("t.latitude").alias("latitude"),
            F.col("t.longitude").alias("longitude"),
            F.col("v.latitude").alias("v_latitude"),
            F.col("v.longitude").alias("v_longitude"),
            F.round(place_score, 12).alias("score"),
            (-F.col("v.first.visible_id")).alias("neg_order"),
            dist.alias("distance"),
            F.col("v.first.capture_ts").alias("seen"),
        )
    )
    stand = F.struct(F.col("v_latitude").alias("lat"), F.col("v_longitude").alias("lon")).alias("stand")
    there = F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")).alias("stand")
    nearby = t.where(timed).join(ranges, ["latitude", "longitude"]).select(
        stand, "media_id", "at", F.col("latitude").alias("t_latitude"), F.col("longitude").alias("t_longitude")
    )
    standing = v.where(timed).where(has_place).select(there, "visible_id", "at", "latitude", "longitude")
    standing = standing.groupBy("stand", "at").agg(F.min_by(seen, "visible_id").alias("seen"))
    by_time = hits(anywhere).unionByName(hits(around(nearby, standing, ["stand"], "at", "seen", width)))
    nearest = ranges.groupBy("latitude", "longitude").agg(F.max(F.struct("score", "neg_order", "distance", "seen")).alias("near"))
    by_place = t.join(nearest, ["latitude", "longitude"]).select(
        "media_id",
        F.struct(
            F.col("near.score").alias("score"),
            F.col("near.neg_order").alias("neg_order"),
            (F.abs(micros("capture_ts") - F.unix_micros("near.seen")) / 1e6).alias("gap"),
            F.col("near.distance").alias("distance"),
        ).alias("hit"),
    )
    best = by_time.unionByName(by_place).groupBy("media_id").agg(F.max("hit").alias("hit"))
    score, gap_s, dist_m = F.col("hit.score"), F.col("hit.gap"), F.col("hit.distance")
    return best.select(
        F.col("media_id").alias("thermal_id"),
        (-F.col("hit.neg_order")).alias("visible_id"),
        F.when(score >= 0.75, "high").when(score >= 0.45, "medium").otherwise("low").alias("confidence"),
        score.alias("score"),
        gap_s.alias("time_difference_s"),
        dist_m.alias("distance_m"),
        F.array_compact(
            F.array(
                F.when(gap_s <= seconds, F.format_string("capture time within %.2f s", gap_s)),
                F.when(dist_m <= distance_m, F.format_string("GPS positions within %.1f m", dist_m)),
            )
        ).alias("rationale"),
    )
