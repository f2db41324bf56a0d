"""Matching entities of two sources without a common key: a deterministic cascade of rules.

The first source's records are grouped into entities by their own key (a record without one is an entity of its own),
with the middle position and the median of each number. Units of the second source are then joined with the entities by
successive exact joins, from strong to weak combinations of attributes: first on the cell of the position and the farm,
then on the cell alone, then on the cells within a wider radius; the tests of distance, power and hub height stand behind
the keys. What a join resolves is taken out by an anti-join before the next one. Rules that join on the same keys share
one join, in which a unit takes the first rule that gives it an entity, and the nearest entity of that rule: the same as
a pass each. No rule accepts a pair that contradicts itself in an attribute that both sides know. A last rule,
`same_spot`, pairs a unit with the other entities at its entity's spot (records of one turbine under no key or another).

Confidence: each rule's precision on labelled pairs, (right + 2 * 0.9) / (labelled + 2). Labels are given as a table, or
taken from the maker: of pairs that were accepted without asking for it, whether it agrees.

Scale: records of one entity are aggregated map-side before they meet the units, however many there are; cells keep every
join an equi-join. Entities, the units left and the matches of each join are written to the shared folder, so that a join
reads the one before it and recomputes nothing. Nothing is collected.

Defined cases: a record or unit without a usable position (null, not finite, outside the globe, 0 and 0) is in no pair;
unknown numbers (null, not finite, out of range) agree with nothing and contradict nothing; capacities of 20 and more are
kilowatts, records' powers under 20 megawatts; ties in distance go to the smaller entity key; repeated records and units
all come out; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonolith.functions.geo import cell_of, cells_within, distance_m, has_place
from sonolith.session import discard, materialize

CELL = 0.00225
SAME_SPOT_M = 100.0
LONE_M = 60.0
NEAR_M, FAR_M = 150.0, 255.0


@dataclass(frozen=True)
class Rule:
    name: str
    radius_m: float
    attributes: tuple[str, ...]


RULES = (
    Rule("near_power_hub_farm", NEAR_M, ("power", "hub", "farm")),
    Rule("near_power_hub", NEAR_M, ("power", "hub")),
    Rule("near_power", NEAR_M, ("power",)),
    Rule("near_hub", NEAR_M, ("hub",)),
    Rule("near", NEAR_M, ()),
    Rule("far_power_hub", FAR_M, ("power", "hub")),
    Rule("far_power", FAR_M, ("power",)),
    Rule("far_hub", FAR_M, ("hub",)),
    Rule("far", FAR_M, ()),
)


def usable(lat: Column, lon: Column) -> Column:
    return has_place(lat, lon) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def farm_key(name: Column) -> Column:
    """First letters of a farm's name, without what registers put before it and without marks on letters."""
    plain = F.translate(F.lower(F.trim(name)), "áàâäãåéèêëíìîïóòôöõúùûüñçčřšžěýøß", "aaaaaaeeeeiiiiooooouuuuncrrszeyos")
    plain = F.regexp_replace(F.regexp_replace(plain, "ae", "a"), "oe", "o")
    plain = F.regexp_replace(F.regexp_replace(plain, "ue", "u"), "ss", "s")
    bare = F.regexp_replace(F.regexp_replace(plain, r"^(wind farm|windpark|wp|parque eolico|parc eolien)\s+", ""), r"\s+", "")
    return F.when(F.length(bare) >= 4, F.substring(bare, 1, 5))


def maker_key(model: Column) -> Column:
    """The first word of a model's name."""
    word = F.regexp_extract(F.lower(F.trim(model)), r"^(\p{L}+)", 1)
    return F.when(word != "", word)


def _number(value: Column, low: float, high: float) -> Column:
    return F.when(~F.isnan(value) & value.between(low, high), value)


def _entities(records: DataFrame) -> DataFrame:
    """One row an entity: middle position, medians, farm and maker. records: record_id, key, lat, lon, hub, power, ..."""
    la, lo = F.radians("lat"), F.radians("lon")
    half = F.lit(0.5)
    grouped = records.groupBy("key").agg(
        F.avg(F.cos(la) * F.cos(lo)).alias("x"),
        F.avg(F.cos(la) * F.sin(lo)).alias("y"),
        F.avg(F.sin(la)).alias("z"),
        (F.percentile(F.floor(F.col("hub") * 10 + 0.5).cast("int"), half) / 10).alias("hub"),
        F.percentile(F.floor(F.col("power") + 0.5).cast("int"), half).alias("power"),
        F.max("farm").alias("farm"),
        F.max("maker").alias("maker"),
    )
    lat = F.degrees(F.atan2("z", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))))
    return grouped.select(
        F.col("key").alias("e_key"),
        lat.alias("e_lat"),
        F.degrees(F.atan2("y", "x")).alias("e_lon"),
        *[F.col(c).alias(f"e_{c}") for c in ("hub", "power", "farm", "maker")],
    )


def _informed(entities: DataFrame) -> DataFrame:
    """Unkeyed entities take what they don't know from the nearest keyed one at the same spot."""
    lone = F.col("e_key").startswith("#")
    spot = F.explode(cells_within(F.col("e_lat"), F.col("e_lon"), CELL, LONE_M))
    named = entities.where(~lone).select(
        cell_of(F.col("e_lat"), F.col("e_lon"), CELL).alias("cell"), *[F.col(f"e_{c}").alias(f"n_{c}") for c in ("key", "lat", "lon", "hub", "power")]
    )
    away = distance_m(F.col("e_lat"), F.col("e_lon"), F.col("n_lat"), F.col("n_lon"))
    near = entities.where(lone).withColumn("cell", spot).hint("merge").join(named, "cell").withColumn("m", away).where(F.col("m") <= LONE_M)
    best = near.groupBy("e_key").agg(F.min(F.struct("m", "n_key", "n_hub", "n_power")).alias("n"))
    known = [F.coalesce(f"e_{c}", F.col(f"n.n_{c}")).alias(f"e_{c}") for c in ("hub", "power")]
    kept = [c for c in entities.columns if c not in ("e_hub", "e_power")]
    return entities.where(~lone).select(*kept, "e_hub", "e_power").unionByName(
        entities.where(lone).join(best, "e_key", "left").select(*kept, *known)
    )


def _same_power() -> Column:
    """Within a fifth: registers round, and give the power of the machine or of its contract."""
    return (F.col("e_power") / F.col("u_power")).between(1 / 1.2, 1.2)


def _same_hub() -> Column:
    return F.abs(F.col("e_hub") - F.col("u_hub")) <= 5.0


def _odd_hub() -> Column:
    """Both know the hub and it differs, and the power isn't exactly equal."""
    exact = F.coalesce(F.abs(F.col("e_power") / F.col("u_power") - 1) <= 0.07, F.lit(False))
    return F.coalesce(~_same_hub(), F.lit(False)) & ~exact


def _contradicts() -> Column:
    """Both know the power and it differs, or the hub is odd and the maker not the same."""
    maker = F.coalesce(F.col("e_maker") == F.col("u_maker"), F.lit(False))
    return F.coalesce(~_same_power(), F.lit(False)) | (_odd_hub() & ~maker) | F.col("u_gone")


def _same_maker() -> Column:
    """Whether the makers agree, of pairs that no test has asked for the maker; null where one is unknown."""
    return F.when(~_odd_hub(), F.col("e_maker") == F.col("u_maker"))


def _pass(units: DataFrame, entities: DataFrame, rules: Sequence[tuple[int, Rule]]) -> DataFrame:
    """One join of the cascade: the first of its rules that gives a unit an entity, and the nearest entity it gives. The
    rules join on the same keys and differ in their tests, so that a unit's first rule is a minimum."""
    radius = F.lit(rules[0][1].radius_m) + F.col("u_slack")
    left = units.withColumn("cell", F.explode(cells_within(F.col("u_lat"), F.col("u_lon"), CELL, radius)))
    right = entities.withColumn("cell", cell_of(F.col("e_lat"), F.col("e_lon"), CELL))
    on = ["cell"]
    if "farm" in rules[0][1].attributes:
        left, right = left.withColumn("farm_key", F.col("u_farm")), right.withColumn("farm_key", F.col("e_farm"))
        on.append("farm_key")
    away = distance_m(F.col("u_lat"), F.col("u_lon"), F.col("e_lat"), F.col("e_lon"))
    # The copied side looks small to the planner, which knows only its file: no broadcast of it.
    pairs = left.hint("merge").join(right, on).withColumn("m", away).where((F.col("m") <= radius) & ~_contradicts())
    agrees = {"power": F.coalesce(_same_power(), F.lit(False)), "hub": F.coalesce(_same_hub(), F.lit(False)), "farm": F.lit(True)}
    place = F.coalesce(*[F.when(reduce(lambda a, b: a & agrees[b], rule.attributes, F.lit(True)), i) for i, rule in rules])
    best = F.min(F.struct(place.alias("place"), "m", "e_key", *[c for c in _MATCHED if c != "e_key"])).alias("b")
    found = pairs.where(place.isNotNull()).groupBy("unit_id").agg(best)
    return found.select("unit_id", "b.place", *[f"b.{c}" for c in _MATCHED])


_MATCHED = ("e_key", "e_lat", "e_lon", "u_maker", "u_hub", "u_power", "u_gone")


def match(
    records: DataFrame, units: DataFrame, labelled: DataFrame | None = None, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """(record_id, unit_id, rule, confidence). records: record_id, key, lat, lon, hub, power (kW), farm, maker; units:
    unit_id, lat, lon, hub, power (MW or kW), farm, maker, gone (true for a machine that no longer stands). labelled:
    record_id, unit_id, same (boolean), for the rules' precision."""
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    power = F.col("power").cast("double")
    own = records.where(usable(lat, lon) & F.col("record_id").isNotNull()).select(
        "record_id",
        F.coalesce("key", F.concat(F.lit("#"), F.col("record_id").cast("string"))).alias("key"),
        lat.alias("lat"),
        lon.alias("lon"),
        _number(F.col("hub"), 10, 250).alias("hub"),
        _number(F.when(power < 20, power * 1000).otherwise(power), 50, 20_000).alias("power"),
        farm_key(F.col("farm")).alias("farm"),
        maker_key(F.col("maker")).alias("maker"),
    )
    coarse = (F.abs(lat * 1000 - F.round(lat * 1000)) < 1e-6) & (F.abs(lon * 1000 - F.round(lon * 1000)) < 1e-6)
    other = units.where(usable(lat, lon) & F.col("unit_id").isNotNull()).select(
        "unit_id",
        lat.alias("u_lat"),
        lon.alias("u_lon"),
        F.when(coarse, 65.0).otherwise(0.0).alias("u_slack"),
        _number(F.col("hub"), 10, 250).alias("u_hub"),
        _number(F.when(power < 20, power * 1000).otherwise(power), 50, 20_000).alias("u_power"),
        farm_key(F.col("farm")).alias("u_farm"),
        maker_key(F.col("maker")).alias("u_maker"),
        F.coalesce("gone", F.lit(False)).alias("u_gone"),
    )
    bare = materialize(_entities(own), "entities")
    entities = materialize(_informed(bare), "entities")
    discard(bare)
    left, resolved, matches = materialize(other, "units"), None, []
    joins = [list(g) for _, g in groupby(enumerate(rules), lambda x: (x[1].radius_m, "farm" in x[1].attributes))]
    for i, joined in enumerate(joins):
        now = materialize(_pass(left, entities, joined), "matches")
        matches.append(now)
        resolved = now if resolved is None else resolved.unionByName(now)
        before = left
        if i + 1 < len(joins):
            left = materialize(left.join(now.select("unit_id"), "unit_id", "left_anti"), "units")
        discard(before)
    # Each unit with the entity it found, and by a rule of its own with the unkeyed (or differently keyed) ones at the spot.
    near = F.explode(cells_within(F.col("e_lat"), F.col("e_lon"), CELL, SAME_SPOT_M))
    at = resolved.select("unit_id", "place", F.col("e_key").alias("b_key"), F.col("e_lat").alias("b_lat"), F.col("e_lon").alias("b_lon"),
        "u_maker", "u_hub", "u_power", "u_gone", near.alias("cell"))
    spots = entities.withColumn("cell", cell_of(F.col("e_lat"), F.col("e_lon"), CELL))
    away = distance_m(F.col("b_lat"), F.col("b_lon"), F.col("e_lat"), F.col("e_lon"))
    met = at.hint("merge").join(spots, "cell").where((away <= SAME_SPOT_M) & ~_contradicts())
    same = F.col("e_key") == F.col("b_key")
    matched = materialize(
        met.select("unit_id", F.when(same, F.col("place")).otherwise(len(rules)).alias("place"), F.col("e_key").alias("key"), _same_maker().alias("same")),
        "matched",
    )
    discard(entities, *matches)
    precision = _precision(matched, own, labelled, rules)
    pairs = own.select("record_id", "key").join(matched.select("unit_id", "place", "key"), "key")
    return pairs.join(F.broadcast(precision), "place", "left").select("record_id", "unit_id", "rule", "confidence")


def _precision(matched: DataFrame, own: DataFrame, labelled: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """(place, rule, confidence) of every rule."""
    if labelled is None:
        said = matched.where(F.col("same").isNotNull())
    else:
        said = matched.select("place", "unit_id", "key").join(own, "key").join(labelled, ["record_id", "unit_id"])
    counted = said.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("same"), 1)).alias("right"))
    names = [*[r.name for r in rules], "same_spot"]
    places = matched.sparkSession.createDataFrame(list(enumerate(names)), "place int, rule string")
    n, right = F.coalesce("n", F.lit(0)), F.coalesce("right", F.lit(0))
    return places.join(counted, "place", "left").select("place", "rule", ((right + 2 * 0.9) / (n + 2)).alias("confidence"))
