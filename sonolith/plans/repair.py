"""Queries of problem 1 (filling missing values) and problem 4 (rows that fail to parse)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonolith.functions.text import bare_name, reference_key
from sonolith.operators.badrows import Field, parse_records
from sonolith.operators.fill import Level, fill_from_groups, filled_rows
from sonolith.sources import table

ROAD_CLASSES = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "residential", "living_street", "service", "track",
    "unclassified", "motorway_link", "trunk_link", "primary_link",
)


def known_hub(hub: Column) -> Column:
    return hub.between(10, 250) & ~F.isnan(hub)


def known_class(name: Column) -> Column:
    return road_class(name).isin(*ROAD_CLASSES)


def road_class(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), " -", "__")


def known_shares(shares: Column) -> Column:
    good = F.forall(shares, lambda x: F.coalesce((x >= 0) & ~F.isnan(x) & (x < float("inf")), F.lit(False)))
    return (F.size(shares) == 3) & good & (_total(shares) > 0)


def _total(shares: Column) -> Column:
    return F.get(shares, 0) + F.get(shares, 1) + F.get(shares, 2)


def fill_traffic(df: DataFrame) -> DataFrame:
    """Period shares as shares of one (some are delivered in percent). A station's own counts of the same kind of
    vehicle know best, then its way's, then the country's roads of that group."""
    shares = F.col("period_shares")
    parts = {n: F.get(shares, i) / _total(shares) for i, n in enumerate(("day", "evening", "night"))}
    levels = [
        Level("station", ("station_id", "heavy"), 5),
        Level("way", ("osm_id", "heavy"), 5),
        Level("country_group", ("country_iso", "road_group", "heavy"), 5),
        Level("group", ("road_group", "heavy"), 5),
        Level("vehicle", ("heavy",), 1),
        Level("all", (), 1),
    ]

    def finish(c: dict[str, Column]) -> Column:
        total = c["day"] + c["evening"] + c["night"]
        return F.when(total > 0, F.array(*[c[n] / total for n in parts]))

    return fill_from_groups(df, parts, known_shares(shares), levels, "median", 1000, "shares", finish)


def fill_display(df: DataFrame) -> DataFrame:
    """Road classes. The other pieces of the way know best, then roads of that reference, then roads of the country
    that carry as much traffic at the same speed."""
    load = F.floor(F.log2(F.col("aadt_light") + 1.0) * 2).cast("int")
    speed = F.coalesce(F.col("speed_posted_kmh").cast("int"), F.lit(-1))
    df = df.withColumn("__load", load).withColumn("__speed", speed)
    levels = [
        Level("way", ("osm_id",), 1),
        Level("name", ("country_iso", "road_ref", "road_name"), 2),
        Level("traffic_speed", ("country_iso", "__load", "__speed"), 3),
        Level("traffic", ("__load",), 3),
        Level("country", ("country_iso",), 1),
        Level("all", (), 1),
    ]
    parts = {"class": road_class(F.col("road_class"))}
    out = fill_from_groups(df, parts, known_class(F.col("road_class")), levels, "mode", out="class")
    return out.drop("__load", "__speed")


def fill_turbines(df: DataFrame) -> DataFrame:
    """Hub heights. The other records of the mast know best, then machines of that model in the farm, the farm, the
    model, the country."""
    keyed = (
        df.withColumn("__mast", reference_key(F.col("mast_ref")))
        .withColumn("__farm", bare_name(F.col("farm")))
        .withColumn("__model", F.translate(bare_name(F.col("turbine_model")), " ", "-"))
    )
    levels = [
        Level("mast", ("__mast",), 1),
        Level("farm_model", ("__farm", "__model"), 2),
        Level("farm", ("__farm",), 3),
        Level("model", ("__model",), 3),
        Level("country", ("country_iso",), 3),
        Level("all", (), 1),
    ]
    hub = F.col("hub_m")
    out = fill_from_groups(keyed, {"hub": hub}, known_hub(hub), levels, "median", 10, "hub")
    return out.drop("__mast", "__farm", "__model")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    def rows(df: DataFrame, name: str, row_id: str, field: str, out: str) -> DataFrame:
        return filled_rows(df, out).select(
            F.lit(name).alias("table_name"), F.col(row_id).alias("row_id"), F.lit(field).alias("field")
        )

    return (
        rows(fill_turbines(table(spark, folder, "turbines")), "turbines", "record_id", "hub_m", "hub")
        .unionByName(rows(fill_display(table(spark, folder, "display")), "display", "piece_id", "road_class", "class"))
        .unionByName(rows(fill_traffic(table(spark, folder, "traffic")), "traffic", "count_id", "period_shares", "shares"))
    )


def p1_hub_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its hub height, the mark and the group that gave it."""
    out = fill_turbines(table(spark, folder, "turbines"))
    return out.select("record_id", "hub", "hub_filled", "hub_level", "hub_support")


def p1_class_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece with its road class, the mark and the group that gave it."""
    return fill_display(table(spark, folder, "display")).select("piece_id", "class", "class_filled", "class_level", "class_support")


def p1_shares_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Every count with its shares to four places, the mark and the group that gave them."""
    out = fill_traffic(table(spark, folder, "traffic"))
    parts = [
        (F.floor(F.get("shares", F.lit(i)) * 10000 + 0.5) / 10000).alias(n)
        for i, n in enumerate(("day", "evening", "night"))
    ]
    return out.select("count_id", *parts, "shares_filled", "shares_level", "shares_support")


REGISTER = (
    Field("id_aero"),
    Field("parque"),
    Field("municipio"),
    Field("utm_x", 100_000, 900_000),
    Field("utm_y"),
    Field("altura_buje", 10, 250, unknown=True),
    Field("potencia_uni", 1, 20_000, unknown=True),
    Field("fecha_alta"),
)


def load_register(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of the register's files, typed or with the reason why it doesn't load."""
    return parse_records(table(spark, folder, "register_lines").select("line_id", "raw"), "raw", REGISTER)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return load_register(spark, folder).where(F.col("reason").isNotNull()).select("line_id", "reason")


def p4_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that load, as typed rows."""
    good = load_register(spark, folder).where(F.col("reason").isNull())
    return good.select("line_id", *[f.name for f in REGISTER])


QUERIES = {
    "p4_found": p4_found,
    "p4_loaded": p4_loaded,
    "p1_found": p1_found,
    "p1_hub_filled": p1_hub_filled,
    "p1_class_filled": p1_class_filled,
    "p1_shares_filled": p1_shares_filled,
}

_CLASSES = ", ".join(f"'{c}'" for c in ROAD_CLASSES)
_CLASS = "replace(replace(lower(trim(road_class)), ' ', '_'), '-', '_')"
_HUB = "(hub_m is not null and not isnan(hub_m) and hub_m between 10 and 250)"
_SHARES = (
    "coalesce(len(period_shares) = 3 and len(list_filter(period_shares, lambda x: x is not null and not isnan(x) "
    "and not isinf(x) and x >= 0)) = 3 and period_shares[1] + period_shares[2] + period_shares[3] > 0, false)"
)


def _cascade(prepared: str, values: str, levels: list[tuple[str, str, int]], stats: str, key: str, out: str) -> str:
    """The back-off in SQL: one statistics query a level, joined in order. values: names of the components."""
    names = values.split()
    parts, joins, packed = [f"prepared as ({prepared})", "known as (select * from prepared where ok)"], [], []
    for i, (name, keys, support) in enumerate(levels):
        cols = keys.split()
        group = f" group by {', '.join(cols)}" if cols else ""
        valid = " and ".join(f"{c} is not null" for c in cols) or "true"
        source = stats.format(keys="".join(f"{c}, " for c in cols), valid=valid, group=group)
        parts.append(f"l{i} as (select * from ({source}) where support >= {support})")
        on = " and ".join(f"p.{c} = l{i}.{c}" for c in cols) or "true"
        joins.append(f" left join l{i} on {on}")
        packed.append(f"case when l{i}.support is not null then {{'level': '{name}', 'support': l{i}.support, "
                      + ", ".join(f"'{n}': l{i}.{n}" for n in names) + "} end")
    return (
        f"with {', '.join(parts)}, filled as (select p.*, case when not p.ok then coalesce({', '.join(packed)}) end as f "
        f"from prepared p{''.join(joins)}) select {key}, {out} from filled"
    )


_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_LINES = f"""with lines as (select line_id, regexp_replace(coalesce(raw, ''), '\\r$', '') as r from register_lines),
    split as (select *, regexp_full_match(r, '{_FIELD}(?:,{_FIELD})*', 's') as quoted, regexp_full_match(r, '{_FIELD}(?:,{_FIELD}){{7}}', 's') as eight from lines),
    fields as (select *, {", ".join(
        f"regexp_extract(r, '^{''.join(f'{_FIELD},' for _ in range(i))}({_FIELD})', 1, 's') as c{i}" for i in range(8))} from split),
    plain as (select line_id, quoted, eight, {", ".join(
        f"case when c{i} like '\"%' then replace(substr(c{i}, 2, len(c{i}) - 2), '\"\"', '\"') else c{i} end as f{i}" for i in range(8))} from fields),
    typed as (select *, {", ".join(
        f"case when regexp_full_match(f{i}, ' *[+-]?[0-9]+([.,][0-9]+)? *') then cast(replace(trim(f{i}, ' '), ',', '.') as double) end as v{i}" for i in (3, 5, 6))} from plain),
    judged as (select *, case when not quoted then 'quoting' when not eight then 'column_count'
        when not coalesce(v3 between 100000 and 900000, false) or not (trim(f5) = '' or coalesce(v5 = 0 or v5 between 10 and 250, false))
        or not (trim(f6) = '' or coalesce(v6 = 0 or v6 between 1 and 20000, false)) then 'bad_value' end as reason from typed)"""

SQL = {
    "p4_found": f"{_LINES} select line_id, reason from judged where reason is not null",
    "p4_loaded": f"""{_LINES} select line_id, f0 as id_aero, f1 as parque, f2 as municipio, v3 as utm_x, f4 as utm_y,
        nullif(v5, 0) as altura_buje, nullif(v6, 0) as potencia_uni, f7 as fecha_alta from judged where reason is null""",
    "p1_found": f"""
        select 'turbines' as table_name, record_id as row_id, 'hub_m' as field from turbines where not {_HUB}
        union all select 'display', piece_id, 'road_class' from display
        where not coalesce({_CLASS} in ({_CLASSES}), false)
        union all select 'traffic', count_id, 'period_shares' from traffic where not {_SHARES}""",
    "p1_hub_filled": _cascade(
        f"""select record_id, {_HUB} as ok, hub_m, case when {_HUB} then floor(hub_m * 10 + 0.5) end as v, country_iso,
        nullif(regexp_replace(regexp_replace(upper(mast_ref), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g'), '[\\s\\-_/.]+', '', 'g'), '') as mast,
        nullif(lower(trim(farm)), '') as farm, replace(nullif(lower(trim(turbine_model)), ''), ' ', '-') as model from turbines""",
        "v",
        [("mast", "mast", 1), ("farm_model", "farm model", 2), ("farm", "farm", 3), ("model", "model", 3), ("country", "country_iso", 3), ("all", "", 1)],
        "select {keys}count(*) as support, quantile_cont(v, 0.5) as v from known where {valid}{group}",
        "record_id",
        "case when ok then hub_m else f.v / 10.0 end as hub, not ok as hub_filled, case when not ok then coalesce(f.level, 'none') end as hub_level, coalesce(f.support, 0) as hub_support",
    ),
    "p1_class_filled": _cascade(
        f"""select piece_id, coalesce({_CLASS} in ({_CLASSES}), false) as ok, {_CLASS} as v, osm_id, country_iso, road_ref, road_name,
        cast(floor(log2(aadt_light + 1.0) * 2) as int) as load, coalesce(cast(speed_posted_kmh as int), -1) as speed from display""",
        "v",
        [("way", "osm_id", 1), ("name", "country_iso road_ref road_name", 2), ("traffic_speed", "country_iso load speed", 3), ("traffic", "load", 3), ("country", "country_iso", 1), ("all", "", 1)],
        "select {keys}sum(c)::bigint as support, arg_min(v, {{'a': -c, 'b': v}}) as v from (select {keys}v, count(*) as c from known where {valid} group by {keys}v){group}",
        "piece_id",
        "case when ok then v else f.v end as class, not ok as class_filled, case when not ok then coalesce(f.level, 'none') end as class_level, coalesce(f.support, 0) as class_support",
    ),
    "p1_shares_filled": _cascade(
        f"""select count_id, {_SHARES} as ok, station_id, osm_id, country_iso, road_group, heavy,
        period_shares[1] / (period_shares[1] + period_shares[2] + period_shares[3]) as a,
        period_shares[2] / (period_shares[1] + period_shares[2] + period_shares[3]) as b,
        period_shares[3] / (period_shares[1] + period_shares[2] + period_shares[3]) as c from traffic""",
        "day evening night",
        [("station", "station_id heavy", 5), ("way", "osm_id heavy", 5), ("country_group", "country_iso road_group heavy", 5), ("group", "road_group heavy", 5), ("vehicle", "heavy", 1), ("all", "", 1)],
        """select {keys}count(*) as support, quantile_cont(floor(a * 1000 + 0.5), 0.5) / 1000 as day,
        quantile_cont(floor(b * 1000 + 0.5), 0.5) / 1000 as evening, quantile_cont(floor(c * 1000 + 0.5), 0.5) / 1000 as night
        from known where {valid}{group}""",
        "count_id",
        """floor(case when ok then a / (a + b + c) else f.day / (f.day + f.evening + f.night) end * 10000 + 0.5) / 10000 as day,
        floor(case when ok then b / (a + b + c) else f.evening / (f.day + f.evening + f.night) end * 10000 + 0.5) / 10000 as evening,
        floor(case when ok then c / (a + b + c) else f.night / (f.day + f.evening + f.night) end * 10000 + 0.5) / 10000 as night,
        not ok as shares_filled, case when not ok then coalesce(f.level, 'none') end as shares_level, coalesce(f.support, 0) as shares_support""",
    ),
}
