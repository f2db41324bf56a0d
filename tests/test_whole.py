"""Queries over all rows and values, beside those whose SQL fixes a part: hand-made tables and brute force."""

import datetime
import math

import pytest

from sonolith.functions.levels import A_WEIGHT_DB
from sonolith.plans import further, joins, noise, tables
from tests.conftest import SMALL, rows_of

POINTS = [
    (1, "WEST", 179.98, -17.6), (2, "WEST", -179.99, -17.6), (3, "TURN", -174.6, 66.9), (4, "TURN", 185.43, 66.9), (5, "HOME", 10.0, 50.0), (6, "HOME", 10.1, 50.1),
]
RECORDS = [(1, -179.97, -17.61), (2, 179.95, -17.58), (3, 185.4, 66.9), (4, 10.05, 50.05), (5, -349.95, 50.05), (6, 0.0, -17.6), (7, 179.9, -17.6)]


@pytest.fixture(scope="module")
def meridian(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("meridian"))
    points = [(i, a, "threshold", i, lat, lon) for i, a, lon, lat in POINTS]
    kinds = "point_id long, airport string, kind string, seq int, lat double, lon double"
    spark.createDataFrame(points, kinds).write.parquet(f"{folder}/runway_points.parquet")
    records = [(i, lat, lon, "XX", "farm", 1000.0) for i, lon, lat in RECORDS]
    kinds = "record_id long, lat double, lon double, country_iso string, farm string, power_kw double"
    spark.createDataFrame(records, kinds).write.parquet(f"{folder}/turbines.parquet")
    return folder


def test_inside_across_the_meridian(spark, meridian):
    got = {tuple(r) for r in noise.J20_inside_all(spark, meridian).collect()}
    assert got == {(1, "WEST"), (2, "WEST"), (3, "TURN"), (4, "HOME"), (5, "HOME")}
    hosts = {r.record_id: r.host for r in further.J22_hosts_all(spark, meridian).collect()}
    assert hosts == {1: "WEST", 2: "WEST", 3: "TURN", 4: "HOME", 5: "HOME", 6: "none", 7: "WEST"}


def test_area_and_squares_across_the_meridian(spark, meridian):
    area = {r.airport: r.area for r in noise.S30_area_all(spark, meridian).collect()}
    assert area == pytest.approx({"WEST": 0.13 * 0.1, "TURN": 0.13 * 0.1, "HOME": 0.04}, abs=1e-4)
    squares = [tuple(r) for r in noise.J7_squares_all(spark, meridian).collect()]
    assert len(squares) == len(set(squares))
    assert {x for a, x, _ in squares if a == "WEST"} == {511, 0}
    assert {x for a, x, _ in squares if a == "TURN"} == {7}


def test_all_of_the_narrow_ones_as_before(spark, meridian):
    for name in ("S30_area", "J7_squares"):
        kept = {tuple(r) for r in getattr(noise, name)(spark, meridian).collect()}
        assert kept and kept <= {tuple(r) for r in getattr(noise, f"{name}_all")(spark, meridian).collect()}


def test_all_values_of_a_vector(spark):
    vectors = {r.vec_id: (r.label, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    assert {len(v) for _, v in vectors.values()} == {64}
    runs, energies, levels = {}, {}, {}
    for key, (label, values) in vectors.items():
        n, run = 0, []
        for x in values:
            run = [*run, x]
            if len(run) == 1 or max(run) - min(run) > 0.2:
                n, run = n + 1, [x]
        runs[key] = n
        for i, x in enumerate(values):
            at = (label, i // 8, i % 8)
            energies[at] = energies.get(at, 0.0) + 10**x
        for part in range(8):
            band = values[8 * part : 8 * part + 8]
            levels[key, part] = 10 * math.log10(sum(10 ** ((10 * x + 50 + w) / 10) for x, w in zip(band, A_WEIGHT_DB, strict=True)))
    assert {r.vec_id: r.runs for r in further.W25_merged_states(spark, SMALL).collect()} == pytest.approx(runs)
    assert {(r.label, r.period, r.band): r.energy for r in further.A1_bands_all(spark, SMALL).collect()} == pytest.approx(energies, abs=1e-3)
    assert {(r.vec_id, r.part): r.level_dba for r in noise.A4_a_weighting_all(spark, SMALL).collect()} == pytest.approx(levels, abs=1e-3)


WHOLE = {
    "J35_lookup_all": "select s_suppkey, coalesce(r_name, 'elsewhere') as region from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey",
    "J40_drift_all": """select case when o_orderkey is null then 'lines only' when l_orderkey is null then 'order only' else 'both' end as kind, count(*) as orders
        from orders full join (select distinct l_orderkey from lineitem) on o_orderkey = l_orderkey group by 1""",
    "S28_overlay_all": """with l as (select l_orderkey as o, l_quantity as q, year(l_shipdate) >= 1995 as fresh from lineitem)
        select o % 6 as k, count(*) as n, sum(q) as q from l where fresh or o not in (select o from l where fresh) group by 1""",
    "W17_first_sign_all": """select user_id as address, cast(cast(ts as date) as varchar) as day,
        arg_min(event_id, {'a': cast(floor(epoch(ts)) as bigint), 'b': event_id}) % 7 as sign from events group by 1, 2""",
    "D17_passes_all": "select piece_id, floor((1 - exp(-aadt_light / 2880)) * 100000 + 0.5) / 100000 as share from display",
}


@pytest.mark.parametrize("name", list(WHOLE))
def test_all_rows(spark, duck, name):
    query = {**tables.QUERIES, **further.QUERIES}[name]
    assert rows_of(query(spark, SMALL).toPandas()) == rows_of(duck.sql(WHOLE[name]).df())


def test_components_of_all_lines(spark, duck):
    nodes = duck.sql("select l_partkey from lineitem union select l_suppkey + 10000000 from lineitem").fetchall()
    assert {(r.node,) for r in tables.G3_components(spark, SMALL).collect()} == set(nodes)


def test_long_steps_are_cut_too(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(hours=h), 7, "view", 1.0, "{}") for i, h in ((1, 0), (2, 300))]
    df = spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = joins.J8_cut(spark, str(tmp_path)).collect()
    assert {r.id for r in got} == {2} and len(got) == 13
    assert sum(r.share for r in got) == pytest.approx(1, abs=1e-4)
